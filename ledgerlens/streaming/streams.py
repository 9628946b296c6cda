"""Structured Streaming versions of the log operators.

The log arrives in deliveries: the table is cut into time ranges, each delivery is
appended to the stream's input folder by as many tasks as it has partitions, and the
query then runs over the new files with ``trigger(availableNow=True)``.  Its
checkpoint stays in the session's shared checkpoint folder between deliveries, so
state and watermark carry on, and a restarted job resumes exactly once.  Each
function returns the final result table as a batch DataFrame, which is what the
correctness checks compare.

Rows without a timestamp come with the first delivery.  Window counts report them
under a null window (a watermark cannot place them); the ledger reports them with
``status = 'undated'`` and does not apply them.

* T1  window counts in append mode: a window is written once the watermark passes
      its end.  Rows whose window was closed by earlier deliveries are late: they
      go to a table of their own (``late_rows``) instead of being dropped.
* T3  ledger as per-account state (``transformWithStateInPandas`` over RocksDB): state =
      running balance in cents, closed flag (T9) and the last (ts, seq) applied.
      Rows older than the state's last row are late: they are emitted with
      ``status = 'late'`` and not applied (a ledger cannot be re-ordered once
      emitted).  The opening balance comes from a stream-static join (T8).  An
      account with more than ``HANDOVER`` rows in one delivery is handed over: from
      then on its rows pass the operator batch by batch and are replayed
      by the batch ledger, which splits a hot account over tasks.
* T2  contract validation with the user's last accepted timestamp as state; the
      other checks are stateless column expressions.  Hot users are handed over to
      running maxima over measured buckets in the same way.
* T4  running reward per run (complete mode totals).
* T5  session windows: as T1.  T6  sliding windows: as T1 over the panes that make them up.
* T7  ``foreachBatch`` append sink, idempotent per batch id.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import contract as K
from ..operators import ledger, seqwin
from ..session import checkpoint_dir, stored


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-streams/{name}-{uuid.uuid4().hex[:10]}"


class Deliveries:
    """``df`` cut into ``n`` time ranges of equal length (rows without a time in the first), or by its column
    ``_delivery`` (0 to n - 1, null: 0) where it has one: deliveries then need not be in time order."""

    def __init__(self, spark: SparkSession, df: DataFrame, ts: str, n: int, name: str):
        self.spark, self.ts, self.name, self.n = spark, ts, name, n
        path = _scratch(spark, f"{name}-all")
        df.write.parquet(path)  # the given frame is computed once; each range is a filtered scan of it
        self.rows = spark.read.schema(df.schema).parquet(path)
        lo, hi = self.rows.agg(F.min(ts), F.max(ts)).first()
        self.bounds = [] if lo is None else [lo + (hi - lo) / n * k for k in range(1, n)]
        self.folder = _scratch(spark, name)
        self.rows.limit(0).write.parquet(self.folder)

    def parts(self) -> list[DataFrame]:
        if "_delivery" in self.rows.columns:
            return [self.rows.filter(F.coalesce("_delivery", F.lit(0)) == k) for k in range(self.n)]
        t, edges = F.col(self.ts), [None, *self.bounds, None]
        out = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            cond = F.lit(True) if a is None else t >= F.lit(a)
            cond = cond if b is None else cond & (t < F.lit(b))
            out.append(self.rows.filter(cond | t.isNull() if k == 0 else cond))
        return out

    def run(self, start) -> None:
        """``start(stream) -> DataStreamWriter`` is started once for each delivery, always with the same checkpoint."""
        ckpt = _scratch(self.spark, f"{self.name}-ckpt")
        for part in self.parts():
            part.write.mode("append").parquet(self.folder)
            stream = self.spark.readStream.schema(self.rows.schema).parquet(self.folder)
            start(stream).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    def appended(self, transform) -> DataFrame:
        """The sink's table of an append-mode query ``transform(stream)``."""
        out, schema = _scratch(self.spark, f"{self.name}-out"), []

        def start(stream):
            result = transform(stream)
            schema[:] = [result.schema]
            return result.writeStream.format("parquet").option("path", out).outputMode("append")

        self.run(start)
        return self.spark.read.schema(schema[0]).parquet(out)

    def complete(self, transform) -> DataFrame:
        """The last full result of a complete-mode query ``transform(stream)``."""
        out = _scratch(self.spark, f"{self.name}-out")

        def start(stream):
            return (transform(stream).writeStream.outputMode("complete")
                    .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/latest")))

        self.run(start)
        return self.spark.read.parquet(f"{out}/latest")


def closed_windows(feed: Deliveries, counted, watermark: str) -> DataFrame:
    """The sink's table of the append-mode window query ``counted(df)``, every window closed.

    After the last delivery one row far in the future (all other columns null)
    moves the watermark past every window, so all of them are written; the window
    of that row itself stays open and is never written."""
    last = feed.rows.agg(F.max("_ets").alias("t")).first()["t"]
    parts = feed.parts
    if last is not None:
        end = feed.spark.range(1).select(*[
            F.lit(last + timedelta(days=3650)).cast(f.dataType).alias(f.name) if f.name == "_ets"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in feed.rows.schema])
        feed.parts = lambda: [*parts(), end, feed.rows.limit(0)]
    dated = lambda df: df.filter(F.col("_ets").isNotNull()).withWatermark("_ets", watermark)
    with _rocksdb(feed.spark):
        return feed.appended(lambda stream: counted(dated(stream)))


def undated_counts(feed: Deliveries, key: str) -> DataFrame:
    """(key, n) of the rows without a time, which no window holds."""
    return feed.rows.filter(F.col("_ets").isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


# ---- late rows --------------------------------------------------------------

def late_rows(rows: DataFrame, ts: str, delivery: str, end, watermark: str) -> DataFrame:
    """``rows`` with ``late``: whether the window with end ``end`` was closed when the row's delivery came.

    The watermark of a delivery is the largest time of all earlier ones (to the millisecond) less ``watermark``, as the
    engine has it; a window is closed once the watermark reaches its end.  One row a delivery is broadcast."""
    tops = rows.groupBy(delivery).agg(F.max(ts).alias("_top"))
    earlier = Window.orderBy(delivery).rowsBetween(Window.unboundedPreceding, -1)  # one row a delivery
    marks = tops.select(delivery, (F.date_trunc("millisecond", F.max("_top").over(earlier)) - F.expr(f"INTERVAL {watermark}")).alias("_mark"))
    return rows.join(F.broadcast(marks), delivery).withColumn("late", F.coalesce(end <= F.col("_mark"), F.lit(False))).drop("_mark")


def window_counts_late(spark: SparkSession, log: DataFrame, ts: str, by: str, delivery: str, n: int, width: str = "1 hour",
                       watermark: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """T1 with deliveries out of order: the counts of the windows, and the late rows (_ets, ``by``, _delivery) that no window counts.

    Late rows are told apart before the stream reads them, so none is dropped unseen; undated rows are in neither."""
    rows = log.select(F.col(ts).cast("timestamp").alias("_ets"), by, F.coalesce(delivery, F.lit(0)).cast("int").alias("_delivery"))
    rows = rows.where("_ets IS NOT NULL")
    marked = stored(late_rows(rows, "_ets", "_delivery", F.window("_ets", width)["end"], watermark), "marked")
    feed = Deliveries(spark, marked.where("NOT late").drop("late"), "_ets", n, "late")
    res = closed_windows(feed, lambda df: df.groupBy(F.window("_ets", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")), watermark)
    return res.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n"), marked.where("late").drop("late")


# ---- T1 / T4 --------------------------------------------------------------

def window_counts(spark: SparkSession, log: DataFrame, ts: str, by: str, width: str = "1 hour",
                  watermark: str = "2 hours", n_slices: int = 3) -> DataFrame:
    rows = log.select(F.col(ts).cast("timestamp").alias("_ets"), by)
    feed = Deliveries(spark, rows, "_ets", n_slices, "counts")
    res = closed_windows(feed, lambda df: df.groupBy(F.window("_ets", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")), watermark)
    undated = undated_counts(feed, by)
    none = F.lit(None).cast("timestamp_ntz").alias("window_start")
    return res.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n").unionByName(undated.select(none, by, "n"))


def sliding_counts(spark: SparkSession, log: DataFrame, ts: str, key: str, width: str = "1 day", slide: str = "1 hour",
                   watermark: str = "2 hours", n_slices: int = 3, over: int = 0) -> DataFrame:
    """(window_start, key, n) of all sliding windows of more than ``over`` rows; undated rows of a key stand under a null window.

    The stream counts panes, the longest spans that no window cuts: its state holds a row once, not once a window.  A closed
    pane adds its rows at the first window it lies in and takes them off behind the last one, so a key's running sum is the
    count of each window.  A key has at most as many such changes as the log has windows."""
    wide, step = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (width, slide))
    feed = Deliveries(spark, log.select(F.col(ts).cast("timestamp").alias("_ets"), key), "_ets", n_slices, "sliding")
    pane = f"{math.gcd(wide, step)} microseconds"
    res = closed_windows(feed, lambda df: df.groupBy(F.window("_ets", pane).alias("w"), key).agg(F.count(F.lit(1)).alias("n")), watermark)
    grid = lambda t: t - F.pmod(t, F.lit(step)) + step  # noqa: E731  (the first window start behind t)
    at = F.unix_micros("w.start")
    changes = res.select(key, F.inline(F.array(F.struct(grid(at - wide).alias("_t"), F.col("n").alias("_d")),
                                               F.struct(grid(at).alias("_t"), (-F.col("n")).alias("_d")))))
    changes = changes.groupBy(key, "_t").agg(F.sum("_d").alias("_d"))
    order = Window.partitionBy(key).orderBy("_t")
    spans = changes.select(key, F.sum("_d").over(order).alias("n"), "_t", F.lead("_t").over(order).alias("_next")).where(F.col("n") > over)
    found = spans.select(F.explode(F.expr(f"sequence(_t, _next - {step}, {step})")).alias("_s"), key, "n")
    none = F.lit(None).cast("timestamp_ntz")
    return (found.select(F.timestamp_micros("_s").cast("timestamp_ntz").alias("window_start"), key, "n")
            .unionByName(undated_counts(feed, key).select(none.alias("window_start"), key, "n")))


def sessions(spark: SparkSession, log: DataFrame, ts: str, key: str, gap, watermark: str = "2 hours", n_slices: int = 3,
             extra: list[str] = ()) -> DataFrame:
    """T5: (key, session_start, session_end, n); ``gap`` is a column over ``extra``.  Undated rows of a
    key stand under a session with null start and end."""
    feed = Deliveries(spark, log.select(F.col(ts).cast("timestamp").alias("_ets"), key, *extra), "_ets", n_slices, "sessions")
    res = closed_windows(feed, lambda df: df.groupBy(F.session_window("_ets", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")), watermark)
    none = F.lit(None).cast("timestamp_ntz")
    return (res.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                       F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
            .unionByName(undated_counts(feed, key).select(key, none.alias("session_start"), none.alias("session_end"), "n")))


def running_totals(spark: SparkSession, log: DataFrame, ts: str, key: str, value: str,
                   n_slices: int = 3) -> DataFrame:
    feed = Deliveries(spark, log.select(F.col(ts).cast("timestamp").alias("_ets"), key, value), "_ets", n_slices, "totals")
    return feed.complete(lambda df: df.groupBy(key).agg(F.sum(value).cast("long").alias("total"), F.count(F.lit(1)).alias("n")))


# ---- T3 / T8 / T9 -----------------------------------------------------------

HANDOVER = 100_000  # rows of a key in one delivery that a task holds and sorts at once
LEDGER_STATE = "balance long, closed boolean, last_ts long, last_seq long"
LEDGER_OUT = ("account long, seq long, ts_us long, balance_before long, granted boolean, balance_after long, "
              "after_close boolean, status string")


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """State of the streams started inside is kept in RocksDB, outside the workers' heaps."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held(rows: Iterator[pd.DataFrame], limit: int) -> tuple[list[pd.DataFrame], bool]:
    """Batches of ``rows`` up to ``limit`` rows, and whether that was not all: the iterator then goes on behind them."""
    parts, n = [], 0
    for pdf in rows:
        parts.append(pdf)
        n += len(pdf)
        if n > limit:
            return parts, True
    return parts, False


def fold_rows(account: int, pdf: pd.DataFrame, state: tuple | None, close_type: str) -> tuple[list[pd.DataFrame], tuple]:
    """``LEDGER_OUT`` rows of one account's delivery, and its new ``LEDGER_STATE``."""
    bal, closed, last_ts, last_seq = state if state is not None else (None, False, None, None)
    pdf = pdf.sort_values(["ts_us", "seq"], kind="stable")
    if bal is None:
        op = pdf["opening_c"].iloc[0]
        bal = 0 if pd.isna(op) else int(op)
    out = []
    undated = pdf[pdf["ts_us"].isna()]
    pdf = pdf[pdf["ts_us"].notna()]
    if len(undated):
        out.append(pd.DataFrame({"account": np.full(len(undated), account, dtype=np.int64), "seq": undated["seq"].to_numpy(np.int64),
                                 "ts_us": pd.array([None] * len(undated), dtype="Int64"), "balance_before": np.full(len(undated), bal),
                                 "granted": False, "balance_after": np.full(len(undated), bal), "after_close": closed, "status": "undated"}))
    if not len(pdf):
        return out, (int(bal), closed, last_ts, last_seq)
    ts = pdf["ts_us"].to_numpy(np.int64)
    sq = pdf["seq"].to_numpy(np.int64)
    late = np.zeros(len(pdf), dtype=bool)
    if last_ts is not None:
        late = (ts < last_ts) | ((ts == last_ts) & (sq < last_seq))
    ok = ~late
    delta = pdf["delta_c"].to_numpy(np.int64)[ok]
    acct = np.zeros(int(ok.sum()), dtype=np.int64)
    before = np.full(len(pdf), bal, dtype=np.int64)
    after = np.full(len(pdf), bal, dtype=np.int64)
    granted = np.zeros(len(pdf), dtype=bool)
    if ok.any():
        b, g, a = ledger.fold_arrays(acct, delta, delta < 0, 0, bal)
        before[ok], granted[ok], after[ok] = b, g, a
        bal = int(a[-1])
        last_ts, last_seq = int(ts[ok][-1]), int(sq[ok][-1])
    is_close = (pdf["activity_type"].to_numpy() == close_type) & ok
    seen_close = np.concatenate([[False], np.cumsum(is_close)[:-1] > 0]) | closed
    closed = bool(closed or is_close.any())
    out.append(pd.DataFrame({"account": np.full(len(pdf), account, dtype=np.int64), "seq": sq, "ts_us": ts, "balance_before": before,
                             "granted": granted, "balance_after": after, "after_close": seen_close, "status": np.where(late, "late", "applied")}))
    return out, (int(bal), closed, last_ts, last_seq)


def _ledger_state_fn(close_type: str):
    """The fold as a function for ``applyInPandasWithState``, for sessions without RocksDB: an account's delivery is one frame."""

    def fn(key, pdfs, state):
        out, new = fold_rows(key[0], pd.concat(list(pdfs), ignore_index=True), state.get if state.exists else None, close_type)
        state.update(new)
        yield from out
    return fn


HANDED_OUT = LEDGER_OUT + ", delta_c long, activity_type string, turn int, last_ts long, last_seq long"
_HANDED = [c.split()[0] for c in HANDED_OUT.split(", ")]


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python strings: the state worker's writer takes no chunked Arrow text."""
    return pdf.assign(**{c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("status", "activity_type")})


class LedgerProcessor(StatefulProcessor):
    """Folds an account's deliveries; hands the account over once a delivery has more than ``limit`` rows of it.

    Rows of an account handed over leave as they come, with ``status = 'handed'``, their delivery's number and the
    account's balance, closed flag and last row at the hand-over; a task then holds one Arrow batch at a time."""

    def __init__(self, close_type: str, limit: int):
        self.close_type, self.limit = close_type, limit

    def init(self, handle) -> None:
        self.ledger = handle.getValueState("ledger", LEDGER_STATE + ", turn int")  # read once and written once a delivery

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        *state, turn = self.ledger.get() or (None, 0)
        state = tuple(state) if len(state) > 1 else None
        parts, more = held(rows, self.limit) if not turn else ([], True)
        if not more:
            out, new = fold_rows(key[0], pd.concat(parts, ignore_index=True), state, self.close_type)
            self.ledger.update((*new, 0))
            for pdf in out:
                yield _plain(pdf.reindex(columns=_HANDED))
            return
        if state is not None:
            self.ledger.update((*state, turn + 1))
        for group in (parts, rows):
            for pdf in group:
                if state is None:
                    op = pdf["opening_c"].iloc[0]
                    state = (0 if pd.isna(op) else int(op), False, None, None)
                    self.ledger.update((*state, turn + 1))
                dated = pdf["ts_us"].notna()
                yield _plain(pd.DataFrame({
                    "account": key[0], "seq": pdf["seq"], "ts_us": pdf["ts_us"].astype("Int64"), "balance_before": state[0], "granted": False,
                    "balance_after": state[0], "after_close": state[1], "status": np.where(dated, "handed", "undated"), "delta_c": pdf["delta_c"],
                    "activity_type": pdf["activity_type"], "turn": turn + 1, "last_ts": pd.array([state[2]] * len(pdf), dtype="Int64"),
                    "last_seq": pd.array([state[3]] * len(pdf), dtype="Int64")})[_HANDED])

    def close(self) -> None:
        pass


def replay_handed(rows: DataFrame, close_type: str) -> DataFrame:
    """``LEDGER_OUT`` of handed-over rows: the batch ledger from the balance at the hand-over on.

    Tables of one row per account handed over (and delivery) are broadcast: each stands for ``HANDOVER`` rows or more."""
    at = F.struct("ts_us", "seq")
    turns = rows.groupBy("account", "turn").agg(F.max(at).alias("top"), 
                                                 F.max(F.when(F.col("last_ts").isNotNull(), F.struct(F.col("last_ts").alias("ts_us"), F.col("last_seq").alias("seq")))).alias("was"))
    earlier = Window.partitionBy("account").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    bound = turns.select("account", "turn", F.greatest(F.max("top").over(earlier), "was").alias("bound"))
    known = rows.join(F.broadcast(bound), ["account", "turn"]).withColumn("late", F.coalesce(at < F.col("bound"), F.lit(False)))
    known = stored(known.withColumn("amount", ledger.from_cents("delta_c")), "handed")
    good = known.where("NOT late")
    heads = known.groupBy("account").agg(F.first("balance_before").alias("o"), F.max("after_close").alias("closed"))
    opening = heads.select("account", ledger.from_cents("o").alias("opening"))
    played = ledger.replay(good.select("account", "seq", "ts_us", "turn", "amount", "activity_type"), opening, account="account", order=["ts_us", "seq"])
    cents = lambda c: F.round(F.col(c) * 100, 0).cast("long")
    played = stored(played.withColumns({"b": cents("balance_before"), "a": cents("balance_after")}), "replayed")
    closes = played.where(F.col("activity_type") == close_type).groupBy("account").agg(F.min(at).alias("close"))
    flags = heads.select("account", "closed").join(closes, "account", "left")
    shut = F.col("closed") | F.coalesce(at > F.col("close"), F.lit(False))
    applied = played.join(F.broadcast(flags), "account").select(
        "account", "seq", "ts_us", F.col("b").alias("balance_before"), "granted", F.col("a").alias("balance_after"),
        shut.alias("after_close"), F.lit("applied").alias("status"))
    # a late row shows the balance and the flag that its delivery began with
    ends = played.groupBy("account", "turn").agg(F.max_by("a", at).alias("end"))
    begin = turns.select("account", "turn").join(ends, ["account", "turn"], "left").join(heads, "account").select(
        "account", "turn", F.coalesce(F.last("end", True).over(earlier), "o").alias("begin"))
    late = known.where("late").drop("after_close").join(F.broadcast(begin), ["account", "turn"]).join(F.broadcast(flags), "account").select(
        "account", "seq", "ts_us", F.col("begin").alias("balance_before"), F.lit(False).alias("granted"), F.col("begin").alias("balance_after"),
        (F.col("closed") | F.coalesce(F.col("bound") > F.col("close"), F.lit(False))).alias("after_close"), F.lit("late").alias("status"))
    return applied.unionByName(late)


def ledger_stream(spark: SparkSession, log: DataFrame, opening: DataFrame, account: str = "virtual_id",
                  ts: str = "ts", seq: str = "seq", amount: str = "amount", state_col: str = "activity_type",
                  close_type: str = "Close Account", n_slices: int = 3, limit: int = HANDOVER, delivery: str | None = None) -> DataFrame:
    """T3 + T8 + T9: streaming V1 ledger with closure flag; returns the sink table and what the batch ledger made of accounts handed over."""
    base = log.select(F.col(account).alias("account"), F.col(seq).alias("seq"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
                      F.col(ts).cast("timestamp").alias("_ets"),
                      F.round(F.col(amount).cast("decimal(18,2)") * 100, 0).cast("long").alias("delta_c"),
                      F.col(state_col).alias("activity_type"), *([F.col(delivery).alias("_delivery")] if delivery else []))
    feed = Deliveries(spark, base, "_ets", n_slices, "ledger")
    op = opening.select(F.col("account"), F.round(F.col("opening").cast("decimal(18,2)") * 100, 0)
                        .cast("long").alias("opening_c"))
    with _rocksdb(spark):
        out = feed.appended(lambda stream: stream.join(op, "account", "left").groupBy("account").transformWithStateInPandas(  # T8: stream-static join
            LedgerProcessor(close_type, limit), HANDED_OUT, "Append", "None"))
    names = [c.split()[0] for c in LEDGER_OUT.split(", ")]
    handed = out.where("status = 'handed'")
    done = out.where("status <> 'handed'").select(*names)
    return done.unionByName(replay_handed(handed, close_type)) if handed.limit(1).count() else done


# ---- T2 ---------------------------------------------------------------------

VALIDATE_STATE = "last_t long"
VALIDATE_OUT = "resp_id long, user_id string, stage int, valid boolean"
CHECKED_OUT = VALIDATE_OUT + ", ts_us long, pre int, post int, tx_us long, turn int, last_t long"
_CHECKED = [c.split()[0] for c in CHECKED_OUT.split(", ")]
_NEVER = np.iinfo(np.int64).min


def judge_rows(pdf: pd.DataFrame, last: int | None) -> tuple[np.ndarray, int | None]:
    """Stage of each row (0: valid) of one user's delivery in its order, and the last accepted time.

    Accepted times only grow, so the last one accepted is the largest of all rows that pass the other checks."""
    pre, post = (pdf[c].fillna(0).to_numpy(np.int64) for c in ("pre", "post"))
    t = pdf["tx_us"].fillna(_NEVER).to_numpy(np.int64)
    top = np.maximum.accumulate(np.concatenate([[_NEVER if last is None else last], np.where((pre == 0) & (post == 0), t, _NEVER)]))
    early = (top[:-1] > _NEVER) & (t <= top[:-1])
    return np.where(pre > 0, pre, np.where(early, 7, post)), None if top[-1] == _NEVER else int(top[-1])


class ContractProcessor(StatefulProcessor):
    """Order check of a user's responses against the last accepted time; hot users are handed over as in :class:`LedgerProcessor`."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", VALIDATE_STATE + ", turn int")  # read once, and written once if it changes

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known, turn = self.last.get() or (None, 0)
        last = known
        parts, more = held(rows, self.limit) if not turn else ([], True)
        if not more:
            pdf = pd.concat(parts, ignore_index=True).sort_values(["ts_us", "resp_id"], kind="stable")
            stage, last = judge_rows(pdf, last)
            if last != known:
                self.last.update((last, 0))
            yield pd.DataFrame({"resp_id": pdf["resp_id"].to_numpy(), "user_id": key[0], "stage": pd.array(stage, "Int32"),
                                "valid": stage == 0}).assign(stage=lambda x: x["stage"].mask(x["valid"])).reindex(columns=_CHECKED)
            return
        self.last.update((last, turn + 1))
        for group in (parts, rows):
            for pdf in group:
                whole = pdf.astype({c: "Int64" for c in ("ts_us", "pre", "post", "tx_us")})
                yield whole.assign(user_id=key[0], stage=pd.array([None] * len(pdf), "Int32"), valid=None, turn=turn + 1,
                                   last_t=pd.array([last] * len(pdf), "Int64"))[_CHECKED]

    def close(self) -> None:
        pass


def judge_handed(rows: DataFrame) -> DataFrame:
    """``VALIDATE_OUT`` of handed-over rows, by running maxima in order of delivery, time and number."""
    # 2 ** 52 microseconds are 142 years: deliveries of one user follow one another in this order
    placed = rows.withColumn("_at", F.col("turn").cast("long") * (1 << 52) + F.coalesce("ts_us", F.lit(0)))
    good = F.when(F.col("pre").isNull() & F.col("post").isNull(), F.col("tx_us"))
    bucketed = seqwin.add_bucket(placed, "user_id", ["_at", "resp_id"])
    top = seqwin.running(bucketed, "user_id", ["_at", "resp_id"], {"_top": ("max", good)})
    before = seqwin.neighbor(top, "user_id", ["_at", "resp_id"], ["_top"])
    last = F.greatest("prev__top", "last_t")
    stage = F.when(F.col("pre").isNotNull(), F.col("pre")).when(F.col("tx_us") <= last, 7).otherwise(F.col("post"))
    return before.select("resp_id", "user_id", stage.cast("int").alias("stage")).withColumn("valid", F.col("stage").isNull())


def validate_stream(spark: SparkSession, responses: DataFrame, n_slices: int = 3, limit: int = HANDOVER) -> DataFrame:
    """Contract validation over a response stream (order check from state)."""
    st = K.stages(responses).select(
        "resp_id", "user_id", F.col("ts").cast("timestamp").alias("_ets"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("_pre").cast("int").alias("pre"), F.col("_post").cast("int").alias("post"),
        F.unix_micros("tx_ts").alias("tx_us"))
    feed = Deliveries(spark, st, "_ets", n_slices, "validate")
    with _rocksdb(spark):
        out = feed.appended(lambda stream: stream.groupBy("user_id").transformWithStateInPandas(
            ContractProcessor(limit), CHECKED_OUT, "Append", "None"))
    names = [c.split()[0] for c in VALIDATE_OUT.split(", ")]
    handed = out.where("turn IS NOT NULL")
    done = out.where("turn IS NULL").select(*names)
    return done.unionByName(judge_handed(handed)) if handed.limit(1).count() else done


# ---- T7 ---------------------------------------------------------------------

def append_sink(spark: SparkSession, log: DataFrame, ts: str, n_slices: int = 3) -> DataFrame:
    """Batched append with ``foreachBatch``; each batch id writes its own
    folder (overwrite), so a replayed batch after a failure replaces itself."""
    feed = Deliveries(spark, log.withColumn("_ets", F.col(ts).cast("timestamp")), "_ets", n_slices, "sink")
    out = _scratch(spark, "sink-out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.drop("_ets").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    feed.run(lambda stream: stream.writeStream.foreachBatch(sink))
    return spark.read.parquet(out).drop("batch")
