"""Quality classifier: byte-level convolutional network in numpy.

Input: the UTF-8 bytes of the whole text and one more channel that says whether
the six bytes at a place stood within the last 40 bytes already.  ``FILTERS``
learned filters of ``TAPS`` bytes slide over every byte.  A document is cut into
blocks of 256 places; a chunk is two neighbouring blocks, so chunks overlap by
half and cover the document to its end.  Each filter is max-pooled over a chunk,
a linear layer on the rectified pools scores the chunk, and the mean and the
least score of all chunks give one probability.

Fitting: Adam on windows of a bounded sample (``labelled.PER_CLASS`` documents a
label, ``WINDOWS`` windows of ``SPAN`` bytes each, spread over the whole text).
The weights (some hundred kilobytes, fixed) are broadcast; scoring is one Arrow
pass over whole texts in pieces of bounded size, without a shuffle.

Defined cases: null and empty texts score the share of label 1 in the sample;
with no labels, or labels of one kind, every text scores that share (0.5 without
any); a null doc_id is scored and not held out; repeated rows score alike; an
empty table gives an empty result; extra columns are not read (``keep_good``
passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, text_bytes
from .labelled import held_out

TAPS, FILTERS, BLOCK, GAP, LAGS = 6, 16, 256, 48, 40
SPAN, WINDOWS, STEPS, BATCH = 512, 3, 400, 48
SLICE = 400_000


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with GAP zero bytes behind each, so no filter or lag reaches into another text; their starts."""
    n = len(offs) - 1
    starts = offs[:-1] + GAP * np.arange(n)
    out = np.zeros(len(data) + GAP * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(GAP * np.arange(n), np.diff(offs))] = data
    return out, starts


def repeats(x: np.ndarray) -> np.ndarray:
    """1.0 where the six bytes from a place on also stand 2 to LAGS bytes before it."""
    n = len(x) - 5
    seen = np.zeros(len(x), bool)
    if n > 0:
        gram = np.zeros(n, np.int64)
        for k in range(6):
            gram = (gram << 8) | x[k:k + n]
        for lag in range(2, min(LAGS, n - 1) + 1):
            seen[lag:n] |= gram[lag:] == gram[:-lag]
    return seen.astype(np.float32)


class Network:
    """Weights: taps (TAPS, 256, FILTERS), again and bias (FILTERS), head (FILTERS), head0, mix (3), prior."""

    def __init__(self, weights: dict):
        self.w = weights
        t = weights["taps"]
        # two taps by one lookup
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, TAPS, 2)]

    def blocks(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each block [begin, end) of the padded bytes."""
        two = (x[:-1].astype(np.int32) << 8) | x[1:]
        again = repeats(x)
        out = np.empty((len(begin), FILTERS), np.float32)
        at = 0
        while at < len(begin):  # runs of blocks of bounded length
            stop = max(at + 1, int(np.searchsorted(end, begin[at] + (1 << 17), side="right")))
            lo, hi = begin[at], end[stop - 1]
            act = np.empty((hi - lo + 1, FILTERS), np.float32)  # one row more, for the last edge
            np.multiply(again[lo:hi, None], self.w["again"], out=act[:-1])
            for k, pair in enumerate(self.pairs):
                act[:-1] += pair[two[lo + 2 * k:hi + 2 * k]]
            # places between texts must not count: blocks are cut out by pairs of edges
            edges = np.column_stack([begin[at:stop], end[at:stop]]).ravel() - lo
            out[at:stop] = np.maximum.reduceat(act, edges, axis=0)[::2]
            at = stop
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offs = text_bytes(texts)
        sizes = np.diff(offs)
        x, starts = padded(data, offs)
        count = -(-sizes // BLOCK)
        out = np.full(len(sizes), self.w["prior"])
        full = np.flatnonzero(count)
        if self.w["taps_used"] and len(full):
            doc = np.repeat(np.arange(len(sizes)), count)
            first = np.cumsum(count) - count
            begin = starts[doc] + BLOCK * (np.arange(len(doc)) - first[doc])
            end = np.minimum(begin + BLOCK, (starts + sizes)[doc])
            pools = self.blocks(x, begin, end)
            last = np.append(doc[1:] != doc[:-1], True)
            chunks = np.where(last[:, None], pools, np.maximum(pools, np.roll(pools, -1, axis=0)))
            # the last block of a longer text is part of the chunk before it
            chunk = ~last | (count[doc] == 1)
            z = np.maximum(chunks + self.w["bias"], 0).astype(np.float64) @ self.w["head"] + self.w["head0"]
            z, doc = z[chunk], doc[chunk]
            edge = np.searchsorted(doc, full)
            mean = np.add.reduceat(z, edge) / np.diff(np.append(edge, len(z)))
            out[full] = _sigmoid(mean * self.w["mix"][0] + np.minimum.reduceat(z, edge) * self.w["mix"][1] + self.w["mix"][2])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def windows(sample: DataFrame) -> DataFrame:
    """order, doc_id, label, i and the bytes of up to WINDOWS windows of each sampled text."""

    def run(batches):
        for b in batches:
            rows = []
            for order, doc, label, text in zip(*(b.column(c).to_pylist() for c in ("order", "doc_id", "label", "text")), strict=True):
                raw = text.encode()
                n = min(WINDOWS, -(-len(raw) // SPAN))
                for i in range(n):
                    at = (len(raw) - SPAN) * i // max(1, n - 1) if n > 1 else 0
                    rows.append((order, doc, label, i, raw[max(0, at):max(0, at) + SPAN]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=["order", "doc_id", "label", "i", "raw"])

    return sample.select("order", "doc_id", "label", "text").mapInArrow(run, "order long, doc_id long, label int, i int, raw binary")


def fit(sample: DataFrame) -> dict:
    """Weights learned from the bounded sample (its windows come to the driver: a few megabytes at most)."""
    rows = sorted((r["order"], r["doc_id"], r["i"], r["label"], bytes(r["raw"])) for r in windows(sample).collect())
    doc = np.array([r[1] for r in rows], np.int64)
    y = np.array([r[3] for r in rows], np.float64)
    rng = np.random.default_rng(5)
    w = {"taps": rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), "again": rng.normal(0, 0.3, FILTERS).astype(np.float32),
         "bias": np.zeros(FILTERS, np.float32), "head": rng.normal(0, 0.3, FILTERS), "head0": 0.0, "mix": np.array([1.0, 0, 0]),
         "prior": float(y.mean()) if len(y) else 0.5, "taps_used": len(set(y)) == 2}
    if not w["taps_used"]:
        return w
    size = np.array([len(r[4]) for r in rows])
    x = np.zeros((len(rows), SPAN + TAPS), np.int64)
    rep = np.zeros((len(rows), SPAN), np.float32)
    for k, r in enumerate(rows):
        x[k, :size[k]] = np.frombuffer(r[4], np.uint8)
        rep[k, :size[k]] = repeats(np.frombuffer(r[4], np.uint8))
    names = ("taps", "again", "bias", "head", "head0")
    first = {k: np.zeros_like(np.asarray(w[k], np.float64)) for k in names}
    second = {k: np.zeros_like(np.asarray(w[k], np.float64)) for k in names}
    kinds = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        xs, rs, ys = x[pick], rep[pick], y[pick]
        act = rs[:, :, None] * w["again"]
        for k in range(TAPS):
            act = act + w["taps"][k][xs[:, k:k + SPAN]]
        act[np.arange(SPAN)[None, :] >= size[pick][:, None]] = -np.inf
        best = act.argmax(axis=1)
        pool = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + w["bias"]
        hidden = np.maximum(pool, 0)
        d = (_sigmoid(hidden @ w["head"] + w["head0"]) - ys) / len(pick)
        back = d[:, None] * w["head"][None, :] * (pool > 0)
        grad = {k: np.zeros_like(first[k]) for k in names}
        cols = np.broadcast_to(np.arange(FILTERS), best.shape)
        row = np.arange(len(pick))[:, None]
        for k in range(TAPS):
            np.add.at(grad["taps"][k], (xs[row, best + k], cols), back)
        grad["again"] = (back * rs[row, best]).sum(axis=0)
        grad["bias"], grad["head"], grad["head0"] = back.sum(axis=0), hidden.T @ d + 1e-3 * w["head"], np.asarray(d.sum())
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            move = 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            w[k] = (w[k] - move).astype(np.float32) if k in ("taps", "again", "bias") else w[k] - move
    w["head0"] = float(w["head0"])
    _mix(w, rows, doc, y)
    return w


def _mix(w: dict, rows: list, doc: np.ndarray, y: np.ndarray) -> None:
    """How mean and least chunk score make one probability: logistic regression on the sampled documents."""
    net = Network(w | {"mix": np.array([1.0, 0, 0])})
    score = net.score(pa.array([r[4].decode("utf-8", "ignore") for r in rows]))
    z = np.log(np.maximum(score, 1e-12) / np.maximum(1 - score, 1e-12))
    at = np.argsort(doc, kind="stable")
    z, label = z[at], y[at]
    edge = np.searchsorted(doc[at], np.unique(doc))
    f = np.column_stack([np.add.reduceat(z, edge) / np.diff(np.append(edge, len(z))), np.minimum.reduceat(z, edge), np.ones(len(edge))])
    t = label[edge]
    v = np.array([1.0, 0.0, 0.0])
    for _ in range(25):  # Newton steps with a small ridge towards the mean alone
        p = _sigmoid(f @ v)
        g = f.T @ (p - t) + 1.0 * (v - np.array([1.0, 0, 0]))
        v = v - np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.eye(3), g)
    w["mix"] = v


def score(docs: DataFrame, weights: dict) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        net = Network(sent.value)

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(net.score(rows.column("text")), pa.float64())],
                                              names=["doc_id", "score"])

        return work

    scored = map_slices(narrow, "text", "doc_id long, score double", make, SLICE)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        net = Network(sent.value)
        return lambda rows: rows.filter(pa.array(net.score(rows.column("text")) >= 0.5))

    return map_slices(docs, "text", docs.schema, make, SLICE)
