"""Secret scan with linking of multipart credentials, DataFrame functions only.

Strong kinds are reported wherever they match:

* ``assign``: a key word, an assignment sign and a value of 6 characters or more;
* ``access``: an access identifier of 20 characters or more;
* ``hex``: a run of 24 hexadecimal digits or more.

Weak kinds are reported only beside their complements:

* ``secret``: a run of 32 or more base64 characters with a capital, a small
  letter and a digit, when an access identifier starts within ``SCOPE`` code points;
* ``endpoint``: an ``http``/``https``/``s3`` address, when both an access
  identifier and a secret (weak or assigned) start within ``SCOPE`` code points.

The scope of a span is the interval of ``SCOPE`` code points to either side of
its start, inside its document.  The interval join is one sort of the spans by
start and a range frame over it that counts complements; it makes no pair.

Positions: matches and the parts between them (``split`` by the same pattern)
lie in turn, so a running sum of their lengths is the start of each match.  It
runs over rows, one a match, so a text of any length with any number of matches
is linear; only texts that hold a match at all are exploded.

Rows are told apart by doc_id and a 128-bit hash of the text, so rows that repeat
both share their spans.  Defined cases: null text is empty; a null doc_id keeps
its row; no match gives zero counts, the hash of the empty string and empty
``spans``; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

SCOPE = 400
# Patterns of the kinds, in the order of the report.  {24,} and {16,} equal "+" with a least length, as these
# runs hold no shorter match; an assignment is matched with "+" and dropped afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SECRET = r"[A-Za-z0-9+/=]{32,}"
ENDPOINT = r"""(?:https?|s3)://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, SECRET, ENDPOINT), strict=True))
MASK = "[SECRET]"


def _fits(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "secret":
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def _key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .select("doc_id", F.xxhash64("text", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), "text"))


KEY = ["doc_id", "h1", "h2"]


def matches(docs: DataFrame) -> DataFrame:
    """KEY, kind (number), start, end (code points, end exclusive) of all matches of all kinds that fit."""
    texts = _key(docs)
    # weak kinds need an access identifier in the document; without any strong kind there is nothing to report
    text = F.col("text")
    texts = texts.where(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX))
    weak = text.contains("AKIA")

    def pieces(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        found = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
        # no match in the last pair
        rows = F.transform(found, lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["between"]).cast("long").alias("gap"),
            F.length(x["match"]).cast("long").alias("size"), _fits(kind, x["match"]).alias("fits")))
        rows = F.filter(rows, lambda x: x["size"].isNotNull())
        return F.when(weak, rows) if kind in ("secret", "endpoint") else rows

    none = F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,fits:boolean>>")
    every = F.concat(*(F.coalesce(pieces(kind), none) for kind in KINDS))
    rows = texts.select(*KEY, every.alias("m")).dropDuplicates(KEY).select(*KEY, F.inline("m"))
    run = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    return rows.withColumn("end", end).where("fits").select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans without weak ones that lack a complement within the scope."""
    near = Window.partitionBy(*KEY).orderBy("start").rangeBetween(-scope, scope)
    before = Window.partitionBy(*KEY).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *kinds: F.sum(F.col("kind").isin(*(KINDS.index(k) for k in kinds)).cast("long")).over(near)
    weak = F.col("kind") >= KINDS.index("secret")
    # weak secrets inside a strong span are the same string again
    covered = F.coalesce(F.max(F.when(~weak, F.col("end"))).over(before), F.lit(0)) > F.col("start")
    marked = spans.withColumn("access_near", count("access")).withColumn("covered", weak & covered)
    marked = marked.where(~F.col("covered") & (~weak | (F.col("access_near") > 0)))
    marked = marked.withColumn("secret_near", count("secret", "assign"))
    return marked.where((F.col("kind") != KINDS.index("endpoint")) | (F.col("secret_near") > 0)).select(*KEY, "kind", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def by_document(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """KEY and found: the sorted array of (start, kind, end) of each distinct document that has a span."""
    return (linked(matches(docs), scope).groupBy(*KEY)
            .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found")))


def _matched(docs: DataFrame, spans: DataFrame) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["h1"] == spans["h1"]) & (docs["h2"] == spans["h2"])
    return docs.join(spans, same, "left").select(docs["*"], spans["found"])


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = _matched(_key(docs).select(*KEY), by_document(docs, scope))
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(found, lambda s: s["kind"] < KINDS.index("secret"))
    n = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                       F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(found).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` every reported span is replaced by ``mask``, ``n_chars`` follows.

    Spans that overlap are masked once.  Rows without a span stay as they are."""
    own = {c: fresh(docs, f"_{c}") for c in (*KEY, "found")}
    spans = by_document(docs, scope).select(*(F.col(c).alias(name) for c, name in own.items()))
    text, found = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(own["found"])
    same = (docs["doc_id"].cast("long").eqNullSafe(F.col(own["doc_id"])) & (F.xxhash64(text, F.lit(1)) == F.col(own["h1"]))
            & (F.xxhash64(F.lit(2), text) == F.col(own["h2"])))
    rows = docs.join(spans, same, "left")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        more = F.when(gap >= 0, F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text).cast("long"))))
    new = F.when(found.isNotNull(), done).otherwise(F.col("text"))
    out = rows.withColumn("text", new.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
