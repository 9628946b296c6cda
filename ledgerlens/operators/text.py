"""Text operators: JSON-array extraction variants (X2-X5), token counts (X23),
telemetry line parsing (X25) and load severity (X24).  All are column
expressions over whole texts (no prefixes, no truncation)."""

from __future__ import annotations

from pyspark.sql import functions as F

FENCED_ARRAY = r"(?s)```json\s*(\[.*?\])\s*```"
FENCED_OBJECTS = r"(?s)```json\s*(\[\s*\{.*?\}\s*\])\s*```"
BARE_ARRAY = r"(?s)(\[\s*\{.*?\}\s*\])"
GREEDY_ARRAY = r"(?s)\[.*\]"
FIRST_ARRAY = r"(?s)\[.*?\]"
FIRST_OBJECT = r"(?s)\{.*?\}"


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _items(block) -> F.Column:
    """Items of a JSON text (an array's own, or the value itself), each as JSON text; null if it does not parse.

    Spark's parser stops behind the first value, so the text is read as the only
    item of an array: anything behind the value then breaks the array or adds to it."""
    one = F.from_json(F.concat(F.lit("["), block, F.lit("]")), "array<variant>")
    many = F.transform(F.from_json(block, "array<variant>"), lambda x: F.to_json(x))
    return F.when(F.size(one) == 1, F.when(block.rlike(r"^\s*\["), many).otherwise(F.transform(one, lambda x: F.to_json(x))))


def extract_arrays(text) -> F.Column:
    """Items (JSON texts) of every fenced ```json [...]``` block, else of every bare
    ``[ {...} ]``; blocks that do not parse are skipped; null when no item is found."""
    t = _c(text)
    fenced = F.regexp_extract_all(t, F.lit(FENCED_ARRAY), 1)
    blocks = F.when(F.size(fenced) > 0, fenced).otherwise(F.regexp_extract_all(t, F.lit(BARE_ARRAY), 1))
    items = F.flatten(F.filter(F.transform(blocks, _items), lambda a: a.isNotNull()))
    return F.when(F.size(items) > 0, items)


def extract_array_simple(text) -> F.Column:
    """Items of the whole text if it is JSON, else of the greedy ``[...]`` span; null if that does not parse either."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    span = F.regexp_extract(t, GREEDY_ARRAY, 0)
    return F.coalesce(_items(t), F.when(span != "", _items(span)))


def extract_array_nocomment(text) -> F.Column:
    """struct(items, retries).  Fenced arrays of objects, else bare ones; ``//`` to the line's end is taken out
    of each block; the first block that parses is the answer and ``retries`` counts the ones before it.  Without an
    answer ``items`` is null and ``retries`` is 1 (no block), or what passes over all blocks add up to, three at least."""
    t = _c(text)
    fenced = F.regexp_extract_all(t, F.lit(FENCED_OBJECTS), 1)
    blocks = F.when(F.size(fenced) > 0, fenced).otherwise(F.regexp_extract_all(t, F.lit(BARE_ARRAY), 1))
    tried = F.transform(blocks, lambda b: F.struct(_items(F.regexp_replace(b, r"//[^\n]*", "")).alias("items")))
    at = F.array_position(F.transform(tried, lambda x: x["items"].isNotNull()), True).cast("int")
    k = F.size(blocks)
    return F.struct(F.when(at > 0, F.element_at(tried, F.when(at > 0, at))["items"]).alias("items"),
                    F.when(at > 0, at - 1).when(k == 0, 1).otherwise(k * F.ceil(F.lit(3) / k)).cast("int").alias("retries"))


def first_json_block(text) -> F.Column:
    """First lazy ``[...]``, else first lazy ``{...}``; null if neither."""
    t = _c(text)
    a = F.regexp_extract(t, FIRST_ARRAY, 0)
    o = F.regexp_extract(t, FIRST_OBJECT, 0)
    return F.when(a != "", a).when(o != "", o)


def count_tokens(text) -> F.Column:
    """X23 (re-aimed): whitespace-separated tokens of the whole text (not BPE)."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(r"\S+"), 0))


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): severity labels.
# ---------------------------------------------------------------------------
SEVERITY = [(10, "CRITICAL 🚨"), (7, "HIGH 🔥"), (4, "MODERATE ⚠️")]
SEVERITY_LOW = "LOW ✅"


def load_severity(power_w, util_pct, temp_c) -> F.Column:
    """p/20 + u/20 + (t - 50)/10 -> CRITICAL (>10) / HIGH (>7) / MODERATE (>4) / LOW; N/A if any null."""
    p, u, t = _c(power_w), _c(util_pct), _c(temp_c)
    score = p / 20 + u / 20 + (t - 50) / 10
    out = F.when(p.isNull() | u.isNull() | t.isNull(), F.lit("N/A"))
    for thr, label in SEVERITY:
        out = out.when(score > thr, F.lit(label))
    return out.otherwise(F.lit(SEVERITY_LOW))


def parse_power_line(line) -> F.Column:
    """struct(power_w, freq_mhz, util_pct) from one telemetry line, by line prefix."""
    s = _c(line)
    pw = F.regexp_extract(s, r"GPU Power: (\d+) mW", 1)
    fq = F.regexp_extract(s, r"(\d+) MHz", 1)
    ut = F.regexp_extract(s, r"(\d+\.\d+)%", 1)
    return F.struct(
        F.when(s.contains("GPU Power:") & (pw != ""), pw.cast("long") / 1000.0).alias("power_w"),
        F.when(~s.contains("GPU Power:") & s.contains("GPU HW active frequency:") & (fq != ""),
               fq.cast("long")).alias("freq_mhz"),
        F.when(~s.contains("GPU Power:") & ~s.contains("GPU HW active frequency:")
               & s.contains("GPU HW active residency:") & (ut != ""), ut.cast("double")).alias("util_pct"))
