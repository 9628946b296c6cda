"""Readers and writers for the log formats.

Every reader takes an explicit schema (no inference); malformed CSV rows keep
a ``_corrupt_record`` column in PERMISSIVE mode.  Text formats whose records
span lines (profile blocks, response logs) are split with ``lineSep``, so a row
is one record; only files that hold one small object are read with ``wholetext``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import seqwin

TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
RESPONSE_MARK = "### LLM Chain of Thought for user ID "
_HEADER_REST = r"^(\S+) ###\n"


def _csv_reader(spark: SparkSession, schema, corrupt: bool):
    r = spark.read.option("header", True).option("timestampNTZFormat", TS_FMT).option("timestampFormat", TS_FMT)
    if corrupt:
        schema = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return r.schema(schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """Header CSV with an explicit schema."""
    return _csv_reader(spark, schema, corrupt).csv(path)


def write_ordered_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """S2 / S3 (mode='append'): fixed column order, header in every part file."""
    (df.select(*columns).write.mode(mode).option("header", True).option("timestampNTZFormat", TS_FMT)
     .option("timestampFormat", TS_FMT).csv(path))


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to declared types (bad values -> null, as try_cast)."""
    return df.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                       for f in schema.fields])


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """JSON file(s) holding one object profile -> strategy text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("profile", "raw"))


def upsert(existing: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Add or replace rows by key, latest version wins."""
    u = existing.unionByName(updates)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_r")).select(key, "_r.*")


def write_strategies(df: DataFrame, path: str, profile: str = "profile", raw: str = "raw") -> None:
    """S4 writer: one JSON object profile -> text (profiles are few: one row each; of repeats the greatest text stays)."""
    one = df.filter(F.col(profile).isNotNull()).groupBy(profile).agg(F.max(raw).alias("_raw"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(profile), F.col("_raw"))))
    one.agg(F.to_json(F.map_from_entries(entries), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_profile_blocks(df: DataFrame, path: str, profile: str = "profile", strategy: str = "strategy") -> None:
    """S8 writer: blocks of a first line ``Profile Type: X`` and a body after ``Strategy:``, each closed by ``---``. A null profile
    leaves the first line out, a null strategy the body."""
    head = F.coalesce(F.concat(F.lit("Profile Type: "), F.col(profile)), F.lit("No type"))
    body = F.coalesce(F.concat(F.lit("\nStrategy:\n"), F.col(strategy)), F.lit(""))
    df.select(F.concat(head, body, F.lit("\n")).alias("value")).write.mode("overwrite").option("lineSep", "---\n").text(path)


def write_error_log(errors: DataFrame, path: str, col: str = "errors", mode: str = "append") -> None:
    """One JSON array of error strings per line."""
    errors.select(F.to_json(F.col(col)).alias("value")).write.mode(mode).text(path)


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON array per line; lines that do not parse are skipped."""
    t = spark.read.text(path)
    return t.select(F.from_json("value", "array<string>").alias("errors")).filter(F.col("errors").isNotNull())


def read_profile_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records separated by ``---\\n``; first line ``Profile Type: X``; body
    after ``Strategy:`` (empty when absent); records without the first line are skipped."""
    t = spark.read.option("lineSep", "---\n").text(path)
    prof = F.regexp_extract("value", r"^\s*Profile Type: ([^\n]*)", 1)
    body = F.regexp_extract("value", r"(?s)Strategy:(.*)$", 1)
    ws = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")  # noqa: E731  (trims newlines too)
    return t.filter(prof != "").select(ws(prof).alias("profile"), ws(body).alias("strategy"))


def write_response_log(responses: DataFrame, path: str, user: str = "user_id", text: str = "raw_text") -> None:
    """Writer for S9: blocks headed ``### LLM Chain of Thought for user ID U ###``."""
    head = F.concat(F.lit(RESPONSE_MARK), F.col(user), F.lit(" ###\n"))
    responses.select(F.concat(head, F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite") \
        .option("lineSep", "\n").text(path)


def read_response_log(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, raw_text) per block.

    Records end at the words that open a header, so files are split over tasks and a row is one block.  A file's
    first record lies before its first header and is skipped.  Where another record is no block (the opening words
    stand inside a text), it is put back behind the block before it."""
    t = spark.read.option("lineSep", RESPONSE_MARK).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    head, first = F.col("value").rlike(_HEADER_REST), F.min(F.when(F.col("_block") == 0, F.col("_id")))
    files = t.groupBy("_file").agg(F.count_if(~head).alias("n"), F.min(F.when(~head & (F.col("_block") == 0), F.col("_id"))).alias("odd"), first.alias("first"))
    if files.filter((F.col("n") != 1) | ~F.col("odd").eqNullSafe(F.col("first"))).limit(1).count():
        blocks = _rejoined(t, head)
    else:
        blocks = t.filter(head)
    body = F.regexp_replace(F.regexp_replace("value", _HEADER_REST, ""), r"\n$", "")
    return blocks.select(F.regexp_extract("value", _HEADER_REST, 1).alias("user_id"), body.alias("raw_text"))


def _rejoined(t: DataFrame, head) -> DataFrame:
    """(value): the blocks of records of :func:`read_response_log`, each with the records that belong to it."""
    at = F.struct("_block", "_id")
    first = F.min("_id").over(Window.partitionBy("_file", "_block"))  # rows of one split of a file
    marked = t.withColumn("_head", head & ~((F.col("_block") == 0) & (F.col("_id") == first)))
    placed = seqwin.running(marked, "_file", ["_block", "_id"], {"_of": ("max", F.when(F.col("_head"), at))}, bucket=F.col("_block"))
    own = placed.filter(F.col("_of").isNotNull()).groupBy("_file", "_of").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("_parts"))
    return own.select(F.array_join(F.col("_parts.value"), RESPONSE_MARK).alias("value"))


def write_matrix_tsv(m: DataFrame, path: str, states: list[str], by: str = "behavior",
                     frm: str = "from_activity", to: str = "to_activity", p: str = "p") -> None:
    """Writer for S10: one row per (behaviour, from-state), one column per to-state."""
    wide = m.groupBy(by, frm).pivot(to, states).agg(F.first(p))
    wide.na.fill(0.0).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_matrix_tsv(spark: SparkSession, path: str, states: list[str], by: str = "behavior",
                    frm: str = "from_activity") -> DataFrame:
    """Square matrix TSV -> long (behaviour, from, to, p) with zero cells dropped."""
    schema = T.StructType([T.StructField(by, T.StringType()), T.StructField(frm, T.StringType())]
                          + [T.StructField(s, T.DoubleType()) for s in states])
    w = spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)
    return w.unpivot([by, frm], states, "to_activity", "p").filter(F.col("p") != 0)


def read_catalog_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested catalog JSON -> (behavior, activity_impact, transition) tables."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json(
        "value", "map<string, struct<activities: map<string,string>, transition_matrix: array<array<double>>,"
                 " time_limit: long, fraud: int>>")).alias("behavior", "d"))
    beh = m.select("behavior", F.col("d.time_limit").alias("time_limit_s"), F.col("d.fraud").alias("fraud"))
    acts = m.select("behavior", F.posexplode(F.map_entries("d.activities")).alias("idx", "e")) \
        .select("behavior", "idx", F.col("e.key").alias("activity"), F.col("e.value").alias("impact"))
    rows = m.select("behavior", F.posexplode("d.transition_matrix").alias("from_idx", "row"))
    cells = rows.select("behavior", "from_idx", F.posexplode("row").alias("to_idx", "p"))
    return beh, acts, cells
