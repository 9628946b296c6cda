"""WARC archives written from, and read as, a table of payload chunks.

* ``chunk_table`` cuts every payload into rows (record, chunk, data) of at most ``CHUNK``
  bytes, between code points.  Each row carries the bytes and the SHA-1 of the payload up
  to its end, so the last row of a record holds the digest of the whole and no step
  needs a payload in one piece.
* ``revisits`` finds records with equal payloads from those last rows alone: the smallest
  page_id (then the first record) is the response, the others revisit it.  Digests that
  more than a thousandth of all records (and more than 1,000) share are at most 1,000 and
  are broadcast; the others are joined, none of them hot.
* ``write_archives`` deals chunks by record, in order, and writes each as one WARC record
  through Spark's text sink (gzip): a ``response`` with its HTTP head, or the first segment
  of one and ``continuation`` records (the format's own segmentation), or a ``revisit``.
* ``read_archives`` reads the files with Spark's text source, split where a blank line
  ends.  A gzip file is one task's and is parsed in order by Content-Length: a payload that
  holds blank lines or text like a record head is read as what it is.  Digests are
  counted anew from the bytes as they pass; a difference from the head is an error.

``Page-ID``, ``Refers-To-Page-ID`` and ``Payload-Length`` are extension fields.

Defined cases: a null html is an empty payload; a null url leaves the field out; a null
page_id is kept, comes last where a group's response is chosen, and is null in refers_to;
rows that repeat a page_id are records of their own; line ends in a url are written as
%0D and %0A; an empty table gives archives without records; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices, stored, text_bytes

CHUNK = 128 << 10
FLUSH = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "record long, chunk long, page_id long, url string, data string, upto_bytes long, upto_sha1 string, last boolean"
RECORDS = ("record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, refers_to_id string, segments long")


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(data: memoryview, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes that end between code points (one empty range for no bytes)."""
    at, n = 0, len(data)
    while True:
        stop = min(n, at + limit)
        while stop < n and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield at, stop
        at = stop
        if at >= n:
            return


def chunk_table(pages: DataFrame, limit: int = CHUNK) -> DataFrame:
    """``CHUNKS`` rows of all payloads; ``record`` numbers the rows of ``pages`` (store the table before it is read twice)."""
    assert limit >= 4
    chosen = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"),
                          F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def flush(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(k) if n == "data" else pa.array(c, k)
                                           for n, c, k in zip(names, columns, kinds, strict=True)], names=names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for part in slices(batch, "html", FLUSH):
                data, offs = text_bytes(part.column("html"))
                view = memoryview(data)
                record, page, url = (part.column(c).to_pylist() for c in ("record", "page_id", "url"))
                for k in range(part.num_rows):
                    payload, sha = view[int(offs[k]):int(offs[k + 1])], hashlib.sha1()
                    for n, (a, z) in enumerate(cuts(payload, limit)):
                        sha.update(payload[a:z])
                        last = z == len(payload)
                        rows.append((record[k], n, page[k], url[k] if n == 0 else None, payload[a:z].tobytes(), z, b32(sha.digest()), last))
                        held += z - a + 200
                        if held >= FLUSH:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    return chosen.mapInArrow(run, CHUNKS)


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record, first (the response's record), refers_to, bytes, sha1 of all records that repeat an earlier payload."""
    whole = chunks.where("last").select("record", "page_id", F.col("upto_bytes").alias("bytes"), F.col("upto_sha1").alias("sha1"))
    whole = whole.where(F.col("bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record")
    groups = stored(whole.groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
                    .select("sha1", "bytes", "n", F.col("first.record").alias("first"), F.col("first.page_id").alias("refers_to")), "payloads")
    hot = max(1000, whole.count() // 1000)
    many, few = groups.where(F.col("n") > hot), groups.where(F.col("n") <= hot)  # at most 1,000 groups are larger
    found = whole.join(F.broadcast(many), ["sha1", "bytes"]).unionByName(whole.join(few, ["sha1", "bytes"]))
    return found.where("record <> first").select("record", "first", "refers_to", "bytes", "sha1")


# ---- writing ------------------------------------------------------------------------

def _urn(record: Column, chunk: Column | int = 0) -> Column:
    h = F.md5(F.concat_ws("/", record.cast("string"), (F.lit(chunk) if isinstance(chunk, int) else chunk).cast("string")).cast("binary"))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One head line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_texts(chunks: DataFrame, again: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record a row, in ``value``; the writer's line end completes its final blank line."""
    # a record's decision goes in front of its chunks: payloads are shuffled once, no join deals a long record out again
    marks = again.select("record", F.lit(-1).cast("long").alias("chunk"), F.struct("first", "refers_to", "sha1", "bytes").alias("again"))
    in_order = Window.partitionBy("record").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.unionByName(marks, allowMissingColumns=True).repartition("record").withColumn("again", F.first("again").over(in_order))
    rows = rows.where("chunk = 0 OR (chunk > 0 AND again IS NULL)").select("*", "again.first", "again.refers_to", "again.sha1", "again.bytes")
    revisit, later = F.col("again").isNotNull(), F.col("chunk") > 0
    kind = F.when(revisit, "revisit").when(later, "continuation").otherwise("response")
    block = F.when(revisit, F.lit(HTTP)).when(later, F.col("data")).otherwise(F.concat(F.lit(HTTP), F.col("data")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    split = ~revisit & (later | ~F.col("last"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", kind), _field("WARC-Record-ID", _urn(F.col("record"), F.col("chunk"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.when(~later, url)),
        _field("Content-Type", F.when(~later, F.lit("application/http;msgtype=response"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("sha1")).when(F.col("last"), F.col("upto_sha1")))),
        _field("WARC-Segment-Number", F.when(split, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(later, _urn(F.col("record")))),
        _field("WARC-Segment-Total-Length", F.when(later & F.col("last"), F.col("upto_bytes") + len(HTTP))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _field("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        _field("Refers-To-Page-ID", F.when(revisit, F.col("refers_to"))), _field("Payload-Length", F.when(revisit, F.col("bytes"))),
        _field("Page-ID", F.when(~later, F.col("page_id"))), _field("Content-Length", F.octet_length(block)))
    return rows.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, limit: int = CHUNK) -> None:
    chunks = stored(chunk_table(pages, limit), "chunks", "zstd")
    record_texts(chunks, revisits(chunks, min_bytes)).write.option("lineSep", "\n").option("compression", "gzip").text(path)


# ---- reading ------------------------------------------------------------------------

def parse(rows: Iterable[bytes]) -> Iterator[tuple[str, object]]:
    """("head", fields), ("data", bytes) ..., ("end", None) of each record; rows are what stands between blank lines."""
    left, first, over = -1, True, False
    for row in rows:
        if over:  # a block that ends with a line end: its last two bytes were read as the first half of the blank line
            if not row.startswith(b"\r\n"):
                raise ValueError("a WARC record is longer than its Content-Length")
            row, over = row[2:], False
            if not row:
                continue
        if left < 0:
            lines = row.split(b"\r\n")
            if not lines[0].startswith(b"WARC/1."):
                raise ValueError(f"no WARC record head: {row[:60]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            left, first = int(fields[b"content-length"]), True
            yield "head", {k.decode(): v.decode() for k, v in fields.items()}
            continue
        piece = row if first else b"\r\n\r\n" + row
        first = False
        left -= len(piece)
        if left < 0:
            raise ValueError("a WARC record is longer than its Content-Length")
        over = left == 2
        yield "data", piece + b"\r\n" * over
        if left == 0 or over:
            yield "end", None
            left = -1
    if left >= 0:
        raise ValueError("a WARC record ends before its Content-Length")


class Payload:
    """Bytes and digest of one record's payload, counted as its pieces pass."""

    def __init__(self, fields: dict):
        self.fields, self.sha, self.bytes, self.segments = fields, hashlib.sha1(), 0, 1
        self.http = fields["warc-type"] != "continuation" and fields.get("content-type", "").startswith("application/http")
        self.started = not self.http

    def add(self, piece: bytes) -> bytes:
        """The piece without the HTTP head, which ends with the first blank line."""
        if not self.started:
            if not piece.startswith(b"\r\n\r\n"):
                return b""
            self.started, piece = True, piece[4:]
        self.sha.update(piece)
        self.bytes += len(piece)
        return piece

    def row(self, end: dict) -> tuple:
        f = self.fields
        digest = b32(self.sha.digest())
        said = (end.get("warc-payload-digest") or "sha1:" + digest).removeprefix("sha1:")
        size = self.bytes
        if f["warc-type"] == "revisit":
            digest, size = said, int(f["payload-length"])
        elif said != digest:
            raise ValueError(f"payload digest of {f['warc-record-id']} differs")
        number = lambda k: int(f[k]) if k in f else None
        return (f["warc-record-id"], number("page-id"), f.get("warc-target-uri"), f["warc-type"], size, digest,
                number("refers-to-page-id"), f.get("warc-refers-to"), self.segments)


def records(events: Iterable[tuple[str, object]]) -> Iterator[tuple]:
    """One ``RECORDS`` row a record, its segments put together."""
    open_, now = None, {}
    for kind, value in events:
        if kind == "head":
            now = value
            if now["warc-type"] != "continuation":
                open_ = Payload(now)
            elif open_ is None or now["warc-segment-origin-id"] != open_.fields["warc-record-id"]:
                raise ValueError("a continuation does not follow its record")
            else:
                open_.segments += 1
        elif kind == "data":
            open_.add(value)
        elif "warc-segment-number" not in now or "warc-segment-total-length" in now:
            yield open_.row(now)
            open_ = None


def _rows(batches) -> Iterator[bytes]:
    for b in batches:
        yield from pc.cast(b.column(0), pa.binary()).to_pylist()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``RECORDS`` of all archives under ``path``."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORDS.split(", ")]

    def run(batches):
        held = []
        for row in records(parse(_rows(batches))):
            held.append(row)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return spark.read.text(path, lineSep="\r\n\r\n").mapInArrow(run, RECORDS)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads as chunk rows (record_id, chunk, data) of the records that hold one, again without whole payloads in memory."""

    def run(batches):
        payload, chunk, held, size = None, 0, [], 0
        for kind, value in parse(_rows(batches)):
            if kind == "head":
                if value["warc-type"] != "continuation":
                    payload, chunk = Payload(value), 0
            elif kind == "data" and payload.fields["warc-type"] != "revisit":
                if (piece := payload.add(value)) or (payload.started and chunk == 0):
                    held.append((payload.fields["warc-record-id"], chunk, piece))
                    chunk, size = chunk + 1, size + len(piece) + 100
                    if size >= FLUSH:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    def flush(rows):
        ids, at, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(data, pa.binary()).cast(pa.string())],
                                          names=["record_id", "chunk", "data"])

    return spark.read.text(path, lineSep="\r\n\r\n").mapInArrow(run, "record_id string, chunk long, data string")


def digest(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back: one row a page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
