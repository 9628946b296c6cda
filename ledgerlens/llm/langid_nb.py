"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is a row of code points, capitals of ASCII and Latin-1 made small and
everything that is no letter there made one blank; its one, two and three
character grams are hashed to ``BUCKETS`` buckets.  A language's weights are the
smoothed logarithms of its share in each bucket.  A batch's counts (documents by
buckets, sparse) times the broadcast matrix of log-probabilities scores it.

Fitting: per language all texts, or, above ``PER_LANG`` documents, those under a
hash threshold that leaves ``PER_LANG`` of them on average (a documented bound);
each task adds up counts by language and bucket before they are shuffled.
Languages are a small set of labels; the matrix has one row of ``BUCKETS`` each.
Only documents with ``crc32(doc_id as text) mod 4 <> 2`` are learned from.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a
null lang or doc_id is not learned from, and such rows are predicted like others;
without any language to learn everything is ``und``; ties go to the language
first in order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices

BUCKETS = 1 << 14
PER_LANG = 2000
SMOOTH = 0.5
SLICE = 1_500_000
GROUP = 64
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _fold() -> np.ndarray:
    """Small letter, or a blank, for each code point under 0x300."""
    out = np.arange(0x300, dtype=np.uint32)
    out[0x41:0x5B] += 32
    out[0xC0:0xDF] += 32
    for k in range(0x300):
        if not chr(int(out[k])).isalpha():
            out[k] = 0x20
    return out


FOLD = _fold()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of all grams of all texts."""
    values = pc.fill_null(texts.cast(pa.string()), "")
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 2  # a blank at either end
    points = np.frombuffer("".join(f" {x} " for x in values.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(points < 0x300, FOLD[np.minimum(points, 0x2FF)], points)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    # runs of blanks count as one
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20) | (doc[1:] != doc[:-1])
    low, doc = low[keep], doc[keep]
    h = low * _MUL[0]
    out, owner = [h >> np.uint32(18)], [doc]
    for n in (1, 2):
        if len(low) <= n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MUL[n] + low[n:] * _MUL[0]
        inside = doc[n:] == doc[:-n]
        out.append((h ^ (h >> np.uint32(13)))[inside] >> np.uint32(18))
        owner.append(doc[:-n][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counts(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, bucket, n of the documents learned from."""
    known = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
             .where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    sizes = known.groupBy("lang").count().collect()  # one row a language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_lang / r["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)

    def run(batches):
        total: dict[str, np.ndarray] = {}  # bounded: languages by buckets
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                bucket, doc = grams(rows.column("text"))
                d = rows.column("lang").dictionary_encode()
                lang = d.indices.to_numpy(zero_copy_only=False)[doc]
                for k, name in enumerate(d.dictionary.to_pylist()):
                    more = np.bincount(bucket[lang == k], minlength=BUCKETS)
                    total[name] = total[name] + more if name in total else more
        for name, n in total.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)),
                                              pa.array(n[there].astype(np.int64))], names=["lang", "bucket", "n"])

    return (known.where(drawn & F.col("text").isNotNull()).mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """langs and the log-probabilities (langs, BUCKETS); languages by buckets rows come to the driver."""
    found = counts(docs, per_lang).collect()
    langs = sorted({r["lang"] for r in found})
    n = np.zeros((len(langs), BUCKETS))
    at = {x: k for k, x in enumerate(langs)}
    for r in found:
        n[at[r["lang"]], r["bucket"]] = r["n"]
    n += SMOOTH
    return {"langs": langs, "logp": np.log(n / n.sum(axis=1, keepdims=True))}


def predict_batch(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and its probability (equal priors) of each text."""
    n = len(texts)
    letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model["langs"]:
        return ["und"] * n, np.zeros(n)
    weights = np.ascontiguousarray(model["logp"].T)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    for at in range(0, n, GROUP):
        part = texts.slice(at, GROUP)
        bucket, doc = grams(part)
        dense = np.bincount(doc * BUCKETS + bucket, minlength=len(part) * BUCKETS)
        where = np.flatnonzero(dense)  # the sparse counts of the batch
        row, col = where // BUCKETS, where % BUCKETS
        z = np.zeros((len(part), len(model["langs"])))
        edge = np.searchsorted(row, np.arange(len(part)))
        if len(where):
            z = np.add.reduceat(weights[col] * dense[where, None], edge, axis=0)
        top = z.argmax(axis=1)
        best[at:at + len(part)] = top
        score[at:at + len(part)] = 1 / np.exp(z - z[np.arange(len(z)), top][:, None]).sum(axis=1)
    return [model["langs"][k] if x else "und" for k, x in zip(best, letter, strict=True)], np.where(letter, score, 0.0)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = predict_batch(rows.column("text"), sent.value)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                              names=["doc_id", "lang_pred", "score"])

        return work

    return (map_slices(narrow, "text", "doc_id long, lang_pred string, score double", make, SLICE)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
