"""Runs of periodic words inside a text, found by multi-scale minimizers.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of words with
smallest period ``q`` and ``max(MIN_LENGTH, TIMES * q)`` words at least that no
neighbour extends keeping the period.

* Periods up to ``DIRECT`` are scanned at their lag: word ``i`` against word ``i + q``.
* A scale ``s`` = ``DIRECT``, twice that, and so on covers the periods in ``(s, 2s]``.
  Every start of a block of ``2s`` words has a hash; the minima over windows of ``s``
  starts are its minimizers.  Inside a run of period ``q`` the window at its first word
  and the one ``q`` words on hold the same words, so their minimizers lie ``q`` apart;
  a block is no shorter than the period, so no equal block lies between.  Minimizers
  with equal blocks are therefore paired with the next one only, and pairs at a distance
  in ``(s, 2s]`` are seeds: at most one a minimizer, about ``2 / s`` of all words.
* A seed is extended to both sides by binary search over prefix hashes, and the
  stretch is then compared word by word, so nothing false is returned.  A stretch that
  fails the comparison has its lag scanned directly in its text.

Two 31-bit hashes modulo a prime with fixed random bases stand for a block: two
different blocks of one text have equal hashes with a chance of about ``2**-60``.
The work is about ``n log n`` for a text of ``n`` words, also in texts made of one word.
One Arrow pass, no shuffle; slices are bounded, a longer text is a slice of its own.

Defined cases: a null or empty text has no words and no runs, its collapsed text is
empty; a null doc_id is a row like any other and is never echoed; repeated rows are kept;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import codes, lists, map_slices, words

TIMES = 4
MIN_LENGTH = 6
DIRECT = 8
PRIME = (1 << 31) - 1
BASES = (1_234_567_891, 987_654_323)
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def need(period):
    """Words that a run of this period has at least."""
    return np.maximum(MIN_LENGTH, TIMES * period)


@functools.lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** k modulo PRIME for k below ``2 ** bits``."""
    out = np.ones(1 << bits, np.uint32)
    step = base
    for b in range(bits):
        half = 1 << b
        out[half:2 * half] = out[:half].astype(np.uint64) * np.uint64(step) % np.uint64(PRIME)
        step = step * step % PRIME
    return out


class Hashes:
    """Prefix hashes of a row of word numbers: hashes of blocks, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.n, self.parts = len(ids), []
        bits = max(1, int(self.n).bit_length())
        for k, base in enumerate(BASES):
            up, down = _powers(base, bits), _powers(pow(base, PRIME - 2, PRIME), bits)
            value = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33 - k)) % np.uint64(PRIME)
            prefix = np.zeros(self.n + 1, np.uint64)
            np.cumsum(value * up[:self.n] % np.uint64(PRIME), out=prefix[1:])
            self.parts.append((prefix % np.uint64(PRIME), up, down))

    def blocks(self, size: int) -> np.ndarray:
        """One number for each block of ``size`` words."""
        out = np.zeros(self.n - size + 1, np.uint64)
        for prefix, _, down in self.parts:
            h = (prefix[size:] + np.uint64(PRIME) - prefix[:self.n - size + 1]) * down[:len(out)] % np.uint64(PRIME)
            out = out << np.uint64(31) | h
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for prefix, up, _ in self.parts:
            left = (prefix[a + size] + np.uint64(PRIME) - prefix[a]) % np.uint64(PRIME) * up[b - a] % np.uint64(PRIME)
            same &= left == (prefix[b + size] + np.uint64(PRIME) - prefix[b]) % np.uint64(PRIME)
        return same

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """Number of words, at most ``limit``, that agree from ``a`` and ``b`` (a < b) on, or before them."""
        got = np.zeros(len(a), np.int64)
        step = 1 << int(max(int(limit.max(initial=0)), 1)).bit_length()
        while step:
            more = got + step
            fits = np.flatnonzero(more <= limit)
            if len(fits):
                m = more[fits]
                x, y = (a[fits] - m, b[fits] - m) if back else (a[fits], b[fits])
                good = fits[self._equal(x, y, m)]
                got[good] = more[good]
            step >>= 1
        return got


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least key of some window of ``width`` places (all of them where equal)."""
    if len(keys) < width:
        return np.zeros(0, np.int64)
    low = _sliding(keys, width, np.minimum)
    pad = np.zeros(width - 1, keys.dtype)
    return np.flatnonzero(keys == _sliding(np.concatenate([pad, low, pad]), width, np.maximum))


def lag_stretches(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all stretches long enough whose words agree with those ``q`` further on."""
    if len(ids) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]])
    size = np.diff(other) - 1 + q
    good = np.flatnonzero(size >= need(q))
    return other[good] + 1, size[good]


def _same(ids: np.ndarray, a: int, n: int, q: int) -> bool:
    """Whether the stretch has period q and neither neighbour keeps it (texts end in marks that equal nothing)."""
    z = a + n
    return (np.array_equal(ids[a:z - q], ids[a + q:z]) and (a == 0 or ids[a - 1] != ids[a - 1 + q])
            and (z == len(ids) or ids[z] != ids[z - q]))


def find(ids: np.ndarray, parent: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of all runs, by text, start and period.

    ``ids`` numbers the words of all texts one after the other, ``parent`` is the text of each."""
    counts = np.bincount(parent, minlength=docs).astype(np.int64)
    top = int(ids.max(initial=0)) + 1
    # a mark of its own behind each text
    at = np.arange(len(ids)) + parent
    row = np.empty(len(ids) + docs, np.int64)
    ends = np.cumsum(counts + 1) - 1
    row[at], row[ends] = ids, top + np.arange(docs)
    begins = ends - counts
    found = []
    for q in range(1, DIRECT + 1):
        a, n = lag_stretches(row, q)
        found += [(a, n, np.full(len(a), q, np.int64))]
    scale = DIRECT
    while True:
        some = np.flatnonzero(counts >= need(scale + 1))
        if not len(some):
            break
        sizes = counts[some] + 1
        stops = np.cumsum(sizes)
        shift = begins[some] - (stops - sizes)  # from places among these texts to places in row
        part = row[np.arange(stops[-1]) + np.repeat(shift, sizes)]
        hashes = Hashes(part)
        keys = hashes.blocks(min(2 * scale, len(part)))
        place = minimizers(keys, scale)
        order = np.argsort(keys[place], kind="stable")
        first, key = place[order], keys[place][order]
        gap = np.diff(first)
        seed = np.flatnonzero((key[1:] == key[:-1]) & (gap > scale) & (gap <= 2 * scale))
        a, q = first[:-1][seed], gap[seed]
        if len(a):
            of = np.searchsorted(stops, a, side="right")
            head, tail = stops[of] - sizes[of], stops[of] - 1
            start = a - hashes.agree(a, a + q, a - head, True)
            stop = a + q + hashes.agree(a, a + q, tail - (a + q), False)
            long = stop - start >= need(q)
            for x, z, period, k in np.unique(np.stack([start, stop, q, of], 1)[long], axis=0).tolist():
                if _same(part, x, z - x, period):
                    found.append((np.array([x + shift[k]]), np.array([z - x]), np.array([period])))
                else:  # two blocks with one hash: the lag is scanned as a whole
                    lo = int(begins[some[k]])
                    b, n = lag_stretches(row[lo:lo + int(counts[some[k]]) + 1], period)
                    found.append((b + lo, n, np.full(len(b), period, np.int64)))
        scale *= 2
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    # a stretch found with several periods is a run of the smallest
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = np.searchsorted(ends, start, side="left")
    return of, start - begins[of], length, period


def echoed(counts: np.ndarray, h: pa.Array) -> np.ndarray:
    """For each word the word of the slice that stands there: where ``h`` is a multiple of ten, a text repeats some words to its end."""
    offs = np.cumsum(counts) - counts
    source = np.arange(int(counts.sum()))
    given = h.to_pylist()
    for k in range(len(given)):
        n = int(counts[k])
        if n and given[k] is not None and given[k] % 10 == 0:
            g = given[k] // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[offs[k] + a:offs[k] + n] = offs[k] + a + np.arange(n - a) % p
    return source


def _work(rows: pa.RecordBatch) -> pa.RecordBatch:
    values, parent, _ = words(rows.column("text"))
    docs = rows.num_rows
    counts = np.bincount(parent, minlength=docs).astype(np.int64)
    source = echoed(counts, rows.column("echo"))
    ids = codes(values)[0][source]
    of, start, length, period = find(ids, parent, docs)
    offs = np.cumsum(counts) - counts
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, offs[of] + start + period, 1)
    np.add.at(cover, offs[of] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    sizes = np.bincount(parent[kept], minlength=docs)
    groups = lists(np.zeros(0, np.int64), np.zeros(docs, np.int64), pa.int64()) if not len(kept) else None
    if groups is None:
        groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values.take(pa.array(source[kept])))
        collapsed = pc.binary_join(groups, " ")
    else:
        collapsed = pa.array([""] * docs, pa.string())
    runs = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=docs))]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts), runs, collapsed],
                                      names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, echo: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_words, its runs (by start, then period) and ``collapsed``, its words joined by one space
    without those that a run repeats after its first period.

    ``echo``: a long column; where it is a multiple of ten the text is read with repeated words (:func:`echoed`)."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         (F.lit(None) if echo is None else echo).cast("long").alias("echo"))
    return map_slices(chosen, "text", SCHEMA, lambda: _work)


def digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and the digests of runs and collapsed texts, of echoed documents."""
    found = find_runs(docs, F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                               (-r["period"]).alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"),
        (-best["period"]).alias("period"), F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
