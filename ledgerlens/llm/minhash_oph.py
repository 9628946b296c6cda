"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star edges.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles
(ASCII letters lower-cased; with fewer words the whole sequence is the only
shingle).  Documents with ``100 * |A and B| >= percent * |A or B|`` are linked;
``component_id`` is the smallest doc_id reachable by links.

1. ``sketches`` (one Arrow pass): one permutation deals the sorted hashes to
   ``bands * ROWS`` bins, the smallest of a bin is its value; an empty bin takes
   the value of the first non-empty bin in its own fixed random order of bins.
   A band is the hash of ``ROWS`` bins.  Equal sets have equal 128-bit digests,
   so copies are one row (``groupBy(digest)``) from here on.
2. Star edges: in each bucket (band value) every member is paired with the
   bucket's smallest digest only, so pairs grow with members, not their square.
3. Candidates are confirmed on full sets, fetched for candidates only.
4. The rest, exactly: buckets whose members stand in more than one component
   still hide pairs that no star holds.  Up to ``SMALL`` members all pairs are
   taken.  Larger buckets get a second star, from their pivot, that also counts
   what each member shares with the pivot; what two members must then share
   beyond it selects pairs by their rarest such shingles (``_beside_pivots``).
   Both are bounds, so no link is lost.
5. Components by contraction to the smallest neighbour, a written table a round.

``bands`` follows from the threshold: a pair at the threshold shares no bucket
with a probability under ``MISS``.  Hot groups: copies collapse by partial
aggregation, buckets are aggregated before they are joined, and no step gathers
a group into a row or a task.  Only the ids of candidates and the keys of shared buckets
are broadcast, behind a count (``BROADCAST``); beyond it the same joins shuffle.

Defined cases: null, empty or wordless texts have the empty set, link with
nothing and are kept; rows that repeat a doc_id are documents of their own that
share that id (equal texts link as copies do); a null doc_id takes no part, its
row has a null component and is kept; an empty table gives an empty result;
extra columns are not read.  ``deduplicate`` drops rows, not ids: a document that
shares its doc_id with a dropped one stays, and rows without an id take part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import codes, fresh, map_slices, stored, text_bytes, words

MISS = 1e-5
ROWS = 6
BROADCAST = 400_000
SMALL = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def n_bands(percent: int, rows: int = ROWS) -> int:
    """Bands at which a pair at the threshold is missed with a probability of MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of them by text."""
    data, offs = text_bytes(texts)
    n = len(offs) - 1
    low = pa.StringArray.from_buffers(n, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(_LOWER[data]))
    word, parent, _ = words(low)
    which, distinct = codes(word)
    by_word = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                        for w in distinct.to_pylist()], np.uint64)
    h = by_word[which] if len(which) else np.zeros(0, np.uint64)
    count = np.bincount(parent, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    total = int(size.sum())
    doc = np.repeat(np.arange(n), size)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + first[doc]
    out = np.zeros(total, np.uint64)
    for j in range(k):
        there = j < count[doc]  # shorter sequences are one shingle of all their words
        out[there] = _mix(out[there] * np.uint64(31) + h[at[there] + j] + np.uint64(j + 1))
    return out, size


def probe_order(bins: int) -> np.ndarray:
    """For each bin its fixed random ranking of all bins: an empty bin takes the first non-empty one."""
    rng = np.random.default_rng(20_17)
    return np.argsort(rng.random((bins, bins)), axis=1).argsort(axis=1).astype(np.int16)


def one_permutation(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values of all bins for a sorted, distinct, non-empty set."""
    bins = len(order)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(bin_of, return_index=True)
    values = np.empty(bins, np.uint64)
    values[full] = hashes[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        values[empty] = values[full[np.argmin(order[np.ix_(empty, full)], axis=1)]]
    return values


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    hashes, size = shingle_hashes(texts, k)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(size)[:-1])]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _narrow(docs: DataFrame, *own: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)


def sketches(docs: DataFrame, k: int, percent: int, own: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n (set size), digest (null: empty set), bands (array of long, null: empty set), columns ``own`` (long) as they are."""
    bands = n_bands(percent)

    def make():
        order = probe_order(bands * ROWS)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of(rows.column("text"), k)
            keys = []
            for x in sets:
                if not len(x):
                    keys.append(None)
                    continue
                values, h = one_permutation(x, order).reshape(bands, ROWS), salt.copy()
                for j in range(ROWS):
                    h = _mix(h + values[:, j])
                keys.append(h.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), *(rows.column(c) for c in own)], names=["doc_id", "n", "digest", "bands", *own])

        return work

    schema = ", ".join(["doc_id long, n long, digest binary, bands array<long>", *(f"{c} long" for c in own)])
    return map_slices(_narrow(docs, *own), "text", schema, make)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """digest and set (array of long) of each non-empty document."""

    def make():
        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            sets = [x for x in sets_of(rows.column("text"), k) if len(x)]
            return pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in sets], pa.binary()),
                 pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "set"])

        return work

    return map_slices(_narrow(docs), "text", "digest binary, set array<long>", make)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    right = pairs.join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b")
    both = right.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return (both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s"))
            .where(F.col("c") * 100 >= (F.col("s") - F.col("c")) * percent).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes of ``edges`` (a, b).

    Each round contracts every node to its smallest neighbour.  Nodes are digests,
    so their order is random and the expected number of rounds is logarithmic, for
    a long chain as for a star.  Every round's tables are written to the shared folder."""
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                        .select(F.col("a").alias("old"), F.least("a", "m").alias("new")), "parents")
        labels = stored(labels.join(parent, labels["label"] == parent["old"], "left")
                        .select("node", F.coalesce("new", "label").alias("label")), "labels")
        left = edges.join(parent, edges["a"] == parent["old"]).select(F.col("new").alias("a"), "b")
        edges = stored(left.join(parent, left["b"] == parent["old"]).select("a", F.col("new").alias("b"))
                       .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _fetch(docs: DataFrame, sketch: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Full sets of the digests in ``wanted``, one row each, written to the shared folder."""
    ids = stored(sketch.where("digest is not null and doc_id is not null").join(wanted, "digest", "left_semi")
                 .groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "ids")
    side = ids.select("doc_id").distinct()
    if ids.count() <= BROADCAST:  # a few megabytes; beyond that the same join shuffles
        side = F.broadcast(side)
    found = full_sets(_narrow(docs).join(side, "doc_id", "left_semi"), k)
    return stored(found.join(ids.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "sets")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, digest, label, m (size) of the buckets of three members or more that stand in more than one component."""
    named = (members.select("key", "digest").join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left")
             .select("key", "digest", F.coalesce("label", "digest").alias("label")))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"))
    return stored(named.join(mixed.where("lo <> hi and m > 2").select("key", "m"), "key"), "mixed")


def _small(mixed: DataFrame) -> DataFrame:
    """All pairs of different components of buckets of at most SMALL members: a bounded number for each member."""
    rows = mixed.where(F.col("m") <= SMALL)
    other = rows.select(F.col("key").alias("k2"), F.col("digest").alias("d2"), F.col("label").alias("l2"))
    return (rows.join(other, (F.col("key") == F.col("k2")) & (F.col("digest") < F.col("d2")) & (F.col("label") != F.col("l2")))
            .select(*_ordered("digest", "d2")))


def _against_pivots(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """p, y, n, np, ip, extra: each member y of a large bucket against the bucket's pivot p.

    n and np are set sizes, ip the common shingles, extra those of y that p lacks.
    The pivot is the member that most mixed buckets hold, which are the plainest copies."""
    large = mixed.where(F.col("m") > SMALL)
    often = large.groupBy("digest").agg(F.count("*").alias("k"))
    pivot = large.join(often, "digest").groupBy("key").agg(F.min(F.struct((-F.col("k")).alias("k"), "digest"))["digest"].alias("p"))
    pairs = large.join(pivot, "key").select("p", F.col("digest").alias("y")).distinct()
    both = (pairs.join(sets.select(F.col("digest").alias("y"), F.col("set").alias("sy")), "y")
            .join(sets.select(F.col("digest").alias("p"), F.col("set").alias("sp")), "p"))
    return stored(both.select("p", "y", F.size("sy").alias("n"), F.size("sp").alias("np"), F.size(F.array_intersect("sy", "sp")).alias("ip"),
                              F.array_except("sy", "sp").alias("extra")), "pivots")


def _beside_pivots(against: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) under one pivot, of different components, that can reach the threshold; x is not linked with the pivot.

    A link needs ``percent / (100 + percent) * (n_x + n_y)`` common shingles and at
    most ``min(ip_x, ip_y)`` of them are the pivot's.  For y not smaller than x the
    rest, ``r`` of x's extra shingles at least, must be y's too, so y holds one of any
    ``e_x - r + 1`` of them: the rarest are joined.  For other pairs the extra ones
    that stand in another set at all bound what two sets can share."""
    name = labels.select("node", "label")
    rows = (against.join(name.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y", "left")
            .join(name.select(F.col("node").alias("p"), F.col("label").alias("lp")), "p", "left")
            .withColumns({"ly": F.coalesce("ly", "y"), "lp": F.coalesce("lp", "p")}))
    held = rows.select("p", "y", "n", "ly", F.explode("extra").alias("h"))
    shared = held.groupBy("p", "h").agg(F.count("*").alias("c")).where("c > 1")
    need = F.ceil(F.col("n") * (2 * percent / (100 + percent)) - 1e-9).cast("int")
    outside = rows.where("ly <> lp").withColumns({"e": F.size("extra"), "r": need - F.col("ip")})
    # shingles that only x has come first in the order and join with nothing
    spread = outside.where("r >= 1 and e >= r").select("p", F.col("y").alias("x"), F.col("n").alias("nx"), F.col("ly").alias("lx"), "e", "r",
                                                       F.explode("extra").alias("h")).join(shared, ["p", "h"])
    place = F.row_number().over(Window.partitionBy("p", "x").orderBy("c", "h")) + F.col("e") - F.count("*").over(Window.partitionBy("p", "x"))
    prefix = spread.withColumn("place", place).where(F.col("place") <= F.col("e") - F.col("r") + 1).select("p", "h", "x", "nx", "lx")
    found = prefix.join(held, ["p", "h"]).where((F.col("lx") != F.col("ly")) & (F.col("n") >= F.col("nx"))).select(*_ordered("x", "y"))
    slack = held.join(shared, ["p", "h"], "left_semi").groupBy("p", "y").agg(F.count("*").cast("int").alias("slack"))
    bound = lambda df: df.join(slack, ["p", "y"], "left").withColumn("slack", F.coalesce("slack", F.lit(0)))
    col = lambda k: [F.col("p").alias(f"p{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("y", "n", "ip", "ly", "slack"))]
    left, right = bound(outside).select(*col(1), "r"), bound(rows).select(*col(2))
    common = F.least("ip1", "ip2") + F.least("slack1", "slack2")
    other = left.join(right, (F.col("p1") == F.col("p2")) & (F.col("ly1") != F.col("ly2")) & ((F.col("n2") < F.col("n1")) | (F.col("r") < 1))
                      & (common * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)).select(*_ordered("y1", "y2"))
    return found.union(other)


def _linked(docs: DataFrame, k: int, percent: int, own: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and node and label of all digests that are linked with another."""
    sketch = stored(sketches(docs, k, percent, own), "sketch")
    some = sketch.where("digest is not null and doc_id is not null")
    rows = some.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("digest", F.explode("r.bands").alias("key"))
    rows = stored(rows, "buckets")
    buckets = stored(rows.groupBy("key").agg(F.min("digest").alias("a"), F.count("*").alias("m")).where("m > 1").select("key", "a"), "shared")
    members = stored(rows.join(F.broadcast(buckets) if buckets.count() <= BROADCAST else buckets, "key"), "members")
    tested = stored(members.where("a <> digest").select("a", F.col("digest").alias("b")).distinct(), "stars")
    full = _fetch(docs, sketch, members.select("digest").distinct(), k)
    links = stored(confirmed(tested, full, percent), "links")
    labels = components(links)
    mixed = _mixed(members, labels)
    against = _against_pivots(mixed, full)
    reach = F.col("ip") * 100 >= (F.col("n") + F.col("np") - F.col("ip")) * percent
    more = stored(against.where((F.col("p") != F.col("y")) & reach).select(*_ordered("p", "y")).distinct(), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    tested = tested.union(against.select(*_ordered("p", "y")))
    pairs = stored(_small(mixed).union(_beside_pivots(against, labels, percent)).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    rest = stored(confirmed(pairs, full, percent), "rest")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    return sketch, labels


def _first(rows: DataFrame, labels: DataFrame, first) -> DataFrame:
    """digest, label and the least ``first`` of its rows; copies meet in a partial aggregate, so a hot digest is one row in the join."""
    return rows.groupBy("digest").agg(F.min(first).alias("first")).join(
        labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    sketch, labels = _linked(docs, k, percent)
    lowest = _first(sketch.where("digest is not null and doc_id is not null"), labels, "doc_id")
    by_digest = lowest.join(lowest.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("digest", "component_id")
    out = sketch.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, repeats: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group the one with the smallest doc_id (null last), then digest.

    Rows that repeat that row's doc_id and set stay with it; without ``repeats`` one row of each group does."""
    row = fresh(docs, "row")
    # written once, so that a row has the same number in every pass
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    nodes = keyed.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    sketch, labels = _linked(nodes, k, percent, ("id",))
    some = sketch.where("digest is not null").select("digest", "id", F.col("doc_id").alias("node"))
    best = _first(some, labels, F.struct(F.col("id").isNull().alias("last"), "id", "digest", "node"))
    stay = best.groupBy("label").agg(F.min("first").alias("f")).select("f.node", "f.id", "f.digest")
    gone = some.join(stay.select("node"), "node", "left_anti")
    if repeats:
        gone = gone.join(stay.select("digest", "id"), ["digest", "id"], "left_anti")
    gone = gone.select(F.col("node").alias(row))
    return keyed.join(gone, row, "left_anti").select(*(keyed[c] for c in docs.columns))
