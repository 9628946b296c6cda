"""Spelling variants of the words of a corpus, by k-d trees over letter-count vectors.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z made small that have
``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences at least.  Two words are near if
they differ by exactly one inserted, deleted or replaced code point; a word's form is its
near word of largest count, if that is twice its own at least.

One edit changes the letter-count vector by 2 in L1 distance between words of one length,
by 1 between lengths that differ by one, so only words with such vectors are compared.

* Words are counted in numpy by slices, then by a partial aggregation.
* An upper k-d tree for each length deals the words out in cells.  It is fitted on a
  sample of at most ``SAMPLE`` words of up to 64 code points; all words are dealt by it.
  A word is at home in one cell and is sent as a query to every cell of its own length
  whose box is at distance 2 at most, and of the next length at distance 1 at most.
* A cell builds a k-d tree over the distinct vectors at home there and searches it with
  all its queries at once, pruning by the bounding boxes of the nodes.
* Vector pairs at the right distance give word pairs, whose letter order is verified in
  numpy blocks of bounded size; large groups of words with one vector are verified by
  looking up edited words instead, so that no group is paired with another in full.
* A cell returns one row a word (number of near words, best form), never the pairs.

Chains of forms end after 63 steps at most, as counts double at each; roots are found by
doubling pointers over the words that have a form.

Defined cases: null and empty texts have no words; a null doc_id stands as an empty text
in the rule that deletes a code point; repeated rows count each; ties between forms go to
the word first in code-point order; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored, text_bytes

MIN_LENGTH = 5
MIN_COUNT = 3
EVERY = 97  # one word of a document in so many loses a code point
SAMPLE = 200_000
CELL = 16_000
LEAF = 24
PAIRS = 1_000_000
KEYED = 20_000  # word pairs of one vector pair beyond which edited words are looked up
DIMS = 26 + 64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIM = np.zeros(256, np.int64)  # Latin-1 byte -> dimension
_DIM[0x61:0x7B] = np.arange(26)
_DIM[0xC0:0x100] = 26 + np.arange(64)


@functools.lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


# ---- words and counts ---------------------------------------------------------------

def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words one after the other, their first bytes, byte lengths, code points and text numbers."""
    data, offs = text_bytes(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data).astype(np.uint8)
    wide = data == 0xC3  # first byte of exactly the code points C0 to FF
    inside = _ASCII[data] | wide
    inside[1:] |= wide[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    parent = np.searchsorted(offs, at, side="right") - 1
    seen = np.concatenate([[0], np.cumsum(inside)])
    begin = seen[at]
    size = np.diff(np.append(begin, seen[-1]))
    lead = np.concatenate([[0], np.cumsum(wide[inside])])
    points = size - (lead[begin + size] - lead[begin])
    return data[inside], begin, size, points, parent


def crcs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each word, carried on from the crc32 of what stands before it."""
    table = _crc_table()
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    short = np.flatnonzero(size <= 64)
    for j in range(int(size[short].max(initial=0))):
        short = short[size[short] > j]
        s = out[short]
        out[short] = table[(s ^ data[begin[short] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > 64):
        out[k] = zlib.crc32(data[begin[k]:begin[k] + size[k]], int(state[k]))
    return out


def _count(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    data, begin, size, points, parent = tokens(rows.column("text"))
    long = np.flatnonzero(points >= MIN_LENGTH)
    if not len(long):
        return None
    begin, size, parent = begin[long], size[long], parent[long]
    before = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in rows.column("doc_id").to_pylist()], np.uint32)
    h = crcs(data, begin, size, before[parent])
    hit = h % EVERY == 0
    edited: Counter[str] = Counter()
    for k in np.flatnonzero(hit):
        word = data[begin[k]:begin[k] + size[k]].tobytes().decode()
        cut = int(h[k]) % len(word)
        if len(word) > MIN_LENGTH:
            edited[word[:cut] + word[cut + 1:]] += 1
    begin, size = begin[~hit], size[~hit]
    ends = np.cumsum(size)
    flat = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat))
    found = pc.value_counts(words)
    names, n = found.field("values"), found.field("counts")
    return pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array(list(edited), pa.string())]),
                                       pa.concat_arrays([n, pa.array(list(edited.values()), pa.int64())])], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words long and frequent enough."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (map_slices(chosen, "text", "word string, n long", lambda: _count)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


# ---- letter counts and cells --------------------------------------------------------

def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of Latin-1 words, one row a word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = _DIM[np.frombuffer(b"".join(words), np.uint8)]
    cell = np.repeat(np.arange(len(words)), size) * DIMS + flat
    return np.bincount(cell, minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.int32 if size.max(initial=0) > 30_000 else np.int16)


def best_split(x: np.ndarray) -> tuple[int, int] | None:
    """Dimension and count that halve the rows best (rows with at most that count go left)."""
    best = None
    n = len(x)
    for dim in np.flatnonzero(x.max(0) > x.min(0)):
        values, sizes = np.unique(x[:, dim], return_counts=True)
        left = np.cumsum(sizes)[:-1]
        k = int(np.abs(2 * left - n).argmin())
        off = abs(2 * int(left[k]) - n)
        if best is None or off < best[0]:
            best = (off, int(dim), int(values[k]))
    return None if best is None else best[1:]


def upper_tree(x: np.ndarray, leaf: float) -> tuple:
    """Nested (dimension, count, left, right), or () where at most ``leaf`` rows are left or none differ."""
    split = best_split(x) if len(x) > leaf else None
    if split is None:
        return ()
    low = x[:, split[0]] <= split[1]
    return (*split, upper_tree(x[low], leaf), upper_tree(x[~low], leaf))


def cells(tree: tuple, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells of the upper tree whose boxes are within L1 distance ``radius`` (0: the cell at home)."""
    rows, out = [], []
    top = int(np.iinfo(np.int32).max)

    def down(node, which, far, low, high, name):
        if not len(which):
            return
        if not node:
            rows.append(which)
            out.append(np.full(len(which), name, np.int64))
            return
        dim, at, left, right = node
        v = x[which, dim].astype(np.int64)
        lo, hi = low.get(dim, 0), high.get(dim, top)
        was = np.maximum(lo - v, 0) + np.maximum(v - hi, 0)
        for child, a, b, bit in ((left, lo, at, 0), (right, at + 1, hi, 1)):
            now = far - was + np.maximum(a - v, 0) + np.maximum(v - b, 0)
            near = now <= radius
            down(child, which[near], now[near], low | {dim: a}, high | {dim: b}, 2 * name + bit)

    down(tree, np.arange(len(x)), np.zeros(len(x), np.int64), {}, {}, 1)
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_cells(vocab: DataFrame, cell: int, sample: int = SAMPLE) -> dict[int, tuple]:
    """Upper tree of each length whose words fill more than a cell."""
    sizes = vocab.groupBy(F.length("word").alias("length")).count().where(F.col("count") > cell).collect()  # one row a length
    total = sum(r["count"] for r in sizes if r["length"] <= 64)
    if not total:
        return {}
    share = min(1.0, sample / total)
    lengths = [r["length"] for r in sizes if r["length"] <= 64]
    drawn = vocab.where(F.length("word").isin(lengths) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
    by: dict[int, list[bytes]] = {}
    for word in drawn.select("word").limit(2 * sample).toArrow().column("word").to_pylist():  # about ``sample`` words
        by.setdefault(len(word), []).append(word.encode("latin-1"))
    return {k: upper_tree(vectors(sorted(w)), max(16.0, cell * share)) for k, w in by.items()}


def dealt(vocab: DataFrame, trees: dict[int, tuple]) -> DataFrame:
    """length, cell, home, word, n: each word at home once, and as a query wherever a near word may be at home."""
    trees = vocab.sparkSession.sparkContext.broadcast(trees)  # about one node a cell, of at most SAMPLE / 16

    def run(batches):
        for b in batches:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            x = vectors(words)
            out = []
            for length in np.unique(size):
                own = np.flatnonzero(size == length)
                home = cells(trees.value.get(int(length), ()), x[own], 0)
                at = np.zeros(len(own), np.int64)
                at[home[0]] = home[1]
                out.append((own, length, at, True))
                for other, radius in ((length, 2), (length + 1, 1)):
                    k, c = cells(trees.value.get(int(other), ()), x[own], radius)
                    keep = (c != at[k]) | (other != length)
                    out.append((own[k[keep]], other, c[keep], False))
            take = pa.array(np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(o[0]), o[1], np.int64) for o in out]) if out else [], pa.int64()),
                 pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()),
                 pa.array(np.concatenate([np.full(len(o[0]), o[3]) for o in out]) if out else [], pa.bool_()),
                 b.column("word").take(take), b.column("n").take(take)], names=["length", "cell", "home", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "length long, cell long, home boolean, word string, n long")


# ---- search inside a cell -----------------------------------------------------------

class Tree:
    """k-d tree over distinct vectors; ``search`` prunes by the nodes' bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, which, leaf):
        x = self.points[which]
        split = best_split(x) if len(which) > leaf else None
        if split is None:
            return x.min(0), x.max(0), which, None
        low = x[:, split[0]] <= split[1]
        return x.min(0), x.max(0), None, (self._build(which[low], leaf), self._build(which[~low], leaf))

    def search(self, queries: np.ndarray, distance: int):
        """Blocks of (query, point) numbers at exactly this L1 distance."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (low, high, which, below), asked = todo.pop()
            q = queries[asked]
            far = (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(1)
            asked = asked[far <= distance]
            if not len(asked):
                continue
            if below is not None:
                todo += [(child, asked) for child in below]
                continue
            step = max(1, PAIRS * 4 // max(1, len(which) * self.points.shape[1]))
            for k in range(0, len(asked), step):
                some = asked[k:k + step]
                gap = np.abs(queries[some][:, None, :] - self.points[which][None]).sum(2)
                a, b = np.nonzero(gap == distance)
                if len(a):
                    yield some[a], which[b]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is the row of ``a`` with one code point more."""
    n = a.shape[1]
    head, tail = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
    p = np.where(head.all(1), n, head.argmin(1))
    s = np.where(tail.all(1), n, tail.argmin(1))
    return p + s >= n


class Groups:
    """Words by vector: ``words[order[first[v]:first[v] + size[v]]]`` have vector ``v``."""

    def __init__(self, words: list[bytes], dims: np.ndarray):
        x = np.ascontiguousarray(vectors(words)[:, dims])
        # equal vectors by one number each; two vectors with the same number would be seen and told apart in full
        key = x.astype(np.uint64) @ np.random.default_rng(13).integers(1, 1 << 63, len(dims), np.uint64)
        _, some, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.x = x[some]
        if not np.array_equal(self.x[inverse], x):
            self.x, inverse = np.unique(x, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
        self.order = np.argsort(inverse, kind="stable")
        self.size = np.bincount(inverse, minlength=len(self.x))
        self.first = np.cumsum(self.size) - self.size
        self.words = words
        self.codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)

    def of(self, v: int) -> np.ndarray:
        return self.order[self.first[v]:self.first[v] + self.size[v]]


def _keyed(a: Groups, u: int, b: Groups, v: int, same: bool):
    """Near words of two vectors, by looking edited words up."""
    gap = b.x[v].astype(np.int64) - a.x[u]
    more = a.dims[int(np.flatnonzero(gap > 0)[0])]
    known = {a.words[k] if not same else b.words[k]: k for k in (b.of(v) if same else a.of(u))}
    left, right = [], []
    if same:
        less = a.dims[int(np.flatnonzero(gap < 0)[0])]
        for k in a.of(u).tolist():
            w = a.words[k]
            for z in [z for z, c in enumerate(w) if c == less]:
                if (hit := known.get(w[:z] + bytes([more]) + w[z + 1:])) is not None:
                    left.append(k)
                    right.append(hit)
    else:
        for k in b.of(v).tolist():
            w = b.words[k]
            for hit in {known.get(w[:z] + w[z + 1:]) for z, c in enumerate(w) if c == more} - {None}:
                left.append(hit)
                right.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def near_pairs(a: Groups, b: Groups, tree: Tree, same: bool):
    """Blocks of (word of ``a``, word of ``b``) that are one edit apart; ``same``: of one length, else ``b`` is one longer."""
    check = one_replaced if same else one_inserted
    most = max(1, PAIRS * 16 // max(16, b.codes.shape[1]))
    for u, v in tree.search(a.x, 2 if same else 1):
        n = a.size[u] * b.size[v]
        for k in np.flatnonzero(n > KEYED):
            yield _keyed(a, int(u[k]), b, int(v[k]), same)
        u, v, n = u[n <= KEYED], v[n <= KEYED], n[n <= KEYED]
        part = np.cumsum(n) // most
        for p in np.unique(part):
            x, y, m = u[part == p], v[part == p], n[part == p]
            at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            x, y = np.repeat(x, m), np.repeat(y, m)
            left = a.order[a.first[x] + at // b.size[y]]
            right = b.order[b.first[y] + at % b.size[y]]
            good = check(a.codes[left], b.codes[right])
            yield left[good], right[good]


def search_cell(home: list[bytes], same: list[bytes], shorter: list[bytes]):
    """Blocks of (kind, query, word at home): queries are words at home and ``same`` (numbered on), or ``shorter`` ones."""
    used = np.zeros(256, bool)
    used[np.frombuffer(b"".join([*home, *same, *shorter]), np.uint8)] = True
    letters = np.flatnonzero(used)
    dims = _DIM[letters]
    at_home = Groups(home, dims)
    tree = Tree(at_home.x)
    at_home.dims = letters
    for kind, words in (("same", [*home, *same]), ("shorter", shorter)):
        if words:
            asking = Groups(words, dims)
            asking.dims = letters
            for q, w in near_pairs(asking, at_home, tree, kind == "same"):
                yield kind, q, w


def _search(table: pa.Table) -> pa.Table:
    """Per word of a cell: number of near words found here and the best of them."""
    length = table.column("length")[0].as_py()
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n = table.column("n").to_numpy().astype(np.int64)
    home = table.column("home").to_numpy().astype(bool)
    size = np.fromiter(map(len, words), np.int64, len(words))
    parts = [np.flatnonzero(home), np.flatnonzero(~home & (size == length)), np.flatnonzero(size == length - 1)]
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    if len(parts[0]):
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))  # Latin-1 order is code-point order
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        own = [[words[k] for k in p] for p in parts]
        queries = {"same": np.concatenate(parts[:2]), "shorter": parts[2]}
        for kind, q, w in search_cell(*own):
            q, w = queries[kind][q], parts[0][w]
            count += np.bincount(w, minlength=len(words))
            np.minimum.at(best, w, rank[q])
            if kind == "shorter":
                count += np.bincount(q, minlength=len(words))
                np.minimum.at(best, q, rank[w])
    some = np.flatnonzero(count)
    form = np.array(order)[best[some]] if len(some) else some
    return pa.table({"word": table.column("word").take(pa.array(some)), "n_near": pa.array(count[some]),
                     "form": table.column("word").take(pa.array(form)), "form_n": pa.array(n[form])})


def near_words(vocab: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n_near, form, form_n of all words with a near one; ``form`` is the near word of largest count, whatever that is."""
    trees = fit_cells(vocab, cell)
    found = dealt(vocab, trees).groupBy("length", "cell").applyInArrow(_search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, by doubling pointers (word, form of words that have one)."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):  # chains have 63 steps at most
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not now.join(step, "root", "left_semi").limit(1).count():
            break
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return now


def group_variants(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs``."""
    vocab = stored(vocabulary(docs), "vocab")
    near = near_words(vocab, cell)
    is_form = F.col("form_n") >= 2 * F.col("n")
    joined = stored(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
