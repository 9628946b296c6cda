"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field.

Counts of the base rules (words, symbols, repeated lines, repeated three-word
windows) and the features of all lines come from one pass over the bytes of a
slice of texts.  A line with a word has ``FEATURES``; the field scores a
sequence of labels by the sum of the lines' feature weights and of the
transitions between neighbours, and Viterbi decoding gives the best sequence.
The words in content lines over all words is the content share; a document
stays when the base rules hold and the share is ``SHARE`` or more.

Fitting: exact likelihood (forward-backward in numpy) of runs of at most ``RUN``
lines of a bounded sample of labelled documents (``labelled.PER_CLASS`` a
label).  No line carries a label, so every line takes its document's: lines of
documents of quality 1 are content, of quality 0 boilerplate.  Each run gets a block of
lines of a run of the other label put in, so changes of label are learned from lines
whose labels are known.  The weights (a few hundred bytes) go to the tasks; there
is no shuffle.

Defined cases: null, empty or wordless texts have zero counts and fail the base
rules; without labels of both kinds the field calls every line content; null and
repeated doc_ids keep their rows; an empty table gives an empty result; extra
columns are not read (``keep_good`` passes them through).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, codes, map_slices, text_bytes, words

SHARE = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
RUN, STEPS = 40, 200
SLICE = 3_000_000
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "short", "log words", "echo", "repeated line", "repeated windows",
            "word length", "sentence end", "short words")


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _lut(b"#*$%&|<>")
MARK = _lut(b"!?|{}[]=_~^@\\")
DIGIT = _lut(b"0123456789")
CAPITAL = _lut(bytes(range(0x41, 0x5B)))
SMALL = _lut(bytes(range(0x61, 0x7B)))
END = _lut(b".!?:;\"')")


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring edges."""
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return np.diff(total[edges])


def _same(*keys: np.ndarray) -> np.ndarray:
    """One code for each distinct tuple of non-negative integers."""
    out = keys[0]
    for k in keys[1:]:
        out = pd.factorize(out * (int(k.max(initial=0)) + 1) + k)[0]
    return out


class Lines:
    """Base counts of the texts of a slice, and the features of their lines that hold a word."""

    def __init__(self, texts: pa.Array):
        data, offs = text_bytes(texts)
        n = len(offs) - 1
        word, parent, at = words(texts)
        which, _ = codes(word)
        lead = (data & 0xC0) != 0x80  # one byte of each code point
        solid = ~IS_SPACE[data]
        self.n_words = np.bincount(parent, minlength=n)
        self.word_chars = _sums(lead & solid, offs)
        self.n_symbols = _sums(SYMBOL[data], offs)
        # words of three-word windows that stand twice or more in the text
        repeated = np.zeros(len(which), bool)
        if len(which) > 2:
            window = parent[2:] == parent[:-2]
            triple = _same(_same(_same(which[:-2], which[1:-1]), which[2:]), parent[2:])
            triple = np.where(window, triple, -1)
            count = np.bincount(triple[window], minlength=1) if window.any() else np.zeros(1, int)
            twice = window & (count[triple] > 1)
            for k in range(3):
                repeated[k:len(which) - 2 + k] |= twice
        self.n_repeat_words = np.bincount(parent[repeated], minlength=n)
        # lines: cut at \n and at the texts' ends
        newline = np.flatnonzero(data == 10)
        edges = np.union1d(np.union1d(newline + 1, offs[:-1][offs[:-1] < offs[1:]]), [len(data)]).astype(np.int64)
        edges = edges[edges <= len(data)]
        first = edges[:-1]
        line = np.searchsorted(first, at, side="right") - 1 if len(first) else np.zeros(0, np.int64)
        size = np.bincount(line, minlength=len(first))
        kept = data != 10
        bounds = np.append(0, np.cumsum(kept))[edges].astype(np.int32) if len(data) else np.zeros(1, np.int32)
        content = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[kept])))
        code, _ = codes(content) if len(first) else (np.zeros(0, np.int64), None)
        owner = np.searchsorted(offs, first, side="right") - 1
        there = size > 0
        # positions of the lines with a word
        code, owner_kept = code[there], owner[there]
        pair = _same(code, owner_kept)
        again = pd.Series(pair).duplicated().to_numpy() if len(pair) else np.zeros(0, bool)
        self.n_dup_lines = np.bincount(owner_kept[again], minlength=n)
        self.owner, self.size = owner_kept, size[there]
        self.count = np.bincount(owner_kept, minlength=n)
        if not len(owner_kept):
            self.x = np.zeros((0, len(FEATURES)))
            return
        per = lambda flags: _sums(flags, edges)[there]
        chars = np.maximum(1, per(lead & solid))
        letters = np.maximum(1, per(CAPITAL[data] | SMALL[data]))
        number = np.cumsum(there) - 1
        number = number[line]
        echo = np.zeros(len(which), bool)
        echo[1:] = (which[1:] == which[:-1]) & (line[1:] == line[:-1])
        by_line = lambda flags: np.bincount(number[flags], minlength=len(owner_kept))
        lengths = np.diff(np.frombuffer(word.buffers()[1], np.int32, len(word) + 1))
        last = at + lengths - 1
        closing = np.zeros(len(which), bool)
        closing[-1:] = True
        closing[:-1] = line[1:] != line[:-1]
        short = lengths <= 4
        self.x = np.column_stack([
            np.ones(len(chars)), per(SYMBOL[data]) / chars, per(CAPITAL[data]) / letters, per(DIGIT[data]) / chars,
            per(MARK[data]) / chars, self.size <= 3, np.log1p(self.size) / 4, by_line(echo) / self.size, again,
            by_line(repeated) / self.size, chars / self.size / 8, by_line(closing & END[data[last]]),
            by_line(short) / self.size]).astype(np.float64)


def viterbi(emission: np.ndarray, count: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of all lines; ``count`` lines of each text lie one after the other."""
    out = np.zeros(len(emission), np.int8)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return out
    first, size = first[order], count[order]
    back = np.zeros((len(emission), 2), np.int8)
    best = emission[first] + start
    live = len(order)
    for t in range(1, int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        step = best[:live, :, None] + move[None]
        at = first[:live] + t
        back[at] = step.argmax(axis=1)
        best[:live] = step.max(axis=1) + emission[at]
    label = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))  # texts with more than t lines
        at = first[:live] + t
        out[at] = label[:live]
        label[:live] = back[at, label[:live]]
    return out


class Field:
    """Weights of the chain: emit (features, 2), move (2, 2), start (2); label 1 is content."""

    def __init__(self, weights: dict):
        self.w = weights

    def verdict(self, texts: pa.Array) -> dict:
        lines = Lines(texts)
        labels = viterbi(lines.x @ self.w["emit"], lines.count, self.w["start"], self.w["move"])
        good = np.bincount(lines.owner, weights=lines.size * (labels == 1), minlength=len(lines.n_words))
        failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT * lines.n_words)
        share = good / np.maximum(1, lines.n_words)
        return {"n_words": lines.n_words, "word_chars": lines.word_chars, "n_symbols": lines.n_symbols,
                "n_dup_lines": lines.n_dup_lines, "n_repeat_words": lines.n_repeat_words, "content_share": share,
                "base_failed": failed, "kept": ~failed & (share >= SHARE)}


def runs(sample: DataFrame) -> DataFrame:
    """order, doc_id, label and the features (flat) of up to RUN lines, spread by the doc's hash, of each sampled text."""

    def make():
        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            lines = Lines(rows.column("text"))
            first = np.cumsum(lines.count) - lines.count
            spare = np.maximum(0, lines.count - RUN)
            begin = first + np.abs(rows.column("order").to_numpy(zero_copy_only=False)) % (spare + 1)
            flat = [lines.x[b:b + min(RUN, c)].ravel() for b, c in zip(begin, lines.count, strict=True)]
            return pa.RecordBatch.from_arrays([rows.column("order"), rows.column("doc_id"), rows.column("label"),
                                               pa.array(flat, pa.list_(pa.float64()))], names=["order", "doc_id", "label", "x"])

        return work

    return map_slices(sample.select("order", "doc_id", "label", "text"), "text",
                      "order long, doc_id long, label int, x array<double>", make, SLICE)


def fit(sample: DataFrame) -> dict:
    """Weights learned from the bounded sample (its features come to the driver: a few megabytes at most)."""
    rows = sorted((r["order"], r["doc_id"], r["label"], r["x"]) for r in runs(sample).where("size(x) > 0").collect())
    d = len(FEATURES)
    w = {"emit": np.zeros((d, 2)), "move": np.zeros((2, 2)), "start": np.zeros(2)}
    if len({r[2] for r in rows}) < 2:
        w["emit"][0, 1] = 1.0
        return w
    x, y, size = spliced([(r[0], r[2], np.reshape(r[3], (-1, d))) for r in rows])
    n = len(rows)
    own = np.array([r[2] for r in rows])
    mask = np.arange(x.shape[1])[None, :] < size[:, None]
    weight = np.where(own == 1, n / (2 * (own == 1).sum()), n / (2 * (own == 0).sum())) / n
    hot = np.eye(2)[y]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    steps_true = hot[:, :-1, :, None] * hot[:, 1:, None, :] * mask[:, 1:, None, None]
    pairs_true = steps_true.sum(axis=1)
    for step in range(1, STEPS + 1):
        node, pair = marginals(x @ w["emit"], mask, w["start"], w["move"])
        # gradient of the negative log-likelihood: expected counts less true ones
        diff = (node - hot) * mask[:, :, None] * weight[:, None, None]
        grad = {"emit": np.einsum("ntd,ntk->dk", x, diff) + 1e-4 * w["emit"],
                "move": ((pair - pairs_true) * weight[:, None, None]).sum(axis=0) + 1e-3 * w["move"],
                "start": ((node[:, 0] - hot[:, 0]) * weight[:, None]).sum(axis=0) + 1e-3 * w["start"]}
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            w[k] = w[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return w


def spliced(rows: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (run, line, feature), labels (run, line) and lengths of the runs (order, label, features).

    Each run has a block of up to half of ``RUN`` lines of a run of the other label inside it, or at either end; where
    that makes it longer than ``RUN``, its own last lines go.  Place, length and partner follow from the run's order."""
    other = {k: [r[2] for r in rows if r[1] != k] for k in (0, 1)}
    runs_, labels = [], []
    for k, (order, label, own) in enumerate(rows):
        lines, kind = own, np.full(len(own), label)
        if other[label]:
            h = order & 0x7FFFFFFFFFFFFFFF
            guest = other[label][h % len(other[label])]
            m = 1 + h // 7 % min(len(guest), RUN // 2)
            first = h // 101 % (len(guest) - m + 1)
            own = own[:RUN - m]
            at = h // 977 % (len(own) + 1)
            lines = np.concatenate([own[:at], guest[first:first + m], own[at:]])
            kind = np.concatenate([np.full(at, label), np.full(m, 1 - label), np.full(len(own) - at, label)])
        runs_.append(lines)
        labels.append(kind)
    size = np.array([len(r) for r in runs_])
    x, y = np.zeros((len(rows), int(size.max()), len(FEATURES))), np.zeros((len(rows), int(size.max())), np.int64)
    for k, (lines, kind) in enumerate(zip(runs_, labels, strict=True)):
        x[k, :size[k]], y[k, :size[k]] = lines, kind
    return x, y, size


def marginals(emission: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each line and expected transitions of each run, by forward-backward in logarithms."""
    n, length, _ = emission.shape
    fore = np.zeros((n, length, 2))
    fore[:, 0] = emission[:, 0] + start
    for t in range(1, length):
        step = np.logaddexp(fore[:, t - 1, :1] + move[0], fore[:, t - 1, 1:] + move[1]) + emission[:, t]
        fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
    total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
    behind = np.zeros((n, length, 2))
    pair = np.zeros((n, 2, 2))
    for t in range(length - 2, -1, -1):
        ahead = emission[:, t + 1] + behind[:, t + 1]
        step = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        behind[:, t] = np.where(mask[:, t + 1, None], step, behind[:, t + 1])
        both = np.exp(fore[:, t, :, None] + move[None] + ahead[:, None, :] - total[:, None, None])
        pair += np.where(mask[:, t + 1, None, None], both, 0)
    node = np.exp(fore + behind - total[:, None, None])
    return node * mask[:, :, None], pair


KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
         "content_share": "double", "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, weights: dict) -> DataFrame:
    """Per row: doc_id and ``KINDS``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        field = Field(weights)

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = field.verdict(rows.column("text"))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[k]) for k in KINDS)], names=["doc_id", *KINDS])

        return work

    return map_slices(narrow, "text", "doc_id long, " + ", ".join(f"{k} {v}" for k, v in KINDS.items()), make, SLICE)


def keep_good(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""

    def make():
        field = Field(weights)
        return lambda rows: rows.filter(pa.array(field.verdict(rows.column("text"))["kept"]))

    return map_slices(docs, "text", docs.schema, make, SLICE)
