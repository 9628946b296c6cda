"""Exact token ids of whole texts through the tokenizers library, each distinct chunk encoded once.

A text is cut only where its tokenizer cannot let a token or a merge cross the
cut, so the ids of the chunks in order are the ids of the text.  Chunks (mostly
words) repeat, so a task asks the tokenizers library for each distinct chunk
once and gathers the ids with numpy.  The memo is an Arrow array of the chunks
known: one dictionary encoding of it and of the chunks of a slice finds the
known and the new ones.  It holds ``MEMO`` chunks; beyond them the half used
last stays, and so do all of the present slice.

Cuts, all in front of a byte:

* ``"space"`` (byte-level and word BPE): a space (0x20) whose neighbours are not
  white space; ``,.!?;:$#&%*)"`` after an ASCII or Latin-1 letter.  Both
  pre-tokenizers end a piece there, and neither sign is part of a special token.
* ``"piece"`` (SentencePiece BPE or unigram whose pieces hold the white space
  mark only at their start): a space whose neighbours are not white space.

Word BPE (white space dropped, each word's last id marked by the model's suffix)
takes new chunks of ASCII and Latin-1 letters many a text, a space between them.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

MEMO = 800_000
LONG = 64  # bytes; longer chunks are encoded, not kept
JOINED = 1000  # plain words a text of word BPE
SLICE = 8_000_000  # bytes of texts at a time: the memo is hashed once a slice
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
PLAIN = f"^ ?[{LETTERS}]+$"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_WS = np.zeros(256, bool)
_WS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b',.!?;:$#&%*)"')] = True
_WIDE = np.zeros(256, bool)  # first bytes of all characters over 0x7F that are white space
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAYBE = {"space": _SIGN.copy(), "piece": np.zeros(256, bool)}  # bytes that a cut may be in front of
for _table in _MAYBE.values():
    _table[0x20] = True


def cut_points(data: np.ndarray, offs: np.ndarray, cuts: str) -> np.ndarray:
    """Start bytes of all chunks, the starts of non-empty texts included."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_MAYBE[cuts][data])
    around = np.concatenate([np.zeros(3, np.uint8), data, np.full(1, 0x20, np.uint8)])  # byte i is around[i + 3]
    last, behind = around[at + 2], around[at + 4]
    space = data[at] == 0x20
    # neither the character before nor the one behind may be white space, and there is one behind
    yes = space & ~(_WS[last] | (around[at + 1] == 0xC2) | _WIDE[around[at]] | _WS[behind] | _WIDE[behind])
    if cuts == "space":
        yes |= ~space & (_LETTER[last] | (around[at + 1] == 0xC3) & (last != 0x97) & (last != 0xB7))
    cut = np.zeros(n, bool)
    cut[at[yes]] = True
    starts = offs[:-1][offs[:-1] < offs[1:]]
    # a space at the end of a text has its next text's byte behind it: not a cut, as no chunk may begin there unseen
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    cut[ends] &= data[ends] != 0x20
    cut[starts] = True
    return np.flatnonzero(cut)


def word_ends(tokenizer) -> np.ndarray | None:
    """For word BPE as described above, whether an id ends a word; else None."""
    spec = json.loads(tokenizer.to_str())
    model, norm, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    suffix = model.get("end_of_word_suffix")
    plain = (model["type"] == "BPE" and suffix and not model.get("dropout") and not model.get("unk_token")
             and not spec["truncation"] and not spec["padding"]
             and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
             and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and norm["normalizers"][1]["content"] == " "
             and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
             and pre["pretokenizers"][0]["pattern"] == {"Regex": WORDS} and pre["pretokenizers"][0]["behavior"] == "Removed"
             and pre["pretokenizers"][0]["invert"] and not pre["pretokenizers"][1]["add_prefix_space"]
             and not pre["pretokenizers"][1]["use_regex"]
             and all(not x["normalized"] and pc.match_substring_regex(x["content"], f"[^ {LETTERS}]").as_py()
                     for x in spec["added_tokens"]))
    if not plain:
        return None
    out = np.zeros(1 + max(model["vocab"].values()), bool)
    out[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return out


class Encoder:
    """Ids of texts; ``load()`` gives the tokenizer, ``parallel`` lets the tokenizers library use its own threads."""

    def __init__(self, load, cuts: str, prefix: str = "", parallel: bool = True):
        self.tokenizer, self.cuts, self.prefix, self.parallel = load(), cuts, prefix, parallel
        self.ends = word_ends(self.tokenizer)
        # the memo: chunks, where their ids begin in flat and how many they are, and the slice that used each last
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.begin, self.size, self.used, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as the library gives them, and their number in each."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.parallel else "false"
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new chunks, where they begin and how many they are."""
        size, flat = np.zeros(len(chunks), np.int64), []
        plain = np.zeros(len(chunks), bool)
        if self.ends is not None:
            plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        if n := int(plain.sum()):
            names = chunks.filter(pa.array(plain)).to_pylist()
            ids, _ = self._batch([" ".join(names[k:k + JOINED]) for k in range(0, n, JOINED)])
            size[plain] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            flat.append(ids)
        if n < len(chunks):
            ids, size[~plain] = self._batch(chunks.filter(pa.array(~plain)).to_pylist())
            flat.append(ids)
        begin = np.zeros(len(chunks), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(flat), begin, size

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of the memo one after the other, and their number in each."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[rows] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes

    def _find(self, chunks: pa.Array) -> tuple[np.ndarray, int]:
        """Rows of chunks in the memo, new ones encoded behind it; and the number of chunks known before."""
        before, self.turn = len(self.known), self.turn + 1
        found = pa.chunked_array([self.known, chunks]).dictionary_encode()
        found = found.chunk(found.num_chunks - 1)  # its dictionary: the memo, in order, and the new chunks
        rows = found.indices.to_numpy(zero_copy_only=False)
        self.known = found.dictionary
        if n := len(self.known) - before:
            flat, begin, size = self._new(self.known.slice(before))
            self.begin, self.size = np.append(self.begin, begin + len(self.flat)), np.append(self.size, size)
            self.flat, self.used = np.append(self.flat, flat), np.append(self.used, np.zeros(n, np.int64))
        self.used[rows] = self.turn
        return rows, before

    def _trim(self, before: int) -> None:
        """Long chunks among the new ones go; beyond the bounds, so do those not used lately."""
        keep = np.ones(len(self.known), bool)
        if len(self.known) > before:
            keep[before:] = pc.binary_length(self.known.slice(before)).to_numpy(zero_copy_only=False) <= LONG
        full = int(keep.sum()) > MEMO or len(self.flat) > 16 * MEMO
        if full:
            rest = len(keep) - min(MEMO, len(keep)) // 2
            keep &= self.used >= np.partition(self.used, rest)[rest]
        if full:
            kept = np.flatnonzero(keep)
            self.flat, self.size = self._gather(kept)
            self.begin, self.used = np.cumsum(self.size) - self.size, self.used[kept]
        elif not keep.all():
            self.begin, self.size, self.used = self.begin[keep], self.size[keep], self.used[keep]
        if not keep.all():
            self.known = self.known.filter(pa.array(keep))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32) and the number of ids of each text."""
        if self.prefix:
            filled = pc.fill_null(texts.cast(pa.string()), "")
            texts = pc.if_else(pc.equal(filled, ""), filled, pc.binary_join_element_wise(self.prefix, filled, ""))
        data, offs = text_bytes(texts)
        starts = cut_points(data, offs, self.cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        rows, before = self._find(pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))))
        flat, sizes = self._gather(rows)
        self._trim(before)
        upto = np.append(0, np.cumsum(sizes))
        return flat, np.diff(upto[np.searchsorted(starts, offs)])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """One more id behind the ids of each text."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)), counts + 1


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


@functools.lru_cache(maxsize=4)
def encoder(name: str, cuts: str = "space") -> Encoder:
    """Encoder of a public tokenizer file, by its name or a path; a worker process keeps it, memo and all, across tasks."""
    return Encoder(lambda: load(name), cuts, parallel=False)  # a task has one core


def load(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


def threads() -> None:
    """Where the tokenizers library encodes a batch in parallel, it does so on two threads unless the cluster says otherwise."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
