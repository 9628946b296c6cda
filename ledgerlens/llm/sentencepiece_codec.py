"""SentencePiece models on the tokenizers library.

``parse`` reads the model protobuf (wire format, the fields used here only):
pieces with score and kind, model kind, byte fallback, normaliser.  ``build``
makes the tokenizer:

* normaliser: the precompiled character map, if the model has one, collapsed
  white space where the model says so, then the white space mark ``U+2581``
  for spaces and in front of the text;
* unigram models keep their scores; BPE models get merges from the scores: every
  split of a piece into two pieces, ranked by the score of the whole;
* byte fallback for characters without a piece;
* decoder: byte pieces back to characters, marks to spaces, one space less in front.

``encode_decode`` runs it over a table, batches multithreaded inside the library
(``RAYON_NUM_THREADS``).  Where a model's pieces hold the mark only at their
start and its normaliser changes nothing, distinct chunks are encoded once
(``encoding``); else whole texts are.

Defined cases: null and empty texts give no id; null and repeated doc_ids keep
their rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, map_slices
from .encoding import Encoder, crc32, threads

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in the protobuf


def _fields(data: bytes):
    """Field number and value of a protobuf message: int, float (4 bytes) or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at:at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {key & 7} is not part of a SentencePiece model")


def parse(data: bytes) -> dict:
    """Pieces [(text, score, kind)], unigram, byte_fallback, unk_id, charsmap, dummy_prefix, collapse."""
    model = {"pieces": [], "unigram": True, "byte_fallback": False, "unk_id": 0, "charsmap": b"",
             "dummy_prefix": True, "collapse": True}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            model["pieces"].append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            if spec.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models")
            model |= {"unigram": spec.get(3, 1) == 1, "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0)}
        elif number == 3:
            spec = dict(_fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "collapse": bool(spec.get(4, 1))}
    return model


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges of a BPE model: every split of a piece into two pieces, best scores of the whole first."""
    ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for p, k in ids.items():
        splits = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        found += [(-pieces[k][1], k, ids[a], ids[b], a, b) for a, b in splits]
    return [x[4:] for x in sorted(found)]


def build(data: bytes):
    """Tokenizer of the tokenizers library for the model ``data``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    model = parse(data)
    pieces = model["pieces"]
    if model["unigram"]:
        # only normal and user pieces may match text: the others are kept under names with a space, which no normalised text
        # holds, and under a score that leaves the least one (the unknown piece's measure) to the normal pieces
        best = max([s for _, s, kind in pieces if kind == NORMAL], default=0.0)
        core = models.Unigram([(p, s) if kind in (NORMAL, USER) else (f" {p}", best) for p, s, kind in pieces], model["unk_id"], False)
    else:
        core = models.BPE({p: k for k, (p, _, _) in enumerate(pieces)}, merges(pieces),
                          unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["collapse"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model["dummy_prefix"] else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                           *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER])
    return tokenizer


def chunkable(model: dict) -> bool:
    """Whether ids of chunks in order are the ids of the text: no piece crosses a single space, nothing is rewritten."""
    return (not model["charsmap"] and not model["collapse"] and model["dummy_prefix"]
            and not any(MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER)))


def read_model(path: str) -> bytes:
    import os

    import public_tokenizers
    with open(path if os.path.sep in path else public_tokenizers.path(path), "rb") as f:
        return f.read()


class Codec:
    """Encode and decode Arrow arrays of texts."""

    def __init__(self, data: bytes):
        threads()
        from tokenizers import normalizers
        self.model = parse(data)
        self.tokenizer, self.chunks = build(data), None
        if chunkable(self.model):  # the mark in front of a text comes as the first chunk's space
            self.tokenizer.normalizer = normalizers.Replace(" ", MARK)
            self.chunks = Encoder(lambda: self.tokenizer, "piece", " ")
        kinds = [k for _, _, k in self.model["pieces"]]
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN
                             else p.replace(MARK, " ").encode() for p, _, k in self.model["pieces"]], pa.binary())
        self.byte = np.array([k == BYTE for k in kinds])
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.model["pieces"]) if k == BYTE}
        self.own_bytes = self.model["unigram"] and self.model["byte_fallback"] and len(self.byte_ids) == 256

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.chunks is not None:
            return self.chunks.encode(texts)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        plain = pc.fill_null(texts.cast(pa.string()), "").to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        if self.own_bytes:  # texts with unknown stretches once more, for the tokens' own strings
            odd = [k for k, ids in enumerate(found) if self.model["unk_id"] in ids]
            for k, e in zip(odd, self.tokenizer.encode_batch([plain[k] for k in odd], add_special_tokens=False), strict=True):
                found[k] = self._fall_back(e)
        counts = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def _fall_back(self, e) -> list[int]:
        """Ids with the bytes of unknown stretches in place of the unknown piece."""
        unknown = self.model["unk_id"]
        return [i for k, text in zip(e.ids, e.tokens, strict=True) for i in
                ([self.byte_ids[b] for b in text.encode()] if k == unknown else [k])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; the space that the model puts in front is taken off."""
        parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)),
                                         self.raw.take(pa.array(ids)))
        out = pc.binary_join(parts, b"").to_pylist()
        return [x[1:] if x[:1] == b" " else x for x in out] if self.model["dummy_prefix"] else out


@functools.lru_cache(maxsize=2)
def codec_of(data: bytes) -> Codec:
    """A worker process keeps the codec, memo and all, across tasks."""
    return Codec(data)


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row: doc_id, tokens, n_tokens, n_byte_tokens, ids_crc32, decoded (text again), round_trip."""
    data = read_model(model)  # some hundred kilobytes, fixed by the model
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        codec = codec_of(data)

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(rows.column("text"), "")
            ids, counts = codec.encode(texts)
            ends = np.cumsum(counts)
            sums = [crc32(ids[i:j]) for i, j in zip(ends - counts, ends, strict=True)]
            seen = np.append(0, np.cumsum(codec.byte[ids]))
            decoded = pa.array([x.decode("utf-8", "replace") for x in codec.decode(ids, counts)], pa.string())
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), lists(ids.astype(np.int32), counts, pa.int32()), pa.array(counts),
                 pa.array((seen[ends] - seen[ends - counts]).astype(np.int64)), pa.array(sums, pa.int64()), decoded,
                 pc.equal(decoded, texts)],
                names=["doc_id", "tokens", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded", "round_trip"])

        return work

    return map_slices(narrow, "text", "doc_id long, tokens array<int>, n_tokens long, n_byte_tokens long, "
                      "ids_crc32 long, decoded string, round_trip boolean", make)


def digest(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    return encode_decode(docs, model).select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip")
