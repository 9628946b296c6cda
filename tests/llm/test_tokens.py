"""Operators 1, 2 and 8 against whole-text calls of the libraries."""
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import encoding, packing, token_files
from ledgerlens.llm import sentencepiece_codec as sp

ALPHABET = ["a", "b ", "  ", "\n", " é", "É", "ß", "Σ", ",", ".", " $", "$$", "'s", "'", " ", "　", " ", "“", "x", "<|endoftext|>",
            "<s>", "12", "\t", "▁", "́", "<", "|", ">", "\u0085", "日本", "😀", "-", ")", '"', "the ", "ing", "\x1c"]
TEXTS = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join) | st.none(), max_size=8)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def whole(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_chunks_give_the_ids_of_whole_texts(name, texts):
    ids, counts = encoding.encoder(name).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][:len(texts)] == whole(name, texts)


@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_sentencepiece_parity(texts):
    codec, lib = sp.codec_of(sp.read_model("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, counts = codec.encode(pa.array(texts, pa.string()))
    want = [lib.encode(x or "") for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][:len(texts)] == want
    assert [x.decode("utf-8", "replace") for x in codec.decode(ids, counts)] == [lib.decode(x) for x in want]


def _field(number, kind, payload):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out
    return varint(number << 3 | kind) + (varint(payload) if kind == 0 else payload if kind == 5 else varint(len(payload)) + payload)


def test_unigram_scores_and_byte_fallback():
    """A unigram model put together by hand: same ids as the SentencePiece library."""
    import struct
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] + [
        ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -2.9, 1), ("ba", -4.0, 1), ("▁a", -3.1, 1)]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, 1) + _field(35, 0, 1) + _field(40, 0, 0)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 1))
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sp.Codec(data)
    assert codec.chunks is None and codec.model["unigram"] and codec.model["byte_fallback"]
    for text in ("ab", "abba ab", " a  b ", "aé b", "", "ba ab"):
        ids, _ = codec.encode(pa.array([text]))
        assert ids.tolist() == lib.encode(text), text


@pytest.mark.parametrize("fallback", [0, 1])
@settings(max_examples=80, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b", "ab", " ", "<s>", "</s>", "<unk>", "<0x41>", "<", "0x", "é", "abb", "s", ">", "日", "<<s>"]), max_size=12).map("".join))
def test_control_unknown_unused_and_byte_pieces_never_match_text(fallback, text):
    import struct
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("abb", -0.1, 5)] + ([(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] if fallback else []) + [
        ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("<", -4.0, 1), ("s", -3.5, 1), ("▁a", -3.1, 1), ("0x", -5.0, 1)]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, 1) + _field(35, 0, fallback) + _field(40, 0, 0)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 1))
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sp.codec_of(data)
    ids, counts = codec.encode(pa.array([text]))
    want = lib.encode(text)
    assert ids.tolist() == want
    assert [x.decode("utf-8", "replace") for x in codec.decode(ids, counts)] == [lib.decode(want)]


def test_sentencepiece_table(spark, odd_docs, no_docs, odd_rows):
    got = sp.encode_decode(odd_docs).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, crc(lib.encode(t or ""))) for i, t in odd_rows), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in got), key=str) == want
    assert all(r["round_trip"] for r in got)
    assert sp.digest(no_docs).collect() == []


def test_token_files(spark, odd_docs, no_docs, odd_rows, real_docs, tmp_path):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (i, _), ids in zip(rows, whole("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        want.append((i, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    got = token_files.digest(odd_docs)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_files.digest(no_docs).collect() == []
    path = str(tmp_path / "files")
    token_files.write_token_files(real_docs, path)
    some = token_files.read_tokens(spark, path, 10, 14).collect()
    assert sorted(r["doc_id"] for r in some) == [10, 11, 12, 13, 14]
    import glob

    import pyarrow.parquet as pq
    meta = pq.ParquetFile(next(f for f in glob.glob(path + "/*.parquet") if pq.ParquetFile(f).metadata.num_rows)).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    tokens = next(v for k, v in columns.items() if k.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings) and tokens.has_column_index and tokens.has_offset_index


def test_packing(spark, odd_docs, no_docs, odd_rows):
    got = packing.digest(odd_docs).collect()
    assert packing.digest(no_docs).collect() == []
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    want = []
    for (i, _), ids in zip(odd_rows, whole("byte_bpe_50k.json", [t for _, t in odd_rows]), strict=True):
        ids = [*ids, 1]
        left, at = len(ids), 0
        while left:
            n = min(2048, 1 << (left.bit_length() - 1))
            want.append((i, at, n, crc(ids[at:at + n]), len(ids)))
            at, left = at + n, left - n
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] is not None) == sorted(
        x for x in want if x[0] is not None)
    assert sorted(r["ids_crc32"] for r in got) == sorted(x[3] for x in want)


def test_new_words_reach_the_library_many_a_text(monkeypatch):
    """Word BPE: plain new words are joined, each distinct chunk goes to the library once, and a small memo changes no id."""
    monkeypatch.setattr(encoding, "MEMO", 40)
    own, sent = encoding.Encoder(lambda: encoding.load("word_bpe_49k.json"), "space", parallel=False), []

    class Library:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return inner.encode_batch_fast(texts, **options)

    inner, own.tokenizer = own.tokenizer, Library()
    texts = [" ".join(f"{'aäßÉ'[k % 4]}{chr(97 + k // 26)}{chr(97 + k % 26)}Wort" for k in range(300)), "", "H̱ İx 12 a</w>b " + "y" * 90]
    for part in ([texts[0], None, texts[0]], texts, [texts[2]], texts[::-1]):
        ids, counts = own.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole("word_bpe_49k.json", part)
    ids, _ = own.encode(pa.array([texts[1]]))
    assert not len(ids) and len(own.known) <= 310
    sent.clear()
    own.encode(pa.array([" ".join(f"neu{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500))] * 3))
    assert len(sent) == 1 and len(sent[0].split()) == 500
