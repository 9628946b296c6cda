"""Operators 11, 12 and 13 against brute force."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import periodic_runs, spelling_kd, warc_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


# ---- WARC ---------------------------------------------------------------------------

ODD = ["", "a", "x\r\n\r\ny", "\r\n\r\n", "\r", "\r\n\r\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "é日本😀" * 50,
       "line\n" * 40, "\n\n\r\n" * 9, "z" * 5000, "q\r\n\r\n" * 400]


def page_rows():
    rows = [(k, f"http://a/{k}", x) for k, x in enumerate(ODD)]
    rows += [(100, "http://b\r\nX: y", "a"), (50, None, "a"), (50, "u", "a"), (None, "u", "a"), (None, None, None), (7, "u", ODD[7]), (-3, "u", "a" * 17)]
    return rows


def warc_brute(rows):
    out = []
    for k, (i, _, x) in enumerate(rows):
        data = (x or "").encode()
        same = [(j is None, j if j is not None else 0, n) for n, (j, _, y) in enumerate(rows) if (y or "") == (x or "")]
        first = min(same)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first[2] == k else "revisit",
                    None if first[2] == k or first[0] else first[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [7, 64, warc_chunks.CHUNK])
def test_warc_round_trip(spark, tmp_path, limit):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, record long, again string").coalesce(2)
    path = str(tmp_path / "w")
    warc_chunks.write_archives(pages, path, limit=limit)
    got = warc_chunks.read_archives(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == warc_brute(rows)
    ids = {r["record_id"] for r in got}
    assert len(ids) == len(rows) and all(r["refers_to_id"] in ids for r in got if r["record_type"] == "revisit")
    assert {r["url"] for r in got if r["page_id"] == 100} == {"http://b%0D%0AX: y"}
    texts = {}
    for r in warc_chunks.read_payloads(spark, path).orderBy("record_id", "chunk").collect():
        texts[r["record_id"]] = texts.get(r["record_id"], "") + r["data"]
    assert sorted(texts.values()) == sorted({x or "" for _, _, x in rows})
    if limit == 64:
        assert max(r["segments"] for r in got) == len(list(warc_chunks.cuts(memoryview(ODD[-2].encode()), 64)))


def test_warc_digest_and_faults(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_chunks.digest(empty).collect() == []
    got = warc_chunks.digest(spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1))
    assert sorted(map(tuple, got.collect()), key=str) == warc_brute(page_rows())
    # payloads under the bound are responses all
    path = str(tmp_path / "w")
    warc_chunks.write_archives(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), path, min_bytes=2)
    assert {r["record_type"] for r in warc_chunks.read_archives(spark, path).where("payload_bytes < 2").collect()} == {"response"}
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha1:AAAA"
    with pytest.raises(ValueError, match="differs"):
        list(warc_chunks.records(warc_chunks.parse([head, b"abc"])))
    with pytest.raises(ValueError, match="longer"):
        list(warc_chunks.parse([head, b"abcd"]))
    with pytest.raises(ValueError, match="ends before"):
        list(warc_chunks.parse([head, b"ab"]))


def test_warc_hot_payload(spark):
    """A third of all pages hold one payload; chunks are cut between code points and carry digests of what came so far."""
    pages = spark.range(6000).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 = 1, 'same', concat('p', id)) AS html")
    got = warc_chunks.digest(pages).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 4001, "revisit": 1999}
    rows = warc_chunks.chunk_table(spark.createDataFrame([(1, "u", "aé日" * 9)], "page_id long, url string, html string"), 5).orderBy("chunk").collect()
    so_far = ""
    for r in rows:
        so_far += r["data"]
        assert len(r["data"].encode()) <= 5 and r["upto_bytes"] == len(so_far.encode())
        assert r["upto_sha1"] == base64.b32encode(hashlib.sha1(so_far.encode()).digest()).decode()
    assert so_far == "aé日" * 9 and [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]


# ---- periodic runs ------------------------------------------------------------------

def runs_brute(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q):
                out.setdefault((i, n), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, out = rng.choice([1, 2, 3, 30]), []
    for _ in range(rng.randint(0, 6)):
        base = [rng.randrange(k) for _ in range(rng.randint(1, rng.choice([3, 10, 40, 150])))]
        out += [base[i % len(base)] for i in range(rng.randint(1, len(base) * rng.choice([1, 3, 5, 9])))]
    return out


def test_runs_of_random_rows():
    rng = random.Random(4)
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        ids = np.array([x for d in docs for x in d], np.int64)
        parent = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = list(zip(*(x.tolist() for x in periodic_runs.find(ids, parent, len(docs))), strict=True))
        assert got == [(k, *r) for k, d in enumerate(docs) for r in runs_brute(d)]


def test_long_periods_and_thue_morse():
    """Periods of many scales; a row whose halves fool sums of powers has no run with these exponents."""
    rng = np.random.default_rng(3)
    for q in (8, 9, 16, 17, 100, 1000):
        ids = np.concatenate([rng.integers(0, 9, 50), np.tile(rng.integers(0, 50, q), 4), rng.integers(100, 900, 70)])
        _, start, length, period = periodic_runs.find(ids, np.zeros(len(ids), np.int64), 1)
        assert (q in period) and all(n >= 4 * p for n, p in zip(length, period, strict=True))
    morse = np.array([bin(k).count("1") % 2 for k in range(1 << 14)])
    assert len(periodic_runs.find(morse, np.zeros(len(morse), np.int64), 1)[0]) == 0


def test_runs_with_equal_hashes(monkeypatch):
    """Where different blocks share a hash, a stretch that fails the comparison is scanned directly."""
    monkeypatch.setattr(periodic_runs, "BASES", (1, 1))  # a block's hash is the sum of its words' hashes
    rng = random.Random(9)
    for _ in range(40):
        docs = [random_words(rng) for _ in range(3)]
        ids = np.array([x for d in docs for x in d], np.int64)
        parent = np.repeat(np.arange(3), [len(d) for d in docs])
        want = {(k, *r) for k, d in enumerate(docs) for r in runs_brute(d)}
        assert set(zip(*(x.tolist() for x in periodic_runs.find(ids, parent, 3)), strict=True)) <= want


def echo(w, h):
    n = len(w)
    if h is None or h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def runs_row(i, text):
    w = echo(WORD.findall(text or ""), None if i is None else zlib.crc32(str(i).encode()))
    runs = runs_brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_table(spark, odd_docs, no_docs, odd_rows, real_docs):
    short = [r for r in odd_rows if len(r[1] or "") < 100_000 or " " not in r[1]]
    got = periodic_runs.digest(odd_docs.where("text IS NULL OR length(text) < 100000 OR instr(text, ' ') = 0"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((runs_row(*r) for r in short), key=str)
    assert periodic_runs.digest(no_docs).collect() == []
    some = [(r["doc_id"], r["text"]) for r in real_docs.where("length(text) < 20000").collect()]
    got = periodic_runs.digest(real_docs.where("length(text) < 20000"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((runs_row(*r) for r in some), key=str)
    long = "na " * 200_000 + "x"
    r = periodic_runs.find_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 200_000, 1)] and r["collapsed"] == "na x"


# ---- spelling -----------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling_brute(rows):
    n = Counter()
    for i, text in rows:
        for run in LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    rest = {}
    for w in n:
        for k in range(len(w)):
            rest.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)
    out, forms = [], {}
    near_of = {w: set() for w in n}
    for (_, d), group in rest.items():
        for w in group:
            near_of[w] |= group - {w}
            if d in n:
                near_of[w].add(d)
                near_of[d].add(w)
    for w, k in n.items():
        best = min(near_of[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * k else None
    for w, k in n.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, k, len(near_of[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def found(docs, **more):
    return sorted(tuple(r) for r in spelling_kd.group_variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_and_crc(odd_rows):
    data, begin, size, points, parent = spelling_kd.tokens(pa.array([t for _, t in odd_rows]))
    got = [(int(p), data[b:b + n].tobytes().decode(), int(c)) for b, n, c, p in zip(begin, size, points, parent, strict=True)]
    want = [(k, w, len(w)) for k, (_, t) in enumerate(odd_rows) for w in LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert got == want
    state = np.full(len(begin), zlib.crc32(b"12:"), np.uint32)
    assert spelling_kd.crcs(data, begin, size, state).tolist() == [zlib.crc32(b"12:" + w.encode()) for _, w, _ in want]


@pytest.mark.parametrize("keyed", [0, 20_000])
def test_cell_search(monkeypatch, keyed):
    monkeypatch.setattr(spelling_kd, "KEYED", keyed)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 7))) for _ in range(1500)})
    for length in (5, 6, 7):
        own, shorter = ([w for w in words if len(w) == n] for n in (length, length - 1))
        home, same = own[:len(own) // 2], own[len(own) // 2:]
        got, count = set(), 0
        for kind, q, w in spelling_kd.search_cell(*([x.encode("latin-1") for x in p] for p in (home, same, shorter))):
            asked = home + same if kind == "same" else shorter
            pairs = [(asked[a], home[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)]
            got |= set(pairs)
            count += len(pairs)
        assert got == {(a, b) for a in own + shorter for b in home if near(a, b)} and count == len(got)


def test_spelling_table(spark, odd_docs, no_docs, odd_rows, real_docs):
    for docs, rows in ((odd_docs, odd_rows), (real_docs, [(r["doc_id"], r["text"]) for r in real_docs.collect()])):
        assert found(docs) == spelling_brute(rows)
    assert found(real_docs, cell=100) == spelling_brute(rows)  # many cells
    assert found(no_docs) == []


def test_spelling_chains(spark):
    """Forms of forms, ties, words of one vector in large groups, long words."""
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "straße": 5, "strasse": 9, "strase": 5, "strabe": 5,
             "z" * 400: 3, "z" * 401: 6}
    rng = random.Random(6)
    for _ in range(400):
        words.setdefault("".join(rng.sample("abcdefg", 7)), 3)
        words.setdefault("".join(rng.sample("abcdefgh", 8)), rng.choice([3, 7]))
    text = " ".join(f"{w} " * n for w, n in words.items())
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert found(docs) == found(docs, cell=20) == spelling_brute([(5, text)])
