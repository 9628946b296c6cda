"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import secret_links as S

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""


def _secrets() -> str:
    quoted = {k: p.replace("'", "''") for k, p in S.PATTERNS.items()}
    fits = {"assign": f"length(regexp_extract(m, '{quoted['assign']}', 2)) >= 6",
            "secret": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"}
    kinds = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(t, '{quoted[name]}', 0)) AS m, "
        f"unnest(string_split_regex(t, '{quoted[name]}')[1:len(regexp_extract_all(t, '{quoted[name]}', 0))]) AS gap, "
        f"unnest(range(len(regexp_extract_all(t, '{quoted[name]}', 0)))) AS i FROM d" for k, name in enumerate(S.KINDS))
    fit = " ".join(f"WHEN kind = {S.KINDS.index(k)} THEN {v}" for k, v in fits.items())
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(S.KINDS)) + " END"
    near = f"OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN {S.SCOPE} PRECEDING AND {S.SCOPE} FOLLOWING)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({kinds}),
placed AS (SELECT doc_id, kind, m, length(m) AS size,
  CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM found),
spans AS (SELECT doc_id, kind, stop - size AS start, stop FROM placed WHERE CASE {fit} ELSE true END),
one AS (SELECT *, sum(CAST(kind = 1 AS INT)) {near} AS access_near,
  kind >= 3 AND coalesce(max(CASE WHEN kind < 3 THEN stop END) OVER (PARTITION BY doc_id ORDER BY start, kind
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > start AS covered FROM spans),
two AS (SELECT *, sum(CAST(kind IN (0, 3) AS INT)) {near} AS secret_near FROM one WHERE NOT covered AND (kind < 3 OR access_near > 0)),
three AS (SELECT doc_id, kind, start, stop, {name} || ':' || start || ':' || stop AS s FROM two WHERE kind <> 4 OR secret_near > 0),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM three GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


SECRETS = _secrets()


_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc)"""


def _crc32(text: str) -> str:
    """crc32 of a text, with the table ``crc``."""
    return (f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({text})), '..'),
  lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c // 256, crc[1 + xor(c, b) % 256])))""")


# stretches that agree with those q words on, from equal triples of words; of several periods the smallest counts
PERIODIC_RUNS = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, tab),
m AS (SELECT r, doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM m),
place AS (SELECT r, n, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM m),
e AS (SELECT place.r, place.n, place.i, words.x FROM place JOIN words ON words.r = place.r
  AND words.i = CASE WHEN a IS NOT NULL AND place.i >= a THEN a + (place.i - a) % p ELSE place.i END),
t AS (SELECT r, n, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs),
found AS (SELECT r, q, min(i) AS start, count(*) + 2 + q AS length FROM isles GROUP BY r, q, k),
runs AS (SELECT r, start, length, min(q) AS period FROM found WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT e.r, e.i FROM e JOIN runs ON e.r = runs.r AND e.i >= runs.start + runs.period AND e.i < runs.start + runs.length),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM e ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
  CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM m LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

# near words share what is left when one code point is deleted
SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM u WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM c, tab),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
  CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
k AS (SELECT word, n, unnest(range(length(word))) AS k FROM v),
e AS (SELECT word, n, k, substr(word, 1, CAST(k AS INT)) || substr(word, CAST(k AS INT) + 2) AS rest FROM k),
near AS (
  SELECT a.word, b.word AS other, b.n FROM e a JOIN e b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT v.word, e.word, e.n FROM v JOIN e ON v.word = e.rest
  UNION SELECT e.word, v.word, v.n FROM v JOIN e ON v.word = e.rest),
best AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
  CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS reached, 1 AS step FROM f WHERE form IS NOT NULL
  UNION ALL SELECT steps.word, f.form, step + 1 FROM steps JOIN f ON f.word = steps.reached WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(reached, step) AS root FROM steps GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f LEFT JOIN last USING (word)
"""


# base32 of a SHA-1: five hexadecimal digits are four characters
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(sha, {5 * g + 1}, 5)) AS INT) // {32 ** (3 - k)} % 32, 1)"
                      for g in range(8) for k in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha, row_number() OVER () AS r FROM pages),
q AS (SELECT *, row_number() OVER o AS k, first_value(page_id) OVER o AS first_id FROM p
  WINDOW o AS (PARTITION BY payload ORDER BY page_id NULLS LAST, r))
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to FROM q
"""
