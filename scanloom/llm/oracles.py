"""DuckDB SQL of the queries that SQL can express; plain forms for small tables."""

from __future__ import annotations

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k:
    substr({_BASE32}, 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::INTEGER >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(1, len(w) - 4)),
    lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id"""

SUFFIXES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(t) - 398)) AS i FROM d WHERE octet_length(t) >= 400),
h AS (SELECT p.doc_id, p.i, md5(d.t[p.i:p.i + 399]) AS h FROM p JOIN d USING (doc_id)),
k AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
m AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true)::INTEGER AS new FROM k),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
z AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM z),
o AS (SELECT q.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS stop,
      string_agg(CASE WHEN a > before THEN hex(d.t[before:a - 1]) ELSE '' END, '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, octet_length(d.t) AS n_bytes, coalesce(o.gone, 0)::BIGINT AS n_removed, coalesce(o.spans, 0) AS n_spans,
  sha256(CASE WHEN o.doc_id IS NULL THEN d.t ELSE unhex(o.kept || CASE WHEN o.stop <= octet_length(d.t) THEN hex(d.t[o.stop:]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""

COVER_TREE = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e
JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id"""

# The checksum has no function here: a table of 256 entries by its rule, then a fold over the bytes of every distinct word.
RESAMPLING = r"""
WITH crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda x, i:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS w FROM d), y AS (SELECT unnest(w) AS w FROM b),
v AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(w))), lambda i:
    ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, n: xor(c >> 8, t[1 + (xor(c, n) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM x UNION SELECT w FROM y), crc),
s AS (SELECT bucket, count(*) AS s FROM x JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM y JOIN v USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS s, (SELECT count(*) FROM y)::DOUBLE AS t),
g AS (SELECT v.w, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * (n.s + 10000) / ((coalesce(s.s, 0)::DOUBLE + 1) * (n.t + 10000))))::BIGINT AS gain
  FROM v LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
e AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM x JOIN g USING (w) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN e ON e.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= 20)
SELECT f.*, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM f LEFT JOIN r ON r.doc_id = f.doc_id"""

PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= 100),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.f >= 100 * c.f
      AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM d),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f) AS score FROM x JOIN n ON n.lang = x.lang
      JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000"""
