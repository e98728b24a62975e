"""SQL for the queries of this subpackage that SQL can say, each by the plainest way: all pairs, all windows, all products."""

from __future__ import annotations

import zlib

# Shingles meet by their digests; the links' components are walked from every vertex.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [md5(array_to_string(ws[i:i + 4], ' ')) for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS h FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, met) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.met),
c AS (SELECT id, min(met) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS bigint) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
"""

# Every query against every other vector.
OP6_SQL = r"""
WITH v AS (SELECT vec_id, [CAST(floor(x::double * 64) AS bigint) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS bigint) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

# Every window of 35 words by its digest.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM g),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
l AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept, count(*) AS n, count(c.i) AS gone FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS bigint) AS n_words, CAST(coalesce(gone, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN l USING (doc_id)
"""

# Every window of an item against every run of as many words of a document.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
w AS MATERIALIZED (SELECT DISTINCT item_id, k, md5(array_to_string(ws[i:i + k - 1], ' ')) AS h FROM q),
g AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k),
m AS MATERIALIZED (SELECT doc_id, g.k, i, item_id FROM (SELECT doc_id, k, i, md5(array_to_string(ws[i:i + k - 1], ' ')) AS h FROM g) g JOIN w ON w.k = g.k AND w.h = g.h),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# All runs of one to three words of the pieces, counted and cut in 128-bit numbers.
OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::hugeint AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(ws))::bigint AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, 1 AS cut, ws[1] AS lp, array_to_string(ws[2:], ' ') AS rp FROM c UNION ALL SELECT lang, k, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
s AS (SELECT u.lang, u.k, u.phrase, a, cut, x.n AS l, y.n AS r, (1000000 * a * a) // (x.n * y.n) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = lp JOIN f y ON y.lang = u.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.a >= 50 * b.a))
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, t.n AS n, score::bigint AS score FROM d JOIN t ON t.lang = d.lang QUALIFY rank <= 2000
"""

# The table of crc32: what a register's low byte becomes. With it SQL folds a crc32 over a text's bytes.
_CRC = ", ".join(str(zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000) for i in range(256))

# Near words share what is left of them without one letter.
OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::varchar, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
x AS (SELECT run, c, hex(doc || ':' || run) AS hx FROM r),
y AS (SELECT run, c, list_prepend(4294967295::bigint, [((strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1)::bigint for i in range(0, length(hx) // 2)]) AS bytes FROM x),
h AS (SELECT run, c, xor(list_reduce(bytes, lambda s, b: xor(list_extract([{_CRC}]::bigint[], (xor(s, b) & 255) + 1), s >> 8)), 4294967295) AS h FROM y),
t AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::bigint AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
v AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT v.word AS a, w.word AS b FROM v JOIN w ON w.word = v.rest UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.rest UNION SELECT v.word, u.word FROM v JOIN v u ON u.i = v.i AND u.rest = v.rest AND u.word <> v.word),
q AS (SELECT p.a, p.b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, p.b) AS k FROM p JOIN w ON w.word = p.b),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 2 * w.n THEN q.b END AS form, CASE WHEN q.n >= 2 * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON q.a = w.word AND q.k = 1),
g(word, met) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.met WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.met AS root FROM g JOIN f ON f.word = g.met WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN e USING (word)
"""
