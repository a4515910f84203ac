"""DuckDB SQL for those of the ten operators that SQL can express on whole tables."""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, strlen(h) // 2 - 49)) AS p FROM d WHERE doc_id IS NOT NULL AND strlen(h) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT w.r, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.least),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
spans AS (SELECT r, k, min(p) AS lo, max(p) + 50 AS hi FROM i GROUP BY r, k),
edges AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prior FROM spans),
kept AS (SELECT e.r, string_agg(substr(d.h, CAST(2 * prior + 1 AS BIGINT), CAST(2 * (lo - prior) AS BIGINT)), '' ORDER BY lo) AS head, max(hi) AS tail, sum(hi - lo) AS gone, count(*) AS n FROM edges e JOIN d USING (r) GROUP BY e.r)
SELECT d.doc_id, CAST(strlen(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN d.h ELSE head || substr(d.h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

LINKED = """
reach(x, y) AS (SELECT a, a FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
comp AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
"""

OP6 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY hash(g), g) AS k FROM s),
short AS (SELECT f.doc_id, f.g, n.n FROM f JOIN n USING (doc_id) WHERE f.k <= n.n - (85 * n.n + 99) // 100 + 1),
near AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM short a JOIN short b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT a, b, count(*) AS k FROM near JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
pair AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
""" + LINKED + """
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.least, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.x = d.doc_id
"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
dw AS (SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT r, p, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
per AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)
"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
links AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
""" + LINKED + """
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.least, v.vec_id) AS component_id, coalesce(comp.least, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.x = v.vec_id
"""

# CRC-32 by its table of 256 entries, made from the polynomial 0xEDB88320 (fixed value).
OP9 = """
WITH RECURSIVE bits(n, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, CAST(strlen(h) // 2 + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(h, '..'), lambda y: CAST('0x' || y AS BIGINT)) AS b FROM d),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(crc[(xor(c, y) & 255) + 1], c >> 8))) AS text_crc32 FROM x, t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM s),
c AS (SELECT *, CAST(least(15, start * 16 // total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c
"""

ORACLES = {"op5_suffix_dedup": OP5, "op6_jaccard_join": OP6, "op7_decontamination": OP7, "op9_sharding": OP9, "op10_embedding_dedup": OP10}
