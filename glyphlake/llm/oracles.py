"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * o >= 85 * (len(x.g) + len(y.g) - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

NEIGHBOURS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h FROM w WHERE len(ws) >= 50),
lo AS (SELECT h, min(doc_id) AS lo FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM p JOIN lo USING (h), range(50) t(k) WHERE lo < doc_id),
x AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(x.x, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '') AS kept FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, b, translate(concat(to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8), to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest, min(page_id) OVER (PARTITION BY b) AS lo FROM p)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lo THEN lo END AS refers_to FROM d"""

#: One round of the clustering after another: distances to all centroids, the nearest, floors of the means.
DISTANCES = "SELECT vec_id, q, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (SELECT vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM kept, c{0}) GROUP BY vec_id, q"
MEANS = "SELECT o.k, coalesce(n.c, o.c) AS c FROM c{0} o LEFT JOIN (SELECT k, list(c ORDER BY i) AS c FROM (SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS c FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS i FROM a{0}) GROUP BY k, i) GROUP BY k) n ON o.k = n.k"
CLUSTERS = (
    """
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT q, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8)),"""
    + "".join(f"\na{r} AS MATERIALIZED ({DISTANCES.format(r)}), c{r + 1} AS MATERIALIZED ({MEANS.format(r)})," for r in range(10))
    + f"\na AS MATERIALIZED ({DISTANCES.format(10)})"
    + """
SELECT vec_id, a.k::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c10 ON a.k = c10.k"""
)

ORACLES = {"op2_ngram_jaccard_join": JACCARD, "op6_nn_descent": NEIGHBOURS, "op9_difference_cover": REPEATS, "op11_partial_distance_clusters": CLUSTERS, "op12_revisit_resolution": ARCHIVES}
