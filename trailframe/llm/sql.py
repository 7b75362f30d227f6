"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

#: Components of 5-word shingle sets with a Jaccard similarity of 0.8: labels spread along links until none changes.
OP7 = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

#: Three rounds of Lloyd's over 16 centroids, in whole numbers.
_ASSIGNED = """
d{i} AS (SELECT v.row_no, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS d FROM v, c{i} c),
a{i} AS (SELECT row_no, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, k) = 1)"""
_MOVED = """
s{i} AS (
  SELECT k, list(m ORDER BY j) AS v
  FROM (SELECT a.k, j, CAST((sum(v.v[j]) - ((sum(v.v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM a{i} a JOIN v USING (row_no), range(1, 65) t(j) GROUP BY a.k, j)
  GROUP BY k),
c{n} AS (SELECT c.k, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN s{i} s USING (k))"""
OP11 = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 16)),
{",".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, n=i + 1) for i in range(3))},{_ASSIGNED.format(i=3)},
t AS (SELECT k, sum(d) AS s FROM a3 GROUP BY k)
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(t.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (row_no) JOIN t ON t.k = a.k JOIN c3 c ON c.k = a.k
"""

#: The five highest inner products of every fiftieth vector with all others.
OP12 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
p AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row_no <> q.row_no)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY row_no ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard_join": OP7, "op11_dual_tree": OP11, "op12_sorted_lists": OP12}
