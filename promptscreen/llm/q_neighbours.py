"""Query of the embedding near-duplicate operator and its SQL (exact pairs)."""

from __future__ import annotations

from promptscreen.llm.common import table
from promptscreen.llm.neighbours import near_vectors
from promptscreen.llm.registry import query

SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS label FROM v UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.node WHERE c.label < l.b),
m AS (SELECT node, MIN(label) AS component_id FROM c GROUP BY node),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


@query("op9_neighbours", SQL)
def op9_neighbours(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
