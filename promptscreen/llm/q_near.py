"""Query of the n-gram Jaccard join and its SQL."""

from __future__ import annotations

from promptscreen.llm.common import table
from promptscreen.llm.near import near_duplicates
from promptscreen.llm.registry import query

_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Pairs that share a shingle of the rarest quarter are counted exactly; the
# components follow by taking the smallest label until nothing changes.
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, list_aggregate(w[p : p + LEAST(5, len(w)) - 1], 'string_agg', ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - LEAST(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, COUNT(*) AS c FROM s GROUP BY g),
r AS (SELECT doc_id, g, n, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY c, g) AS p FROM s JOIN f USING (g) JOIN n USING (doc_id)),
x AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
      FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE 4 * a.p <= a.n + 4 AND 4 * b.p <= b.n + 4 AND 4 * LEAST(a.n, b.n) >= 3 * GREATEST(a.n, b.n)),
o AS (SELECT x.a, x.b, COUNT(*) AS k FROM x JOIN s p ON p.doc_id = x.a JOIN s q ON q.doc_id = x.b AND q.g = p.g GROUP BY x.a, x.b),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS label FROM d
      UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node WHERE c.label < e.b)
SELECT d.doc_id, COALESCE(n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, MIN(label) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id"""


@query("op3_near", SQL)
def op3_near(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
