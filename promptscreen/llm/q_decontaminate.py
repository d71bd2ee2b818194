"""Query of the decontamination operator and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm.common import table
from promptscreen.llm.decontaminate import hit_words, is_contaminated, items_digest, scan
from promptscreen.llm.registry import query

_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, LEAST(13, len(w)) AS k,
        list_aggregate(w[p : p + LEAST(13, len(w)) - 1], 'string_agg', ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - LEAST(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
x AS (SELECT doc_id, k, p, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, item_id, k, p FROM x JOIN g USING (k, s)),
n AS (SELECT doc_id, COUNT(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op5_decontamination", SQL)
def op5_decontamination(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    d = F.col("decon")
    return found.select("doc_id", d["n_words"].alias("n_words"), hit_words(d).alias("n_hit"),
                        F.size(d["items"]).cast("bigint").alias("n_items"), items_digest(d).alias("items_sha256"),
                        is_contaminated(d).alias("contaminated"))
