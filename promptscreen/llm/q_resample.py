"""Query of importance resampling and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm import resample as R
from promptscreen.llm.common import store, table
from promptscreen.llm.registry import query

# crc32 byte by byte over the distinct features, from a table made by its rule
SQL = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab),
w AS MATERIALIZED (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT kind, r, array_to_string(w[p : p + k - 1], ' ') AS g, COUNT(*) AS c
      FROM (SELECT kind, r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY 1, 2, 3),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT),
             lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT g FROM f), tab),
n AS (SELECT bucket, COALESCE(SUM(c) FILTER (kind = 0), 0) AS s, COALESCE(SUM(c) FILTER (kind = 1), 0) AS t FROM f JOIN b USING (g) GROUP BY bucket),
a AS (SELECT COALESCE(SUM(s), 0)::DOUBLE AS s_all, COALESCE(SUM(t), 0)::DOUBLE AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, a),
d AS (SELECT r, SUM(c)::BIGINT AS n_features, SUM(c * gain)::BIGINT AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r),
e AS (SELECT w.id AS doc_id, len(w.w) AS words, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('42:' || COALESCE(w.id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN d USING (r) WHERE kind = 0),
o AS (SELECT *, CASE WHEN words >= 20 THEN ROW_NUMBER() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS k,
             5 * COUNT(*) FILTER (words >= 20) OVER () // 100 AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n THEN k END::BIGINT AS rank FROM o"""


@query("op12_resample", SQL)
def op12_resample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = R.weighted(docs, R.fitted(docs, table(spark, sf_dir, "benchmark")))
    order = R.order_of(F.col("weighted.weight"), F.col("doc_id"), F.col("text"))
    scores = store(found.select("doc_id", "weighted", *(c.alias(n) for c, n in zip(order, R.ORDER, strict=True))), "scores")
    drawn = R.draw(scores, F.col("weighted.n_words") >= R.MIN_WORDS)
    return drawn.select("doc_id", F.col("weighted.n_features").alias("n_features"), F.col("weighted.weight").alias("weight"),
                        (-F.col("low")).alias("score"), "rank")
