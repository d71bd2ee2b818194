"""Query of the fill-in-middle transformation and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm import fim
from promptscreen.llm.common import store, table
from promptscreen.llm.registry import query

SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n,
                  sha256('1:' || COALESCE(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, LEAST(c1, c2) AS a, GREATEST(c1, c2) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@query("op13_fim", SQL)
def op13_fim(spark, sf_dir):
    frames = store(fim.framed(table(spark, sf_dir, "documents").select("doc_id", "text")), "frames")
    filled = fim.digests(fim.infill(frames))
    n = F.when(F.size("framed.ends") > 0, F.element_at("framed.ends", -1)).otherwise(F.lit(0).cast("bigint"))
    return filled.select("doc_id", n.alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", "digests.output_sha256",
                         "digests.restored_sha256")
