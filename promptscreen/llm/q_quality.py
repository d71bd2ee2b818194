"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm import quality
from promptscreen.llm.common import id_crc, table
from promptscreen.llm.registry import query


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc(F.col("doc_id")) % 5 == 0
    w = quality.fit(docs.filter(~held), table(spark, sf_dir, "labels"))
    return quality.score(docs, w).select("doc_id", held.alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))
