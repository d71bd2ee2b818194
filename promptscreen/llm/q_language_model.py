"""Query of the language-model operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm.common import id_crc, table
from promptscreen.llm.language_model import score_documents
from promptscreen.llm.registry import query


@query("op2_language_model")
def op2_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc(F.col("doc_id")) % 5 == 1
    return score_documents(docs, ~held).withColumn("held_out", held)
