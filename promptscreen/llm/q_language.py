"""Query of the language-identification operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm import language
from promptscreen.llm.common import id_crc, table
from promptscreen.llm.registry import query


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_crc(F.col("doc_id")) % 4 == 2
    crf = language.fit(docs.filter(~held))
    return (language.identify(docs.select("doc_id", "text"), crf)
            .select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))
