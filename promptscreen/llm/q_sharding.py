"""Query of the sharding operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.llm.common import table
from promptscreen.llm.registry import query
from promptscreen.llm.sharding import shard, text_bytes


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
