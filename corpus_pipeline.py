"""The corpus pipeline: documents in, sharded training documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
``docs`` of the next stage. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from promptscreen.llm import decontaminate, language, mixing, near, sharding
from promptscreen.llm.common import id_crc, store, table

ORACLE_SQL = None       # the language model of the first stage has no SQL


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a sure label among the learned
    languages. A text in a language not learned is mostly kept, under the nearest label."""
    crf = language.fit(docs.filter(id_crc(F.col("doc_id")) % 4 != 2))
    return language.accepted(docs, crf)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return near.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages (by the share of words they make up)."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the token budget of each source, in whole epochs and a last token prefix.
    Columns whose names the operator keeps for itself are carried under others."""
    free = "carried"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    names = {c: f"{free}{i}" for i, c in enumerate(docs.columns) if c.lower() in mixing.ADDED or c.lower().startswith("_m")}
    rows = mixing.mix(docs.withColumnsRenamed(names), mixing.MIX)
    return rows.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its shard and its place in it."""
    return sharding.shard(docs)


STAGES = [("language identification", recognised), ("near duplicates", deduplicated),
          ("benchmark decontamination", decontaminated), ("mixing to weights", mixed),
          ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
