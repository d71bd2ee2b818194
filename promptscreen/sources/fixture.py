"""Labelled prompt tables derived from the driver's ``documents``/``labels``.

The workflow expects raw labelled prompts (``data_type``, ``vanilla``,
``adversarial``). Our test input maps onto that model as described in
FIXTURES.md: ``documents JOIN labels``; the sample type comes from the
``quality`` and ``toxic`` flags; some adversarial texts are missing or blank
so the fallback to the plain text is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscreen.functions.text import has_text

STORY_PREFIX = "Imagine a story. "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompt_id, data_type, vanilla, adversarial`` for every labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    data_type = F.concat(
        F.when(F.col("quality") == 1, F.lit("vanilla")).otherwise(F.lit("adversarial")),
        F.lit("_"),
        F.when(F.col("toxic") == 1, F.lit("harmful")).otherwise(F.lit("benign")),
    )
    adversarial = (
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 7 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(STORY_PREFIX), F.col("text")))
    )
    return j.select(
        F.col("doc_id").alias("prompt_id"),
        data_type.alias("data_type"),
        F.col("text").alias("vanilla"),
        adversarial.alias("adversarial"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two raw inputs: (train, eval). ``eval`` has no ``vanilla`` column."""
    raw = raw_prompts(spark, sf_dir)
    in_eval = F.coalesce(
        F.col("data_type").startswith("adversarial")
        & has_text("adversarial")
        & (F.col("prompt_id") % 2 == 1),
        F.lit(False),
    )
    raw_eval = raw.filter(in_eval).select("prompt_id", "data_type", "adversarial")
    raw_train = raw.filter(~in_eval)
    return raw_train, raw_eval


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled request feed: user turns of ``conversations``."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"),
        F.col("text").alias("prompt"),
    )


def synonym_rows() -> list[tuple[str, str, int]]:
    """Small lexicon ``(word, synonym, rank)`` standing in for a thesaurus.

    Fixed values (test lexicon): label-bearing words of the corpus with
    neutral replacements, plus filler words. It includes an entry with ``_``,
    one in upper case, one equal to its word, and one word with six entries.
    """
    return [
        ("idiot", "fool", 1), ("idiot", "simple_person", 2), ("idiot", "friend", 3),
        ("trash", "rubbish", 1), ("trash", "garbage", 2), ("trash", "notes", 3),
        ("scum", "residue", 1), ("scum", "film", 2),
        ("clown", "joker", 1), ("clown", "Comedian", 2), ("clown", "clown", 3),
        ("worthless", "valueless", 1), ("worthless", "fine", 2),
        ("moron", "dolt", 1), ("moron", "person", 2),
        ("pathetic", "pitiful", 1), ("pathetic", "sad", 2), ("pathetic", "moving", 3),
        ("pathetic", "touching", 4), ("pathetic", "poignant", 5), ("pathetic", "piteous", 6),
        ("loser", "also-ran", 1), ("loser", "player", 2),
        ("disgusting", "revolting", 1), ("disgusting", "unusual", 2),
        ("stupid", "dense", 1), ("stupid", "quiet", 2),
        ("the", "that", 1), ("and", "also", 1), ("is", "be", 1),
    ]


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(synonym_rows(), "word string, synonym string, rank int")
