"""Raw labelled prompts to clean ``(prompt_id, prompt, data_type, label)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.functions.scalar import content_key
from promptscreen.functions.text import has_text


def union_raw(*frames: DataFrame) -> DataFrame:
    """Stack raw files by column name; a column missing in one file is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _opt(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def extract_prompt(df: DataFrame) -> DataFrame:
    """Adversarial rows use their adversarial text unless it is null or blank."""
    adv = _opt(df, "adversarial")
    use_adv = F.coalesce(F.col("data_type").startswith("adversarial") & has_text(adv),
                         F.lit(False))
    return df.withColumn("prompt", F.when(use_adv, adv).otherwise(_opt(df, "vanilla")))


def derive_label(df: DataFrame) -> DataFrame:
    """1 when the sample type mentions ``harmful``; null type gives 0."""
    return df.withColumn(
        "label", F.coalesce(F.col("data_type").contains("harmful"), F.lit(False)).cast("int"))


def drop_blank(df: DataFrame, col: str = "prompt") -> DataFrame:
    """Drop null prompts and prompts of only whitespace."""
    return df.filter(F.col(col).isNotNull() & has_text(col))


def prepare_prompts(raw: DataFrame) -> DataFrame:
    """One prompt and a label per raw row, blanks removed."""
    out = drop_blank(derive_label(extract_prompt(raw)))
    return out.select("prompt_id", "prompt", "data_type", "label")


#: Copies of one row that one task numbers.
COPY_CHUNK = 100_000


def assign_prompt_id(df: DataFrame, cols=("prompt", "data_type", "label")) -> DataFrame:
    """Give keyless rows a stable identity from their content.

    Equal rows share a ``content_key``; ``dup_no`` numbers the copies from 1.
    Rows are counted per content (a hot text is combined before the shuffle),
    and the counts are written out again as chunks of copies that are dealt
    anew, so nothing depends on how the input is partitioned. Only ``cols``
    are kept: other columns could not be told apart between copies.
    """
    counts = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    last = F.floor((F.col("_n") - 1) / COPY_CHUNK).cast("bigint")
    chunks = counts.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    chunks = chunks.withColumn("content_key", content_key(*cols)).repartition("content_key", "_c")
    begin = F.col("_c") * COPY_CHUNK
    end = F.least(F.col("_n"), begin + COPY_CHUNK)
    out = chunks.withColumn("dup_no", F.explode(F.sequence(begin + 1, end)))
    return out.withColumn("prompt_id", content_key(*cols, "dup_no")).drop("_n", "_c")
