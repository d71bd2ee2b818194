"""Sources and sinks (S1-S5): raw TSV, split tables, model tables.

Parquet is the format between stages. CSV/TSV is only an edge format: prompts
hold newlines and quotes, so files are read by :mod:`delimited`, which splits
them across tasks all the same.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir
from promptscreen.sources import delimited

RAW_COLUMNS = ("data_type", "vanilla", "adversarial")
# Strings a CSV reader commonly treats as missing (read_split_csv normalises them by default, as
# the reference does; such prompts are dropped).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/promptscreen-{name}-{uuid.uuid4().hex[:12]}"


def read_raw(spark: SparkSession, path: str, fmt: str = "tsv", extra: tuple = ("prompt_id",),
             columns: tuple | None = None) -> DataFrame:
    """Raw labelled prompts (S1). With ``columns`` the file's columns are fixed
    (all text), and a file whose header says otherwise fails; use it for folders
    of several files. Without, they come from the header of a single file, so a
    file without ``vanilla`` simply lacks it (filled by ``union_raw``)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        sep = "\t" if fmt == "tsv" else ","
        df = delimited.read(spark, path, CSV_OPTIONS, sep, columns)
    keep = [c for c in (*extra, *RAW_COLUMNS) if c in df.columns]
    out = df.select(*keep)
    if "prompt_id" in out.columns:
        out = out.withColumn("prompt_id", F.col("prompt_id").cast("bigint"))
    return out


def write_raw(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    sep = "\t" if fmt == "tsv" else ","
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("sep", sep).csv(path)


def write_splits(split_df: DataFrame, path: str) -> None:
    """One table partitioned by ``split`` (S3)."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header and RFC-4180 quoting (S3)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_split_csv(spark: SparkSession, path: str, normalize_na: bool = True) -> DataFrame:
    """Split CSV back as ``prompt_id, prompt, data_type, label``; null prompts
    dropped (S2). With ``normalize_na``, NA-like strings count as null."""
    df = delimited.read(spark, path, CSV_OPTIONS, ",")
    p = F.col("prompt")
    if normalize_na:
        p = F.when(p.isin(*NA_TOKENS), F.lit(None)).otherwise(p)
    out = df.select(F.col("prompt_id").cast("bigint"), p.alias("prompt"), "data_type",
                    F.col("label").cast("int"))
    return out.na.drop(subset=["prompt"])


def save_linear(scorer, path: str) -> None:
    """Model table as parquet plus the featurizer settings as JSON."""
    scorer.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spec = dict(scorer.spec.__dict__, stop_words=list(scorer.spec.stop_words), bias=scorer.bias)
    spark = scorer.vocab.sparkSession
    spark.createDataFrame([(json.dumps(spec),)], "spec string").write.mode("overwrite").json(
        f"{path}/spec")


def load_linear(spark: SparkSession, path: str):
    from promptscreen.operators.linear import LinearScorer
    spec = json.loads(spark.read.json(f"{path}/spec").first()["spec"])
    bias = spec.pop("bias")
    spec["stop_words"] = tuple(spec["stop_words"])
    return LinearScorer(T.TfidfSpec(**spec), spark.read.parquet(f"{path}/vocab"), bias)
