"""Evaluation aggregates (A3-A8, A13-A14): one pass of counters, then arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscreen.constants import BASELINE_RESULTS, LABEL_NAMES


def _ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 when the denominator is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def counters(label: str = "label", pred: str = "predicted_label") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"),
            F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"),
            F.count_if((y == 0) & (p == 0)).alias("tn"),
            F.count("*").alias("n")]


def with_prf(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return (c.withColumn("precision", _ratio(tp, tp + fp))
            .withColumn("recall", _ratio(tp, tp + fn))
            .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
            .withColumn("accuracy", _ratio(tp + tn, n)))


def confusion(df: DataFrame, label: str = "label", pred: str = "predicted_label") -> DataFrame:
    """Always four counters, also when a class is missing (A4)."""
    return df.agg(*counters(label, pred))


def prf(df: DataFrame, label: str = "label", pred: str = "predicted_label",
        by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 (positive class 1, zero_division 0) and counters (A3)."""
    g = df.groupBy(*by) if by else df
    return with_prf(g.agg(*counters(label, pred)))


def classification_report(df: DataFrame, label: str = "label",
                          pred: str = "predicted_label") -> DataFrame:
    """Per class P/R/F1/support, accuracy, macro and weighted average (A5)."""
    c = confusion(df, label, pred)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))

    def wavg(a, b):
        return _ratio(a * s0 + b * s1, n)

    null = F.lit(None).cast("double")
    rows = F.array(
        row(LABEL_NAMES[0], p0, r0, f0, s0),
        row(LABEL_NAMES[1], p1, r1, f1, s1),
        row("accuracy", null, null, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )
    return c.select(F.inline(rows))


def breakdown(df: DataFrame, label: str = "label", pred: str = "predicted_label",
              by: str = "data_type") -> DataFrame:
    """n, accuracy and F1 per sample type plus an ``ALL`` row."""
    g = df.rollup(by).agg(*counters(label, pred), F.grouping(by).alias("_g"))
    g = with_prf(g).withColumn(by, F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by)))
    return g.select(by, "n", "accuracy", "f1", "precision", "recall", "tp", "fp", "fn", "tn")


def gate_counts(scored: DataFrame, blocked_col: str = "gate_predicted_label") -> DataFrame:
    """How many prompts the gate blocked and passed."""
    return scored.agg(F.count_if(F.col(blocked_col) == 1).alias("blocked"),
                      F.count_if(F.col(blocked_col) == 0).alias("passed"),
                      F.count("*").alias("n"))


def comparison(spark: SparkSession, computed: DataFrame) -> DataFrame:
    """Published baseline rows plus computed ``(model, precision, recall, f1)``.

    Published values are text in the reference (``"N/A"``, ``"~0"``); they are
    kept as ``*_text`` and parsed to doubles where they are numbers.
    """
    base = spark.createDataFrame(BASELINE_RESULTS, "model string, p string, r string, f string")

    def num(c):
        return F.when(F.col(c).rlike(r"^[0-9.]+$"), F.col(c).cast("double"))

    base = base.select("model", num("p").alias("precision"), num("r").alias("recall"),
                       num("f").alias("f1"), F.col("p").alias("precision_text"),
                       F.col("r").alias("recall_text"), F.col("f").alias("f1_text"),
                       F.lit("published").alias("source"))
    comp = computed.select("model", "precision", "recall", "f1",
                           F.format_number("precision", 4).alias("precision_text"),
                           F.format_number("recall", 4).alias("recall_text"),
                           F.format_number("f1", 4).alias("f1_text"),
                           F.lit("computed").alias("source"))
    return base.unionByName(comp)


def best_candidate(per_candidate: DataFrame, cand_col: str = "candidate",
                   metric: str = "f1") -> DataFrame:
    """Highest metric, ties to the lowest candidate number: always one winner."""
    return per_candidate.orderBy(F.col(metric).desc(), F.col(cand_col).asc()).limit(1)
