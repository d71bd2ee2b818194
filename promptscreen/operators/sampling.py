"""Exact stratified sampling and splitting.

Row order inside a stratum is the md5 of ``seed|salt|prompt_id`` (ties by
``prompt_id``, which must be unique), so every engine can reproduce the choice.
A stratum may hold a large share of all rows, so a stratum is never ranked, and
texts are never moved, to sample or split it:

1. the first hex digits of the order key cut every stratum into 65,536 ordered
   buckets, whose sizes come from one partial aggregation (they also give the
   stratum sizes, and so the quotas);
2. running sums tell in which bucket a quota ends, and only the keys of that
   bucket are ranked, which gives the exact cut key ``(md5, id)``;
3. every row is compared with its stratum's few cut keys, where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import (HASH_BUCKET_CHARS, SEED, TEST_SIZE,
                                    VAL_TEST_SIZE)
from promptscreen.functions.scalar import order_key
from promptscreen.operators.joins import bounded_broadcast
from promptscreen.session import ensure_checkpoint_dir


def stratum_shares(df: DataFrame, strata: list[str], within: list[str] | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """Rows per stratum and their share of the stratum's class (A1)."""
    if counts is None:
        counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*(within or []))     # over the small counts table
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def allocate_quotas(df: DataFrame, n_by_class: dict[int, int], class_col: str = "label",
                    stratum_col: str = "data_type", counts: DataFrame | None = None) -> DataFrame:
    """Per-stratum sample sizes for a total ``N`` per class (A2).

    Strata in descending size (ties by name); all but the last get
    ``round_half_even(share * N)`` capped at the stratum size; the last gets
    what is left of ``N`` (at least 0), also capped. Null strata are ignored.
    ``counts`` may give the stratum sizes ``n``, if they are known already.
    """
    src = df if counts is None else counts
    known = src.filter(F.col(stratum_col).isNotNull())
    shares = stratum_shares(known, [class_col, stratum_col], [class_col],
                            None if counts is None else known)
    n_total = None
    for k, v in n_by_class.items():
        cond = F.col(class_col) == k
        n_total = F.when(cond, F.lit(v)) if n_total is None else n_total.when(cond, F.lit(v))
    shares = shares.withColumn("n_class", n_total).filter(F.col("n_class").isNotNull())
    order = [F.col("n").desc(), F.col(stratum_col).asc()]
    w_pos = Window.partitionBy(class_col).orderBy(*order)
    w_cnt = Window.partitionBy(class_col)
    w_prev = w_pos.rowsBetween(Window.unboundedPreceding, -1)
    rounded = F.least(F.bround(F.col("share") * F.col("n_class"), 0).cast("bigint"), F.col("n"))
    q = (shares.withColumn("_pos", F.row_number().over(w_pos))
         .withColumn("_k", F.count("*").over(w_cnt))
         .withColumn("_alloc", F.when(F.col("_pos") < F.col("_k"), rounded).otherwise(F.lit(0)))
         .withColumn("_prev", F.coalesce(F.sum("_alloc").over(w_prev), F.lit(0))))
    last = F.least(F.greatest(F.col("n_class") - F.col("_prev"), F.lit(0)), F.col("n"))
    q = q.withColumn("quota", F.when(F.col("_pos") < F.col("_k"), F.col("_alloc"))
                     .otherwise(last).cast("bigint"))
    return q.select(class_col, stratum_col, "n", "share", "quota")


def _bucket(key_col: str, bucket_chars: int):
    return F.substring(F.col(key_col), 1, bucket_chars)


def bucket_sizes(keyed: DataFrame, strata: list[str], key_col: str,
                 bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """Rows per stratum and order bucket: ``(*strata, _bucket, _bn)``."""
    return keyed.groupBy(*strata, _bucket(key_col, bucket_chars).alias("_bucket")).agg(
        F.count("*").alias("_bn"))


def _offsets(sizes: DataFrame, strata: list[str]) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(w), F.lit(0)))


def rank_in_strata(df: DataFrame, strata: list[str], key_col: str, tie_col: str,
                   bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """Add ``rank`` (1-based) of each row inside its stratum by (key, tie);
    rows are ranked inside their (stratum, bucket)."""
    keyed = df.withColumn("_bucket", _bucket(key_col, bucket_chars))
    offsets = _offsets(bucket_sizes(df, strata, key_col, bucket_chars), strata)
    joined = keyed.join(offsets, strata + ["_bucket"])
    w_rank = Window.partitionBy(*strata, "_bucket").orderBy(key_col, tie_col)
    ranked = joined.withColumn("rank", F.col("_off") + F.row_number().over(w_rank))
    return ranked.drop("_bucket", "_bn", "_off")


def cut_keys(keyed: DataFrame, strata: list[str], key_col: str, tie_col: str, sizes: DataFrame,
             quotas: DataFrame, names: list[str],
             bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """``(*_c_strata, *_cut_name)``: per stratum and quota column the ``(key,
    tie)`` of the last row the quota takes (null if it takes none). Strata come
    back with the prefix ``_c_``, so that the caller can join null-safely."""
    offsets = _offsets(sizes, strata)
    renamed = quotas.select(*[F.col(c).alias(f"_q_{c}") for c in strata], *names)
    same = F.lit(True)
    for c in strata:
        same = same & offsets[c].eqNullSafe(F.col(f"_q_{c}"))
    at = offsets.join(renamed, same)
    need = F.explode(F.array(*[F.struct(F.lit(n).alias("which"), (F.col(n) - F.col("_off")).alias("need"))
                               for n in names])).alias("_p")
    points = at.select(*[F.col(c).alias(f"_c_{c}") for c in strata], F.col("_bucket").alias("_c_bucket"),
                       "_bn", need).filter("_p.need > 0 and _p.need <= _bn")
    points = points.select(*[f"_c_{c}" for c in strata], "_c_bucket", "_p.which", "_p.need")
    # one row per stratum and quota, joined with the keys of its bucket only
    narrow = keyed.select(*strata, F.col(key_col).alias("_k"), F.col(tie_col).alias("_t"),
                          _bucket(key_col, bucket_chars).alias("_bucket"))
    cond = narrow["_bucket"] == points["_c_bucket"]
    for c in strata:
        cond = cond & narrow[c].eqNullSafe(points[f"_c_{c}"])
    by = [f"_c_{c}" for c in strata] + ["which"]
    w = Window.partitionBy(*by).orderBy("_k", "_t")
    found = (narrow.join(bounded_broadcast(points), cond).withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") == F.col("need")))
    return found.groupBy(*[f"_c_{c}" for c in strata]).agg(
        *[F.max(F.when(F.col("which") == n, F.struct("_k", "_t"))).alias(f"_cut_{n}") for n in names])


def with_cuts(keyed: DataFrame, strata: list[str], key_col: str, tie_col: str, quotas, names: list[str],
              bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """``keyed`` with a boolean ``_in_<name>`` per quota column: whether the row
    is among the first ``name`` rows of its stratum. ``quotas`` is a function
    of the stratum sizes ``(*strata, n)``. The rows themselves do not move:
    the cut keys (a row per stratum) are broadcast after a count."""
    ensure_checkpoint_dir(keyed.sparkSession)
    sizes = bucket_sizes(keyed, strata, key_col, bucket_chars).checkpoint(eager=True)
    counts = sizes.groupBy(*strata).agg(F.sum("_bn").alias("n"))
    cuts = cut_keys(keyed, strata, key_col, tie_col, sizes, quotas(counts), names,
                    bucket_chars).checkpoint(eager=True)
    cond = F.lit(True)
    for c in strata:
        cond = cond & keyed[c].eqNullSafe(cuts[f"_c_{c}"])
    out = keyed.join(bounded_broadcast(cuts), cond, "left")
    me = F.struct(F.col(key_col).alias("_k"), F.col(tie_col).alias("_t"))
    for n in names:
        out = out.withColumn(f"_in_{n}", F.coalesce(me <= F.col(f"_cut_{n}"), F.lit(False)))
    return out.drop(*[f"_c_{c}" for c in strata], *[f"_cut_{n}" for n in names])


def stratified_sample(df: DataFrame, n_by_class: dict[int, int], class_col: str = "label",
                      stratum_col: str = "data_type", id_col: str = "prompt_id",
                      seed: int = SEED, salt: str = "sample") -> DataFrame:
    """Exactly ``quota`` rows per stratum, the first by the seeded order."""
    keyed = df.filter(F.col(stratum_col).isNotNull()).withColumn(
        "_key", order_key(id_col, salt, seed))
    cut = with_cuts(keyed, [class_col, stratum_col], "_key", id_col, lambda counts: allocate_quotas(
        df, n_by_class, class_col, stratum_col, counts), ["quota"])
    return cut.filter("_in_quota").select(*df.columns)


def _largest_remainder(counts: DataFrame, n_col: str, total_draw, stratum_col: str,
                       out_col: str) -> DataFrame:
    """Split ``total_draw`` over strata in proportion to ``n_col`` (integers).

    Floors first; the rest goes one each to the largest remainders, ties by
    stratum name. Runs on the small per-stratum table only.
    """
    everything = Window.partitionBy()
    c = (counts.withColumn("_td", total_draw)
         .withColumn("_tot", F.sum(n_col).over(everything))
         .withColumn("_num", F.col(n_col).cast("decimal(38,0)") * F.col("_td")))
    c = (c.withColumn("_fl", F.expr("_num div _tot").cast("bigint"))
         .withColumn("_rem", F.expr("_num % _tot")))
    c = c.withColumn("_need", F.col("_td") - F.sum("_fl").over(everything))
    w = Window.orderBy(F.col("_rem").desc(), F.col(stratum_col).asc())
    c = c.withColumn(out_col, F.col("_fl") + (F.row_number().over(w) <= F.col("_need")).cast("bigint"))
    return c.drop("_td", "_tot", "_num", "_fl", "_rem", "_need")


def split_quotas(df: DataFrame, stratum_col: str = "data_type", test_size: float = TEST_SIZE,
                 val_test_size: float = VAL_TEST_SIZE, counts: DataFrame | None = None) -> DataFrame:
    """Rows per stratum for train / val / test (the two-step stratified split).

    Step one holds out ``ceil(test_size * n)`` rows; the train share per
    stratum is allotted by largest remainder. Step two splits the held-out
    rows, ``ceil(val_test_size * m)`` to test, the validation share again by
    largest remainder. Null strata form one stratum named ``''``.
    """
    if counts is None:
        counts = (df.withColumn("_s", F.coalesce(F.col(stratum_col), F.lit("")))
                  .groupBy("_s").agg(F.count("*").alias("n")))
    everything = Window.partitionBy()
    n = F.sum("n").over(everything)
    counts = counts.withColumn("_train_total", n - F.ceil(F.lit(float(test_size)) * n))
    counts = _largest_remainder(counts, "n", F.col("_train_total"), "_s", "n_train")
    counts = counts.withColumn("_rest", F.col("n") - F.col("n_train"))
    m = F.sum("_rest").over(everything)
    counts = counts.withColumn("_val_total", m - F.ceil(F.lit(float(val_test_size)) * m))
    counts = _largest_remainder(counts, "_rest", F.col("_val_total"), "_s", "n_val")
    counts = counts.withColumn("n_test", F.col("_rest") - F.col("n_val"))
    return counts.select(F.col("_s").alias(stratum_col), "n", "n_train", "n_val", "n_test")


def stratified_split(df: DataFrame, stratum_col: str = "data_type", id_col: str = "prompt_id",
                     seed: int = SEED, salt: str = "split", test_size: float = TEST_SIZE,
                     val_test_size: float = VAL_TEST_SIZE) -> DataFrame:
    """Add ``split`` in {train, val, test}: exact stratified 70/15/15."""
    keyed = (df.withColumn("_s", F.coalesce(F.col(stratum_col), F.lit("")))
             .withColumn("_key", order_key(id_col, salt, seed)))

    def quotas(counts):
        q = split_quotas(df, stratum_col, test_size, val_test_size, counts)
        return q.select(F.col(stratum_col).alias("_s"), "n_train",
                        (F.col("n_train") + F.col("n_val")).alias("n_known"))

    out = with_cuts(keyed, ["_s"], "_key", id_col, quotas, ["n_train", "n_known"])
    split = (F.when(F.col("_in_n_train"), F.lit("train")).when(F.col("_in_n_known"), F.lit("val"))
             .otherwise(F.lit("test")))
    return out.withColumn("split", split).select(*df.columns, "split")


def split_sizes(split_df: DataFrame) -> DataFrame:
    """Rows per split."""
    return split_df.groupBy("split").agg(F.count("*").alias("n"))


def sample_n(df: DataFrame, n: int, id_col: str = "prompt_id", seed: int = SEED,
             salt: str = "sample_n", by: list[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows (per group if ``by``) in seeded order.

    Neither a hot group nor a large ``n`` brings rows together: only cut keys
    are computed, and rows are kept where they lie.
    """
    keyed = df.withColumn("_key", order_key(id_col, salt, seed))
    strata = list(by or [])
    if not strata:
        keyed, strata = keyed.withColumn("_all", F.lit(0)), ["_all"]
    cut = with_cuts(keyed, strata, "_key", id_col, lambda counts: counts.withColumn(
        "quota", F.least(F.col("n"), F.lit(int(n)))), ["quota"])
    return cut.filter("_in_quota").select(*df.columns)


def shuffle_rank(df: DataFrame, id_col: str = "prompt_id", seed: int = SEED,
                 salt: str = "shuffle") -> DataFrame:
    """Position of each row in a seeded shuffle, computed bucket-wise."""
    keyed = df.withColumn("_key", order_key(id_col, salt, seed)).withColumn("_all", F.lit(0))
    ranked = rank_in_strata(keyed, ["_all"], "_key", id_col)
    return ranked.withColumnRenamed("rank", "shuffle_rank").drop("_key", "_all")


def first_n(df: DataFrame, n: int, id_col: str = "prompt_id", seed: int = SEED) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle (T4)."""
    return sample_n(df, n, id_col, seed, salt="shuffle")
