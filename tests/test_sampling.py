from pyspark.sql import functions as F

from promptscreen.operators import sampling
from tests.conftest import SF01


def _strata(spark, sizes, label=1):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"p{i}", name, label))
            i += 1
    return spark.createDataFrame(rows, "prompt_id bigint, prompt string, data_type string, label int")


def test_quotas_5_3_1(spark):
    df = _strata(spark, {"a": 5, "b": 3, "c": 1})
    q = {r.data_type: r.quota for r in sampling.allocate_quotas(df, {1: 8}).collect()}
    # 8*5/9 = 4.44 -> 4, 8*3/9 = 2.67 -> 3, the last gets the rest (1), capped at 1
    assert q == {"a": 4, "b": 3, "c": 1}
    s = sampling.stratified_sample(df, {1: 8})
    got = {r.data_type: r.n for r in s.groupBy("data_type").agg(F.count("*").alias("n")).collect()}
    assert got == q


def test_quota_shortfall_and_cap(spark):
    df = _strata(spark, {"a": 2, "b": 1})
    q = {r.data_type: r.quota for r in sampling.allocate_quotas(df, {1: 10}).collect()}
    assert q == {"a": 2, "b": 1}          # both capped, total < N


def test_null_type_never_sampled(spark):
    df = _strata(spark, {"a": 4}).unionByName(spark.createDataFrame(
        [(99, "x", None, 1)], "prompt_id bigint, prompt string, data_type string, label int"))
    s = sampling.stratified_sample(df, {1: 5})
    assert s.filter(F.col("data_type").isNull()).count() == 0
    assert s.count() == 4


def test_split_invariants_and_partition_independence(spark):
    from promptscreen.plans.workflow import Workflow
    prompts = Workflow.get(spark, SF01).prompts
    results = []
    for parts in (1, 4, 16):
        sp = sampling.stratified_split(prompts.repartition(parts))
        results.append(sorted((r.prompt_id, r.split) for r in sp.collect()))
    assert results[0] == results[1] == results[2]
    ids = [p for p, _ in results[0]]
    assert len(ids) == len(set(ids)) == prompts.count()      # disjoint and covering
    q = sampling.split_quotas(prompts).collect()
    sizes = {}
    for p, s in results[0]:
        sizes[s] = sizes.get(s, 0) + 1
    assert sizes["train"] == sum(r.n_train for r in q)
    assert sizes["val"] == sum(r.n_val for r in q)
    n = prompts.count()
    import math
    assert sizes["val"] + sizes["test"] == math.ceil(0.3 * n)


def test_rank_buckets_match_plain_rank(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("prompt_id"), (F.col("id") % 3).alias("s"))
    keyed = df.withColumn("_key", sampling.order_key("prompt_id", "t"))
    r = sampling.rank_in_strata(keyed, ["s"], "_key", "prompt_id", bucket_chars=2)
    from pyspark.sql import Window
    w = Window.partitionBy("s").orderBy("_key", "prompt_id")
    plain = keyed.withColumn("rank2", F.row_number().over(w))
    bad = r.join(plain.select("prompt_id", "rank2"), "prompt_id").filter(F.col("rank") != F.col("rank2"))
    assert bad.count() == 0


def test_sample_n_exact(spark):
    df = spark.range(0, 100).select(F.col("id").alias("prompt_id"), (F.col("id") % 2).alias("g"))
    assert sampling.sample_n(df, 10).count() == 10
    assert sampling.sample_n(df, 500).count() == 100
    per = sampling.sample_n(df, 7, by=["g"]).groupBy("g").count().collect()
    assert sorted(r["count"] for r in per) == [7, 7]


def test_bounded_broadcast_both_paths_agree(spark):
    from promptscreen.operators.joins import bounded_broadcast
    big = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 3).alias("s"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "s long, name string")
    a = sorted(tuple(r) for r in big.join(bounded_broadcast(small), "s").collect())
    b = sorted(tuple(r) for r in big.join(bounded_broadcast(small, max_rows=0), "s").collect())
    assert a == b and len(a) == 2000


def test_no_text_is_moved_by_stratum(spark):
    """With small broadcasts off by default, no exchange that carries the text
    is hashed by the stratum or goes to one partition."""
    import re
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _strata(spark, {"a": 300, "b": 40, "c": 1}).unionByName(_strata(spark, {"a": 50}, 0).withColumn(
            "prompt_id", F.col("prompt_id") + 1000))
        plans = [sampling.stratified_split(df), sampling.stratified_sample(df, {0: 20, 1: 60}),
                 sampling.sample_n(df, 5000, by=["data_type"]), sampling.sample_n(df, 30), sampling.first_n(df, 2000)]
        for p in plans:
            p.collect()
            text = p._jdf.queryExecution().executedPlan().toString()
            for block in re.findall(r"Exchange (?:hashpartitioning\([^\n]*|SinglePartition[^\n]*)\n[^\n]*\n[^\n]*", text):
                assert "prompt#" not in block, block
        assert plans[0].count() == 391 and plans[1].count() == 80 and plans[2].count() == 391 and plans[3].count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sample_n_of_null_groups(spark):
    df = spark.range(0, 90).select(F.col("id").alias("prompt_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    per = {r["g"]: r["count"] for r in sampling.sample_n(df, 7, by=["g"]).groupBy("g").count().collect()}
    assert per == {None: 7, 1: 7, 2: 7}
