"""Texts are dealt finely, and counted without a table of every n-gram of a task."""

from pyspark.sql import functions as F

from promptscreen.operators import ensemble, linear
from promptscreen.operators import tfidf as T
from promptscreen.streaming.stream import _Once

SPEC = T.TfidfSpec(max_features=6)
ROWS = [(1, "alpha beta alpha", 1), (1, "beta gamma", 1), (1, "alpha beta", 0), (2, None, 0), (3, "", 1),
        (4, "the beta alpha beta", 0), (None, "delta beta", 1), (None, "delta alpha", 1), (5, "gamma delta", None)]


def _rows(spark):
    return spark.createDataFrame(ROWS, "prompt_id long, prompt string, label int")


def test_small_texts_are_not_put_together(spark):
    """Adaptive execution made them one partition per core at most."""
    parts = T.by_id(_rows(spark)).rdd.getNumPartitions()
    assert parts >= 4 * spark.sparkContext.defaultParallelism


def test_statistics_of_repeated_and_null_ids(spark):
    """Rows of one id and label are one document, without a count per id and term."""
    got = linear.train_term_stats(_rows(spark), SPEC)
    dterms = T.doc_terms(T.by_id(_rows(spark)), SPEC, keep=("label",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.term_stats(dterms).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [prompt_id" in line and "term" in line for line in plan.splitlines())


def test_features_join_the_vocabulary_before_counting(spark):
    df = _rows(spark).withColumn("idx", F.lit("x")).withColumn("tf", F.lit("y"))
    vocab = T.fit_vocabulary(T.doc_terms(T.by_id(_rows(spark)), SPEC, keep=("label",)), 6, SPEC).withColumn("weight", F.lit(1.0))
    base = T.by_id(df)
    old = T.transform(T.doc_terms(base, SPEC), vocab, SPEC)
    new = T.features(base, vocab, SPEC, keep=())
    key = lambda r: (str(r["prompt_id"]), r["term"])
    pairs = zip(sorted(old.collect(), key=key), sorted(new.collect(), key=key), strict=True)
    assert all(a[:4] == b[:4] and abs(a["weight"] - b["weight"]) < 1e-12 for a, b in pairs)
    assert linear.LinearScorer(SPEC, vocab).score(df).select("idx", "tf").distinct().collect() == [("x", "y")]


def test_forest_of_finely_dealt_rows_walks_in_few_tasks(spark):
    train = spark.range(60).select(F.col("id").alias("prompt_id"), (F.col("id") % 2).cast("int").alias("label"),
                                   F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma delta").alias("prompt"))
    forest = ensemble.fit(train, SPEC, num_trees=3, max_depth=2)
    out = forest.score(train).groupBy("label").agg(F.avg("prob_harmful").alias("p")).collect()
    p = {r["label"]: r["p"] for r in out}
    assert p[1] > p[0]


def test_a_task_makes_its_predictor_once():
    made = []
    once = _Once(lambda: made.append(1) or len)
    assert once()("ab") == once()("cd") == 2 and made == [1]
