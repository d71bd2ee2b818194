"""The top terms by bounds and candidates equal those of a full count."""

import random

import pytest

from promptscreen.operators import heavy
from promptscreen.operators import tfidf as T


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))), k % 2) for k in range(250)]
    return spark.createDataFrame([*rows, (900, "", 1), (901, None, 0)], "prompt_id long, prompt string, label int").repartition(5).cache()


def full(docs, spec):
    stats = T.term_stats(T.doc_terms(T.by_id(docs), spec, keep=("label",)))
    return {r["term"]: tuple(r) for r in stats.collect()}


def test_row_statistics_equal_grouped_ones(docs):
    spec = T.TfidfSpec()
    rows = T.row_stats(T.term_rows(docs, spec)).select("term", "cnt", "df", "df_h", "df_b")
    assert {r["term"]: tuple(r) for r in rows.collect()} == full(docs, spec)


@pytest.mark.parametrize("k,buckets", [(5, 1 << 12), (40, 1 << 12), (40, 64), (300, 8), (10**6, 64)])
def test_top_terms_are_exact_for_any_summary(docs, k, buckets):
    """A sharp summary, one too small to tell terms apart, and more terms wanted than there are."""
    spec = T.TfidfSpec(max_features=k)
    every = full(docs, spec)
    stats = heavy.top_term_stats(docs, spec, buckets=buckets)
    found = {r["term"]: tuple(r) for r in stats.select("term", "cnt", "df", "df_h", "df_b").collect()}
    assert all(every[t] == v for t, v in found.items())
    top = sorted(every.values(), key=lambda v: (-v[1], v[0]))[:k]
    assert sorted(found.values(), key=lambda v: (-v[1], v[0]))[:k] == top
    if buckets == 1 << 12 and k == 5:
        assert len(found) < len(every) / 10             # few terms are counted at all
    vocab = T.vocabulary_from_stats(stats, 250, spec)
    assert {r["term"] for r in vocab.collect()} == {v[0] for v in top}


def test_bounds_hold_and_equal_counts_are_kept(docs, spark):
    spec = T.TfidfSpec(max_features=3)
    found = heavy.summary(docs, spec, buckets=128)
    every = full(docs, spec)
    assert (found.totals.sum(1) == sum(v[1] for v in every.values())).all()
    terms = spark.createDataFrame([(t,) for t in every], "term string").crossJoin(found.frame(spark))
    assert all(r["b"] >= every[r["term"]][1] for r in terms.select("term", found.bound(terms["term"]).alias("b")).collect())
    ties = spark.createDataFrame([(1, "bb aa dd cc", 1), (2, "aa bb cc dd", 0)], "prompt_id long, prompt string, label int")
    spec = T.TfidfSpec(max_features=2, ngram_max=1)
    stats = heavy.top_term_stats(ties, spec, buckets=64)
    assert [r["term"] for r in T.vocabulary_from_stats(stats, 2, spec).orderBy("idx").collect()] == ["aa", "bb"]
    none = heavy.top_term_stats(ties.limit(0), spec)
    assert none.count() == 0
