from pyspark.sql import functions as F

from promptscreen.functions import text as X
from promptscreen.functions.scalar import decide


def test_tokens_stopwords_ngrams(spark):
    df = spark.createDataFrame([("The Cat and the ÜBER-hat a x1",), ("one",), ("",)], "t string")
    toks = X.tokens("t")
    kept = X.remove_stop_words(toks, ["the", "and"])
    out = df.select(toks.alias("a"), kept.alias("b"), X.ngrams(kept, 2).alias("c")).collect()
    assert out[0].a == ["the", "cat", "and", "the", "über", "hat", "x1"]
    assert out[0].b == ["cat", "über", "hat", "x1"]
    assert out[0].c == ["cat", "über", "hat", "x1", "cat über", "über hat", "hat x1"]
    assert out[1].c == ["one"] and out[2].c == []


def test_replace_first_and_blank(spark):
    df = spark.createDataFrame([("scatter the cat",)], "p string")
    r = df.select(X.replace_first("p", F.lit("cat"), F.lit("dog")).alias("r"),
                  X.replace_first("p", F.lit("zzz"), F.lit("dog")).alias("n")).first()
    assert r.r == "sdogter the cat"      # first substring, even inside a word
    assert r.n is None
    b = spark.createDataFrame([(" ",), ("\t\n",), (" x",)], "p string").select(
        X.has_text("p").alias("h")).collect()
    assert [x.h for x in b] == [False, False, True]


def test_decide_at_half(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (0.6,)], "p double")
    r = df.select(decide("p").alias("i"), decide("p", inclusive=False).alias("e")).collect()
    assert [(x.i, x.e) for x in r] == [(1, 0), (0, 0), (1, 1)]


def test_a_text_is_cut_into_tokens_once_for_its_ngrams(spark):
    df = spark.range(3).select(F.when(F.col("id") > 0, F.concat_ws(" ", F.lit("ab cd"), "id")).alias("t"))
    out = df.select(X.ngrams(X.remove_stop_words(X.tokens("t"), ["cd"]), 2).alias("g"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert [r.g for r in out.collect()] == [None, ["ab"], ["ab"]]
    assert df.select(X.ngrams(X.tokens("t"), 2).alias("g")).collect()[2].g == ["ab", "cd", "ab cd"]
