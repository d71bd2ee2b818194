"""Scores from changed terms equal scores of the edited texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from promptscreen.operators import delta, explain, perturb
from promptscreen.operators import tfidf as T
from promptscreen.operators.linear import LinearScorer
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01

WORDS = ["idiot", "clown", "calm", "river", "the", "of", "stone", "art", "party", "x"]
TERMS = [w for w in WORDS if len(w) > 1] + ["unk", "big fool", "fool", "big", "calm river", "idiot clown", "clown idiot",
                                            "river idiot", "idiot idiot", "stone river", "unk calm"]


class ByText:
    """The same scorer as a black box: no shortcut applies."""

    def __init__(self, scorer):
        self.scorer = scorer

    def score(self, *a, **k):
        return self.scorer.score(*a, **k)


def scorer_of(spark, ngram_max, sublinear=True):
    rng = random.Random(ngram_max)
    rows = [(i, t, 1.0 + rng.random(), rng.uniform(-2, 2)) for i, t in enumerate(TERMS) if ngram_max > 1 or " " not in t]
    vocab = spark.createDataFrame(rows, "idx int, term string, idf double, weight double")
    return LinearScorer(T.TfidfSpec(ngram_max=ngram_max, stop_words=("the", "of"), sublinear_tf=sublinear), vocab, 0.1)


@pytest.fixture(scope="module")
def prompts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) + rng.choice(["", ".", "!", " (x)"]) for _ in range(120)]
    texts += ["", "idiot", "the of", "idiot idiot idiot", "IDIOT, Clown; the clown", "partyart art", "x x", "river the idiot of the idiot calm"]
    rows = [(i, t, rng.randint(0, 1), "adversarial_benign") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "prompt_id long, prompt string, label int, data_type string").repartition(4)


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("idiot", "big fool", 1), ("idiot", "of", 2), ("idiot", "x", 3), ("clown", "the", 1), ("clown", "calm_river", 2),
            ("calm", "unknown", 1), ("art", "stone", 1), ("river", "idiot", 1), ("stone", "the of", 1), ("the", "fool", 1)]
    return spark.createDataFrame(rows, "word string, synonym string, rank int")


@pytest.mark.parametrize("ngram_max,sublinear", [(1, True), (2, True), (2, False)])
def test_leave_one_out_equals_the_edited_texts(spark, prompts, ngram_max, sublinear):
    m = scorer_of(spark, ngram_max, sublinear)
    fast = {(r[0], r[1]): r[2] for r in explain.leave_one_out(m, prompts).collect()}
    slow = {(r[0], r[1]): r[2] for r in explain.leave_one_out(ByText(m), prompts).collect()}
    assert fast.keys() == slow.keys() and len(fast) > 300
    assert all(abs(fast[k] - slow[k]) < 2e-6 for k in fast)


@pytest.mark.parametrize("ngram_max", [1, 2])
def test_greedy_equals_the_edited_texts(spark, prompts, lexicon, ngram_max):
    m = scorer_of(spark, ngram_max)
    # words of either stop list may differ: "the" is no stop word of the attack
    found = [sorted(map(tuple, perturb.greedy_substitution(s, prompts, lexicon, stop_words=["of"]).collect())) for s in (m, ByText(m))]
    assert found[0] == found[1] and {r[1] for r in found[0]} == {"Successful", "Failed", "Skipped"}


@pytest.mark.parametrize("ngram_max", [1, 2])
def test_flips_equal_the_edited_texts(spark, prompts, lexicon, ngram_max, monkeypatch):
    m = scorer_of(spark, ngram_max)
    fast = sorted(map(tuple, perturb.synonym_flips(m, prompts, lexicon).collect()))
    monkeypatch.setattr(delta, "supports", lambda scorer: False)
    assert fast and fast == sorted(map(tuple, perturb.synonym_flips(m, prompts, lexicon).collect()))


def test_flips_of_a_black_box_rank_by_loss(spark, prompts, lexicon):
    m = scorer_of(spark, 2)
    rows = perturb.synonym_flips(ByText(m), prompts, lexicon, top_k=3).collect()
    assert rows
    again = spark.createDataFrame([(i, r.perturbed_prompt, r.new_predicted_label) for i, r in enumerate(rows)],
                                  "prompt_id long, prompt string, expect int")
    assert m.score(again).filter((F.col("prob_harmful") >= 0.5).cast("int") != F.col("expect")).count() == 0
    lost = {(r[0], r[1]): r[2] for r in explain.leave_one_out(m, prompts).collect()}
    shares = explain.position_scores(ByText(m), prompts).groupBy("prompt_id", "token").agg(F.sum("score")).collect()
    assert all(abs(lost[r[0], r[1]] - r[2]) < 2e-6 for r in shares) and len(shares) == len(lost)


def test_no_text_is_exchanged_with_the_variants(spark):
    """Every exchange of the attack either carries the given texts (by id, before
    any variant exists) or no text at all."""
    wf = Workflow.get(spark, SF01)
    m = wf.model
    base = T.by_id(wf.test.select("prompt_id", "prompt"))
    known, stats = delta.prepared(m, base)
    gone = delta.removals(delta.token_rows(base, m.spec), m.spec)
    vs = delta.variant_scores(m, gone, known, stats, ["word"])
    plan = vs._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word" not in line and "idx" not in line]
    assert all("prompt_id" in line for line in texts)
    assert "_text" not in plan and "array_join" not in plan
