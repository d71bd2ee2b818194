"""Property tests: random corpora against brute force; partition independence."""

from hypothesis import given, settings
from hypothesis import strategies as st

from promptscreen.operators import cascade, linear
from promptscreen.operators import tfidf as T
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01
from tests.test_model import brute_force, py_logit

WORDS = ["idiot", "calm", "the", "and", "river", "über", "x", "a1", "stone", "trash", "ok"]
doc_st = st.lists(st.sampled_from(WORDS), min_size=0, max_size=12).map(" ".join)
corpus_st = st.lists(st.tuples(doc_st, st.integers(0, 1)), min_size=2, max_size=12).filter(
    lambda c: {lab for _, lab in c} == {0, 1})


@settings(max_examples=5, deadline=None)
@given(corpus=corpus_st, probe=st.lists(doc_st, min_size=1, max_size=4))
def test_random_corpus_matches_brute_force(spark, corpus, probe):
    train = [(i, t, lab) for i, (t, lab) in enumerate(corpus)]
    df = spark.createDataFrame(train, "prompt_id bigint, prompt string, label int")
    m = linear.fit_logodds(df, T.TfidfSpec(max_features=8))
    idf, w = brute_force(train, 8)
    got = {r.term: (r.idf, r.weight) for r in m.vocab.collect()}
    assert set(got) == set(idf)
    for t, (i, ww) in got.items():
        assert abs(i - idf[t]) < 1e-9 and abs(ww - w[t]) < 1e-9
    pdf = spark.createDataFrame(list(enumerate(probe)), "prompt_id bigint, prompt string")
    for r in m.score(pdf).collect():
        assert abs(r.logit - py_logit(probe[r.prompt_id], idf, w)) <= 1e-6


def test_cascade_independent_of_partitioning(spark):
    wf = Workflow.get(spark, SF01)
    results = []
    for parts in (1, 4, 16):
        r = cascade.cascade(wf.gate, wf.model, wf.test.repartition(parts))
        results.append(sorted((x.prompt_id, x.pipeline_predicted_label, x.gate_prob_harmful,
                               x.model_prob_harmful) for x in r.collect()))
    assert results[0] == results[1] == results[2]
