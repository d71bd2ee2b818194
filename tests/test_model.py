"""TF-IDF and the linear scorer against a brute-force Python version."""

import math
from collections import Counter

from pyspark.sql import functions as F

from promptscreen.constants import STOP_WORDS
from promptscreen.operators import batch_model, explain, linear
from promptscreen.operators import tfidf as T
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF001


def py_terms(text, ngram_max=2):
    import regex
    toks = [t for t in regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower()) if t not in STOP_WORDS]
    return toks + ([f"{a} {b}" for a, b in zip(toks, toks[1:])] if ngram_max == 2 else [])


def brute_force(train, max_features, alpha=1.0):
    n = len(train)
    cnt, df, dfh, dfb = Counter(), Counter(), Counter(), Counter()
    for _, text, label in train:
        c = Counter(py_terms(text))
        cnt.update(c)
        for t in c:
            df[t] += 1
            (dfh if label == 1 else dfb)[t] += 1
    top = sorted(cnt, key=lambda t: (-cnt[t], t))[:max_features]
    nh = sum(1 for r in train if r[2] == 1)
    nb = n - nh
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in top}
    w = {t: math.log((dfh[t] + alpha * nh / n) / nh) - math.log((dfb[t] + alpha * nb / n) / nb)
         for t in top}
    return idf, w


def py_logit(text, idf, w):
    c = Counter(t for t in py_terms(text) if t in idf)
    v = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
    q = math.sqrt(sum(x * x for x in v.values()))
    return round(sum(w[t] * x / q for t, x in v.items()), 6) if q else 0.0


def test_tfidf_and_logit_match_brute_force(spark):
    wf = Workflow.get(spark, SF001)
    spec = T.TfidfSpec(max_features=300)
    train = [(r.prompt_id, r.prompt, r.label) for r in wf.train.collect()]
    idf, w = brute_force(train, 300)
    m = linear.fit_logodds(wf.train, spec)
    vocab = {r.term: (r.idf, r.weight) for r in m.vocab.collect()}
    assert set(vocab) == set(idf)
    for t, (i, ww) in vocab.items():
        assert abs(i - idf[t]) < 1e-9 and abs(ww - w[t]) < 1e-9
    got = {r.prompt_id: r.logit for r in m.score(wf.test).collect()}
    for pid, text, _ in [(r.prompt_id, r.prompt, r.label) for r in wf.test.collect()]:
        assert abs(got[pid] - py_logit(text, idf, w)) <= 1e-6


def test_unknown_terms_give_half(spark):
    wf = Workflow.get(spark, SF001)
    m = linear.fit_logodds(wf.train, T.TfidfSpec(max_features=50))
    df = spark.createDataFrame([(1, "zzqx qqzv"), (2, None)], "prompt_id bigint, prompt string")
    r = {x.prompt_id: (x.logit, x.prob_harmful) for x in m.score(df).collect()}
    assert r[1] == (0.0, 0.5) and r[2] == (0.0, 0.5)


def test_attribution_sums_to_logit_and_udf_agrees(spark):
    wf = Workflow.get(spark, SF001)
    m = linear.fit_logodds(wf.train, T.TfidfSpec(max_features=500))
    a = explain.attribution(m, wf.test).groupBy("prompt_id").agg(F.sum("attribution").alias("s"))
    s = m.score(wf.test).join(a, "prompt_id", "left")
    for r in s.collect():
        assert abs((r.s or 0.0) - r.logit) < 1e-5
    udf = batch_model.BatchUdfScorer(batch_model.export_linear(m)).score(wf.test)
    j = udf.select("prompt_id", F.col("prob_harmful").alias("u")).join(
        m.score(wf.test).select("prompt_id", "prob_harmful"), "prompt_id")
    assert j.filter(F.abs(F.col("u") - F.col("prob_harmful")) > 1e-9).count() == 0


def test_position_scores_add_up_to_unigram_part(spark):
    wf = Workflow.get(spark, SF001)
    m = linear.fit_logodds(wf.train, T.TfidfSpec(max_features=500))
    ps = explain.position_scores(m, wf.test).groupBy("prompt_id").agg(F.sum("score").alias("p"))
    uni = explain.attribution(m, wf.test).filter(~F.col("term").contains(" ")).groupBy(
        "prompt_id").agg(F.sum("attribution").alias("u"))
    for r in ps.join(uni, "prompt_id").collect():
        assert abs(r.p - r.u) < 1e-9


def test_leave_one_out_any_scorer(spark):
    from tests.conftest import SF01
    wf = Workflow.get(spark, SF01)
    df = spark.createDataFrame([(1, "You idiot, calm river.")], "prompt_id bigint, prompt string")
    lin = {r.word: r.attribution for r in explain.leave_one_out(wf.model, df).collect()}
    udf = batch_model.BatchUdfScorer(batch_model.export_linear(wf.model))
    bb = {r.word: r.attribution for r in explain.leave_one_out(udf, df).collect()}
    assert set(lin) == {"you", "idiot", "calm", "river"}
    assert lin["idiot"] > 0                       # removing the insult lowers P(harmful)
    assert all(abs(lin[w] - bb[w]) < 1e-9 for w in lin)
