import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.operators import cascade, explain, network, perturb
from promptscreen.operators import tfidf as T
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01

SPEC = T.TfidfSpec(ngram_max=1)


def _docs(rng, n=5, terms=7):
    doc = np.repeat(np.arange(n), 3)
    idx = np.concatenate([rng.choice(terms, 3, replace=False) for _ in range(n)])
    return doc, idx, rng.normal(size=3 * n), rng.integers(0, 2, n).astype(float), rng.random(n) + 0.5


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(3)
    doc, idx, x, y, w = _docs(rng)
    p = network.Params(rng.normal(size=(7, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1))
    _, terms, rows, gu, gb, gc = network.gradient(p, doc, idx, x, y, w)
    full = np.zeros_like(p.e)
    full[terms] = rows
    for array, grad in zip(p.arrays(), (full, gu, gb, np.array([gc])), strict=True):
        for at in np.ndindex(array.shape):
            was, diff = array[at], []
            for step in (1e-6, -1e-6):
                array[at] = was + step
                diff.append(network.gradient(p, doc, idx, x, y, w)[0])
            array[at] = was
            assert abs((diff[0] - diff[1]) / 2e-6 - grad[at]) < 1e-6


def _table(spark, rows):
    return spark.createDataFrame(rows, "prompt_id bigint, prompt string, label int")


def test_reaches_the_closed_form_optimum():
    """With one known term a text, the best logit of each is its weighted log-odds."""
    counts = np.array([(30, 10), (8, 24), (20, 20)])          # harmful, benign texts of each term
    idx = np.repeat([0, 0, 1, 1, 2, 2], counts.ravel())
    y = np.repeat([1.0, 0.0] * 3, counts.ravel())
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    doc, x = np.arange(len(y)), np.ones(len(y))
    p = network.Params.start(3, 4, 1)
    adam, first = network.Adam(p, 0.05), None
    for _ in range(1500):
        loss, terms, rows, gu, gb, gc = network.gradient(p, doc, idx, x, y, w)
        first = first or loss
        adam.step([g / w.sum() for g in (rows, gu, gb, np.array([gc]))])
    assert loss < first
    per_class = counts / counts.sum(0)
    _, logit = network.forward(p, np.arange(3), np.arange(3), np.ones(3), 3)
    assert logit == pytest.approx(np.log(per_class[:, 0] / per_class[:, 1]), abs=0.03)


def test_a_step_sums_over_all_tasks(spark):
    rng = np.random.default_rng(5)
    doc, idx, x, y, w = _docs(rng, n=40)
    p = network.Params(rng.normal(size=(7, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1))
    loss, terms, rows, gu, gb, gc = network.gradient(p, doc, idx, x, y, w)
    df = spark.createDataFrame([(idx[doc == d].tolist(), x[doc == d].tolist(), int(y[d]), float(w[d])) for d in range(40)],
                               "idx array<int>, x array<double>, label int, w double").repartition(6)
    (ge, *rest), mean = network._step(spark, df, p)
    want = np.zeros_like(p.e)
    want[terms] = rows
    assert mean == pytest.approx(loss / w.sum())
    for got, full in zip([ge, *rest], [want, gu, gb, np.array([gc])], strict=True):
        assert got == pytest.approx(full / w.sum())
    assert network._step(spark, df.limit(0), p) is None


def test_partitions_do_not_matter_and_odd_rows_do_not_crash(spark):
    words = ["one", "two", "three", "four", "five", "the", "", None]
    rows = [(i // 2, f"{words[i % 8] or ''} {words[i * 3 % 7]}" if i % 8 != 7 else None, i % 2) for i in range(60)]
    rows += [(1000, "one " * 20_000, 1), (1001, None, None)]
    how = network.TrainSpec(dim=3, epochs=2, batches=3)
    t = _table(spark, rows)
    a, b = (network.fit(t.repartition(k), t, SPEC, how) for k in (1, 9))
    assert a.losses == pytest.approx(b.losses, abs=1e-9) and a.epoch == b.epoch
    one, two = ({r.idx: r.e for r in x.scorer.vocab.collect()} for x in (a, b))
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-7) for i in one)
    null = a.scorer.score(_table(spark, [(1, None, 1), (2, "", 0), (3, "unseen", 0)])).collect()
    assert len({r.logit for r in null}) == 1 and null[0].logit is not None
    assert a.scorer.score(_table(spark, [])).count() == 0


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError):
        network.fit(_table(spark, [(1, "word", 1)]), _table(spark, []), SPEC)


def test_scores_slopes_and_choice_on_the_workflow(spark):
    wf = Workflow.get(spark, SF01)
    got = wf.network
    # the table expressions against numpy, and the slope against a numeric one
    model = {r.idx: r.e for r in got.scorer.vocab.collect()}
    p = network.Params(np.array([model[i] for i in range(len(model))]), np.array(got.scorer.u),
                       np.array(got.scorer.b), np.array([got.scorer.c]))
    logit = {r.prompt_id: r.logit for r in got.scorer.score(wf.val).collect()}
    some = network.sparse_rows(wf.val, got.scorer.vocab, got.scorer.spec).collect()
    assert len(some) == len(logit)
    slopes = {(r.prompt_id, r.idx): r.coef for r in got.scorer.contributions(T.by_id(wf.val)).collect()}

    def of(idx, x):
        return network.forward(p, np.zeros(len(idx), int), np.array(idx, int), np.array(x, float), 1)[1][0]

    for r in some:
        assert logit[r.prompt_id] == pytest.approx(of(r.idx, r.x), abs=2e-6)
    for r in some[:20]:
        for k, i in enumerate(r.idx):
            up, down = ([v + (s if j == k else 0) for j, v in enumerate(r.x)] for s in (1e-5, -1e-5))
            assert slopes[(r.prompt_id, i)] == pytest.approx((of(r.idx, up) - of(r.idx, down)) / 2e-5, abs=1e-5)
    # the kept epoch is the first of the best on validation
    per = {r.epoch: r for r in got.candidates.collect()}
    assert len(per) == network.TrainSpec().epochs and sum(r.best for r in per.values()) == 1
    assert got.epoch == min(per, key=lambda e: (-per[e].f1, e)) and per[got.epoch].best
    tp = sum(1 for r in got.scorer.score(wf.val).collect() if r.label == 1 and r.prob_harmful >= 0.5)
    assert per[got.epoch].tp == tp and per[got.epoch].n == len(logit)
    assert got.losses[-1] < got.losses[0]


def test_saved_and_loaded(spark, tmp_path):
    wf = Workflow.get(spark, SF01)
    m = wf.network.scorer
    m.save(str(tmp_path))
    again = network.NetworkScorer.load(spark, str(tmp_path))
    both = m.score(wf.val).join(again.score(wf.val).select("prompt_id", F.col("logit").alias("l2")), "prompt_id")
    assert again.spec == m.spec and both.count() == wf.val.count() and both.filter("logit <> l2").count() == 0


def test_runs_through_the_scorer_interface(spark):
    wf = Workflow.get(spark, SF01)
    m = wf.network.scorer
    c = cascade.cascade(wf.gate, m, wf.test)
    assert c.count() == wf.test.count()
    ps = explain.position_scores(m, wf.test, target="probability")
    assert explain.top_positions(ps).count() > 0 and explain.token_importance(ps).count() > 0
    src = wf.split.filter(F.col("split") != "train").drop("split")
    # a lexicon whose synonyms pull hardest to either side, so that verdicts do change
    slopes = m.contributions(T.by_id(src)).filter(~F.col("term").contains(" ")).groupBy("term").agg(F.avg("coef").alias("c"))
    ends = [slopes.orderBy(o).first()["term"] for o in (F.asc("c"), F.desc("c"))]
    tokens = {r.token for r in explain.top_positions(explain.position_scores(m, src)).collect()}
    lexicon = spark.createDataFrame([(t, " ".join([e] * 9), k) for t in tokens for k, e in enumerate(ends)],
                                    "word string, synonym string, rank int")
    flips = perturb.synonym_flips(m, src, lexicon).collect()
    assert flips
    chk = spark.createDataFrame([(i, r.perturbed_prompt, r.new_predicted_label) for i, r in enumerate(flips)],
                                "prompt_id bigint, prompt string, want int")
    assert m.score(chk).filter((F.col("prob_harmful") >= 0.5).cast("int") != F.col("want")).count() == 0


def test_vectors_are_no_keys_of_the_counted_terms(spark):
    vocab = spark.createDataFrame([(0, "one", 1.0, [0.5, 1.0]), (1, "two", 2.0, [1.5, -1.0])], "idx int, term string, idf double, e array<double>")
    m = network.NetworkScorer(SPEC, vocab, [1.0, 2.0], [0.0, 0.1], 0.2)
    t = _table(spark, [(1, "one two one", 1), (1, "one", 1), (2, None, 0), (None, "two", 0)])
    plan = m.score(t)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.split("], [")[0].count(", e#") for line in plan.splitlines() if "Aggregate [" in line)
    rows = sorted((str(r["prompt_id"]), r["term"], r["tf"], r["e"]) for r in m._terms(t, "prompt", "prompt_id").collect())
    assert rows == [("1", "one", 3, [0.5, 1.0]), ("1", "two", 1, [1.5, -1.0]), ("None", "two", 1, [1.5, -1.0])]
