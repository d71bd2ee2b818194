from promptscreen.operators import forest
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF01


def test_forest_probabilities_and_importances(spark):
    wf = Workflow.get(spark, SF01)
    f = forest.fit_forest(wf.train, wf.model_spec, num_trees=20, max_depth=5, vocab=wf.model.vocab)
    probs = [r.prob_harmful for r in f.score(wf.test).collect()]
    assert probs and all(0.0 <= p <= 1.0 for p in probs)
    imp = f.model.featureImportances
    assert abs(sum(imp.values) - 1.0) < 1e-6
    top = [r.feature for r in forest.importances(spark, f, 20).collect()]
    planted = {"trash", "idiot", "scum", "clown", "worthless", "moron", "pathetic", "loser",
               "disgusting", "stupid"}
    assert planted & set(top)


def test_stored_vectors_need_no_python_worker(spark):
    from promptscreen.operators import tfidf as T
    wf = Workflow.get(spark, SF01)
    base = T.by_id(wf.val.select("prompt_id", "prompt", "label").unionByName(
        spark.createDataFrame([(-1, None, 0)], "prompt_id long, prompt string, label int")))
    x = T.transform(T.doc_terms(base.select("prompt_id", "prompt"), wf.model_spec), wf.model.vocab, wf.model_spec)
    stored = forest.stored_vectors(x, base.drop("prompt"), 10_000)
    assert "Python" not in stored._jdf.queryExecution().executedPlan().toString()
    read = {r["prompt_id"]: (r["label"], r["features"]) for r in stored.collect()}
    plain = {r["prompt_id"]: (r["label"], r["features"]) for r in forest.vectors(x, base.drop("prompt"), 10_000).collect()}
    assert read.keys() == plain.keys() and read[-1][1].numNonzeros() == 0 and read[-1][1].size == 10_000
    for k, (label, v) in read.items():
        assert label == plain[k][0] and v.size == plain[k][1].size and list(v.indices) == list(plain[k][1].indices)
        assert abs(v.values - plain[k][1].values).max(initial=0) < 1e-12
