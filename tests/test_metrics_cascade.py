
from promptscreen.operators import cascade, metrics
from promptscreen.plans.workflow import Workflow
from tests.conftest import SF001


def test_benign_only_type_and_one_class(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("b", 1, 1), ("b", 1, 0)]
    df = spark.createDataFrame(rows, "data_type string, label int, predicted_label int")
    b = {r.data_type: r for r in metrics.breakdown(df).collect()}
    assert b["a"].f1 == 0.0 and b["a"].accuracy == 0.5       # benign-only: F1 0, accuracy real
    assert b["ALL"].n == 4
    one = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted_label int")
    c = metrics.confusion(one).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (0, 0, 0, 2)
    rep = {r["class"]: r for r in metrics.classification_report(one).collect()}
    assert rep["Harmful"].f1 == 0.0 and rep["accuracy"].f1 == 1.0


def test_cascade_invariants(spark):
    wf = Workflow.get(spark, SF001)
    r = cascade.cascade(wf.gate, wf.model, wf.test).collect()
    assert len(r) == wf.test.count()
    for x in r:
        if x.gate_predicted_label == 1:
            assert x.pipeline_predicted_label == 1
            assert x.model_predicted_label is None and x.model_prob_harmful is None
        else:
            assert x.model_prob_harmful is not None
            assert x.pipeline_predicted_label == x.model_predicted_label


def test_requests_and_response(spark):
    wf = Workflow.get(spark, SF001)
    s = cascade.score_requests(wf.model, wf.requests)
    r = cascade.response(s).first()
    assert r.prediction.label in ("HARMFUL", "BENIGN")
    assert abs(r.prediction.harmful_probability + r.prediction.benign_probability - 1) < 1e-12
    assert '"prediction"' in r.json
