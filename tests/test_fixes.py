"""Cases that once went wrong: repeated attack cases, null prompts, certain
forests, one-class training rows, ambiguous content keys."""

import pytest
from pyspark.sql import functions as F

from promptscreen.functions.scalar import content_key, logit_of
from promptscreen.operators import batch_model, explain, linear, prepare
from promptscreen.operators import tfidf as T
from promptscreen.plans.workflow import Workflow
from promptscreen.sources import io
from tests.conftest import SF01

ROW = "prompt_id long, prompt string, data_type string, label int"


def test_two_flips_of_one_prompt_are_two_cases(spark):
    wf = Workflow.get(spark, SF01)
    row = wf.test.filter(F.length("prompt") < 2000).orderBy("prompt_id").first()
    res = spark.createDataFrame([], "prompt_id long, prompt string, label int, predicted_label int")
    kind = "prompt_id long, original_prompt string, label int, new_predicted_label int, token_rank int"

    def layout(flips):
        a = spark.createDataFrame([(row["prompt_id"], row["prompt"], 0, 1, k) for k in flips], kind)
        return explain.case_layout(wf.model, explain.error_cases(res, a)).select("case_no", "pos", "token", "score").collect()

    one, two = layout([1]), layout([1, 2])
    assert len(two) == 2 * len(one) > 0
    for n in (1, 2):
        assert {r["pos"]: round(r["score"], 9) for r in two if r["case_no"] == n} == {r["pos"]: round(r["score"], 9) for r in one}


def test_batch_model_reads_null_and_agrees_with_sql(spark):
    wf = Workflow.get(spark, SF01)
    for spec in (wf.model_spec, T.TfidfSpec(prefix="Classify this: ", max_tokens=20)):
        m = linear.fit_logodds(wf.train, spec).materialize()
        rows = wf.test.select("prompt_id", "prompt").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "prompt_id long, prompt string"))
        udf = {r["prompt_id"]: r["prob_harmful"] for r in batch_model.BatchUdfScorer(batch_model.export_linear(m)).score(rows).collect()}
        sql = {r["prompt_id"]: r["prob_harmful"] for r in m.score(rows).collect()}
        assert udf[-1] == 0.5 and all(abs(udf[k] - sql[k]) < 1e-5 for k in sql)


def test_logit_is_finite(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(logit_of("p")).collect()]
    assert got[1] == 0 and got[0] < -20 and got[2] > 20


def test_one_class_is_a_clear_error(spark):
    rows = spark.createDataFrame([(i, f"word{i} other words", "vanilla_benign", 0) for i in range(5)], ROW)
    with pytest.raises(Exception, match="both classes"):
        linear.fit_logodds(rows).vocab.collect()


def test_content_keys_are_unambiguous(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("a", None)], "x string, y string")
    keys = [r[0] for r in rows.select(content_key("x", "y")).collect()]
    assert len(set(keys)) == 5 and all(len(k) == 32 for k in keys)


def test_copies_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(prepare, "COPY_CHUNK", 7)
    rows = [("hot", "t", 1)] * 50 + [("x|y", None, 0)] * 3 + [("x", "y", 0)]
    got = prepare.assign_prompt_id(spark.createDataFrame(rows, "prompt string, data_type string, label int").repartition(3)).collect()
    assert len(got) == 54 == len({r["prompt_id"] for r in got})
    assert sorted(r["dup_no"] for r in got if r["prompt"] == "hot") == list(range(1, 51))


def test_raw_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("data_type\tvanilla\nx_harmful\thello\n")
    (tmp_path / "b.tsv").write_text("vanilla\tdata_type\nhello\tx_harmful\n")
    assert io.read_raw(spark, str(tmp_path / "a.tsv"), columns=("data_type", "vanilla")).count() == 1
    with pytest.raises(Exception, match="(?i)header"):
        io.read_raw(spark, str(tmp_path), columns=("data_type", "vanilla")).collect()
