from pyspark.sql import functions as F

from promptscreen.functions.scalar import decide
from promptscreen.operators import explain, perturb
from promptscreen.plans.workflow import Workflow
from promptscreen.sources import fixture
from tests.conftest import SF01


def test_synonyms_normalised(spark):
    s = perturb.prepare_synonyms(fixture.synonyms(spark)).collect()
    by = {}
    for r in s:
        by.setdefault(r.word, []).append((r.syn_rank, r.synonym))
    assert (2, "simple person") in by["idiot"]                    # "_" becomes a space
    assert all(syn != "clown" for _, syn in by["clown"])        # equal to its word: dropped
    assert (2, "comedian") in by["clown"]                         # lower-cased
    assert len(by["pathetic"]) == 5                               # at most five


def test_repeated_word_taken_twice(spark):
    wf = Workflow.get(spark, SF01)
    m = wf.model
    df = spark.createDataFrame([(1, "idiot idiot idiot calm")], "prompt_id bigint, prompt string")
    top = explain.top_positions(explain.position_scores(m, df)).orderBy("token_rank").collect()
    assert [t.pos for t in top] == [0, 1, 2] and {t.token for t in top} == {"idiot"}


def test_every_flip_rescores_to_new_label(spark):
    wf = Workflow.get(spark, SF01)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    a = perturb.synonym_flips(wf.model, src, wf.synonyms)
    rows = a.collect()
    assert rows, "expected at least one flip at sf0.01"
    chk = spark.createDataFrame([(i, r.perturbed_prompt, r.new_predicted_label)
                                 for i, r in enumerate(rows)],
                                "prompt_id bigint, prompt string, expect int")
    s = wf.model.score(chk).withColumn("p", decide("prob_harmful"))
    assert s.filter(F.col("p") != F.col("expect")).count() == 0
    for r in rows:
        assert r.original_predicted_label != r.new_predicted_label
        assert r.perturbed_prompt != r.original_prompt.lower()


def test_reference_default_target_runs(spark):
    # The reference attacks adversarial_benign test prompts (none flips here).
    wf = Workflow.get(spark, SF01)
    tgt = wf.test.filter(F.col("data_type") == "adversarial_benign")
    a = perturb.synonym_flips(wf.model, tgt, wf.synonyms, require_correct=True)
    assert tgt.count() > 0 and a.filter("original_predicted_label <> label").count() == 0
    assert {r.prompt_id for r in a.collect()} <= {r.prompt_id for r in tgt.collect()}
    aug = perturb.augment(wf.train, perturb.as_training_rows(a))
    assert aug.count() == wf.train.count() + a.count()


def test_greedy_substitution_results_hold(spark):
    wf = Workflow.get(spark, SF01)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    r = perturb.greedy_substitution(wf.gate, src, wf.synonyms).collect()
    assert len(r) == src.count()
    kinds = {x.result_type for x in r}
    assert kinds <= {"Successful", "Failed", "Skipped"} and "Successful" in kinds
    chk = spark.createDataFrame([(i, x.perturbed_text) for i, x in enumerate(r)],
                                "prompt_id bigint, prompt string")
    got = {x.prompt_id: x.p for x in wf.gate.score(chk).withColumn(
        "p", decide("prob_harmful")).collect()}
    for i, x in enumerate(r):
        if x.result_type == "Skipped":
            assert x.original_output != x.ground_truth_output and x.num_changes == 0
        elif x.result_type == "Successful":
            assert got[i] != x.ground_truth_output and x.num_changes >= 1
        else:
            assert got[i] == x.ground_truth_output


def test_a_step_carries_no_whole_text(spark):
    """Each position once came with every token of its text (``_a``): quadratic in the text."""
    import re
    wf = Workflow.get(spark, SF01)
    r = perturb._ranked(wf.gate, wf.val, wf.synonyms, None, 5, 0.5, "prompt_id")
    plan = r.positions.groupBy("prompt_id").agg(F.map_from_entries(F.collect_list(
        F.struct("pos", F.struct("order", "_b.synonym")))).alias("_plan"), F.count("*").alias("_c"))
    doc = r.live.join(plan, "prompt_id").withColumns(perturb._pieces()).withColumn(
        "_ord", F.transform("_toks", lambda t, i: F.element_at("_plan", i)))
    steps = perturb._steps(doc, wf.gate.spec, "prompt_id")
    text = steps._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate .*, \[([^\]]*)\], false, \[_e#", text)
    assert carried and not any("_a#" in c for c in carried)
