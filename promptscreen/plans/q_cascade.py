"""Queries: cascade, request scoring, batch-model inference, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.functions.scalar import decide
from promptscreen.operators import batch_model, cascade, metrics
from promptscreen.plans.oracle import STD_MODELS, score_ctes, with_ctes
from promptscreen.plans.oracle_forest import forest_ctes, forest_score_ctes
from promptscreen.plans.q_model import _COUNTS, _PRF, breakdown_sql
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow

_CASC_CTES = with_ctes(["train", "test"], STD_MODELS + "," + score_ctes("te", "m2", "test", 2)
                       + "," + score_ctes("ge", "m1", "test", 1) + """,
casc AS (
  SELECT g.prompt_id, g.prompt, g.data_type, g.label,
         CASE WHEN g.prob_harmful > 0.5 THEN 1 ELSE 0 END AS gate_predicted_label,
         round_even(g.prob_harmful, 4) AS gate_prob_harmful,
         CASE WHEN g.prob_harmful > 0.5 THEN NULL
              ELSE CASE WHEN m.prob_harmful > 0.5 THEN 1 ELSE 0 END END AS model_predicted_label,
         CASE WHEN g.prob_harmful > 0.5 THEN NULL ELSE m.prob_harmful END AS model_prob_harmful,
         CASE WHEN g.prob_harmful > 0.5 THEN 1
              ELSE CASE WHEN m.prob_harmful > 0.5 THEN 1 ELSE 0 END END AS pipeline_predicted_label
  FROM ge_scored g JOIN te_scored m ON g.prompt_id = m.prompt_id)""")

_CASC_COLS = ("prompt_id", "data_type", "label", "gate_predicted_label", "gate_prob_harmful",
              "model_predicted_label", "model_prob_harmful", "pipeline_predicted_label")


def run_cascade(wf: Workflow, model=None):
    return cascade.cascade(wf.gate, model or wf.model, wf.test)


@query("m9_cascade", _CASC_CTES + """
SELECT prompt_id, data_type, label, gate_predicted_label, gate_prob_harmful, model_predicted_label,
       round(model_prob_harmful, 6) AS model_prob_harmful, pipeline_predicted_label FROM casc""")
def m9_cascade(spark, sf_dir):
    return fin(run_cascade(Workflow.get(spark, sf_dir)).select(*_CASC_COLS))


@query("m9_cascade_batch_udf", ORACLE_M9 := _CASC_CTES + """
SELECT prompt_id, data_type, label, gate_predicted_label, gate_prob_harmful, model_predicted_label,
       round(model_prob_harmful, 6) AS model_prob_harmful, pipeline_predicted_label FROM casc""")
def m9_cascade_batch_udf(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    udf_model = batch_model.BatchUdfScorer(batch_model.export_linear(wf.model))
    out = run_cascade(wf, udf_model).select(*_CASC_COLS)
    return fin(out.withColumn("model_prob_harmful", F.round("model_prob_harmful", 6)))


@query("a6_breakdown_cascade", _CASC_CTES + breakdown_sql(
    "SELECT data_type, label, pipeline_predicted_label AS predicted_label FROM casc"))
def a6_breakdown_cascade(spark, sf_dir):
    r = run_cascade(Workflow.get(spark, sf_dir))
    return fin(metrics.breakdown(r, pred="pipeline_predicted_label"))


@query("p8_passed_prompts", _CASC_CTES + """
SELECT prompt_id, prompt, data_type, label, gate_prob_harmful FROM casc
WHERE gate_predicted_label = 0""")
def p8_passed_prompts(spark, sf_dir):
    return fin(cascade.passed_prompts(run_cascade(Workflow.get(spark, sf_dir))))


@query("a7_gate_counts", _CASC_CTES + """
SELECT count_if(gate_predicted_label = 1) AS blocked, count_if(gate_predicted_label = 0) AS passed,
       count(*) AS n FROM casc""")
def a7_gate_counts(spark, sf_dir):
    return metrics.gate_counts(run_cascade(Workflow.get(spark, sf_dir)))


@query("p10_result_columns", _CASC_CTES + """
SELECT prompt_id, data_type, label, CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label,
       round_even(prob_harmful, 4) AS prob_harmful, CAST(prob_harmful >= 0.5 AS INTEGER) AS blocked
FROM ge_scored""")
def p10_result_columns(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(cascade.gate_results(wf.gate, wf.test).select(
        "prompt_id", "data_type", "label", "predicted_label", "prob_harmful", "blocked"))


@query("j1_attach_scores", _CASC_CTES + """
SELECT t.prompt_id, t.label, coalesce(c.model_predicted_label, 0) AS predicted_label,
       round(c.model_prob_harmful, 6) AS prob_harmful
FROM test t LEFT JOIN (SELECT * FROM casc WHERE gate_predicted_label = 0) c
  ON t.prompt_id = c.prompt_id""")
def j1_attach_scores(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    r = run_cascade(wf).filter(F.col("gate_predicted_label") == 0).select(
        "prompt_id", F.col("model_predicted_label").alias("predicted_label"),
        F.col("model_prob_harmful").alias("prob_harmful"))
    out = cascade.attach_scores(wf.test.select("prompt_id", "label"), r)
    return fin(out.select("prompt_id", "label", "predicted_label", "prob_harmful"))


@query("j2_blocked_semi_anti", _CASC_CTES + """
SELECT prompt_id, label, CASE WHEN gate_predicted_label = 1 THEN 'blocked' ELSE 'passed' END AS branch
FROM casc""")
def j2_blocked_semi_anti(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    g = cascade.gate_results(wf.gate, wf.test, inclusive=False)
    blocked_ids = g.filter(F.col("blocked") == 1).select("prompt_id")
    rows = wf.test.select("prompt_id", "label")
    b, p = cascade.split_by_gate(rows, blocked_ids)
    return b.withColumn("branch", F.lit("blocked")).unionByName(
        p.withColumn("branch", F.lit("passed")))


@query("a14_comparison", _CASC_CTES.rstrip() + ",\n" + forest_ctes() + "," + forest_score_ctes("fe", "test") + f""",
fcasc AS (SELECT g.label, CAST(g.prob_harmful > 0.5 AS INTEGER) AS gate,
                 CASE WHEN g.prob_harmful > 0.5 THEN 1 ELSE CAST(m.prob_harmful > 0.5 AS INTEGER) END AS pipeline
          FROM fe_scored g JOIN te_scored m ON m.prompt_id = g.prompt_id),
forest_m AS (SELECT 'Gate (TF-IDF random forest)' AS model, * FROM (SELECT {_COUNTS} FROM (SELECT label, gate AS predicted_label FROM fcasc))),
fpipe_m AS (SELECT 'Forest gate + model cascade' AS model, * FROM (SELECT {_COUNTS} FROM (SELECT label, pipeline AS predicted_label FROM fcasc))),
gate_m AS (SELECT 'Gate (TF-IDF unigram log-odds)' AS model, * FROM (
  SELECT {_COUNTS} FROM (SELECT label, gate_predicted_label AS predicted_label FROM casc))),
pipe_m AS (SELECT 'Gate + model cascade' AS model, * FROM (
  SELECT {_COUNTS} FROM (SELECT label, pipeline_predicted_label AS predicted_label FROM casc))),
comp AS (SELECT model, {_PRF} FROM (SELECT * FROM gate_m UNION ALL SELECT * FROM pipe_m
                                          UNION ALL SELECT * FROM forest_m UNION ALL SELECT * FROM fpipe_m))
SELECT model, CAST(NULLIF(regexp_extract(p, '^[0-9.]+$'), '') AS DOUBLE) AS precision,
       CAST(NULLIF(regexp_extract(r, '^[0-9.]+$'), '') AS DOUBLE) AS recall,
       CAST(NULLIF(regexp_extract(f, '^[0-9.]+$'), '') AS DOUBLE) AS f1,
       p AS precision_text, r AS recall_text, f AS f1_text, 'published' AS source
FROM (VALUES ('LLaMA-8B Naive', 'N/A', '~0', '0.0972'), ('LLaMA-8B Strict', '0.8980', '0.6423', '0.7489'),
             ('BERT Only', '0.9780', '0.9773', '0.9777')) v(model, p, r, f)
UNION ALL
SELECT model, precision, recall, f1, printf('%.4f', precision), printf('%.4f', recall),
       printf('%.4f', f1), 'computed' FROM comp""")
def a14_comparison(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    named = []
    for gate, alone, piped in ((wf.gate, "Gate (TF-IDF unigram log-odds)", "Gate + model cascade"),
                               (wf.forest, "Gate (TF-IDF random forest)", "Forest gate + model cascade")):
        r = cascade.cascade(gate, wf.model, wf.test)
        named.append(metrics.prf(r, pred="gate_predicted_label").withColumn("model", F.lit(alone)))
        named.append(metrics.prf(r, pred="pipeline_predicted_label").withColumn("model", F.lit(piped)))
    comp = reduce(DataFrame.unionByName, named)
    return fin(metrics.comparison(spark, fin(comp)))


@query("s6_score_requests", with_ctes(["train", "requests"], STD_MODELS + "," +
                                      score_ctes("rq", "m2", "requests", 2)) + """
SELECT prompt_id, prompt, CASE WHEN prob_harmful > 0.5 THEN 'HARMFUL' ELSE 'BENIGN' END AS prediction_label,
       round(prob_harmful, 6) AS harmful_probability, round(1 - prob_harmful, 6) AS benign_probability
FROM rq_scored""")
def s6_score_requests(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(cascade.score_requests(wf.model, wf.requests))


@query("p17_response", with_ctes(["train", "requests"], STD_MODELS + "," +
                                 score_ctes("rq", "m2", "requests", 2)) + """,
r AS (SELECT prompt_id, prompt, CASE WHEN prob_harmful > 0.5 THEN 'HARMFUL' ELSE 'BENIGN' END AS label,
             round(prob_harmful, 6) AS harmful_probability, round(1 - prob_harmful, 6) AS benign_probability FROM rq_scored)
SELECT *, prompt AS json_prompt, label AS json_label, harmful_probability AS json_harmful, benign_probability AS json_benign FROM r""")
def p17_response(spark, sf_dir):
    """The nested response, and its JSON text read back field by field."""
    wf = Workflow.get(spark, sf_dir)
    r = cascade.response(cascade.score_requests(wf.model, wf.requests))
    kind = r.schema["prediction"].dataType
    back = F.from_json("json", f"prompt string, prediction {kind.simpleString()}")
    r = r.withColumn("_j", back)
    return fin(r.select("prompt_id", "prompt", *(F.col(f"prediction.{c}").alias(c) for c in ("label", "harmful_probability", "benign_probability")),
                        F.col("_j.prompt").alias("json_prompt"), F.col("_j.prediction.label").alias("json_label"),
                        F.col("_j.prediction.harmful_probability").alias("json_harmful"),
                        F.col("_j.prediction.benign_probability").alias("json_benign")))


@query("m8_batch_udf", with_ctes(["train", "test"], STD_MODELS + "," +
                                 score_ctes("te", "m2", "test", 2)) + """
SELECT prompt_id, round(prob_harmful, 6) AS prob_harmful,
       CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label FROM te_scored""")
def m8_batch_udf(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    s = batch_model.BatchUdfScorer(batch_model.export_linear(wf.model)).score(wf.test)
    return fin(s.select("prompt_id", "prob_harmful",
                        decide("prob_harmful").alias("predicted_label")))
