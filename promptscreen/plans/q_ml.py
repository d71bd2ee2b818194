"""Queries: model selection, logistic regression, random forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.constants import FOREST_TREES
from promptscreen.functions.scalar import decide
from promptscreen.operators import cascade, ensemble, linear, metrics
from promptscreen.plans.oracle import STD_MODELS, score_ctes, tfidf_ctes, with_ctes
from promptscreen.plans.oracle_forest import forest_ctes, forest_score_ctes
from promptscreen.plans.q_model import _COUNTS, _PRF, breakdown_sql
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow

ALPHAS = [0.25, 0.5, 1.0, 2.0, 4.0]

_CANDS = "cands(candidate, alpha) AS (VALUES " + ", ".join(
    f"({i}, CAST({a} AS DOUBLE))" for i, a in enumerate(ALPHAS)) + ")"

_SELECT = with_ctes(["train", "val"], STD_MODELS + ",\n" + _CANDS + "," +
                    tfidf_ctes("va", "m2", "val", 2) + f""",
cw AS (
  SELECT v.term, c.candidate, c.alpha,
         ln((v.df_h + c.alpha * n.n_h / (n.n_h + n.n_b)) / n.n_h)
         - ln((v.df_b + c.alpha * n.n_b / (n.n_h + n.n_b)) / n.n_b) AS coef
  FROM m2_vocab v, m2_n n, cands c),
vs AS (SELECT x.prompt_id, w.candidate, sum(w.coef * x.x) AS s
       FROM va_x x JOIN cw w ON x.term = w.term GROUP BY 1, 2),
vsc AS (
  SELECT v.prompt_id, v.label, c.candidate, c.alpha, round(coalesce(s.s, 0), 6) AS logit
  FROM val v CROSS JOIN cands c LEFT JOIN vs s ON v.prompt_id = s.prompt_id AND c.candidate = s.candidate),
pred AS (SELECT *, CAST(1 / (1 + exp(-logit)) >= 0.5 AS INTEGER) AS predicted_label FROM vsc),
per0 AS (SELECT candidate, alpha, {_COUNTS} FROM pred GROUP BY candidate, alpha),
per AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1raw
        FROM per0),
best AS (SELECT candidate FROM per ORDER BY f1raw DESC, candidate LIMIT 1)""")


def _select(wf: Workflow):
    return linear.select_by_val_f1(wf.train, wf.val, wf.model_spec, ALPHAS, stats=wf.train_stats)


@query("m7_select_by_val_f1", _SELECT + f"""
SELECT candidate, alpha, tp, fp, fn, tn, n, {_PRF},
       candidate = (SELECT candidate FROM best) AS best FROM per""")
def m7_select_by_val_f1(spark, sf_dir):
    return fin(_select(Workflow.get(spark, sf_dir)))


@query("a13_best_candidate", _SELECT + f"""
SELECT candidate, alpha, tp, fp, fn, tn, n, {_PRF} FROM per
WHERE candidate = (SELECT candidate FROM best)""")
def a13_best_candidate(spark, sf_dir):
    per = _select(Workflow.get(spark, sf_dir)).drop("best")
    return fin(metrics.best_candidate(per))


@query("m6_logreg_train")
def m6_logreg_train(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    m = linear.fit_logreg(wf.train, wf.model_spec, reg_param=0.01, stats=wf.train_stats)
    s = m.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
    return fin(s.select("prompt_id", "data_type", "label", "logit", "prob_harmful",
                        "predicted_label"))


FOREST = with_ctes(["train", "test"], STD_MODELS + ",\n" + forest_ctes())
_FOREST_TEST = FOREST.rstrip() + ",\n" + forest_score_ctes("fe", "test")


@query("m3_forest_train", FOREST.rstrip() + ",\n" + forest_score_ctes("fq", "train") + f""",
pred AS (SELECT label, CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label FROM fq_scored),
cnt AS (SELECT {_COUNTS} FROM pred)
SELECT {FOREST_TREES} AS trees, (SELECT count(*) FROM fnodes) AS nodes, tp, fp, fn, tn, n, {_PRF} FROM cnt""")
def m3_forest_train(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    s = wf.forest.score(wf.train).withColumn("predicted_label", decide("prob_harmful"))
    nodes = wf.forest.nodes.agg(F.count("*")).scalar()
    return fin(metrics.prf(s).select(F.lit(wf.forest.trees).alias("trees"), nodes.alias("nodes"), "*"))


@query("m4_forest_score", _FOREST_TEST + """
SELECT prompt_id, data_type, label, CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label,
       round_even(prob_harmful, 4) AS prob_harmful, CAST(prob_harmful >= 0.5 AS INTEGER) AS blocked FROM fe_scored""")
def m4_forest_score(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    r = cascade.gate_results(wf.forest, wf.test)
    return fin(r.select("prompt_id", "data_type", "label", "predicted_label", "prob_harmful",
                        "blocked"))


@query("m5_forest_importance", FOREST.rstrip() + """,
fi AS (SELECT idx, gain / sum(gain) OVER (PARTITION BY tree) AS share FROM fsplits),
fj AS (SELECT v.term AS feature, sum(share) / (SELECT count(DISTINCT tree) FROM fsplits) AS importance
       FROM fi JOIN m2_vocab v ON v.idx = fi.idx GROUP BY 1)
SELECT feature, round(importance, 6) AS importance FROM (SELECT * FROM fj ORDER BY round(importance, 9) DESC, feature LIMIT 20)""")
def m5_forest_importance(spark, sf_dir):
    return fin(ensemble.importances(Workflow.get(spark, sf_dir).forest))


@query("m9_cascade_forest", _FOREST_TEST + "," + score_ctes("te", "m2", "test", 2) + """,
fcasc AS (SELECT g.data_type, g.label, CASE WHEN g.prob_harmful > 0.5 THEN 1 ELSE CAST(m.prob_harmful > 0.5 AS INTEGER) END AS predicted_label
          FROM fe_scored g JOIN te_scored m ON m.prompt_id = g.prompt_id)""" + breakdown_sql("SELECT data_type, label, predicted_label FROM fcasc"))
def m9_cascade_forest(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    r = cascade.cascade(wf.forest, wf.model, wf.test)
    return fin(metrics.breakdown(r, pred="pipeline_predicted_label"))
