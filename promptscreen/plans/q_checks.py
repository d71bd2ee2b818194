"""Queries that check what SQL cannot compute (fitted forests and solvers) by
properties that SQL can state, and the reference's own order of work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptscreen.constants import CLASSIFICATION_PREFIX, FOREST_TREES, MAX_SEQUENCE_TOKENS, N_BENIGN, N_HARMFUL
from promptscreen.functions.scalar import decide
from promptscreen.operators import cascade, ensemble, explain, linear, perturb, sampling
from promptscreen.operators import tfidf as T
from promptscreen.plans.oracle import BASE, STD_MODELS, TOKEN_RE, model_ctes, okey, score_ctes, with_ctes
from promptscreen.plans.q_explain import _SAMPLED as _EXPLAIN_SAMPLE
from promptscreen.plans.q_explain import pos_ctes
from promptscreen.plans.q_prepare import quotas_sql
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow
from promptscreen.sources import io

# --- sample, then split --------------------------------------------------------
_SAMPLED_SPLIT = (
    with_ctes(["prompts"], quotas_sql({1: N_HARMFUL, 0: N_BENIGN})).replace("prompts AS (", "prompts0 AS (", 1)
    .replace("FROM prompts ", "FROM prompts0 ") + f""",
prompts AS (
  SELECT p.prompt_id, p.prompt, p.data_type, p.label
  FROM (SELECT *, row_number() OVER (PARTITION BY label, data_type ORDER BY {okey('sample')}, prompt_id) AS rk
        FROM prompts0 WHERE data_type IS NOT NULL) p
  JOIN quotas q ON p.label = q.label AND p.data_type = q.data_type WHERE p.rk <= q.quota),
""" + BASE["split_q"].strip() + ",\n" + BASE["split"].strip())


@query("w2_sampled_split", _SAMPLED_SPLIT + """
SELECT prompt_id, data_type, label, split FROM split""")
def w2_sampled_split(spark, sf_dir):
    return Workflow.get(spark, sf_dir).sampled.select("prompt_id", "data_type", "label", "split")


# --- the stage-2 input: prefix and the first 256 tokens -------------------------
_PREFIXED = f"('{CLASSIFICATION_PREFIX}' || prompt)"
PREFIXED_SPEC = T.TfidfSpec(ngram_max=2, prefix=CLASSIFICATION_PREFIX, max_tokens=MAX_SEQUENCE_TOKENS)


@query("m6_score_prefixed", with_ctes(["train", "test"], model_ctes("mp", "train", 2, text=_PREFIXED, max_tokens=MAX_SEQUENCE_TOKENS)
                                      + "," + score_ctes("pf", "mp", "test", 2, _PREFIXED, MAX_SEQUENCE_TOKENS)) + """
SELECT prompt_id, label, logit, round(prob_harmful, 6) AS prob_harmful FROM pf_scored""")
def m6_score_prefixed(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    m = linear.fit_logodds(wf.train, PREFIXED_SPEC, wf.alpha)
    return fin(m.score(wf.test).select("prompt_id", "label", "logit", "prob_harmful"))


_PREFIX_MODEL = model_ctes("mp", "train", 2, text=_PREFIXED) + "," + score_ctes("pi", "mp", "test", 2, _PREFIXED)


@query("a10_position_scores_prefix", with_ctes(["train", "test"], _PREFIX_MODEL) + f""",
pos AS (SELECT prompt_id, unnest(range(len(t))) AS pos, unnest(t) AS token
        FROM (SELECT prompt_id, regexp_extract_all(lower({_PREFIXED}), '{TOKEN_RE}') AS t FROM test))
SELECT p.prompt_id, p.pos, p.token, round(coalesce(c.contribution / c.tf, 0), 6) AS score
FROM pos p LEFT JOIN pi_c c ON c.prompt_id = p.prompt_id AND c.term = p.token""")
def a10_position_scores_prefix(spark, sf_dir):
    """Scores of all tokens the model sees, those of the instruction prefix included."""
    wf = Workflow.get(spark, sf_dir)
    m = linear.fit_logodds(wf.train, T.TfidfSpec(ngram_max=2, prefix=CLASSIFICATION_PREFIX), wf.alpha)
    return fin(explain.position_scores(m, wf.test, include_prefix=True))


@query("a10_token_importance_prob", with_ctes(["train", "test"], _EXPLAIN_SAMPLE + "," + STD_MODELS + "," + pos_ctes("sa", "sampled")
                                              + "," + score_ctes("sq", "m2", "sampled", 2)) + """
SELECT token, round(avg(abs(v)), 6) AS average_abs_gradient_input, count(*) AS n
FROM (SELECT token, score * s.prob_harmful * (1 - s.prob_harmful) AS v FROM sa_ps p JOIN sq_scored s ON s.prompt_id = p.prompt_id)
WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]') AND NOT starts_with(token, '##')
GROUP BY token HAVING count(*) >= 3 ORDER BY avg(abs(v)) DESC, token LIMIT 20""")
def a10_token_importance_prob(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    s = sampling.sample_n(wf.test, 500)
    return fin(explain.token_importance(explain.position_scores(wf.model, s, target="probability")))


# --- forest, solver and attack properties ---------------------------------------
@query("m3_forest_check", with_ctes(["train"]) + f"""
SELECT {FOREST_TREES} AS trees, true AS has_splits, count(*) AS n, count_if(label = 1) AS n_harmful FROM train""")
def m3_forest_check(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    f = wf.forest
    return f.score(wf.train).agg(
        F.lit(f.trees).alias("trees"), (f.nodes.agg(F.count("*")).scalar() > f.trees).alias("has_splits"),
        F.count("prob_harmful").alias("n"), F.count_if(F.col("label") == 1).alias("n_harmful"))


@query("m4_forest_check", with_ctes(["test"]) + """
SELECT prompt_id, label, true AS in_range, true AS predicted_ok, true AS blocked_ok FROM test""")
def m4_forest_check(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    raw = wf.forest.score(wf.test).select("prompt_id", F.col("prob_harmful").alias("p"))
    r = cascade.gate_results(wf.forest, wf.test).join(raw, "prompt_id")
    return r.select("prompt_id", "label", F.col("p").between(0, 1).alias("in_range"),
                    (F.col("predicted_label") == (F.col("p") >= 0.5).cast("int")).alias("predicted_ok"),
                    (F.col("blocked") == F.col("predicted_label")).alias("blocked_ok"))


@query("m5_importance_check", """
SELECT p AS position, true AS in_vocabulary, true AS not_rising, 1.0 AS total FROM (SELECT unnest(range(1, 21)) AS p)""")
def m5_importance_check(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    top = ensemble.importances(wf.forest)
    w = Window.orderBy(F.col("importance").desc(), "feature")             # 20 rows
    known = wf.model.vocab.select(F.col("term").alias("feature"), F.lit(True).alias("known"))
    total = round(ensemble.importances(wf.forest, None).agg(F.sum("importance")).first()[0], 6)
    return top.join(known, "feature", "left").select(
        F.row_number().over(w).cast("bigint").alias("position"), F.coalesce("known", F.lit(False)).alias("in_vocabulary"),
        (F.col("importance") <= F.coalesce(F.lag("importance").over(w), F.lit(1.0))).alias("not_rising"), F.lit(total).alias("total"))


@query("m6_logreg_check", with_ctes(["train"]) + """
SELECT count(*) AS n, 0.0 AS largest_gradient FROM train""")
def m6_logreg_check(spark, sf_dir):
    """At the solution the weighted gradient of the regularised loss is 0, whatever the solver."""
    wf, reg = Workflow.get(spark, sf_dir), 0.01
    m = linear.fit_logreg(wf.train, wf.model_spec, reg_param=reg, stats=wf.train_stats, max_iter=500, tol=1e-12)
    w = linear.with_class_weight(m.score(wf.train).select("prompt_id", "label", "prob_harmful"))
    err = w.select("prompt_id", "weight", (F.col("weight") * (F.col("prob_harmful") - F.col("label"))).alias("e"))
    total = err.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.sum("e").alias("e")).first()
    x = m.features(T.by_id(wf.train.select("prompt_id", "prompt"))).select("prompt_id", "idx", F.col("weight").alias("x"))
    per = x.join(err.select("prompt_id", "e"), "prompt_id").groupBy("idx").agg(F.sum(F.col("x") * F.col("e")).alias("g"))
    g = m.vocab.select("idx", F.col("weight").alias("c")).join(per, "idx", "left").select(
        F.abs(F.coalesce("g", F.lit(0.0)) / total["w"] + reg * F.col("c")).alias("g"))
    worst = g.agg(F.greatest(F.max("g"), F.lit(abs(total["e"] / total["w"]))).alias("g"))
    return worst.select(F.lit(total["n"]).cast("bigint").alias("n"), F.round("g", 6).alias("largest_gradient"))


@query("m9_cascade_forest_check", with_ctes(["test"]) + """
SELECT prompt_id, label, true AS nulls_ok, true AS verdict_ok FROM test""")
def m9_cascade_forest_check(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    r = cascade.cascade(wf.forest, wf.model, wf.test)
    blocked, m = F.col("gate_predicted_label") == 1, F.col("model_predicted_label")
    return r.select("prompt_id", "label", (blocked == (m.isNull() & F.col("model_prob_harmful").isNull())).alias("nulls_ok"),
                    (F.col("pipeline_predicted_label") == F.coalesce(m, F.lit(1))).alias("verdict_ok"))


@query("m12_greedy_forest_check", with_ctes(["split"]) + """
SELECT prompt_id, label, true AS text_ok, true AS result_ok FROM split WHERE split <> 'train'""")
def m12_greedy_forest_check(spark, sf_dir):
    """The attack log on the forest gate, written, read back and scored again."""
    wf = Workflow.get(spark, sf_dir)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    path = io.scratch_dir(spark, "attack-log")
    perturb.greedy_substitution(wf.forest, src, wf.synonyms).write.parquet(path)
    log = spark.read.parquet(path)
    again = wf.forest.score(log.select("prompt_id", F.col("perturbed_text").alias("prompt"))).select(
        "prompt_id", decide("prob_harmful").alias("again"))
    j = log.join(again, "prompt_id").join(src.select("prompt_id", "prompt", "label"), "prompt_id")
    y, kind = F.col("label"), F.col("result_type")
    ok = (F.when(kind == "Successful", (F.col("again") != y) & (F.col("original_output") == y))
          .when(kind == "Failed", (F.col("again") == y)).otherwise(F.col("original_output") != y))
    return j.select("prompt_id", "label", (F.col("original_text") == F.col("prompt")).alias("text_ok"), ok.alias("result_ok"))
