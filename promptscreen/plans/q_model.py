"""Queries: text functions, TF-IDF, the linear model and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.constants import CLASSIFICATION_PREFIX, MAX_SEQUENCE_TOKENS, STOP_WORDS
from promptscreen.functions import text as X
from promptscreen.functions.scalar import decide, softmax2
from promptscreen.operators import heavy, linear, metrics
from promptscreen.operators import tfidf as T
from promptscreen.plans.oracle import (STD_MODELS, STOP_SQL, TOKEN_RE, model_ctes,
                                       score_ctes, terms_expr, tfidf_ctes, with_ctes)
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow

_TOK = f"regexp_extract_all(lower(prompt), '{TOKEN_RE}')"


@query("f2_tokens", with_ctes(["prompts"]) + f"""
SELECT prompt_id, len({_TOK}) AS n_tokens, array_to_string({_TOK}, ' ') AS tokens FROM prompts""")
def f2_tokens(spark, sf_dir):
    t = X.tokens("prompt")
    return Workflow.get(spark, sf_dir).prompts.select(
        "prompt_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("f3_stopwords", with_ctes(["prompts"]) + f"""
SELECT prompt_id, len(k) AS n_kept, array_to_string(k, ' ') AS kept
FROM (SELECT prompt_id, list_filter({_TOK}, lambda w: NOT list_contains({STOP_SQL}, w)) AS k
      FROM prompts)""")
def f3_stopwords(spark, sf_dir):
    k = X.remove_stop_words(X.tokens("prompt"), STOP_WORDS)
    return Workflow.get(spark, sf_dir).prompts.select(
        "prompt_id", F.size(k).alias("n_kept"), F.array_join(k, " ").alias("kept"))


@query("f4_ngrams", with_ctes(["prompts"]) + f"""
SELECT prompt_id, len(g) AS n_terms, array_to_string(g, '|') AS terms
FROM (SELECT prompt_id, {terms_expr('prompt', 2)} AS g FROM prompts)""")
def f4_ngrams(spark, sf_dir):
    g = T.terms_column("prompt", T.TfidfSpec())
    return Workflow.get(spark, sf_dir).prompts.select(
        "prompt_id", F.size(g).alias("n_terms"), F.array_join(g, "|").alias("terms"))


@query("t6_truncate", with_ctes(["prompts"]) + f"""
SELECT prompt_id, len(t) AS n_tokens, least(len(t), {MAX_SEQUENCE_TOKENS}) AS n_kept,
       len(t) > {MAX_SEQUENCE_TOKENS} AS truncated, array_to_string(t[1:{MAX_SEQUENCE_TOKENS}], ' ') AS kept
FROM (SELECT prompt_id, regexp_extract_all(lower('{CLASSIFICATION_PREFIX}' || prompt),
                                           '{TOKEN_RE}') AS t FROM prompts)""")
def t6_truncate(spark, sf_dir):
    toks = X.tokens(X.with_prefix("prompt"))
    kept = X.truncate_tokens(toks, MAX_SEQUENCE_TOKENS)
    return Workflow.get(spark, sf_dir).prompts.select(
        "prompt_id", F.size(toks).alias("n_tokens"), F.size(kept).alias("n_kept"),
        (F.size(toks) > MAX_SEQUENCE_TOKENS).alias("truncated"), F.array_join(kept, " ").alias("kept"))


@query("p15_prefix", with_ctes(["test"]) + f"""
SELECT prompt_id, '{CLASSIFICATION_PREFIX}' || prompt AS model_input FROM test""")
def p15_prefix(spark, sf_dir):
    return Workflow.get(spark, sf_dir).test.select(
        "prompt_id", X.with_prefix("prompt").alias("model_input"))


@query("a12_term_stats", with_ctes(["train"], model_ctes("m2", "train", 2)) + """
SELECT term, cnt, df, df_h, df_b FROM m2_stats""")
def a12_term_stats(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return linear.train_term_stats(wf.train, wf.model_spec)


@query("t5_vocabulary", with_ctes(["train"], model_ctes("m2", "train", 2)) + """
SELECT idx, term, cnt, df FROM m2_vocab""")
def t5_vocabulary(spark, sf_dir):
    return Workflow.get(spark, sf_dir).model.vocab.select("idx", "term", "cnt", "df")


@query("t5_vocabulary_two_pass", with_ctes(["train"], model_ctes("m2", "train", 2)) + """
SELECT idx, term, cnt, df, df_h, df_b, round(idf, 6) AS idf FROM m2_vocab""")
def t5_vocabulary_two_pass(spark, sf_dir):
    """The same vocabulary from a summary of bounds and exact counts of its candidates."""
    wf = Workflow.get(spark, sf_dir)
    stats = heavy.top_term_stats(wf.train, wf.model_spec)
    n_docs, _, _ = linear.class_counts(wf.train)
    return fin(T.vocabulary_from_stats(stats, n_docs, wf.model_spec).select("idx", "term", "cnt", "df", "df_h", "df_b", "idf"))


@query("m1_tfidf_vocab", with_ctes(["train"], model_ctes("m2", "train", 2)) + """
SELECT idx, term, df, round(idf, 6) AS idf FROM m2_vocab""")
def m1_tfidf_vocab(spark, sf_dir):
    return fin(Workflow.get(spark, sf_dir).model.vocab.select("idx", "term", "df", "idf"))


@query("m2_tfidf_weights", with_ctes(["train", "test"], model_ctes("m2", "train", 2) + "," +
                                     tfidf_ctes("te", "m2", "test", 2)) + """
SELECT prompt_id, idx, term, tf, round(x, 6) AS weight FROM te_x""")
def m2_tfidf_weights(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(wf.model.features(T.by_id(wf.test)))


@query("m6_logodds_weights", with_ctes(["train"], model_ctes("m2", "train", 2)) + """
SELECT term, round(weight, 6) AS weight FROM m2_w""")
def m6_logodds_weights(spark, sf_dir):
    return fin(Workflow.get(spark, sf_dir).model.weights)


@query("a9_class_weights", with_ctes(["train"]) + """
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT label, count(*) AS n_c FROM train GROUP BY label)""")
def a9_class_weights(spark, sf_dir):
    return fin(linear.class_weights(Workflow.get(spark, sf_dir).train))


def scored_test(wf: Workflow):
    s = wf.model.score(wf.test)
    return s.withColumn("predicted_label", decide("prob_harmful"))


_SCORED = with_ctes(["train", "test"], STD_MODELS + "," + score_ctes("te", "m2", "test", 2))
_PRED = "SELECT *, CASE WHEN prob_harmful >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM te_scored"


@query("m6_score_test", _SCORED + """
SELECT prompt_id, data_type, label, logit, round(prob_harmful, 6) AS prob_harmful,
       CASE WHEN prob_harmful >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM te_scored""")
def m6_score_test(spark, sf_dir):
    return fin(scored_test(Workflow.get(spark, sf_dir)).select(
        "prompt_id", "data_type", "label", "logit", "prob_harmful", "predicted_label"))


@query("f11_softmax", _SCORED + """
SELECT prompt_id, round(1 / (1 + exp(-(logit - 0))), 6) AS harmful_probability,
       round(1 - 1 / (1 + exp(-(logit - 0))), 6) AS benign_probability FROM te_scored""")
def f11_softmax(spark, sf_dir):
    s = Workflow.get(spark, sf_dir).model.score(Workflow.get(spark, sf_dir).test)
    p = softmax2(F.lit(0.0), F.col("logit"))
    return fin(s.select("prompt_id", p.alias("harmful_probability"),
                        (F.lit(1.0) - p).alias("benign_probability")))


@query("p11_decide", _SCORED + """
SELECT prompt_id, round(prob_harmful, 6) AS prob_harmful,
       CAST(prob_harmful >= 0.5 AS INTEGER) AS decision_inclusive,
       CAST(prob_harmful > 0.5 AS INTEGER) AS decision_exclusive FROM te_scored""")
def p11_decide(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    s = wf.model.score(wf.test)
    return fin(s.select("prompt_id", "prob_harmful",
                        decide("prob_harmful").alias("decision_inclusive"),
                        decide("prob_harmful", inclusive=False).alias("decision_exclusive")))


_COUNTS = """count_if(label = 1 AND predicted_label = 1) AS tp,
       count_if(label = 0 AND predicted_label = 1) AS fp,
       count_if(label = 1 AND predicted_label = 0) AS fn,
       count_if(label = 0 AND predicted_label = 0) AS tn, count(*) AS n"""
_PRF = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END, 6) AS accuracy"""


@query("a3_prf", _SCORED + f"""
SELECT tp, fp, fn, tn, n, {_PRF} FROM (SELECT {_COUNTS} FROM ({_PRED}))""")
def a3_prf(spark, sf_dir):
    return fin(metrics.prf(scored_test(Workflow.get(spark, sf_dir))))


@query("a4_confusion", _SCORED + f"SELECT {_COUNTS} FROM ({_PRED})")
def a4_confusion(spark, sf_dir):
    return metrics.confusion(scored_test(Workflow.get(spark, sf_dir)))


_REPORT = """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM (
  SELECT 'Benign' AS class, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS recall,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1,
         tn + fp AS support FROM c
  UNION ALL
  SELECT 'Harmful', CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, tp + fn FROM c
  UNION ALL
  SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END, n FROM c
  UNION ALL
  SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
  UNION ALL
  SELECT 'weighted avg', CASE WHEN n = 0 THEN 0 ELSE (p0 * s0 + p1 * s1) / n END,
         CASE WHEN n = 0 THEN 0 ELSE (r0 * s0 + r1 * s1) / n END,
         CASE WHEN n = 0 THEN 0 ELSE (f0 * s0 + f1 * s1) / n END, n FROM m)"""
_REPORT_M = """,
m AS (
  SELECT n, tn + fp AS s0, tp + fn AS s1,
         CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
         CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1,
         CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM c)"""


@query("a5_report", with_ctes(["train", "test"], STD_MODELS + "," + score_ctes("te", "m2", "test", 2)
                              + f",\nc AS (SELECT {_COUNTS} FROM ({_PRED}))" + _REPORT_M) + _REPORT)
def a5_report(spark, sf_dir):
    return fin(metrics.classification_report(scored_test(Workflow.get(spark, sf_dir))))


def breakdown_sql(src: str) -> str:
    return f"""
SELECT CASE WHEN g = 1 THEN 'ALL' ELSE data_type END AS data_type, n, {_PRF}, tp, fp, fn, tn
FROM (SELECT data_type, {_COUNTS}, grouping(data_type) AS g FROM ({src}) GROUP BY ROLLUP (data_type))"""


@query("a6_breakdown", _SCORED + breakdown_sql(_PRED))
def a6_breakdown(spark, sf_dir):
    return fin(metrics.breakdown(scored_test(Workflow.get(spark, sf_dir))))


@query("a11_weighted_logloss", _SCORED + """,
cw AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS w
       FROM (SELECT label, count(*) AS n_c FROM train GROUP BY label)),
ll AS (SELECT s.label, cw.w, least(greatest(s.prob_harmful, 1e-15), 1 - 1e-15) AS p
       FROM te_scored s JOIN cw ON s.label = cw.label)
SELECT round(sum(w * -(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END)) / sum(w), 6)
         AS weighted_logloss, count(*) AS n FROM ll""")
def a11_weighted_logloss(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(linear.weighted_logloss(wf.model.score(wf.test), linear.class_weights(wf.train)))
