"""Queries: attribution, token importance, error cases, substitution attacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.constants import EXCLUDED_TOKENS
from promptscreen.functions.scalar import decide
from promptscreen.operators import explain, linear, metrics, perturb, sampling
from promptscreen.plans.oracle import (STD_MODELS, TOKEN_RE, content_id, model_ctes, okey, score_ctes,
                                       with_ctes)
from promptscreen.plans.q_model import _COUNTS
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow
from promptscreen.sources.fixture import synonym_rows

_EXCL = ", ".join("'" + t.replace("'", "''") + "'" for t in EXCLUDED_TOKENS)


def pos_ctes(p: str, src: str) -> str:
    """``{p}_ps``: (prompt_id, pos, token, score) over ``src`` with model m2."""
    return score_ctes(p, "m2", src, 2) + f""",
{p}_pos AS (
  SELECT prompt_id, unnest(range(len(t))) AS pos, unnest(t) AS token
  FROM (SELECT prompt_id, regexp_extract_all(lower(prompt), '{TOKEN_RE}') AS t FROM {src})),
{p}_uni AS (SELECT prompt_id, term, contribution / tf AS s FROM {p}_c WHERE NOT contains(term, ' ')),
{p}_ps AS (
  SELECT a.prompt_id, a.pos, a.token, coalesce(u.s, 0) AS score
  FROM {p}_pos a LEFT JOIN {p}_uni u ON a.prompt_id = u.prompt_id AND a.token = u.term),
{p}_top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY abs(score) DESC, pos) AS token_rank
    FROM {p}_ps WHERE token NOT IN ({_EXCL}) AND NOT starts_with(token, '##'))
  WHERE token_rank <= 3)"""


_TEST_POS = with_ctes(["train", "test"], STD_MODELS + "," + pos_ctes("te", "test"))


@query("m10_attribution_logit", _TEST_POS + """
SELECT prompt_id, term, round(contribution, 6) AS attribution FROM te_c""")
def m10_attribution_logit(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(explain.attribution(wf.model, wf.test, "logit").select(
        "prompt_id", "term", "attribution"))


@query("m10_attribution_prob", _TEST_POS + """
SELECT c.prompt_id, c.term, round(s.prob_harmful * (1 - s.prob_harmful) * c.contribution, 6)
       AS attribution
FROM te_c c JOIN te_scored s ON c.prompt_id = s.prompt_id""")
def m10_attribution_prob(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(explain.attribution(wf.model, wf.test, "probability").select(
        "prompt_id", "term", "attribution"))


@query("m10_position_scores", _TEST_POS + """
SELECT prompt_id, pos, token, round(score, 6) AS score FROM te_ps""")
def m10_position_scores(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    return fin(explain.position_scores(wf.model, wf.test))


@query("w5_top_tokens", _TEST_POS + """
SELECT prompt_id, token_rank, pos, token, round(score, 6) AS score FROM te_top""")
def w5_top_tokens(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    t = explain.top_positions(explain.position_scores(wf.model, wf.test))
    return fin(t.select("prompt_id", "token_rank", "pos", "token", "score"))


@query("w7_normalized_scores", _TEST_POS + """
SELECT prompt_id, pos, token,
       round(score / (max(abs(score)) OVER (PARTITION BY prompt_id) + 1e-8), 6) AS norm_score
FROM te_ps""")
def w7_normalized_scores(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    n = explain.normalized(explain.position_scores(wf.model, wf.test))
    return fin(n.select("prompt_id", "pos", "token", "norm_score"))


_SAMPLED = f"""
sampled AS (SELECT * FROM test ORDER BY {okey('sample_n')}, prompt_id LIMIT 500)"""


@query("a10_token_importance", with_ctes(["train", "test"], _SAMPLED + "," + STD_MODELS + "," +
                                         pos_ctes("sa", "sampled")) + """
SELECT token, round(avg(abs(score)), 6) AS average_abs_gradient_input, count(*) AS n
FROM sa_ps WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]') AND NOT starts_with(token, '##')
GROUP BY token HAVING count(*) >= 3
ORDER BY avg(abs(score)) DESC, token LIMIT 20""")
def a10_token_importance(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    s = sampling.sample_n(wf.test, 500)
    return fin(explain.token_importance(explain.position_scores(wf.model, s)))


def _lex_sql() -> str:
    vals = ", ".join("('{}', '{}', {})".format(w, s.replace("'", "''"), r)
                     for w, s, r in synonym_rows())
    return f"""
lex(word, synonym, rank) AS (VALUES {vals}),
syn AS (
  SELECT * FROM (
    SELECT word, synonym, row_number() OVER (PARTITION BY word ORDER BY rank, synonym) AS syn_rank
    FROM (SELECT lower(word) AS word, lower(replace(synonym, '_', ' ')) AS synonym, min(rank) AS rank
          FROM lex WHERE lower(replace(synonym, '_', ' ')) <> lower(word) GROUP BY 1, 2))
  WHERE syn_rank <= 5)"""


@query("j3_synonym_candidates", with_ctes(["train", "test"], STD_MODELS + "," + pos_ctes("te", "test")
                                          + "," + _lex_sql()) + """
SELECT t.prompt_id, t.token_rank, t.token, s.synonym, s.syn_rank
FROM te_top t JOIN syn s ON t.token = s.word""")
def j3_synonym_candidates(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    top = explain.top_positions(explain.position_scores(wf.model, wf.test))
    c = perturb.synonym_candidates(top, perturb.prepare_synonyms(wf.synonyms))
    return c.select("prompt_id", "token_rank", "token", "synonym", "syn_rank")


@query("u5_synonyms", with_ctes(["prompts"], _lex_sql() + f""",
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(prompt), '{TOKEN_RE}')) AS word FROM prompts)""") + """
SELECT s.word, s.synonym, s.syn_rank FROM syn s WHERE s.word IN (SELECT word FROM words)""")
def u5_synonyms(spark, sf_dir):
    """Normalised lexicon entries for the words that occur in the prompts."""
    from promptscreen.functions.text import tokens
    wf = Workflow.get(spark, sf_dir)
    lex = perturb.prepare_synonyms(wf.synonyms)
    words = wf.prompts.select(F.explode(tokens("prompt")).alias("word"))
    # tokens stream past the (size-checked) broadcast lexicon; distinct
    # aggregates map-side, so hot words never move whole
    present = words.join(perturb.lexicon_side(lex.select("word").distinct()), "word",
                         "left_semi").distinct()
    return lex.join(present, "word", "left_semi")


_ATTACK = STD_MODELS + ",\nsrc AS (SELECT prompt_id, prompt, data_type, label FROM split WHERE split <> 'train')," \
    + pos_ctes("sr", "src") + "," + _lex_sql() + """,
cand AS (
  SELECT t.prompt_id, t.token_rank, t.pos, t.token, s.synonym, s.syn_rank, r.prompt, r.label,
         r.data_type, CAST(r.prob_harmful >= 0.5 AS INTEGER) AS orig_pred, lower(r.prompt) AS lp
  FROM sr_top t JOIN syn s ON t.token = s.word JOIN sr_scored r ON t.prompt_id = r.prompt_id),
cand2 AS (
  SELECT *, CASE WHEN instr(lp, token) > 0
                 THEN overlay(lp PLACING synonym FROM instr(lp, token) FOR length(token)) END AS perturbed
  FROM cand),
cand3 AS (
  SELECT prompt_id || ':' || token_rank || ':' || syn_rank AS cid, *
  FROM cand2 WHERE perturbed IS NOT NULL AND perturbed <> lp),
cands AS (SELECT cid AS prompt_id, perturbed AS prompt FROM cand3),""" + score_ctes("cs", "m2", "cands", 2) + """,
flips AS (
  SELECT c.*, CAST(s.prob_harmful >= 0.5 AS INTEGER) AS new_pred
  FROM cand3 c JOIN cs_scored s ON c.cid = s.prompt_id
  WHERE CAST(s.prob_harmful >= 0.5 AS INTEGER) <> c.orig_pred),
attacks AS (
  SELECT prompt_id, token_rank, pos, prompt AS original_prompt, perturbed AS perturbed_prompt,
         token AS original_token, synonym AS replacement_token, orig_pred AS original_predicted_label,
         new_pred AS new_predicted_label, label, 'adversarial_augmented' AS data_type,
         data_type AS source_data_type
  FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, token_rank ORDER BY syn_rank) AS k
        FROM flips) WHERE k = 1)"""


def attack(wf: Workflow):
    src = wf.split.filter(F.col("split") != "train").drop("split")
    return perturb.synonym_flips(wf.model, src, wf.synonyms), src


@query("m11_synonym_flips", with_ctes(["split", "train"], _ATTACK) + "SELECT * FROM attacks")
def m11_synonym_flips(spark, sf_dir):
    return attack(Workflow.get(spark, sf_dir))[0]


@query("a8_success_rates", with_ctes(["split", "train"], _ATTACK) + """
SELECT (SELECT count(*) FROM src) AS targets,
       (SELECT count(DISTINCT prompt_id) FROM attacks) AS prompts_with_flip,
       round(CASE WHEN (SELECT count(*) FROM src) = 0 THEN 0
             ELSE (SELECT count(DISTINCT prompt_id) FROM attacks) / (SELECT count(*) FROM src) END, 6)
         AS success_rate""")
def a8_success_rates(spark, sf_dir):
    a, src = attack(Workflow.get(spark, sf_dir))
    return fin(perturb.success_rates(a, src))


_AUG_ROWS = """,
aug_rows AS (
  SELECT """ + content_id("perturbed_prompt", "data_type", "label", "prompt_id", "token_rank") + """ AS prompt_id,
         perturbed_prompt AS prompt, data_type, label FROM attacks),
aug AS (SELECT * FROM train UNION ALL SELECT * FROM aug_rows)"""


@query("u3_augment_train", with_ctes(["split", "train"], _ATTACK + _AUG_ROWS) + "SELECT * FROM aug")
def u3_augment_train(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    return perturb.augment(wf.train, perturb.as_training_rows(a))


@query("m15_augmentation_effect", with_ctes(["split", "train", "test"], _ATTACK + _AUG_ROWS + "," +
                                            model_ctes("ma", "aug", 2) + "," +
                                            score_ctes("tp", "m2", "test", 2) + "," +
                                            score_ctes("ta", "ma", "test", 2)) + f"""
SELECT 'plain' AS training, * FROM (
  SELECT {_COUNTS} FROM (SELECT label, CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label FROM tp_scored))
UNION ALL
SELECT 'augmented', * FROM (
  SELECT {_COUNTS} FROM (SELECT label, CAST(prob_harmful >= 0.5 AS INTEGER) AS predicted_label FROM ta_scored))""")
def m15_augmentation_effect(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    # the attack is run once, the model trained once; both are read several times
    aug = perturb.augment(wf.train, perturb.stored(perturb.as_training_rows(a)))
    plain_m = wf.model
    aug_m = linear.fit_logodds(aug, wf.model_spec, wf.alpha).materialize()
    out = None
    for name, m in (("plain", plain_m), ("augmented", aug_m)):
        s = m.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
        c = metrics.confusion(s).select(F.lit(name).alias("training"), "*")
        out = c if out is None else out.unionByName(c)
    return out


_CASES = _ATTACK + f""",
res AS (SELECT s.*, CAST(s.prob_harmful >= 0.5 AS INTEGER) AS predicted_label
        FROM sr_scored s JOIN test t ON s.prompt_id = t.prompt_id),
cases AS (
  SELECT CASE WHEN label = 0 AND predicted_label = 1 THEN 'FP' ELSE 'FN' END AS case_type,
         prompt_id, prompt, label
  FROM res WHERE label <> predicted_label
  UNION ALL
  SELECT 'ADV_BEN_FP', prompt_id, original_prompt, label FROM attacks
  WHERE label = 0 AND new_predicted_label = 1),
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY case_type
             ORDER BY {okey('cases', "case_type || ':' || CAST(prompt_id AS VARCHAR)")},
                      case_type || ':' || CAST(prompt_id AS VARCHAR)) AS case_no FROM cases)
  WHERE case_no <= 10),
layout AS (
  SELECT c.case_type, c.prompt_id, c.case_no, CAST((c.case_no - 1) // 5 AS INTEGER) + 1 AS part,
         printf('%s #%d [%s] P(harmful)=%.3f P(benign)=%.3f', c.case_type, c.case_no,
                CASE WHEN s.prob_harmful > 0.5 THEN 'HARMFUL' ELSE 'BENIGN' END,
                s.prob_harmful, 1 - s.prob_harmful) AS title,
         p.pos, p.token, p.score,
         p.score / (max(abs(p.score)) OVER (PARTITION BY c.case_type, c.prompt_id) + 1e-8) AS ns
  FROM picked c
  JOIN sr_scored s ON c.prompt_id = s.prompt_id
  JOIN sr_ps p ON c.prompt_id = p.prompt_id)"""


@query("m14_case_attribution", with_ctes(["split", "train", "test"], _CASES) + """
SELECT case_type, prompt_id, case_no, part, title, pos, token, round(score, 6) AS score,
       round(ns, 6) AS norm_score, CAST(floor(pos / 18) AS INTEGER) AS "row", CAST(pos % 18 AS INTEGER) AS col,
       round(greatest(0, least(1, CASE WHEN ns > 0 THEN 1 ELSE 1 + ns END)), 6) AS color_r,
       round(greatest(0, least(1, CASE WHEN ns > 0 THEN 1 - ns ELSE 1 + ns END)), 6) AS color_g,
       round(greatest(0, least(1, CASE WHEN ns > 0 THEN 1 - ns ELSE 1 END)), 6) AS color_b
FROM layout""")
def m14_case_attribution(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    res = wf.model.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
    cases = explain.error_cases(res, a)
    out = explain.case_layout(wf.model, cases)
    return fin(out.select("case_type", "prompt_id", "case_no", "part", "title", "pos", "token",
                          "score", "norm_score", "row", "col",
                          F.col("color.r").alias("color_r"), F.col("color.g").alias("color_g"),
                          F.col("color.b").alias("color_b")))


@query("p12_error_cases", with_ctes(["split", "train", "test"], _CASES) + """
SELECT case_type, prompt_id, label FROM cases""")
def p12_error_cases(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    res = wf.model.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
    return explain.error_cases(res, a).select("case_type", "prompt_id", "label")


@query("f5_replace_first", with_ctes(["train", "test"], STD_MODELS + "," + pos_ctes("te", "test")
                                     + "," + _lex_sql()) + """
SELECT t.prompt_id, t.token_rank, s.syn_rank, s.synonym,
       CASE WHEN instr(lower(r.prompt), t.token) > 0
            THEN overlay(lower(r.prompt) PLACING s.synonym FROM instr(lower(r.prompt), t.token)
                         FOR length(t.token)) END AS perturbed_prompt
FROM te_top t JOIN syn s ON t.token = s.word JOIN test r ON t.prompt_id = r.prompt_id""")
def f5_replace_first(spark, sf_dir):
    from promptscreen.functions.text import replace_first
    wf = Workflow.get(spark, sf_dir)
    top = explain.top_positions(explain.position_scores(wf.model, wf.test))
    c = perturb.synonym_candidates(top, perturb.prepare_synonyms(wf.synonyms))
    c = c.join(wf.test.select("prompt_id", "prompt"), "prompt_id")
    return c.select("prompt_id", "token_rank", "syn_rank", "synonym",
                    replace_first(F.lower("prompt"), F.col("token"), F.col("synonym"))
                    .alias("perturbed_prompt"))


@query("w8_case_layout", with_ctes(["split", "train", "test"], _CASES) + """
SELECT case_type, prompt_id, case_no, part, pos, token, CAST(floor(pos / 18) AS INTEGER) AS "row",
       CAST(pos % 18 AS INTEGER) AS col FROM layout""")
def w8_case_layout(spark, sf_dir):
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    res = wf.model.score(wf.test).withColumn("predicted_label", decide("prob_harmful"))
    out = explain.case_layout(wf.model, explain.error_cases(res, a))
    return out.select("case_type", "prompt_id", "case_no", "part", "pos", "token", "row", "col")


_LOO = _TEST_POS + f""",
lo_src AS (SELECT prompt_id, regexp_extract_all(lower(prompt), '{TOKEN_RE}') AS toks,
                  regexp_split_to_array(lower(prompt), '{TOKEN_RE}') AS seps FROM test),
lo_w AS (SELECT prompt_id, toks, seps, unnest(list_distinct(toks)) AS word FROM lo_src),
lo_v AS (
  SELECT prompt_id || ':' || word AS vid, prompt_id, word,
         seps[1] || array_to_string(list_transform(range(1, len(toks) + 1),
           lambda i: (CASE WHEN toks[i] = word THEN '' ELSE toks[i] END) || seps[i + 1]), '') AS vtext
  FROM lo_w),
lo_vt AS (SELECT vid AS prompt_id, vtext AS prompt FROM lo_v),""" + score_ctes("lv", "m2", "lo_vt", 2)


@query("m10_leave_one_out", _LOO + """
SELECT v.prompt_id, v.word, round(t.prob_harmful - s.prob_harmful, 6) AS attribution
FROM lo_v v JOIN lv_scored s ON v.vid = s.prompt_id JOIN te_scored t ON v.prompt_id = t.prompt_id""")
def m10_leave_one_out(spark, sf_dir):
    """Leave-one-word-out attribution through the black-box (batch UDF) model."""
    from promptscreen.operators import batch_model
    wf = Workflow.get(spark, sf_dir)
    black_box = batch_model.BatchUdfScorer(batch_model.export_linear(wf.model))
    return fin(explain.leave_one_out(black_box, wf.test))


@query("m10_leave_one_out_linear", _LOO + """
SELECT v.prompt_id, v.word, round(t.prob_harmful - s.prob_harmful, 6) AS attribution
FROM lo_v v JOIN lv_scored s ON v.vid = s.prompt_id JOIN te_scored t ON v.prompt_id = t.prompt_id""")
def m10_leave_one_out_linear(spark, sf_dir):
    """The same through the linear model, from changed terms alone."""
    wf = Workflow.get(spark, sf_dir)
    return fin(explain.leave_one_out(wf.model, wf.test))
