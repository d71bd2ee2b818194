"""Queries: saliency-ordered greedy substitution on the stage-1 gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.operators import perturb, stepwise
from promptscreen.plans.oracle import STD_MODELS, STOP_SQL, TOKEN_RE, content_id, score_ctes, with_ctes
from promptscreen.plans.oracle_forest import forest_ctes, forest_score_ctes
from promptscreen.plans.q_explain import _ATTACK, _AUG_ROWS, _lex_sql
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import Workflow

_TOKS = f"regexp_extract_all(lower(prompt), '{TOKEN_RE}')"
_SEPS = f"regexp_split_to_array(lower(prompt), '{TOKEN_RE}')"


def _text(toks: str, repl_lambda: str, seps: str) -> str:
    return (f"{seps}[1] || array_to_string(list_transform(range(1, len({toks}) + 1), "
            f"lambda i: ({repl_lambda}) || {seps}[i + 1]), '')")


_GREEDY = STD_MODELS + ",\ngsrc AS (SELECT prompt_id, prompt, data_type, label FROM split WHERE split <> 'train')," \
    + score_ctes("g0", "m1", "gsrc", 1) + f""",
gorig AS (
  SELECT prompt_id, prompt, label, data_type, CAST(prob_harmful >= 0.5 AS INTEGER) AS original_output,
         CASE WHEN label = 1 THEN prob_harmful ELSE 1 - prob_harmful END AS p0,
         {_TOKS} AS toks, {_SEPS} AS seps
  FROM g0_scored),
glive AS (SELECT * FROM gorig WHERE original_output = label),
gsyn AS (SELECT * FROM syn WHERE NOT list_contains({STOP_SQL}, word)),
gpos AS (SELECT prompt_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM glive),
gcand AS (
  SELECT w.prompt_id, w.pos, w.token, s.synonym, s.syn_rank FROM gpos w JOIN gsyn s ON w.token = s.word),
gvar AS (
  SELECT DISTINCT prompt_id, pos, token, '[UNK]' AS synonym, 0 AS syn_rank FROM gcand
  UNION ALL SELECT prompt_id, pos, token, synonym, syn_rank FROM gcand),
gvar2 AS (
  SELECT v.*, l.label, l.p0, v.prompt_id || ':' || v.pos || ':' || v.syn_rank AS vid,
         {_text('l.toks', 'CASE WHEN i - 1 = v.pos THEN v.synonym ELSE l.toks[i] END', 'l.seps')} AS vtext
  FROM gvar v JOIN glive l ON v.prompt_id = l.prompt_id),
gvt AS (SELECT vid AS prompt_id, vtext AS prompt FROM gvar2),""" + score_ctes("gv", "m1", "gvt", 1) + f""",
gvar3 AS (
  SELECT v.*, v.p0 - CASE WHEN v.label = 1 THEN s.prob_harmful ELSE 1 - s.prob_harmful END AS dropv
  FROM gvar2 v JOIN gv_scored s ON v.vid = s.prompt_id),
gsal AS (SELECT prompt_id, pos, dropv AS sal FROM gvar3 WHERE syn_rank = 0),
gbest AS (
  SELECT prompt_id, pos, synonym, dropv AS dp FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_id, pos ORDER BY dropv DESC, syn_rank) AS r
    FROM gvar3 WHERE syn_rank > 0) WHERE r = 1),
gpr AS (
  SELECT s.prompt_id, s.pos, b.synonym,
         exp(s.sal) / sum(exp(s.sal)) OVER (PARTITION BY s.prompt_id) * b.dp AS h
  FROM gsal s JOIN gbest b ON s.prompt_id = b.prompt_id AND s.pos = b.pos),
gpr2 AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY h DESC, pos) AS ord FROM gpr),
gplan AS (
  SELECT prompt_id, list({{'p': pos, 'o': ord, 's': synonym}}) AS plan, count(*) AS c
  FROM gpr2 GROUP BY prompt_id),
gpref AS (
  SELECT l.prompt_id, l.label, g.c, k.k,
         {_text('l.toks', "coalesce(list_filter(g.plan, lambda e: e.p = i - 1 AND e.o <= k.k)[1].s, l.toks[i])", 'l.seps')} AS ptext
  FROM glive l JOIN gplan g ON l.prompt_id = g.prompt_id,
       LATERAL (SELECT unnest(range(1, g.c + 1)) AS k) k),
gpt AS (SELECT prompt_id || ':' || k AS prompt_id, ptext AS prompt FROM gpref),""" + score_ctes("gp", "m1", "gpt", 1) + """,
gpref2 AS (
  SELECT p.*, CAST(s.prob_harmful >= 0.5 AS INTEGER) AS perturbed_output,
         CASE WHEN CAST(s.prob_harmful >= 0.5 AS INTEGER) <> p.label THEN p.k ELSE 2 * p.c + 1 - p.k END AS key
  FROM gpref p JOIN gp_scored s ON p.prompt_id || ':' || p.k = s.prompt_id),
gres AS (
  SELECT prompt_id, arg_min(k, key) AS k, arg_min(ptext, key) AS ptext, arg_min(perturbed_output, key) AS po,
         max(CASE WHEN perturbed_output <> label THEN 1 ELSE 0 END) AS ok
  FROM gpref2 GROUP BY prompt_id),
greedy AS (
  SELECT l.prompt_id, CASE WHEN r.ok = 1 THEN 'Successful' ELSE 'Failed' END AS result_type,
         l.prompt AS original_text, coalesce(r.ptext, lower(l.prompt)) AS perturbed_text,
         l.label AS ground_truth_output, l.original_output,
         coalesce(r.po, l.original_output) AS perturbed_output, coalesce(r.k, 0) AS num_changes, l.data_type
  FROM glive l LEFT JOIN gres r ON l.prompt_id = r.prompt_id
  UNION ALL
  SELECT prompt_id, 'Skipped', prompt, lower(prompt), label, original_output, original_output, 0, data_type
  FROM gorig WHERE original_output <> label)"""


def greedy(wf: Workflow):
    src = wf.split.filter(F.col("split") != "train").drop("split")
    return perturb.greedy_substitution(wf.gate, src, wf.synonyms)


_GREEDY_SOLO = _GREEDY.replace("gorig AS (", _lex_sql().strip() + ",\ngorig AS (", 1)


@query("m12_greedy_substitution", with_ctes(["split", "train"], _GREEDY_SOLO) + "SELECT * FROM greedy")
def m12_greedy_substitution(spark, sf_dir):
    return greedy(Workflow.get(spark, sf_dir))


@query("m12_greedy_stepwise")
def m12_greedy_stepwise(spark, sf_dir):
    """Each swap chosen on the text that the earlier ones left. The steps of a prompt
    follow from each other (hundreds on whole texts), so there is no SQL:
    ``tests/test_stepwise.py`` compares with a loop over whole texts."""
    wf = Workflow.get(spark, sf_dir)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    return stepwise.stepwise_substitution(wf.gate, src, wf.synonyms)


@query("a8_greedy_success_rate", with_ctes(["split", "train"], _GREEDY_SOLO) + """
SELECT count(*) AS attacked, count_if(result_type = 'Successful') AS successful,
       count_if(result_type = 'Failed') AS failed, count_if(result_type = 'Skipped') AS skipped,
       round(CASE WHEN count(*) = 0 THEN 0 ELSE count_if(result_type = 'Successful') / count(*) END, 6)
         AS success_rate
FROM greedy""")
def a8_greedy_success_rate(spark, sf_dir):
    return fin(perturb.greedy_success_rate(greedy(Workflow.get(spark, sf_dir))))


@query("u3_augment_both", with_ctes(["split", "train"], _ATTACK + _AUG_ROWS + ",\n" +
                                    _GREEDY.replace(STD_MODELS + ",", "", 1)) + """
SELECT * FROM aug
UNION ALL
SELECT """ + content_id("perturbed_text", "'adversarial_benign_augmented'", "ground_truth_output", "prompt_id") + """,
       perturbed_text, 'adversarial_benign_augmented', ground_truth_output
FROM greedy WHERE result_type = 'Successful'""")
def u3_augment_both(spark, sf_dir):
    from promptscreen.plans.q_explain import attack
    wf = Workflow.get(spark, sf_dir)
    a, _ = attack(wf)
    return perturb.augment(wf.train, perturb.as_training_rows(a),
                           perturb.greedy_training_rows(greedy(wf)))


def _of_forest(sql: str) -> str:
    """The greedy attack's SQL with the forest's scores in place of the gate's."""
    for p, source in (("g0", "gsrc"), ("gv", "gvt"), ("gp", "gpt")):
        sql = sql.replace(score_ctes(p, "m1", source, 1), forest_score_ctes(p, source))
    return sql.replace(STD_MODELS, STD_MODELS + ",\n" + forest_ctes())


@query("m12_greedy_forest", with_ctes(["split", "train"], _of_forest(_GREEDY_SOLO)) + "SELECT * FROM greedy")
def m12_greedy_forest(spark, sf_dir):
    """The greedy attack on the forest gate."""
    wf = Workflow.get(spark, sf_dir)
    src = wf.split.filter(F.col("split") != "train").drop("split")
    return perturb.greedy_substitution(wf.forest, src, wf.synonyms)
