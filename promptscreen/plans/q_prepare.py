"""Queries: sources, preparation, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptscreen.operators import prepare, sampling
from promptscreen.plans.oracle import content_key, okey, with_ctes
from promptscreen.plans.registry import fin, query
from promptscreen.plans.workflow import SAMPLE_N, Workflow

_IN_EVAL = ("coalesce(starts_with(data_type, 'adversarial') AND regexp_matches(adversarial, '\\S')"
            " AND prompt_id % 2 = 1, false)")


@query("u1_union_raw", with_ctes(["raw"]) + f"""
SELECT prompt_id, data_type, CASE WHEN {_IN_EVAL} THEN NULL ELSE vanilla END AS vanilla,
       adversarial
FROM raw""")
def u1_union_raw(spark, sf_dir):
    return Workflow.get(spark, sf_dir).raw.select("prompt_id", "data_type", "vanilla", "adversarial")


@query("p1_extract_prompt", with_ctes(["extracted"]) + """
SELECT prompt_id, data_type, prompt FROM extracted""")
def p1_extract_prompt(spark, sf_dir):
    return prepare.extract_prompt(Workflow.get(spark, sf_dir).raw).select(
        "prompt_id", "data_type", "prompt")


@query("p2_derive_label", with_ctes(["extracted"]) + """
SELECT prompt_id, data_type, label FROM extracted""")
def p2_derive_label(spark, sf_dir):
    return prepare.derive_label(Workflow.get(spark, sf_dir).raw).select(
        "prompt_id", "data_type", "label")


@query("p3_p4_clean", with_ctes(["prompts"]) + "SELECT * FROM prompts")
def p3_p4_clean(spark, sf_dir):
    return Workflow.get(spark, sf_dir).prompts


_SHARES = """
shares AS (
  SELECT label, data_type, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY label) AS share
  FROM prompts GROUP BY label, data_type)"""


@query("a1_stratum_shares", with_ctes(["prompts"], _SHARES) + """
SELECT label, data_type, n, round(share, 6) AS share FROM shares""")
def a1_stratum_shares(spark, sf_dir):
    p = Workflow.get(spark, sf_dir).prompts
    return fin(sampling.stratum_shares(p, ["label", "data_type"], ["label"]))


def quotas_sql(n: dict) -> str:
    return _SHARES.replace("FROM prompts GROUP BY", "FROM prompts WHERE data_type IS NOT NULL GROUP BY") + f""",
qn AS (
  SELECT *, CASE label WHEN 1 THEN {n[1]} WHEN 0 THEN {n[0]} END AS n_class,
         row_number() OVER (PARTITION BY label ORDER BY n DESC, data_type) AS pos,
         count(*) OVER (PARTITION BY label) AS k
  FROM shares),
qa AS (
  SELECT *, CASE WHEN pos < k THEN least(CAST(round_even(share * n_class, 0) AS BIGINT), n)
                 ELSE 0 END AS alloc
  FROM qn WHERE n_class IS NOT NULL),
quotas AS (
  SELECT label, data_type, n, share,
         CASE WHEN pos < k THEN alloc
              ELSE least(greatest(n_class - coalesce(sum(alloc) OVER (PARTITION BY label ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n) END AS quota
  FROM qa)"""


_QUOTAS = quotas_sql(SAMPLE_N)


@query("a2_quotas", with_ctes(["prompts"], _QUOTAS) + """
SELECT label, data_type, n, round(share, 6) AS share, quota FROM quotas""")
def a2_quotas(spark, sf_dir):
    return fin(sampling.allocate_quotas(Workflow.get(spark, sf_dir).prompts, SAMPLE_N))


@query("w1_stratified_sample", with_ctes(["prompts"], _QUOTAS) + f"""
SELECT p.prompt_id, p.prompt, p.data_type, p.label
FROM (SELECT *, row_number() OVER (PARTITION BY label, data_type
                                   ORDER BY {okey('sample')}, prompt_id) AS rk
      FROM prompts WHERE data_type IS NOT NULL) p
JOIN quotas q ON p.label = q.label AND p.data_type = q.data_type
WHERE p.rk <= q.quota""")
def w1_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(Workflow.get(spark, sf_dir).prompts, SAMPLE_N)


@query("w2_split", with_ctes(["split"]) + "SELECT prompt_id, data_type, label, split FROM split")
def w2_split(spark, sf_dir):
    return Workflow.get(spark, sf_dir).split.select("prompt_id", "data_type", "label", "split")


@query("a15_split_sizes", with_ctes(["split"]) + """
SELECT split, count(*) AS n FROM split GROUP BY split""")
def a15_split_sizes(spark, sf_dir):
    return sampling.split_sizes(Workflow.get(spark, sf_dir).split)


@query("a15_split_quotas", with_ctes(["split_q"]) + """
SELECT s AS data_type, n, n_train, n_val, n - n_train - n_val AS n_test FROM split_q""")
def a15_split_quotas(spark, sf_dir):
    return sampling.split_quotas(Workflow.get(spark, sf_dir).prompts)


@query("w3_sample_n", with_ctes(["prompts"]) + f"""
SELECT prompt_id, prompt, data_type, label FROM prompts
ORDER BY {okey('sample_n')}, prompt_id LIMIT 50""")
def w3_sample_n(spark, sf_dir):
    return sampling.sample_n(Workflow.get(spark, sf_dir).prompts, 50)


@query("w3_sample_n_by_type", with_ctes(["prompts"]) + f"""
SELECT prompt_id, prompt, data_type, label FROM (
  SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY {okey('sample_n')}, prompt_id) AS rn
  FROM prompts) WHERE rn <= 10""")
def w3_sample_n_by_type(spark, sf_dir):
    return sampling.sample_n(Workflow.get(spark, sf_dir).prompts, 10, by=["data_type"])


@query("w4_shuffle_rank", with_ctes(["prompts"]) + f"""
SELECT prompt_id, row_number() OVER (ORDER BY {okey('shuffle')}, prompt_id) AS shuffle_rank
FROM prompts""")
def w4_shuffle_rank(spark, sf_dir):
    return sampling.shuffle_rank(Workflow.get(spark, sf_dir).prompts).select(
        "prompt_id", "shuffle_rank")


@query("t4_train_limit", with_ctes(["train"]) + f"""
SELECT prompt_id, prompt, data_type, label FROM train
ORDER BY {okey('shuffle')}, prompt_id LIMIT 100""")
def t4_train_limit(spark, sf_dir):
    return sampling.first_n(Workflow.get(spark, sf_dir).train, 100)


@query("p7_target_type", with_ctes(["test"]) + """
SELECT * FROM test WHERE data_type = 'adversarial_benign'""")
def p7_target_type(spark, sf_dir):
    return Workflow.get(spark, sf_dir).test.filter(F.col("data_type") == "adversarial_benign")


@query("p19_prompt_id", with_ctes(["prompts"]) + """
SELECT prompt, data_type, label, content_key, dup_no,
       """ + content_key("prompt", "data_type", "label", "dup_no") + """ AS prompt_id
FROM (SELECT prompt, data_type, label,
             """ + content_key("prompt", "data_type", "label") + """ AS content_key,
             row_number() OVER (PARTITION BY prompt, data_type, label) AS dup_no
      FROM prompts)""")
def p19_prompt_id(spark, sf_dir):
    p = Workflow.get(spark, sf_dir).prompts.select("prompt", "data_type", "label")
    return prepare.assign_prompt_id(p).select(
        "prompt", "data_type", "label", "content_key", F.col("dup_no").cast("bigint"), "prompt_id")
