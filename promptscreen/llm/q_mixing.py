"""Query of the mixing operator and its SQL."""

from __future__ import annotations

from promptscreen.llm.common import table
from promptscreen.llm.mixing import ADDED, MIX, mix
from promptscreen.llm.registry import query


def _case(level: int, name: str) -> str:
    named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX.weights[level].items())
    return f"CASE {name} {named} ELSE {MIX.default_weight} END" if named else str(MIX.default_weight)


def _level(i: int) -> str:
    """Shares of level ``i``: a CTE ``g{i}`` from the parent's ``g{i-1}``."""
    names = ["a", "b", "c"][:i + 1]
    key, name, parent = ", ".join(names), names[-1], ", ".join(names[:-1])
    part = f"PARTITION BY {parent}" if parent else ""
    using = f"JOIN g{i - 1} USING ({parent})" if parent else "CROSS JOIN root"
    return f"""
n{i} AS (SELECT {key}, budget, SUM(cap)::HUGEINT AS cap, ({_case(i, name)})::HUGEINT AS w
         FROM leaf {using} GROUP BY {key}, budget),
o{i} AS (SELECT *, budget - COALESCE(SUM(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
                SUM(w) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww
         FROM n{i} WHERE w > 0 WINDOW x AS ({part} ORDER BY (cap * 1000000000)::DOUBLE / w, {name})),
s{i} AS (SELECT *, cap * ww <= w * r AS sat FROM o{i}),
p{i} AS (SELECT *, budget - COALESCE(SUM(cap) FILTER (sat) OVER ({part}), 0) AS lft,
                SUM(w) FILTER (NOT sat) OVER ({part}) AS opn FROM s{i}),
f{i} AS (SELECT *, CASE WHEN sat THEN cap ELSE (w * lft)::HUGEINT // opn::HUGEINT END AS fl,
                CASE WHEN sat THEN -1 ELSE (w * lft)::HUGEINT % opn::HUGEINT END AS rem FROM p{i}),
e{i} AS (SELECT *, lft - SUM(fl) FILTER (NOT sat) OVER ({part}) AS extra,
                ROW_NUMBER() OVER ({part} ORDER BY rem DESC, {name}) AS pos FROM f{i}),
g{i} AS (SELECT {key}, (fl + CASE WHEN NOT sat AND pos <= extra THEN 1 ELSE 0 END)::HUGEINT AS budget FROM e{i})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, COALESCE(lang, '') AS b, COALESCE(source, '') AS c,
         regexp_extract(COALESCE(source, ''), '([0-9]{{1,9}})$', 1) AS num,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n, lang, source, n_chars
  FROM documents),
docs AS (SELECT *, CASE WHEN num = '' THEN '' ELSE 'd' || (num::BIGINT % 4)::VARCHAR END AS a FROM d),
leaf AS (SELECT a, b, c, SUM(n)::HUGEINT AS t, SUM(n)::HUGEINT * {MIX.max_epochs} AS cap FROM docs GROUP BY ALL HAVING SUM(n) > 0),
root AS (SELECT COALESCE(SUM(t), 0)::HUGEINT * {MIX.budget_num} // {MIX.budget_den} AS budget FROM leaf),
{_level(0)},{_level(1)},{_level(2)},
k AS (SELECT docs.*, (budget // t)::BIGINT AS whole, (budget % t)::BIGINT AS rest,
             md5('{MIX.seed}|' || (budget // t)::VARCHAR || '|' || COALESCE(doc_id::VARCHAR, '')) AS o
      FROM docs JOIN leaf USING (a, b, c) JOIN g2 USING (a, b, c) WHERE n > 0),
r AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY a, b, c ORDER BY o, doc_id, n
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k),
u AS (SELECT *, unnest(range(0, whole + 1)) AS e FROM r),
v AS (SELECT *, CASE WHEN e < whole THEN n ELSE GREATEST(0, LEAST(n, rest - run)) END AS take FROM u)
SELECT doc_id, a AS mix_domain, b AS mix_lang, c AS mix_source, e::INTEGER AS mix_epoch, n AS mix_tokens,
       take::BIGINT AS mix_take
FROM v WHERE take > 0"""


@query("op1_mixing", SQL)
def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, with_text=False).select("doc_id", *ADDED)
