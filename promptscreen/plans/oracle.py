"""Independent DuckDB SQL for each registered query (the correctness oracle).

The SQL restates each definition from scratch over the driver's tables; it
shares no code path with the Spark side. CTEs are defined once here and each
query prepends the ones it needs.
"""

from __future__ import annotations

from promptscreen.constants import MAX_FEATURES, SEED, STOP_WORDS

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def okey(salt: str, col: str = "prompt_id") -> str:
    return f"md5('{SEED}|{salt}|' || CAST({col} AS VARCHAR))"


def content_key(*exprs: str) -> str:
    """128-bit content key of some expressions: parts with their lengths, null marked."""
    parts = ", ".join(f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), 'n')" for e in exprs)
    return f"md5(concat_ws('|', {parts}))"


def content_id(*exprs: str) -> str:
    return f"CAST(('0x' || substr({content_key(*exprs)}, 1, 15)) AS BIGINT)"


BASE = {
    "raw": """
raw AS (
  SELECT d.doc_id AS prompt_id,
         (CASE WHEN l.quality = 1 THEN 'vanilla' ELSE 'adversarial' END) || '_' ||
         (CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'benign' END) AS data_type,
         d.text AS vanilla,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL
              WHEN d.doc_id % 7 = 0 THEN '  '
              ELSE 'Imagine a story. ' || d.text END AS adversarial
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "extracted": """
extracted AS (
  SELECT prompt_id, data_type,
         CASE WHEN coalesce(starts_with(data_type, 'adversarial')
                            AND regexp_matches(adversarial, '\\S'), false)
              THEN adversarial ELSE vanilla END AS prompt,
         CASE WHEN coalesce(contains(data_type, 'harmful'), false) THEN 1 ELSE 0 END AS label
  FROM raw)""",
    "prompts": """
prompts AS (
  SELECT prompt_id, prompt, data_type, label FROM extracted
  WHERE prompt IS NOT NULL AND regexp_matches(prompt, '\\S'))""",
    "split_q": """
sq1 AS (
  SELECT coalesce(data_type, '') AS s, count(*) AS n FROM prompts GROUP BY 1),
sq2 AS (
  SELECT s, n, sum(n) OVER () AS tot,
         sum(n) OVER () - CAST(ceil(CAST(0.3 AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS td
  FROM sq1),
sq3 AS (SELECT *, (n * td) // tot AS fl, (n * td) % tot AS rem FROM sq2),
sq4 AS (
  SELECT s, n, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, s)
                              <= td - sum(fl) OVER () THEN 1 ELSE 0 END AS n_train
  FROM sq3),
sq5 AS (
  SELECT s, n, n_train, n - n_train AS rest,
         sum(n - n_train) OVER () AS tot2,
         sum(n - n_train) OVER ()
           - CAST(ceil(CAST(0.5 AS DOUBLE) * sum(n - n_train) OVER ()) AS BIGINT) AS vd
  FROM sq4),
sq6 AS (SELECT *, (rest * vd) // tot2 AS fl2, (rest * vd) % tot2 AS rem2 FROM sq5),
split_q AS (
  SELECT s, n, n_train,
         fl2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, s)
                         <= vd - sum(fl2) OVER () THEN 1 ELSE 0 END AS n_val
  FROM sq6)""",
    "split": f"""
split AS (
  SELECT p.prompt_id, p.prompt, p.data_type, p.label,
         CASE WHEN r.rk <= q.n_train THEN 'train'
              WHEN r.rk <= q.n_train + q.n_val THEN 'val' ELSE 'test' END AS split
  FROM prompts p
  JOIN (SELECT prompt_id, row_number() OVER (PARTITION BY coalesce(data_type, '')
                 ORDER BY {okey('split')}, prompt_id) AS rk FROM prompts) r
    ON p.prompt_id = r.prompt_id
  JOIN split_q q ON coalesce(p.data_type, '') = q.s)""",
    "train": "train AS (SELECT prompt_id, prompt, data_type, label FROM split WHERE split = 'train')",
    "val": "val AS (SELECT prompt_id, prompt, data_type, label FROM split WHERE split = 'val')",
    "test": "test AS (SELECT prompt_id, prompt, data_type, label FROM split WHERE split = 'test')",
    "requests": """
requests AS (
  SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt
  FROM conversations WHERE role = 'user')""",
}

DEPS = {
    "extracted": ["raw"], "prompts": ["extracted"], "split_q": ["prompts"],
    "split": ["split_q"], "train": ["split"], "val": ["split"], "test": ["split"],
}


def terms_expr(text: str, ngram_max: int, max_tokens: int | None = None) -> str:
    toks = f"regexp_extract_all(lower({text}), '{TOKEN_RE}')"
    if max_tokens:
        toks = f"list_slice({toks}, 1, {max_tokens})"
    toks = f"list_filter({toks}, lambda w: NOT list_contains({STOP_SQL}, w))"
    if ngram_max == 1:
        return toks
    return (f"(SELECT list_concat(t, list_transform(range(1, len(t)), "
            f"lambda i: t[i] || ' ' || t[i + 1])) FROM (SELECT {toks} AS t))")


def dterms(name: str, source: str, ngram_max: int, keep: str = "", text: str = "prompt",
           max_tokens: int | None = None) -> str:
    """(prompt_id, [keep,] term, tf) for the rows of ``source``."""
    k = f"{keep}, " if keep else ""
    return f"""
{name} AS (
  SELECT prompt_id, {k}term, count(*) AS tf
  FROM (SELECT prompt_id, {k}unnest({terms_expr(text, ngram_max, max_tokens)}) AS term FROM {source})
  GROUP BY ALL)"""


def model_ctes(p: str, source: str = "train", ngram_max: int = 2, alpha: float = 1.0,
               max_features: int = MAX_FEATURES, text: str = "prompt",
               max_tokens: int | None = None) -> str:
    """Vocabulary ``{p}_vocab`` and log-odds weights ``{p}_w`` fitted on ``source``."""
    return dterms(f"{p}_dt", source, ngram_max, "label", text, max_tokens) + f""",
{p}_stats AS (
  SELECT term, sum(tf) AS cnt, count(*) AS df,
         count_if(label = 1) AS df_h, count_if(label = 0) AS df_b
  FROM {p}_dt GROUP BY term),
{p}_n AS (
  SELECT count(*) AS n, count_if(label = 1) AS n_h, count_if(label = 0) AS n_b FROM {source}),
{p}_vocab AS (
  SELECT t.*, row_number() OVER (ORDER BY term) - 1 AS idx,
         ln((1 + {p}_n.n) / (1 + t.df)) + 1 AS idf
  FROM (SELECT * FROM {p}_stats ORDER BY cnt DESC, term LIMIT {max_features}) t, {p}_n),
{p}_w AS (
  SELECT v.term,
         ln((v.df_h + CAST({alpha} AS DOUBLE) * c.n_h / (c.n_h + c.n_b)) / c.n_h)
         - ln((v.df_b + CAST({alpha} AS DOUBLE) * c.n_b / (c.n_h + c.n_b)) / c.n_b) AS weight
  FROM {p}_vocab v, {p}_n c)"""


def tfidf_ctes(p: str, model: str, source: str, ngram_max: int = 2, text: str = "prompt",
               max_tokens: int | None = None) -> str:
    """``{p}_x``: (prompt_id, idx, term, tf, x) for ``source`` under ``model``'s vocabulary."""
    return dterms(f"{p}_dt", source, ngram_max, "", text, max_tokens) + f""",
{p}_v AS (
  SELECT d.prompt_id, v.idx, d.term, d.tf, (1 + ln(d.tf)) * v.idf AS v
  FROM {p}_dt d JOIN {model}_vocab v ON d.term = v.term),
{p}_x AS (
  SELECT prompt_id, idx, term, tf, v / sqrt(sum(v * v) OVER (PARTITION BY prompt_id)) AS x
  FROM {p}_v)"""


def score_ctes(p: str, model: str, source: str, ngram_max: int = 2, text: str = "prompt",
               max_tokens: int | None = None) -> str:
    """``{p}_scored``: rows of ``source`` + logit + prob_harmful."""
    return tfidf_ctes(p, model, source, ngram_max, text, max_tokens) + f""",
{p}_c AS (
  SELECT x.prompt_id, x.term, x.idx, x.tf, x.x, w.weight AS coef, w.weight * x.x AS contribution
  FROM {p}_x x JOIN {model}_w w ON x.term = w.term),
{p}_s AS (SELECT prompt_id, sum(contribution) AS s FROM {p}_c GROUP BY prompt_id),
{p}_scored AS (
  SELECT r.*, round(coalesce(s.s, 0), 6) AS logit,
         1 / (1 + exp(-round(coalesce(s.s, 0), 6))) AS prob_harmful
  FROM {source} r LEFT JOIN {p}_s s ON r.prompt_id = s.prompt_id)"""


def with_ctes(base: list[str], extra: str = "") -> str:
    """``WITH`` clause holding ``base`` CTEs (plus dependencies) and ``extra``."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in base:
        add(n)
    parts = [BASE[n].strip() for n in order]
    if extra.strip():
        parts.append(extra.strip().lstrip(","))
    return "WITH " + ",\n".join(parts) + "\n"


STD_MODELS = model_ctes("m2", "train", 2) + "," + model_ctes("m1", "train", 1)
