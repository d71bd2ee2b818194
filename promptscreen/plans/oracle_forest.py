"""DuckDB SQL that grows the forest again from the training rows and walks it.

One group of CTEs per level; the same md5 draws, integer counts and formulas as
the definition in ``operators/ensemble.py``, written as joins.
"""

from __future__ import annotations

from promptscreen.constants import FOREST_DEPTH, FOREST_TREES, SEED
from promptscreen.operators.ensemble import BINS, LEAST_GAIN, poisson_limits
from promptscreen.plans.oracle import tfidf_ctes


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT"


def _bins(p: str) -> str:
    return f"""
{p}_b AS MATERIALIZED (SELECT prompt_id, idx, CAST(floor(x * CAST({BINS} AS DOUBLE)) AS INTEGER) + 1 AS bin FROM {p}_x)"""


def _purity(h: str, b: str) -> str:
    return f"(CASE WHEN {h} + {b} > 0 THEN ({h} * {h} + {b} * {b}) / ({h} + {b}) ELSE 0 END)"


def _level(k: int) -> str:
    rh, rb, lh, lb = "(w_h * h)", "(w_b * b)", "(w_h * (n_h - h))", "(w_b * (n_b - b))"
    return f"""
fn{k} AS MATERIALIZED (SELECT tree, heap, sum(wt * label)::BIGINT AS n_h, sum(wt * (1 - label))::BIGINT AS n_b FROM fa{k} GROUP BY 1, 2),
fc{k} AS MATERIALIZED (
  SELECT DISTINCT tree, heap, ({_draw("'feature'", 'tree', 'heap', 'j')} % size)::INTEGER AS idx
  FROM (SELECT tree, heap, size, unnest(range(m)) AS j FROM fn{k}, fz WHERE n_h > 0 AND n_b > 0)),
fh{k} AS (
  SELECT a.tree, a.heap, c.idx, x.bin, sum(a.wt * a.label)::BIGINT AS h, sum(a.wt * (1 - a.label))::BIGINT AS b
  FROM fa{k} a JOIN ft_b x ON x.prompt_id = a.prompt_id JOIN fc{k} c ON c.tree = a.tree AND c.heap = a.heap AND c.idx = x.idx
  GROUP BY 1, 2, 3, 4),
fr{k} AS (
  SELECT r.tree, r.heap, r.idx, r.bin, r.h, r.b, n.n_h, n.n_b FROM (
    SELECT tree, heap, idx, bin, sum(h) OVER w AS h, sum(b) OVER w AS b FROM fh{k}
    WINDOW w AS (PARTITION BY tree, heap, idx ORDER BY bin DESC)) r
  JOIN fn{k} n ON n.tree = r.tree AND n.heap = r.heap WHERE r.h + r.b < n.n_h + n.n_b),
fg{k} AS (
  SELECT tree, heap, idx, bin AS cut, h, b, {_purity(rh, rb)} + {_purity(lh, lb)} AS s,
         {_purity(rh, rb)} + {_purity(lh, lb)} - {_purity('(w_h * n_h)', '(w_b * n_b)')} AS gain FROM fr{k}, fk),
fs{k} AS MATERIALIZED (
  SELECT tree, heap, idx, cut, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, heap ORDER BY s DESC, idx, cut) AS r FROM fg{k} WHERE gain > {LEAST_GAIN}) WHERE r = 1),
fa{k + 1} AS MATERIALIZED (
  SELECT a.tree, a.prompt_id, a.label, a.wt, 2 * a.heap + CAST(coalesce(x.bin, 0) >= s.cut AS INTEGER) AS heap
  FROM fa{k} a JOIN fs{k} s ON s.tree = a.tree AND s.heap = a.heap
  LEFT JOIN ft_b x ON x.prompt_id = a.prompt_id AND x.idx = s.idx),"""


def forest_ctes() -> str:
    """Nodes ``fnodes (tree, heap, n_h, n_b, p)`` and splits ``fsplits (tree,
    heap, idx, cut, gain)``; needs ``train`` and the vocabulary ``m2_vocab``."""
    count = " + ".join(f"CAST(u >= {limit} AS INTEGER)" for limit in poisson_limits())
    levels = range(FOREST_DEPTH)
    return tfidf_ctes("ft", "m2", "train", 2) + "," + _bins("ft") + f""",
fz AS (SELECT count(*) AS size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS m FROM m2_vocab),
fk AS (SELECT (n_h + n_b) / (CAST(2 AS DOUBLE) * n_h) AS w_h, (n_h + n_b) / (CAST(2 AS DOUBLE) * n_b) AS w_b FROM m2_n),
fa0 AS MATERIALIZED (
  SELECT tree, prompt_id, label, wt, 1::BIGINT AS heap FROM (
    SELECT tree, prompt_id, label, {count} AS wt FROM (
      SELECT tree, prompt_id, label, {_draw("'row'", 'tree', 'prompt_id')} AS u
      FROM train, (SELECT unnest(range({FOREST_TREES})) AS tree))) WHERE wt > 0),""" + "".join(map(_level, levels)) + f"""
fn{FOREST_DEPTH} AS (SELECT tree, heap, sum(wt * label)::BIGINT AS n_h, sum(wt * (1 - label))::BIGINT AS n_b FROM fa{FOREST_DEPTH} GROUP BY 1, 2),
fsplits AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM fs{k}" for k in levels)}),
fnodes AS MATERIALIZED (
  SELECT tree, heap, n_h, n_b, w_h * n_h / (w_h * n_h + w_b * n_b) AS p
  FROM ({" UNION ALL ".join(f"SELECT * FROM fn{k}" for k in range(FOREST_DEPTH + 1))}), fk)"""


def forest_score_ctes(p: str, source: str) -> str:
    """``{p}_scored``: rows of ``source`` with the forest's ``prob_harmful``."""
    walk = "".join(f"""
{p}_w{k + 1} AS MATERIALIZED (
  SELECT w.prompt_id, w.tree, CASE WHEN s.idx IS NULL THEN w.heap ELSE 2 * w.heap + CAST(coalesce(x.bin, 0) >= s.cut AS INTEGER) END AS heap
  FROM {p}_w{k} w LEFT JOIN fsplits s ON s.tree = w.tree AND s.heap = w.heap
  LEFT JOIN {p}_b x ON x.prompt_id = w.prompt_id AND x.idx = s.idx),""" for k in range(FOREST_DEPTH))
    return tfidf_ctes(p, "m2", source, 2) + "," + _bins(p) + f""",
{p}_w0 AS (SELECT prompt_id, tree, 1::BIGINT AS heap FROM {source}, (SELECT unnest(range({FOREST_TREES})) AS tree)),{walk}
{p}_p AS (SELECT w.prompt_id, round(avg(n.p), 9) AS prob_harmful FROM {p}_w{FOREST_DEPTH} w
          JOIN fnodes n ON n.tree = w.tree AND n.heap = w.heap GROUP BY 1),
{p}_scored AS (SELECT r.*, s.prob_harmful FROM {source} r JOIN {p}_p s ON s.prompt_id = r.prompt_id)"""
