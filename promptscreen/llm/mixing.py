"""Mixing sources to target weights, by hierarchical token budgets.

The sources form a tree (domain, language, source). A token budget enters at
the root and goes down in proportion to integer weights. A node cannot take
more than its subtree holds (tokens times ``max_epochs``); what it cannot take
goes to its siblings, and only what all siblings cannot take goes back to the
level above. Because a node's capacity is the sum of its children's, one
top-down pass of capped proportional shares gives exactly that.

A leaf with budget ``a`` and ``t`` tokens gives ``a div t`` whole epochs and,
of the next epoch, the token prefix of length ``a % t`` in that epoch's seeded
order of documents; the last document may be cut.

Everything is DataFrame expressions. A hot leaf is never sorted whole: its
order key is cut into 65,536 buckets, bucket sums find the bucket in which the
prefix ends, and only that bucket is ranked.

Defined results: null or empty texts have no tokens and are never chosen; a
null level value is the node ``''``; repeated rows count each; an empty table
gives no rows; other input columns pass through untouched (clashing names are
refused).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.llm.common import apart, store

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens", "mix_take")
LEVELS = ["mix_domain", "mix_lang", "mix_source"]
BIG = "decimal(38,0)"
BROADCAST_LEAVES = 100_000      # rows of the leaf table up to which it is broadcast


@dataclass(frozen=True)
class MixSpec:
    """``weights[level][name]`` are integer weights (``default_weight`` if not
    named); the budget is ``budget_num / budget_den`` of all tokens, or
    ``budget_tokens`` if given."""

    domain: object = None                   # function of a DataFrame to a Column
    weights: tuple = ({}, {}, {})
    default_weight: int = 1
    budget_num: int = 3
    budget_den: int = 5
    budget_tokens: int | None = None
    max_epochs: int = 4
    seed: int = 42
    columns: dict = field(default_factory=lambda: {"lang": "lang", "source": "source"})


def source_domain(df: DataFrame) -> Column:
    """Domain of a document: ``d0``-``d3`` by the number in its source's name."""
    number = F.regexp_extract(F.coalesce(df["source"], F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "").otherwise(F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string")))


#: Production parameters of the registered query and of the pipeline stage.
MIX = MixSpec(domain=source_domain,
              weights=({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "fr": 2, "de": 2, "es": 1}, {"src0": 2}))


def _weight(level: int, spec: MixSpec) -> Column:
    w = F.lit(int(spec.default_weight))
    for name, value in spec.weights[level].items():
        w = F.when(F.col(LEVELS[level]) == name, F.lit(int(value))).otherwise(w)
    return w.cast(BIG)


def _share(nodes: DataFrame, level: int) -> DataFrame:
    """Split ``budget`` (of the parent) over the children of each parent: in
    proportion to ``w``, none above ``cap``; whole tokens by largest remainder."""
    parent, name = LEVELS[:level], LEVELS[level]
    family = Window.partitionBy(*parent)
    order = [(F.col("cap") * F.lit(10**9).cast(BIG)).cast(BIG).try_cast("double") / F.col("w"), F.col(name)]
    up = family.orderBy(*order)
    n = (nodes.filter("w > 0")
         .withColumn("_r", F.col("budget") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_sat", F.expr(f"cast(cap * cast(_w as {BIG}) as {BIG}) <= cast(w * cast(_r as {BIG}) as {BIG})")))
    n = (n.withColumn("_left", (F.col("budget") - F.sum(F.when(F.col("_sat"), F.col("cap")).otherwise(0)).over(family)).cast(BIG))
         .withColumn("_open", F.sum(F.when(~F.col("_sat"), F.col("w")).otherwise(0)).over(family).cast(BIG)))
    n = (n.withColumn("_fl", F.expr(f"case when _sat then cap else cast(cast(w * _left as {BIG}) div _open as {BIG}) end"))
         .withColumn("_rem", F.expr(f"case when _sat then cast(-1 as {BIG}) else cast(cast(w * _left as {BIG}) % _open as {BIG}) end")))
    n = (n.withColumn("_extra", F.col("_left") - F.sum(F.when(~F.col("_sat"), F.col("_fl")).otherwise(0)).over(family))
         .withColumn("_pos", F.row_number().over(family.orderBy(F.col("_rem").desc(), F.col(name)))))
    got = F.col("_fl") + F.when(~F.col("_sat") & (F.col("_pos") <= F.col("_extra")), 1).otherwise(0)
    return n.select(*LEVELS[:level + 1], got.cast(BIG).alias("budget"))


def leaf_budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """``leaves``: the level columns and ``tokens``. Adds ``budget`` per leaf."""
    w = [_weight(i, spec) for i in range(3)]
    live = F.least(*(F.sign(x) for x in w))
    cap = leaves.select(*LEVELS, "tokens", (F.col("tokens") * spec.max_epochs * live).cast(BIG).alias("cap"))
    total = cap.agg(F.sum("tokens").cast(BIG).alias("all"))
    budget = (F.lit(spec.budget_tokens).cast(BIG) if spec.budget_tokens is not None
              else F.expr(f"cast(`all` * {int(spec.budget_num)} div {int(spec.budget_den)} as {BIG})"))
    above = total.select(F.coalesce(budget, F.lit(0)).cast(BIG).alias("budget"))
    for level in range(3):
        nodes = cap.groupBy(*LEVELS[:level + 1]).agg(F.sum("cap").cast(BIG).alias("cap"))
        nodes = nodes.withColumn("w", w[level])
        nodes = nodes.join(above, LEVELS[:level]) if level else nodes.join(F.broadcast(above))   # one row
        above = _share(nodes, level)
    return leaves.join(above, LEVELS).select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, spec: MixSpec = MIX, text: str = "text", doc_id: str = "doc_id",
        with_text: bool = True) -> DataFrame:
    """Rows of ``docs`` chosen for the mixture, one per document and epoch,
    with the columns ``mix_*``: the leaf, the epoch (from 0), the tokens of the
    document and how many of its first tokens are taken. With ``with_text`` the
    text of a cut document is its first ``mix_take`` tokens, joined by spaces;
    otherwise the text column is left out (and the texts are read once only).
    Columns named like an added one, in any case, are replaced; all others stay,
    whatever they are called.
    """
    null = F.lit("")
    leaf = {"mix_domain": F.coalesce(spec.domain(docs), null) if spec.domain else null,
            "mix_lang": F.coalesce(docs[spec.columns["lang"]], null),
            "mix_source": F.coalesce(docs[spec.columns["source"]], null)}
    return apart(docs, {"text": text, "doc_id": doc_id}, lambda d: _mix(d, spec, with_text), ADDED, leaf)


def _mix(docs: DataFrame, spec: MixSpec, with_text: bool, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    null = F.lit("")
    base = docs.withColumns({
        "mix_tokens": F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")})
    narrow = store(base.drop(text) if not with_text else base.select(doc_id, *LEVELS, "mix_tokens"), "mix-rows")
    leaves = store(leaf_budgets(narrow.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
                                .filter("tokens > 0"), spec)
                   .select(*LEVELS, F.expr("cast(budget div tokens as bigint)").alias("_mfull"),
                           F.expr("cast(budget % tokens as bigint)").alias("_mrest")), "mix-leaves")

    def with_leaf(df):
        side = F.broadcast(leaves) if small else leaves
        order = F.md5(F.concat_ws("|", F.lit(str(spec.seed)), F.col("_mfull").cast("string"),
                                  F.coalesce(F.col(doc_id).cast("string"), null)))
        return (df.filter("mix_tokens > 0").join(side, LEVELS).withColumn("_mkey", order)
                .withColumn("_mbucket", F.substring("_mkey", 1, 4)))

    small = leaves.count() <= BROADCAST_LEAVES
    sums = with_leaf(narrow).groupBy(*LEVELS, "_mbucket", "_mrest").agg(F.sum("mix_tokens").alias("_mn"))
    before = Window.partitionBy(*LEVELS).orderBy("_mbucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("_moff", F.coalesce(F.sum("_mn").over(before), F.lit(0)))
            .filter("_moff < _mrest and _mrest <= _moff + _mn")
            .select(*LEVELS, F.col("_mbucket").alias("_mlast"), "_moff"))
    edge = store(edge, "mix-edges")             # at most one row per leaf
    keyed = with_leaf(base if with_text else narrow).join(F.broadcast(edge) if small else edge, LEVELS, "left")
    inside = Window.partitionBy(*LEVELS, "_mbucket").orderBy("_mkey", doc_id, "mix_tokens")
    at_edge = keyed.filter("_mbucket = _mlast").withColumn("_mrun", F.sum("mix_tokens").over(
        inside.rowsBetween(Window.unboundedPreceding, -1)))
    part = F.greatest(F.lit(0), F.least(F.col("mix_tokens"), F.col("_mrest") - F.col("_moff") - F.coalesce("_mrun", F.lit(0))))
    rest = keyed.filter("_mlast is null or _mbucket <> _mlast").withColumn("_mpart", F.when(F.col("_mbucket") < F.col("_mlast"), F.col("mix_tokens")).otherwise(0))
    rows = at_edge.withColumn("_mpart", part).drop("_mrun").unionByName(rest)
    whole = F.transform(F.sequence(F.lit(0), F.col("_mfull")), lambda e: F.struct(
        e.cast("int").alias("mix_epoch"), F.when(e < F.col("_mfull"), F.col("mix_tokens")).otherwise(F.col("_mpart")).cast("bigint").alias("mix_take")))
    out = (rows.withColumn("_mtakes", F.filter(whole, lambda x: x["mix_take"] > 0))
           .select("*", F.inline("_mtakes")))
    if with_text:
        cut = F.concat_ws(" ", F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("mix_take").cast("int")))
        out = out.withColumn(text, F.when(F.col("mix_take") < F.col("mix_tokens"), cut).otherwise(F.col(text)))
    kept = [c for c in docs.columns if (with_text or c != text) and c not in LEVELS]
    return out.select(*kept, *ADDED)
