"""A random forest as Spark aggregations and one node table.

Every random choice is an md5 of the seed and of what it is made for, and every
split is chosen from integer counts, so the forest is a function of the rows: the
same data give the same trees on any partitioning, and any SQL engine can grow
and walk them again.

* Features are TF-IDF weights in ``BINS`` steps (0: absent). A node draws
  ``ceil(sqrt(vocabulary))`` features and takes the split ``bin >= cut`` with the
  largest decrease of the class-weighted Gini impurity (ties: smaller feature,
  then smaller cut). Rows are drawn per tree with Poisson(1) counts.
* Training is one pass over the documents per level: a document walks all trees
  inside its own row, looks up the features its nodes have drawn, and each task
  adds up its ``(node, feature, bin)`` counts in numpy before Spark sums them.
  The drawn features of a level (at most ``trees * 2**level`` nodes of
  ``sqrt(vocabulary)`` each) and its chosen splits pass through the driver.
* The fitted forest is a table ``(pos, tree, heap, feature, cut, child, p, ...)``.
  Scoring broadcasts its arrays and walks the trees for a batch of documents at a
  time; only the steps of the known terms go to Python. Its size is bounded by
  ``trees * 2**(depth + 1)`` nodes.

Defined results: a text without known terms goes left everywhere; a training set
of one class raises an error; a row with a null text is scored like an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptscreen.constants import FOREST_DEPTH, FOREST_TREES, SEED, TOP_N
from promptscreen.functions.scalar import logit_of
from promptscreen.operators import linear
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir

BINS = 8
LEAF, OPEN = -1, -2
LEAST_GAIN = 1e-9
P_DECIMALS = 9              # sums over trees differ below it with their order
DOCS, PAIRS = 512, 50_000   # documents, and (document, tree) pairs, handled together in a task
HELD = 4_000_000            # counts a task holds before it adds them up
NODES = 100                 # least nodes a task draws features for


def poisson_limits(k: int = 5) -> list[int]:
    """32-bit limits of Poisson(1) counts: a draw below the ``i``-th is ``i`` at most."""
    total, out = 0.0, []
    for i in range(k):
        total += math.exp(-1) / math.factorial(i)
        out.append(int(total * 2**32))
    return out


def draw32(*parts):
    """32 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[p.cast("string") if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bin_of(weight):
    """Step of a TF-IDF weight, from 1 (0 stands for an absent term)."""
    return F.floor(weight * F.lit(float(BINS))).cast("int") + 1


def with_bins(rows: DataFrame, features: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """``rows`` with ``_bins``, an array of (feature, step) (null: no known term).
    ``features`` is the long TF-IDF table."""
    per = features.groupBy(id_col).agg(F.collect_list(F.struct("idx", bin_of(F.col("weight")).alias("bin"))).alias("_bins"))
    return rows.join(per, id_col, "left")


# --------------------------------------------------------------------- trees ----
class Nodes:
    """The nodes of all trees while they grow, as arrays on the driver."""

    def __init__(self, trees: int):
        self.tree, self.heap = list(range(trees)), [1] * trees
        self.feature, self.cut, self.child = [OPEN] * trees, [0] * trees, [0] * trees
        self.h, self.b, self.gain = [0] * trees, [0] * trees, [0.0] * trees

    def open(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f == OPEN]

    def split(self, pos: int, idx: int, cut: int, h: int, b: int, gain: float) -> None:
        """``pos`` sends (h, b) to its right child and the rest to its left one."""
        self.feature[pos], self.cut[pos], self.child[pos], self.gain[pos] = idx, cut, len(self.tree), gain
        for side, counts in enumerate(((self.h[pos] - h, self.b[pos] - b), (h, b))):
            self.tree.append(self.tree[pos]), self.heap.append(2 * self.heap[pos] + side)
            self.feature.append(OPEN), self.cut.append(0), self.child.append(0), self.gain.append(0.0)
            self.h.append(counts[0]), self.b.append(counts[1])

    def close(self, positions) -> None:
        for i in positions:
            self.feature[i] = LEAF

    def columns(self, w_h: float, w_b: float) -> dict[str, np.ndarray]:
        h, b = np.array(self.h, np.float64) * w_h, np.array(self.b, np.float64) * w_b
        total = h + b
        return {"pos": np.arange(len(self.tree), dtype=np.int32), "tree": np.array(self.tree, np.int32),
                "heap": np.array(self.heap, np.int64), "feature": np.array(self.feature, np.int32),
                "cut": np.array(self.cut, np.int32), "child": np.array(self.child, np.int32),
                "n_h": np.array(self.h, np.int64), "n_b": np.array(self.b, np.int64),
                "p": np.where(total > 0, h / np.where(total > 0, total, 1.0), 0.5), "gain": np.array(self.gain, np.float64)}

    def table(self, spark: SparkSession, w_h: float, w_b: float) -> DataFrame:
        return spark.createDataFrame(pa.table(self.columns(w_h, w_b)))


def walk_table(nodes: DataFrame) -> dict[str, np.ndarray]:
    """What a walk reads of the node table, as arrays in the order of ``pos``."""
    got = nodes.select("pos", "feature", "cut", "child", "p").toArrow()
    order = np.argsort(got["pos"].to_numpy())
    return {c: got[c].to_numpy()[order] for c in ("feature", "cut", "child", "p")}


def dense(idx: pd.Series, steps: pd.Series, size: int) -> np.ndarray:
    """Steps of all features, a row per document; the last column, 0, is of no feature."""
    out = np.zeros((len(idx), size + 1), np.uint8)
    for row, i, s in zip(out, idx, steps, strict=True):
        if i is not None and len(i):
            row[i] = s
    return out


def leaves(table: dict, steps: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Position of the node that each document (a row of ``steps``) ends in, for each tree."""
    pos = np.tile(np.arange(trees), (len(steps), 1))
    at = np.arange(len(steps))[:, None]
    for _ in range(depth):
        feature = table["feature"][pos]
        right = steps[at, np.where(feature < 0, -1, feature)] >= table["cut"][pos]
        pos = np.where(feature < 0, pos, table["child"][pos] + right)
    return pos


def _probabilities(shared, trees: int, depth: int, size: int):
    """Arrow-backed function: the sum over the trees of a document's leaf."""
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        for idx, steps in batches:
            total = np.zeros(len(idx))
            for k in range(0, len(idx), DOCS):
                part = slice(k, k + DOCS)
                pos = leaves(table, dense(idx.iloc[part], steps.iloc[part], size), trees, depth)
                for tree in range(trees):           # one after the other: the same sum everywhere
                    total[part] += table["p"][pos[:, tree]]
            yield pd.Series(total)

    return F.pandas_udf(of, "double")


@dataclass
class TreeScorer:
    """Vocabulary + node table; ``score`` adds ``prob_harmful`` (rounded to 9 places)."""
    spec: T.TfidfSpec
    vocab: DataFrame
    nodes: DataFrame
    trees: int
    depth: int

    def score(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
              partitioned: bool = False) -> DataFrame:
        base = df if partitioned else T.by_id(df, id_col)
        rows = with_bins(base, T.features(base.select(id_col, text_col), self.vocab, self.spec, text_col, id_col), id_col)
        p = self.total_of(F.col("_bins.idx"), F.col("_bins.bin"))
        out = rows.select(*(F.col(f"`{c}`") for c in df.columns), F.round(p / F.lit(float(self.trees)), P_DECIMALS).alias("prob_harmful"))
        return out.withColumn("logit", logit_of("prob_harmful"))

    @cached_property
    def total_of(self):
        shared = self.nodes.sparkSession.sparkContext.broadcast(walk_table(self.nodes))
        return _probabilities(shared, self.trees, self.depth, self.vocab.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0] + 1)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")

    @staticmethod
    def load(spark: SparkSession, path: str, spec: T.TfidfSpec) -> "TreeScorer":
        nodes = spark.read.parquet(f"{path}/nodes")
        trees, depth = nodes.agg(F.max("tree") + 1, F.floor(F.log2(F.max("heap")))).first()
        return TreeScorer(spec, spark.read.parquet(f"{path}/vocab"), nodes, int(trees), int(depth))


# ------------------------------------------------------------------ training ----
def training_rows(train: DataFrame, vocab: DataFrame, spec: T.TfidfSpec, trees: int, seed: int) -> DataFrame:
    """``(label, _bins, _draws)`` per document with known terms or without, where
    ``_draws`` counts how often each tree has drawn it."""
    base = T.by_id(train.select("prompt_id", "prompt", "label"))
    rows = with_bins(base.select("prompt_id", "label"), T.features(base.select("prompt_id", "prompt"), vocab, spec))

    def count(u):
        return sum(((u >= limit).cast("int") for limit in poisson_limits()), F.lit(0))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw32(seed, "row", t, F.col("prompt_id")))
    return rows.select("label", F.col("_bins.idx").alias("_idx"), F.col("_bins.bin").alias("_steps"),
                       F.transform(drawn, count).alias("_draws"))


def candidates(spark: SparkSession, nodes: Nodes, vocabulary: int, seed: int) -> DataFrame:
    """``(pos, n_h, n_b, _drawn)``: the features each open node has drawn. Tasks draw
    them: over a local table the driver would do it alone while it plans."""
    at = nodes.open()
    m = math.ceil(math.sqrt(vocabulary))
    rows = spark.createDataFrame(pa.table({
        "pos": pa.array(at, pa.int32()), "tree": pa.array([nodes.tree[i] for i in at], pa.int32()),
        "heap": pa.array([nodes.heap[i] for i in at], pa.int64()), "n_h": pa.array([nodes.h[i] for i in at], pa.int64()),
        "n_b": pa.array([nodes.b[i] for i in at], pa.int64())}))
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: (
        draw32(seed, "feature", F.col("tree"), F.col("heap"), j) % F.lit(vocabulary)).cast("int")))
    spread = rows.repartition(max(1, min(spark.sparkContext.defaultParallelism, len(at) // NODES)))
    return spread.select("pos", "n_h", "n_b", drawn.alias("_drawn"))


def purity(h, b):
    """Weighted sum of squares over their total: impurity is total minus this."""
    return F.when(h + b > 0, (h * h + b * b) / (h + b)).otherwise(F.lit(0.0))


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _histograms(shared, trees: int, level: int, size: int, frames):
    """Counts ``(pos, idx, cut, h, b)`` of a task's documents at the open nodes of a level."""
    table, drawn = shared.value["table"], shared.value["drawn"]     # a row of drawn features per open node
    slot_of = np.full(len(table["feature"]), -1)
    slot_of[shared.value["pos"]] = np.arange(len(drawn))
    m, keys, counts, held = drawn.shape[1], [], [], 0
    column = np.where(drawn < 0, size, drawn)
    for frame in frames:
        for k in range(0, len(frame), DOCS):
            part = frame.iloc[k:k + DOCS]
            steps = dense(part["_idx"], part["_steps"], size)
            flat, slots = steps.ravel(), slot_of[leaves(table, steps, trees, level)]
            n, is_h = np.stack(part["_draws"].to_numpy()), (part["label"] == 1).to_numpy()
            doc, tree = np.nonzero((slots >= 0) & (n > 0))
            for j in range(0, len(doc), PAIRS):
                d, t = doc[j:j + PAIRS], tree[j:j + PAIRS]
                slot = slots[d, t]
                met = flat.take(column[slot] + (d * (size + 1))[:, None]).ravel()
                at = np.flatnonzero(met != 0)           # few: on bytes of truth values it is fast
                row, col = np.divmod(at, m)
                keys.append(((slot[row] * m + col) * 16 + met[at]) * 2 + is_h[d[row]])
                counts.append(n[d[row], t[row]])
                held += len(row)
                if held > HELD:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], 0
    if not keys:
        return
    key, count = _summed(keys, counts)
    cell, h = key // 2, key % 2 == 1
    slot, col = np.divmod(cell // 16, m)
    for k in range(0, len(key), HELD // 8):
        s = slice(k, k + HELD // 8)
        yield pd.DataFrame({"pos": shared.value["pos"][slot[s]], "idx": drawn[slot[s], col[s]], "cut": cell[s] % 16,
                            "h": np.where(h[s], count[s], 0), "b": np.where(h[s], 0, count[s])})


def best_splits(docs: DataFrame, nodes: Nodes, drawn: DataFrame, trees: int, level: int,
                size: int, w_h: float, w_b: float) -> pa.Table:
    """``(pos, idx, cut, h, b, gain)``: the best split of each open node."""
    got = drawn.select("pos", "_drawn").toArrow()
    lists = got["_drawn"].combine_chunks()
    length = lists.value_lengths().to_numpy()
    of_node = np.full((len(length), int(length.max())), -1, np.int32)       # -1: no feature
    of_node[np.arange(of_node.shape[1]) < length[:, None]] = lists.flatten().to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast({"table": nodes.columns(w_h, w_b), "pos": got["pos"].to_numpy(), "drawn": of_node})
    per_task = docs.mapInPandas(partial(_histograms, shared, trees, level, size), "pos int, idx int, cut int, h long, b long")
    hist = per_task.groupBy("pos", "idx", "cut").agg(F.sum("h").alias("h"), F.sum("b").alias("b"))
    # right of a cut: all steps from it on
    up = Window.partitionBy("pos", "idx").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    right = hist.select("pos", "idx", "cut", F.sum("h").over(up).alias("h"), F.sum("b").over(up).alias("b"))
    right = right.join(F.broadcast(drawn.select("pos", "n_h", "n_b")), "pos").filter("h + b < n_h + n_b")
    wh, wb = F.lit(w_h), F.lit(w_b)
    both = (purity(wh * F.col("h"), wb * F.col("b"))
            + purity(wh * (F.col("n_h") - F.col("h")), wb * (F.col("n_b") - F.col("b"))))
    right = right.withColumn("_s", both).withColumn("gain", both - purity(wh * F.col("n_h"), wb * F.col("n_b")))
    chosen = right.filter(F.col("gain") > LEAST_GAIN).groupBy("pos").agg(F.max_by(
        F.struct("idx", "cut", "h", "b", "gain"), F.struct("_s", -F.col("idx"), -F.col("cut"))).alias("_b"))
    splits = chosen.select("pos", "_b.*").toArrow()
    shared.unpersist()
    return splits


def fit(train: DataFrame, spec: T.TfidfSpec | None = None, num_trees: int = FOREST_TREES,
        max_depth: int = FOREST_DEPTH, seed: int = SEED, stats: DataFrame | None = None,
        vocab: DataFrame | None = None) -> TreeScorer:
    """Class-balanced random forest on TF-IDF (M3)."""
    spec = spec or T.TfidfSpec()
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    if vocab is None:
        if stats is None:
            stats = linear.train_term_stats(train, spec)
        n_docs, _, _ = linear.class_counts(train)
        vocab = T.vocabulary_from_stats(stats, n_docs, spec).checkpoint(eager=True)
    size = vocab.count()
    # stored over as many tasks as texts need; a walk adds up more in fewer
    docs = training_rows(train, vocab, spec, num_trees, seed).checkpoint(eager=True).coalesce(spark.sparkContext.defaultParallelism)
    n_h, n_b = docs.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not (n_h and n_b):
        raise ValueError("the forest needs training rows of both classes")
    w_h, w_b = (n_h + n_b) / (2.0 * n_h), (n_h + n_b) / (2.0 * n_b)
    nodes = Nodes(num_trees)
    roots = docs.select("label", F.posexplode("_draws").alias("tree", "n")).groupBy("tree").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("h"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("b"))
    for r in roots.collect():                       # one row a tree
        nodes.h[r["tree"]], nodes.b[r["tree"]] = r["h"], r["b"]
    for level in range(max_depth):
        nodes.close([i for i in nodes.open() if not (nodes.h[i] and nodes.b[i])])
        at = nodes.open()
        if not at or not size:
            break
        splits = best_splits(docs, nodes, candidates(spark, nodes, size, seed), num_trees, level, size, w_h, w_b)
        for s in sorted(splits.to_pylist(), key=lambda s: s["pos"]):
            nodes.split(s["pos"], s["idx"], s["cut"], s["h"], s["b"], s["gain"])
        nodes.close(i for i in at if nodes.feature[i] == OPEN)
    nodes.close(nodes.open())
    return TreeScorer(spec, vocab, nodes.table(spark, w_h, w_b).checkpoint(eager=True), num_trees, max_depth)


def importances(scorer: TreeScorer, top_n: int | None = TOP_N) -> DataFrame:
    """``(feature, importance)``: mean over the trees of each tree's shares of
    impurity decrease, joined with the vocabulary (M5, J6, T1). Trees without a
    split have no shares."""
    split = scorer.nodes.filter("feature >= 0")
    of_tree = split.groupBy("tree").agg(F.sum("gain").alias("_all"))
    share = split.join(F.broadcast(of_tree), "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("_all")).alias("_s"))
    total = of_tree.agg(F.count("*")).scalar()
    named = share.withColumnRenamed("feature", "idx").join(F.broadcast(scorer.vocab.select("idx", F.col("term").alias("feature"))), "idx")
    found = named.select("feature", (F.col("_s") / total).alias("importance"))
    return found if top_n is None else found.orderBy(F.round("importance", 9).desc(), F.col("feature")).limit(top_n)
