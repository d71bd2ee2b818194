"""A small non-linear stage-2 model, trained in epochs.

A text is the TF-IDF-weighted sum of one learned vector per known term; one
hidden layer follows: ``logit = u . tanh(b + sum_t x_t e_t) + c``.

Training is synchronous mini-batch descent. An epoch has a fixed number of
batches and a document's batch comes from a hash of its id, so neither the
number of partitions nor of executors changes the model (but for the order of
floating-point sums). Each task sums the gradients of its documents; Spark sums
those by term; the driver applies one Adam step to the model, which has at most
``max_features`` vectors. The feature table is stored by batch, and a step reads
its batch's folder alone. Every epoch leaves a candidate; all candidates score
the validation rows in one pass and the best F1 is kept (ties: the earlier epoch).

Scoring, and attribution by gradient x input, are DataFrame expressions over
the broadcast model table.

Defined results: a text without a known term (also a null one) has the logit
``u . tanh(b) + c``; repeated training rows count each. Rows without a label do
not train. Without training rows, or with one class only, :func:`fit` refuses.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import partial, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptscreen.constants import DECIMALS, SEED, THRESHOLD
from promptscreen.functions.scalar import sigmoid
from promptscreen.operators import linear, metrics
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir
from promptscreen.sources import io

HEAD = -1       # the row number of the hidden layer's gradient among the terms'
CHUNK = 1_000_000       # known terms whose gradient rows are built together


@dataclass(frozen=True)
class TrainSpec:
    dim: int = 8
    epochs: int = 4
    batches: int = 8            # mini-batches of an epoch
    rate: float = 0.05
    balanced: bool = True       # weigh documents by class (A9)
    seed: int = SEED


@dataclass
class Params:
    """``e`` (terms, dim), ``u`` and ``b`` (dim), ``c`` (1)."""
    e: np.ndarray
    u: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def start(terms: int, dim: int, seed: int) -> "Params":
        rng = np.random.default_rng(seed)
        return Params(rng.normal(0, 0.1, (terms, dim)), rng.normal(0, 0.5, dim), np.zeros(dim), np.zeros(1))

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.u, self.b, self.c]

    def copy(self) -> "Params":
        return Params(*(a.copy() for a in self.arrays()))


def forward(p: Params, doc: np.ndarray, idx: np.ndarray, x: np.ndarray, n: int):
    """Hidden layer and logits of ``n`` documents given as (document, term, value)."""
    pooled = np.zeros((n, len(p.b)))
    for k in range(len(p.b)):
        pooled[:, k] = np.bincount(doc, x * p.e[idx, k], n)
    h = np.tanh(pooled + p.b)
    return h, h @ p.u + p.c[0]


def gradient(p: Params, doc, idx, x, y, w):
    """Weighted logistic loss and its gradients, summed over the documents:
    ``(loss, terms, rows of e, u, b, c)``."""
    h, logit = forward(p, doc, idx, x, len(y))
    loss = float(np.sum(w * (np.logaddexp(0, logit) - y * logit)))
    d = w * (0.5 * (1 + np.tanh(logit / 2)) - y)
    back = (d[:, None] * p.u) * (1 - h * h)
    terms, at = np.unique(idx, return_inverse=True)
    rows = np.zeros((len(terms), len(p.b)))
    for k in range(len(p.b)):
        rows[:, k] = np.bincount(at, x * back[doc, k], len(terms))
    return loss, terms, rows, d @ h, back.sum(0), float(d.sum())


def _sparse(frame: pd.DataFrame):
    sizes = frame["idx"].map(len).to_numpy()
    flat = [np.concatenate([np.asarray(v) for v in frame[c]]) if sizes.sum() else np.zeros(0) for c in ("idx", "x")]
    return np.repeat(np.arange(len(frame)), sizes), flat[0].astype(np.int64), flat[1].astype(float)


def _pieces(frame: pd.DataFrame):
    """The frame in runs of rows of about ``CHUNK`` known terms."""
    run = frame["idx"].map(len).cumsum() // CHUNK
    return (part for _, part in frame.groupby(run))


def _gradients(shared, frames):
    p, dim = shared.value, len(shared.value.b)
    names = ["idx", *(f"g{k}" for k in range(2 * dim + 3))]
    head = np.zeros(2 * dim + 3)
    seen, sums = np.zeros(len(p.e), bool), np.zeros_like(p.e)
    for frame in frames:
        for part in _pieces(frame):
            y, w = part["label"].to_numpy(float), part["w"].to_numpy(float)
            loss, terms, rows, gu, gb, gc = gradient(p, *_sparse(part), y, w)
            seen[terms] = True
            sums[terms] += rows
            head += np.concatenate([gu, gb, [gc, loss, w.sum()]])
    at = np.flatnonzero(seen)
    total = np.zeros((len(at) + 1, 2 * dim + 3))
    total[:-1, :dim], total[-1] = sums[at], head
    out = pd.DataFrame(total, columns=names[1:])
    out.insert(0, "idx", np.append(at, HEAD))
    yield out


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = ([np.zeros_like(a) for a in p.arrays()] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for a, g, m, s in zip(self.p.arrays(), grads, self.m, self.s, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= scale * m / (np.sqrt(s) + 1e-8)


def sparse_rows(df: DataFrame, vocab: DataFrame, spec: T.TfidfSpec, keep: tuple = (),
                text_col: str = "prompt", id_col: str = "prompt_id") -> DataFrame:
    """``(id, *keep, idx, x)``: one row per document, its known terms as two arrays."""
    base = T.by_id(df.select(id_col, text_col, *keep), id_col)
    x = T.features(base.select(id_col, text_col), vocab, spec, text_col, id_col)
    pairs = x.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("weight").alias("x")))).alias("_a"))
    out = base.drop(text_col).join(pairs, id_col, "left").withColumn("_a", F.coalesce("_a", F.array().cast(pairs.schema["_a"].dataType)))
    return out.select(id_col, *keep, F.col("_a.idx").alias("idx"), F.col("_a.x").alias("x"))


def _step(spark, rows: DataFrame, p: Params) -> tuple[list[np.ndarray], float] | None:
    """Gradients of the weighted mean loss of ``rows`` and that loss; none without rows."""
    dim = len(p.b)
    shared = spark.sparkContext.broadcast(p)
    cols = [f"g{k}" for k in range(2 * dim + 3)]
    per_task = rows.select("idx", "x", "label", "w").mapInPandas(
        partial(_gradients, shared), ", ".join(["idx long", *(f"{c} double" for c in cols)]))
    # at most one row per vocabulary term and one for the hidden layer
    got = per_task.groupBy("idx").agg(*(F.sum(c).alias(c) for c in cols)).toPandas().set_index("idx")
    shared.unpersist()
    if HEAD not in got.index or got.at[HEAD, cols[-1]] <= 0:
        return None
    head = got.loc[HEAD].to_numpy(float)
    weight, terms = head[-1], got.drop(index=HEAD)
    ge = np.zeros_like(p.e)
    ge[terms.index.to_numpy(np.int64)] = terms[cols[:dim]].to_numpy(float)
    grads = [ge, head[:dim], head[dim:2 * dim], head[2 * dim:2 * dim + 1]]
    return [g / weight for g in grads], head[-2] / weight


def _validate(shared, threshold, frames):
    for frame in frames:
        for part in _pieces(frame):
            sparse, y = _sparse(part), part["label"].to_numpy()
            for number, p in enumerate(shared.value, 1):
                _, logit = forward(p, *sparse, len(y))
                prob = 1 / (1 + np.exp(-np.round(logit, DECIMALS)))
                yield pd.DataFrame({"candidate": number, "label": y, "predicted_label": (prob >= threshold).astype(int)})


@dataclass
class NetworkScorer:
    """Scorer interface (D2) over a model table ``idx, term, idf, e array<double>``."""
    spec: T.TfidfSpec
    vocab: DataFrame
    u: list[float]
    b: list[float]
    c: float

    def save(self, path: str) -> None:
        """The model table as Parquet, everything else as JSON."""
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        head = json.dumps({"spec": dict(self.spec.__dict__, stop_words=list(self.spec.stop_words)),
                           "u": self.u, "b": self.b, "c": self.c})
        self.vocab.sparkSession.createDataFrame([(head,)], "head string").write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NetworkScorer":
        head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
        spec = T.TfidfSpec(**dict(head["spec"], stop_words=tuple(head["spec"]["stop_words"])))
        return NetworkScorer(spec, spark.read.parquet(f"{path}/vocab"), head["u"], head["b"], head["c"])

    def _terms(self, base: DataFrame, text_col: str, id_col: str) -> DataFrame:
        # a term's vector joins its counted row: as a key it would be grouped and sorted for every word
        v = self.vocab.select("term", "idx", "idf")
        x = T.features(base.select(id_col, text_col), v, self.spec, text_col, id_col)
        return x.join(F.broadcast(self.vocab.select("idx", "e")), "idx").select(*x.columns, "e")

    def _hidden(self, pooled):
        return [F.tanh(F.coalesce(s, F.lit(0.0)) + F.lit(b)) for s, b in zip(pooled, self.b, strict=True)]

    def _logit(self, hidden):
        return F.round(reduce(add, (h * F.lit(u) for h, u in zip(hidden, self.u, strict=True))) + F.lit(self.c), DECIMALS)

    def score(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id",
              partitioned: bool = False) -> DataFrame:
        """``df`` + ``logit`` (rounded to 6 places) + ``prob_harmful``."""
        base = df if partitioned else T.by_id(df, id_col)
        pooled = [f"_p{k}" for k in range(len(self.b))]
        sums = self._terms(base, text_col, id_col).groupBy(id_col).agg(
            *(F.sum(F.col("weight") * F.get("e", F.lit(k))).alias(c) for k, c in enumerate(pooled)))
        out = base.join(sums, id_col, "left").withColumn("logit", self._logit(self._hidden([F.col(c) for c in pooled])))
        return out.withColumn("prob_harmful", sigmoid("logit")).drop(*pooled)

    def contributions(self, df: DataFrame, text_col: str = "prompt", id_col: str = "prompt_id") -> DataFrame:
        """``(id, idx, term, tf, x, coef, contribution, logit)`` per known term. ``coef``
        is the slope of the logit in ``x``, ``contribution`` gradient x input: it is
        what the gradient at the term's vector gives along that vector."""
        x = self._terms(df, text_col, id_col).withColumnRenamed("weight", "x")
        doc = Window.partitionBy(id_col)
        hidden = [f"_h{k}" for k in range(len(self.b))]
        pooled = [F.sum(F.col("x") * F.get("e", F.lit(k))).over(doc) for k in range(len(self.b))]
        x = x.withColumns(dict(zip(hidden, self._hidden(pooled), strict=True)))
        slope = reduce(add, (F.lit(u) * (F.lit(1.0) - F.col(h) * F.col(h)) * F.get("e", F.lit(k))
                             for k, (h, u) in enumerate(zip(hidden, self.u, strict=True))))
        x = x.withColumn("coef", slope).withColumn("logit", self._logit([F.col(h) for h in hidden]))
        return x.withColumn("contribution", F.col("coef") * F.col("x")).drop("e", *hidden)


@dataclass
class Trained:
    """The kept scorer, its epoch, the validation table and the training loss of every epoch."""
    scorer: NetworkScorer
    epoch: int
    candidates: DataFrame
    losses: list[float]


def scorer_of(p: Params, vocab: DataFrame, spec: T.TfidfSpec) -> NetworkScorer:
    """A scorer from weights; the model table is written once."""
    ensure_checkpoint_dir(vocab.sparkSession)
    table = vocab.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(p.e)], "idx int, e array<double>")
    model = vocab.select("idx", "term", "idf").join(F.broadcast(table), "idx").checkpoint(eager=True)
    return NetworkScorer(spec, model, p.u.tolist(), p.b.tolist(), float(p.c[0]))


def train(rows: DataFrame, terms: int, how: TrainSpec, id_col: str = "prompt_id") -> tuple[list[Params], list[float]]:
    """The weights after every epoch and each epoch's mean loss, from ``rows``
    ``(id, label, w, idx, x)``. The rows are written once, by batch."""
    spark = rows.sparkSession
    path = io.scratch_dir(spark, "network-rows")
    batch = F.pmod(F.xxhash64(F.lit(how.seed), F.col(id_col).cast("string")), F.lit(how.batches)).cast("int")
    rows.withColumn("batch", batch).write.mode("overwrite").partitionBy("batch").parquet(path)
    stored = spark.read.schema("label int, w double, idx array<int>, x array<double>, batch int").parquet(path)
    p = Params.start(terms, how.dim, how.seed)
    adam, kept, losses = Adam(p, how.rate), [], []
    for _ in range(how.epochs):
        seen = []
        for number in range(how.batches):
            done = _step(spark, stored.filter(F.col("batch") == number), p)
            if done:
                adam.step(done[0])
                seen.append(done[1])
        kept.append(p.copy())
        losses.append(float(np.mean(seen)))
    return kept, losses


def fit(train_rows: DataFrame, val_rows: DataFrame, spec: T.TfidfSpec | None = None, how: TrainSpec | None = None,
        vocab: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "prompt_id") -> Trained:
    """Train on ``train_rows`` (id, prompt, label) and keep the epoch with the best
    validation F1. ``vocab`` (idx, term, idf) may be that of another model over the same rows."""
    spec, how = spec or T.TfidfSpec(), how or TrainSpec()
    spark = train_rows.sparkSession
    ensure_checkpoint_dir(spark)
    labelled = train_rows.filter(F.col("label").isNotNull())
    classes = {r["label"]: r["weight"] for r in linear.class_weights(labelled).collect()}
    if set(classes) != {0, 1}:
        raise ValueError("fit needs training rows of both classes")
    if vocab is None:
        stats = linear.train_term_stats(labelled, spec)
        vocab = T.vocabulary_from_stats(stats, linear.class_counts(labelled)[0], spec).checkpoint(eager=True)
    weight = F.when(F.col("label") == 1, classes[1]).otherwise(classes[0]) if how.balanced else F.lit(1.0)
    rows = sparse_rows(labelled, vocab, spec, ("label",), id_col=id_col).withColumn("w", weight.cast("double"))
    kept, losses = train(rows.withColumn("label", F.col("label").cast("int")), vocab.count(), how, id_col)

    shared = spark.sparkContext.broadcast(kept)
    val = sparse_rows(val_rows.filter(F.col("label").isNotNull()), vocab, spec, ("label",), id_col=id_col)
    scored = val.select("label", "idx", "x").mapInPandas(partial(_validate, shared, threshold),
                                                         "candidate int, label int, predicted_label int")
    per = metrics.prf(scored, by=["candidate"]).checkpoint(eager=True)
    shared.unpersist()
    chosen = metrics.best_candidate(per).first()
    epoch = int(chosen["candidate"]) if chosen else len(kept)
    table = (per.withColumnRenamed("candidate", "epoch").withColumn("best", F.col("epoch") == epoch)
             .withColumn("train_loss", F.element_at(F.array(*map(F.lit, losses)), F.col("epoch"))).orderBy("epoch"))
    return Trained(scorer_of(kept[epoch - 1], vocab, spec), epoch, table, losses)
