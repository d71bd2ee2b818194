"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features are the 1- and 2-grams of a text's words and of the words' shapes
(runs of letters, capitals and digits collapsed, signs kept), hashed into
``2**BITS`` weights; a feature's value is its count divided by the root of the
number of words. The model is fitted by follow-the-regularised-leader updates,
one example at a time, in one task over at most ``SAMPLE`` labelled texts (the
first by the md5 of their id: a documented bound of the fit). Every whole text
is scored by a sparse dot product.

Defined results: null and empty texts have only the bias; a document with
several labels counts as good if any of them says so; without labelled rows
every score is 0.5; labels of unknown documents are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import BYTE_CODE, Words, column, mix, ngrams, powers, text_chunks, without

BITS, SAMPLE, THRESHOLD = 18, 12_000, 0.3
_SHAPE = np.arange(256, dtype=np.uint8)
for _from, _to, _as in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x41), (0x61, 0x7A, 0x61), (0x80, 0xFF, 0x61)):
    _SHAPE[_from:_to + 1] = _as


def cased_words(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shape_hashes(w: Words) -> np.ndarray:
    """Hash of each word's collapsed shape: ``The`` and ``An`` are both ``Aa``."""
    if not len(w):
        return np.zeros(0, np.uint64)
    code = _SHAPE[w.buf]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    new[w.start] = True
    seen = np.cumsum(new)
    pos = seen - np.repeat(seen[w.start], w.end - w.start + 1)
    with np.errstate(over="ignore"):
        v = np.where(new, BYTE_CODE[code] * powers(int(pos.max()) + 1)[pos], np.uint64(0))
        v[w.end] = 0
        return mix(np.add.reduceat(v, w.start) + np.uint64(77))


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts, the text of each feature, words per text.
    Feature 0 is the bias and is not listed."""
    w = Words(texts, cased_words)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.counts
    doc = w.doc_of()
    pair = doc[:-1] == doc[1:]
    ids, owner = [], []
    for salt, h in enumerate((w.hashes(), shape_hashes(w))):
        for n, (g, d) in enumerate(((mix(h), doc), (ngrams(h, 2)[pair], doc[:-1][pair]))):
            with np.errstate(over="ignore"):
                g = mix(g + np.uint64(1000 * salt + n))
            ids.append((g >> np.uint64(64 - BITS)).astype(np.int64) | 1)     # odd: 0 stays the bias's
            owner.append(d)
    return np.concatenate(ids), np.concatenate(owner), w.counts


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.5
    epochs: int = 3


def fit_texts(rows, spec: Ftrl = Ftrl()) -> np.ndarray:
    """``rows``: (text, 0/1) pairs, in the order of the updates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= spec.l1, 0.0, -(zi - np.sign(zi) * spec.l1)
                        / ((spec.beta + np.sqrt(n[i])) / spec.alpha + spec.l2))

    examples = []
    for text, y in rows:
        ids, _, count = features([text])
        i, c = np.unique(ids, return_counts=True)
        examples.append((np.concatenate([[0], i]).astype(np.int32),
                         np.concatenate([[1.0], c / np.sqrt(max(1, count[0]))]).astype(np.float32), y))
    for _ in range(spec.epochs):
        for i, x, y in examples:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / spec.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(1 << BITS))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE, spec: Ftrl = Ftrl()) -> np.ndarray:
    """Weights learned from ``docs`` (already without held-out rows) and ``labels``."""
    def train(batches):
        rows = [r for rb in batches for r in zip(column(rb, "t").to_pylist(), column(rb, "y").to_pylist(), strict=True)]
        w = fit_texts(rows, spec)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    order = F.md5(F.col("i").cast("string"))
    known = (labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).dropna().groupBy("i")
             .agg(F.max((F.col("y") > 0).cast("int")).alias("y")))
    ids = docs.select(F.col(doc_id).alias("i")).dropna().distinct()
    chosen = known.join(ids, "i", "left_semi").orderBy(order, "i").limit(sample)
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(chosen), "i")                       # at most ``sample`` rows
    rows = rows.dropDuplicates(["i"]).select("i", "t", "y")           # a repeated document teaches once
    got = (rows.repartition(1).sortWithinPartitions(order, "i").mapInArrow(train, "w binary").collect())
    return np.frombuffer(got[0][0]) if got else np.zeros(1 << BITS)


def score_texts(texts, w: np.ndarray) -> np.ndarray:
    ids, doc, count = features(texts)
    dot = np.bincount(doc, w[ids], minlength=len(count)) if len(ids) else np.zeros(len(count))
    return 1 / (1 + np.exp(-np.clip(w[0] + dot / np.sqrt(np.maximum(1, count)), -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (a column of that name, in any case, is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    keep = without(docs, "score").columns

    def look(batches):
        for rb in text_chunks(batches, text):
            p = score_texts(column(rb, text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

    src = without(docs, "score")
    return src.mapInArrow(look, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))


def predicted(score_col: Column) -> Column:
    return (score_col >= THRESHOLD).cast("int")
