"""MinHash fingerprints of whole texts, and near duplicates by signature bands.

A text's set holds its 5-word shingles (64-bit hashes of words; a text of fewer
words is one shingle). ``PERMUTATIONS`` universal hash permutations
``a * x + b`` modulo 2**64 with odd ``a`` are applied to all shingles of a chunk
of texts at once; the smallest value of each permutation, mixed down to 16 bits,
makes the signature. The share of equal places estimates the Jaccard similarity
(false agreement of a place: 2**-16).

* :func:`fingerprinted` adds the signature as text (four hex digits a place).
* :func:`against_next` compares each document with a text and an order given:
  rows are dealt into ranges of the id, with the first row of each range repeated
  at the end of the range before, so every text meets its successor in one task
  and moves once.
* :func:`near_duplicates` joins signature bands in Spark (``BANDS`` bands of four
  places: of pairs at the threshold 0.75 all but 5 in a million share one),
  verifies the Jaccard similarity on exact shingle sets and returns components.
  Classes of equal texts are compared once; see :mod:`near` for how groups of
  any size are gone through with output linear in their members.

Defined results: null and empty texts (no words) have the signature of the empty
set, which is equal to itself alone, and link with nothing; equal texts have
equal signatures; null ids (and the smallest bigint) come last in descending order, rows of equal ids by
hash of their text; a single row is its own successor; empty tables give empty
tables. Columns named like an added one (in any case) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import Words, batch, column, mix, ngrams, split_words, store, text_chunks, without
from promptscreen.llm.near import SHINGLE, class_number, components, exact_links, leaders, shared_keys, united

PERMUTATIONS, BANDS = 128, 32
RANGE_BYTES = 256 << 20     # text of one range of ids
LEAST = 0.5                 # agreement below which a pair in a band is not verified (at 0.75: 1 in 10**9)
_rng = np.random.Generator(np.random.PCG64(11))
FACTOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64, endpoint=False)


# --------------------------------------------------------------- signatures ----
def shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (repeats stay) and the offsets of each text."""
    w = Words(texts, split_words)
    h = w.hashes()
    g = ngrams(h, SHINGLE)
    full = np.maximum(w.counts - SHINGLE + 1, 0)
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    sizes = full.copy()
    sizes[short] = 1
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(int(off[-1]), np.uint64)
    place = np.repeat(w.doc[:-1] - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
    long = np.repeat(full > 0, sizes)
    out[long] = g[place]
    for i in short:
        a, b = int(w.doc[i]), int(w.doc[i + 1])
        out[off[i]] = ngrams(h[a:b], b - a)[0]
    return out, off


def signatures(texts) -> np.ndarray:
    """Signature of each text: ``PERMUTATIONS`` places of 16 bits."""
    x, off = shingles(texts)
    some = np.flatnonzero(np.diff(off) > 0)
    low = np.full((PERMUTATIONS, len(off) - 1), np.iinfo(np.uint64).max, np.uint64)
    if len(some):
        value = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(PERMUTATIONS):
                np.multiply(x, FACTOR[k], out=value)
                value += OFFSET[k]
                low[k, some] = np.minimum.reduceat(value, off[some])
    return np.ascontiguousarray((mix(low) >> np.uint64(48)).astype(np.uint16).T)


def as_hex(signs: np.ndarray) -> list[str]:
    raw = signs.astype(">u2").tobytes().hex()
    size = 4 * PERMUTATIONS
    return [raw[k:k + size] for k in range(0, len(raw), size)]


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of signatures, row by row."""
    return (a == b).mean(1)


def of_hex(values) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(values)), ">u2").reshape(-1, PERMUTATIONS)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated Jaccard similarity of two fingerprints (null if one is null)."""
    out = np.full(len(a), np.nan)
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    if len(both):
        out[both] = agreement(of_hex(a.iloc[both]), of_hex(b.iloc[both]))
    return pd.Series(out)


def fingerprinted(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text, in hex digits."""
    keep = without(docs, into).columns

    def sign(batches):
        for rb in text_chunks(batches, text):
            found = as_hex(signatures(column(rb, text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), pa.array(found, pa.string())], [*keep, into])

    src = without(docs, into)
    return src.mapInArrow(sign, T.StructType([*src.schema.fields, T.StructField(into, T.StringType())]))


# ---------------------------------------------------------- successor in order ----
def _bounds(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Smallest (at, tie) of each of ``parts`` ranges of about equal rows."""
    low = F.min(F.struct("at", "tie")).alias("low")
    dealt = keys.repartitionByRange(parts, "at", "tie").groupBy(F.spark_partition_id().alias("part")).agg(low)
    return sorted((r["low"]["at"], r["low"]["tie"]) for r in dealt.collect())


def range_of(bounds: list[tuple[int, int]], at: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of the range that each (at, tie) lies in."""
    first = np.array([b[0] for b in bounds], np.int64)
    out = np.searchsorted(first, at, "right") - 1
    several = np.flatnonzero(np.searchsorted(first, at, "left") < out + 1)      # ranges that start at this very value
    for v in np.unique(at[several]):
        rows = several[at[several] == v]
        a, b = np.searchsorted(first, v, "left"), np.searchsorted(first, v, "right")
        out[rows] = a + np.searchsorted(np.array([x[1] for x in bounds[a:b]], np.int64), tie[rows], "right") - 1
    return np.maximum(out, 0)


def with_successor(docs: DataFrame, make: Callable, schema: T.StructType, text: str = "text", doc_id: str = "doc_id",
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``make(ids, texts)`` over runs of rows by descending id, each run followed
    by the successor of its last row (the last row of all by the first); it gives
    the columns of ``schema`` for all but the last text of a run."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.col(f"`{doc_id}`").cast("bigint")
    rows = docs.select(ident.alias("id"), t.alias("t"), F.coalesce(F.bitwise_not(ident), F.lit(2**63 - 1)).alias("at"), F.xxhash64(t).alias("tie"))
    keys = store(rows.select("at", "tie", F.octet_length("t").cast("bigint").alias("size")), "ids")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bytes_ = keys.agg(F.sum("size")).first()[0]
    if bytes_ is None:
        return spark.createDataFrame([], schema)
    bounds = _bounds(keys, max(4 * tasks, -(-bytes_ // range_bytes)))
    parts = len(bounds)

    @F.pandas_udf(T.LongType())
    def dealt(at: pd.Series, tie: pd.Series) -> pd.Series:
        """Twice the range, plus 1 for the first key of a range."""
        at, tie = at.to_numpy(), tie.to_numpy()
        part = range_of(bounds, at, tie)
        first = np.array(bounds, np.int64)[part]
        return pd.Series(2 * part + ((first[:, 0] == at) & (first[:, 1] == tie)))

    rows = rows.withColumn("dealt", dealt("at", "tie"))
    part, leads = F.shiftright("dealt", 1), F.col("dealt") % 2 == 1
    # a row of its range (0), and of the range before that it follows (1)
    own = F.struct(part.alias("part"), F.lit(0).alias("after"))
    follows = F.struct(F.pmod(part - 1, F.lit(parts)).alias("part"), F.lit(1).alias("after"))
    both = F.when(leads, F.array(own, follows)).otherwise(F.array(own))
    rows = rows.withColumn("where", F.explode(both)).select("id", "t", "at", "tie", "where.part", "where.after")
    sorted_ = rows.repartition(max(tasks, -(-parts // 4)), "part").sortWithinPartitions("part", "after", "at", "tie")
    return sorted_.select("id", "t", "part", "after").mapInArrow(partial(_runs, make, schema.names), schema)


def _runs(make, names, batches):
    """Cut sorted rows into runs of a range (chunk by chunk, each chunk led on by
    the first row of the next) and compute their columns."""
    held = None                                     # last row of the chunk before: (part, after, id, text)
    for rb in text_chunks(batches, "t"):
        rows = list(zip(*(column(rb, c).to_pylist() for c in ("part", "after", "id", "t")), strict=True))
        if held is not None:
            rows.insert(0, held)
        run: list = []
        for r in rows:
            if run and run[-1][0] != r[0]:          # another range: what the last row waited for has come already
                run = []
            if run and run[-1][1] == 1:             # more copies of the following row
                continue
            run.append(r)
            if r[1] == 1 and len(run) > 1:
                yield _made(make, names, run)
        if run and run[-1][1] == 0:
            if len(run) > 1:
                yield _made(make, names, run)
            held = run[-1]
        else:
            held = run[-1] if run else None


def _made(make, names, run):
    cols = make([r[2] for r in run], [r[3] for r in run])
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


AGAINST_NEXT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
                             *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                             T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the other."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _against(ids, texts):
    edited = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = signatures(texts), signatures(edited)
    return (pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array(as_hex(own[:-1]), pa.string()),
            pa.array(as_hex(other), pa.string()), pa.array(agreement(own[:-1], other)), pa.array(agreement(own[:-1], own[1:])))


def against_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited text (:func:`edit` with the text
    of the next smaller id), and how alike they and the next text's are."""
    return with_successor(docs, _against, AGAINST_NEXT, text, doc_id, range_bytes)


# ----------------------------------------------------------- near duplicates ----
def _classes(batches):
    """Class, set size and, for the first of its class in this task, signature."""
    seen: set = set()
    for rb in text_chunks(batches, "t"):
        words = [split_words(t) for t in column(rb, "t").to_pylist()]
        number = [class_number(b" ".join(w)) for w in words]
        fresh = [i for i, c in enumerate(number) if words[i] and not (c in seen or seen.add(c))]
        signs: list = [None] * len(words)
        sizes: list = [None if w else 0 for w in words]
        made = [b" ".join(words[i]).decode() for i in fresh]
        x, off = shingles(made)
        for k, (i, s) in enumerate(zip(fresh, signatures(made), strict=True)):
            signs[i], sizes[i] = s.tobytes(), len(np.unique(x[off[k]:off[k + 1]]))
        yield batch(doc=column(rb, "i"), cls=pa.array(number, pa.int64()), n=pa.array(sizes, pa.int64()), sign=pa.array(signs, pa.binary()))


def _bands(batches):
    """Keys of the bands of each signature."""
    for rb in batches:
        signs = column(rb, "sign").to_pylist()
        if not signs:
            continue
        places = np.frombuffer(b"".join(signs), np.uint16).reshape(len(signs), BANDS, -1).astype(np.uint64)
        key = np.zeros(places.shape[:2], np.uint64)
        for k in range(places.shape[2]):
            key = (key << np.uint64(16)) | places[:, :, k]
        with np.errstate(over="ignore"):
            key = mix(key + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
        yield batch(key=pa.array(key.ravel().view(np.int64)), cls=pa.array(np.repeat(column(rb, "cls").to_numpy(), BANDS)),
                    n=pa.array(np.repeat(column(rb, "n").to_numpy(), BANDS).astype(np.int32)))


def alike(rows, can: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``can``, those that a link with row ``j`` is likely for, and how alike."""
    signs = rows.cache("signs", lambda: np.frombuffer(b"".join(rows.sign), np.uint16).reshape(-1, PERMUTATIONS))
    share = (signs[can] == signs[j]).mean(1)
    return can[share >= LEAST], share[share >= LEAST]


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, label, component_id)``, one row per row of ``docs``:
    documents linked through pairs that share a band and whose exact Jaccard
    similarity is 0.75 at least. ``label`` tells components apart (null for
    empty texts), ``component_id`` is the smallest id of the component."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    signed = store(texts.mapInArrow(_classes, "doc long, cls long, n long, sign binary"), "signed")
    classes = store(signed.filter("n is null or n > 0").groupBy("cls").agg(F.min("doc").alias("doc"), F.max("n").alias("n"),
                                                                           F.first("sign", ignorenulls=True).alias("sign")), "classes")
    runs = shared_keys(classes.select("cls", "n", "sign").mapInArrow(_bands, "key long, cls long, n int"))
    links = exact_links(leaders(runs), classes, texts)
    comp = store(components(links), "components")
    more = united(runs, comp, classes.select("cls", "sign"), classes, texts, alike)
    if not more.isEmpty():
        comp = store(components(links.unionByName(more)), "components")
    ids = classes.select("cls", "doc", F.col("n").alias("size")).join(comp.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = ids.groupBy("label").agg(F.min("doc").alias("component_id"))
    out = signed.select("doc", "cls").join(ids.select("cls", "label", "size").join(names, "label"), "cls", "left")
    empty = F.col("label").isNull()
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("size", F.lit(0)).alias("n_shingles"), "label",
                      F.when(empty, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
