"""Target-distribution importance resampling of whole documents.

Features are all runs of one to three consecutive words, told by the crc32 of
their bytes modulo ``BUCKETS``. A bucket's gain compares its share among the
target texts with its share among all documents; a document's weight is the sum
over its features. Gumbel noise from the document's id turns the ranking by
weight into a weighted draw without replacement.

Method: the weights are scored in numpy arrays. The crc32 of a run is put
together from those of its words (crc32 is linear over GF(2): appending ``k``
bytes is a table look-up), so no run is ever written out. The draw's cutoff is
bracketed by a quantile sketch of the scores; exact counts above and inside the
bracket validate it or widen it, a bracket that is still large is bracketed
again (by id among equal scores), and only the last bracket is sorted.

Defined results: null and empty texts have no words, no features and weight 0;
documents below ``min_words`` are scored but not drawn; equal scores are drawn
by smaller id, null ids last, then by hash of the text (rows equal in all three
are told apart by nothing); a null id counts as the empty text in the noise;
without target texts all gains rest on the documents' counts alone; empty
tables give empty tables. Columns named like the one added (in any case) are
replaced, all others stay.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import batch, column, discard, store, text_chunks, without

BUCKETS = 10_000
RUN = 3                     # words of the longest feature
SEED, MIN_WORDS, PERCENT = 42, 20, 5
SKETCH = 2_000              # accuracy of the quantile sketch: ranks are off by 1/SKETCH of the rows
SORT_ROWS = 100_000         # a bracket of more rows is bracketed again
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCORE = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


# -------------------------------------------------------------------- crc32 ----
def _zero_byte(c: np.ndarray) -> np.ndarray:
    """Checksums after one more zero byte, without their final inversion."""
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


@cache
def shift_tables(longest: int = 64) -> np.ndarray:
    """[k, i, b]: what byte ``i`` of value ``b`` of a checksum becomes after ``k`` more bytes."""
    t = np.zeros((longest + 1, 4, 256), np.uint32)
    t[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(longest):
        t[k + 1] = _zero_byte(t[k])
    return t


def appended(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Checksums ``c`` carried past ``k`` more bytes each; the crc32 of a
    concatenation is this, xor the crc32 of the second part."""
    t = shift_tables()
    longest = len(t) - 1
    now = np.minimum(k, longest)
    out = t[now, 0, c & 255] ^ t[now, 1, c >> 8 & 255] ^ t[now, 2, c >> 16 & 255] ^ t[now, 3, c >> 24]
    far = np.flatnonzero(k > longest)
    if len(far):
        out[far] = appended(out[far], k[far] - longest)
    return out


def features(texts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of the texts' words, and for runs of 1, 2 ... ``RUN`` words the
    bucket of the run that starts at each word (-1: it goes past its text)."""
    words, counts = [], []
    for t in texts:
        w = WORD.findall(t.encode().lower()) if t else []
        counts.append(len(w))
        words += w
    off = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
    n = len(words)
    one = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    size = np.fromiter(map(len, words), np.int64, n)
    spaced = appended(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ one      # of a space and the word
    end = np.repeat(off[1:], np.diff(off))
    at, run, out = np.arange(n), one, []
    for k in range(RUN):
        if k:
            m = max(n - k, 0)
            run = appended(run[:m], size[k:] + 1) ^ spaced[k:]
        out.append(np.where(at[:len(run)] + k < end[:len(run)], (run % np.uint32(BUCKETS)).astype(np.int64), -1))
    return off, out


# ------------------------------------------------------------------- counts ----
def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for rb in text_chunks(batches, "t"):
        for b in features(column(rb, "t").to_pylist())[1]:
            total += np.bincount(b[b >= 0], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield batch(bucket=pa.array(seen, pa.int64()), n=pa.array(total[seen], pa.int64()))


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row a bucket at most,
    and ``BUCKETS`` rows come to the driver."""
    rows = (texts.select(F.col(f"`{text}`").alias("t")).mapInArrow(_count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths of a natural logarithm, rounded down."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", into: str = "weighted") -> DataFrame:
    """``docs`` with the struct ``into``: words, features and weight of each text."""
    keep = without(docs, into).columns
    gain = np.append(gain, 0)                       # bucket -1

    def score(batches):
        for rb in text_chunks(batches, text):
            off, runs = features(column(rb, text).to_pylist())
            words = np.diff(off)
            value = np.zeros(int(off[-1]) + 1, np.int64)
            for b in runs:
                value[1:len(b) + 1] += gain[b]
            value = np.cumsum(value)
            several = sum(np.maximum(words - k, 0) for k in range(RUN))
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, several, value[off[1:]] - value[off[:-1]])], SCORE.names)
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), found], [*keep, into])

    src = docs.select(*(F.col(f"`{c}`") for c in keep))
    return src.mapInArrow(score, T.StructType([*(src.schema[c] for c in keep), T.StructField(into, SCORE)]))


def noise(doc_id, seed: int = SEED):
    """Gumbel noise of an id in thousandths, rounded down."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


# --------------------------------------------------------------------- draw ----
#: The order of a draw: ``low`` is the negated score, ``last`` puts null ids last.
ORDER = ("low", "last", "id", "tie")


def order_of(weight, doc_id, text, seed: int = SEED) -> list[F.Column]:
    """The values of ``ORDER`` for a document."""
    return [-(weight + noise(doc_id, seed)), doc_id.isNull().cast("bigint"), F.coalesce(doc_id.cast("bigint"), F.lit(0).cast("bigint")),
            F.xxhash64(F.coalesce(text, F.lit("")))]


def before(order: list[F.Column], key: tuple):
    """Rows strictly ahead of a key."""
    out = F.lit(False)
    for c, v in reversed(list(zip(order, key, strict=True))):
        out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
    return out


def at(order: list[F.Column], key: tuple):
    out = F.lit(True)
    for c, v in zip(order, key, strict=True):
        out = out & (c == F.lit(v))
    return out


def _bracket(rows: DataFrame, of: str, k: int, n: int) -> tuple[int, int, int, int]:
    """Bounds of a bracket of the ``k``-th smallest value of a column of ``n``
    rows, with the exact counts below it and in it."""
    margin = 2.0 / SKETCH
    while True:
        p = (k - 0.5) / n
        ends = F.percentile_approx(of, F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), F.lit(2 * SKETCH))
        lo, hi = rows.agg(ends).first()[0] if margin < 1 else rows.agg(F.min(of), F.max(of)).first()
        below, inside = rows.agg(F.count_if(F.col(of) < lo), F.count_if(F.col(of).between(lo, hi))).first()
        if below < k <= below + inside:
            break
        margin *= 4
    if inside < n or lo == hi:
        return lo, hi, below, inside
    # the bracket spans all rows (a few values, the cutoff at the edge of one): cut it at a value
    pivot = rows.agg(F.percentile_approx(of, p, 2 * SKETCH)).first()[0]
    below, equal = rows.agg(F.count_if(F.col(of) < pivot), F.count_if(F.col(of) == pivot)).first()
    if k <= below:
        return lo, pivot - 1, 0, below
    if k <= below + equal:
        return pivot, pivot, below, equal
    return pivot + 1, hi, below + equal, n - below - equal


def cutoff(rows: DataFrame, k: int, sort_rows: int = SORT_ROWS) -> tuple | None:
    """Key of the ``k``-th of ``rows`` in the order of their columns ``ORDER``
    (None: no row is drawn)."""
    n = rows.count()
    if not 0 < k <= n:
        return None
    left, inside, within = k, n, rows
    for of in ORDER:
        while inside > sort_rows:
            lo, hi, below, inside = _bracket(within, of, left, inside)
            left -= below
            within = within.filter(F.col(of).between(lo, hi))
            if lo == hi:
                break
    if inside > sort_rows:                      # all of them are the same key
        return tuple(within.select(*ORDER).first())
    return tuple(within.orderBy(*ORDER).offset(left - 1).limit(1).select(*ORDER).first())


def numbered(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """``rows`` with their number in the order of ``ORDER``: rows are dealt into
    ranges and sorted there; all that is added up is the ranges' counts."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn(rank, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(rank, 33)
    sizes = sorted(map(tuple, dealt.groupBy(part.alias("part")).count().collect()))
    start = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)]).tolist()
    offsets = spark.createDataFrame([(int(p), s) for (p, _), s in zip(sizes, start[:-1], strict=True)], "part long, offset long")
    return (dealt.withColumn("part", part.cast("bigint")).join(F.broadcast(offsets), "part")
            .withColumn(rank, F.col(rank) - F.shiftleft(F.col("part"), 33) + F.col("offset") + 1).drop("part", "offset"))


def draw(rows: DataFrame, able, percent: int = PERCENT, sort_rows: int = SORT_ROWS) -> DataFrame:
    """``rows`` (a stored table with the columns ``ORDER``) with ``rank``: 1, 2 ...
    for the drawn ``percent`` of the ``able`` ones (rounded down), else null."""
    those = rows.filter(able)
    k = those.count() * percent // 100
    key = cutoff(those, k, sort_rows)
    none = F.lit(None).cast("bigint")
    if key is None:
        return rows.withColumn("rank", none)
    order = [F.col(c) for c in ORDER]
    upto = able & (before(order, key) | at(order, key))
    first = numbered(rows.filter(upto)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.filter(~upto).withColumn("rank", none).unionByName(first.select(*rows.columns, "rank"))


# ---------------------------------------------------------------- operators ----
def fitted(docs: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """Gains of all buckets, from all documents and all target texts."""
    return gains(bucket_counts(docs, text), bucket_counts(target, text))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             text: str = "text", doc_id: str = "doc_id", into: str = "weighted", sort_rows: int = SORT_ROWS) -> DataFrame:
    """The rows of ``docs`` drawn towards ``target``: ``percent`` of those with at
    least ``min_words`` words, rounded down, with the struct ``into``. Scores are
    stored without texts to find the cutoff; then the texts are scored where they
    lie and compared with it, so no text is moved."""
    found = weighted(docs, fitted(docs, target, text), text, into).filter(F.col(f"`{into}`.n_words") >= min_words)
    order = order_of(F.col(f"`{into}`.weight"), F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)
    keys = store(found.select(*(c.alias(n) for c, n in zip(order, ORDER, strict=True))), "draw-keys")
    k = keys.count() * percent // 100
    key = cutoff(keys, k, sort_rows)
    if key is None:
        discard(keys)
        return found.limit(0)
    room = k - keys.filter(before([F.col(c) for c in ORDER], key)).count()
    discard(keys)
    return found.filter(before(order, key)).unionByName(found.filter(at(order, key)).limit(room))
