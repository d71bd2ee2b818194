"""Helpers shared by the operators: shared-folder tables, word batches, 64-bit hashes.

Words are always cut from the UTF-8 bytes of the whole text, with only A-Z
lower-cased, so Spark, DuckDB and numpy agree on them.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20       # text a Python worker holds in numpy arrays at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- tables ----
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, and survives lost executors. The table lives until
    :func:`discard`, or until the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
    out._llm_path = path
    if not _left:
        atexit.register(_sweep)
    _left.add(path)
    return out


_left: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    """When the driver ends, delete the tables that are still there: plans of
    this application may read them until then, nobody does later."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _left:
        _delete(spark, _left.pop())


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_llm_path", None):
            _delete(t.sparkSession, path)
            _left.discard(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in any case (Spark tells
    columns apart by case-insensitive names)."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


CARRIED = "carried_columns"


def apart(docs: DataFrame, used: dict[str, str], work: Callable[[DataFrame], DataFrame], added: tuple = (),
          also: dict | None = None) -> DataFrame:
    """``work`` on the columns ``used`` (by the names it knows them by, to names of
    ``docs``) and on the expressions ``also``. All other columns are packed into one
    struct and come back untouched, whatever they are called; of two columns of
    one name, in any case, the one of ``added`` stays."""
    taken = {a.lower() for a in added}
    mine = {user: inner for inner, user in used.items()}
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in mine and c.lower() not in taken}
    packed = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in rest.items())) if rest else F.struct(F.lit(0).alias("none"))
    out = work(docs.select(*(F.col(f"`{user}`").alias(inner) for inner, user in used.items()),
                           *(e.alias(n) for n, e in (also or {}).items()), packed.alias(CARRIED)))
    back = [F.col(mine[c] if c in mine else f"{CARRIED}.{rest[c]}").alias(c) for c in docs.columns
            if (c in rest or c in mine and mine[c] in out.columns) and c.lower() not in taken]
    return out.select(*back, *added)


def total_vectors(parts: DataFrame, column: str, dtype, size: int, fan_in: int = 8, add=np.add,
                  unpack: Callable = bytes) -> np.ndarray:
    """Sum (or unite by another ``add``) the equally long binary vectors of
    ``parts`` (one row per task, after ``unpack``): first in ``fan_in`` tasks,
    one vector at a time, then the few results here."""
    dtype = np.dtype(dtype)

    def some(batches):
        acc = np.zeros(size, dtype)
        for rb in batches:
            for v in rb.column(0):
                if v.is_valid:
                    add(acc, np.frombuffer(unpack(v.as_py()), dtype), out=acc)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(acc.tobytes(), 1)], pa.binary())], [column])

    acc = np.zeros(size, dtype)
    for row in parts.select(column).repartition(fan_in).mapInArrow(some, f"{column} binary").toLocalIterator():
        add(acc, np.frombuffer(zlib.decompress(row[0]), dtype), out=acc)
    return acc


# ------------------------------------------------------- SQL expressions ----
def lower_ascii(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_array(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none), A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def id_crc(col) -> F.Column:
    """crc32 of an id as text; null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


# ------------------------------------------------------------ word batches ----
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RATIO = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """RATIO**0 ... RATIO**(n-1) modulo 2**64."""
    global _powers
    if n > len(_powers):
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, RATIO, np.uint64))])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each 64-bit value."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def split_words(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Words:
    """The words of some texts as arrays: ``buf`` (bytes, one space after each
    word), ``start``/``end`` of each word in it, ``doc`` offsets of each text."""

    def __init__(self, texts, split: Callable = split_words):
        parts, counts = [], []
        for t in texts:
            w = split(t)
            counts.append(len(w))
            if w:
                parts.append(b" ".join(w))
        joined = b" ".join(parts) + b" " if parts else b""
        self.raw = joined
        self.buf = np.frombuffer(joined, np.uint8)
        self.end = np.flatnonzero(self.buf == 32)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else np.zeros(0, np.int64)
        self.doc = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) if counts else np.zeros(1, np.int64)
        self.counts = np.asarray(counts, np.int64)

    def __len__(self):
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self)
        if not n:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        pos = np.arange(len(self.buf), dtype=np.int64) - np.repeat(self.start, length + 1)
        with np.errstate(over="ignore"):
            code = BYTE_CODE[self.buf] * powers(int(length.max()) + 1)[pos]
            code[self.end] = 0
            return mix(np.add.reduceat(code, self.start))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (texts are not told apart)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g = g * RATIO + h[k:len(h) - n + 1 + k]
        return mix(g + np.uint64(n))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text (one text at least)."""
    for rb in batches:
        col = rb.column(rb.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64) + 16
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, rb.num_rows], strict=True):
            if b > a:
                yield rb.slice(int(a), int(b - a))


def column(rb: pa.RecordBatch, name: str) -> pa.Array:
    return rb.column(rb.schema.get_field_index(name))


def batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()],
                                      list(cols))
