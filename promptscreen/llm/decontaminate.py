"""Benchmark decontamination with a broadcast hash set of test n-grams.

A benchmark window is 13 consecutive normalised words of an item (the whole
item if it has fewer). The windows' 64-bit hashes are broadcast; every document
window is looked up by hash, each hash hit is verified on the words themselves,
and the words inside verified windows count as hit.

The hash set is broadcast only in blocks of ``BLOCK_WINDOWS`` windows. A larger
benchmark is scanned block by block, and the hit positions of a document are
united afterwards, so no benchmark is too large and no window is dropped.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; repeated items and documents count each; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import Words, apart, batch, column, ngrams, store, text_chunks, without

WINDOW = 13
BLOCK_WINDOWS = 1 << 20                 # windows broadcast at a time (about 150 MB in a worker at most)
SHARE = 20                              # contaminated: SHARE * n_hit >= n_words
_MAP = bytearray(b" " * 256)            # digits, letters and all non-ASCII bytes stay; A-Z become lower case
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _MAP[_b] = _b
for _b in range(0x41, 0x5B):
    _MAP[_b] = _b + 32
_MAP = bytes(_MAP)


def plain_words(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """``(item string, words int, gram binary)``: the distinct windows of every item."""
    def cut(batches):
        for rb in batches:
            ids, n_words, grams = [], [], []
            for i, t in zip(column(rb, "item").to_pylist(), column(rb, "text").to_pylist(), strict=True):
                w = plain_words(t)
                k = min(n, len(w))
                for g in {b" ".join(w[a:a + k]) for a in range(len(w) - k + 1)} if w else ():
                    ids.append(i), n_words.append(k), grams.append(g)
            yield batch(item=pa.array(ids, pa.string()), words=pa.array(n_words, pa.int32()), gram=pa.array(grams, pa.binary()))

    src = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return src.mapInArrow(cut, "item string, words int, gram binary").distinct()


HITS = T.StructType([T.StructField("n_words", T.LongType()),
                     T.StructField("hit", T.ArrayType(T.ArrayType(T.LongType()))),
                     T.StructField("items", T.ArrayType(T.StringType()))])


class GramSet:
    """Windows grouped by length: sorted hashes, and the words and items behind each."""

    def __init__(self, rows):
        by_len: dict[int, dict[bytes, list]] = {}
        for item, words, gram in rows:
            by_len.setdefault(words, {}).setdefault(bytes(gram), []).append(item)
        self.by_len = {}
        for k, grams in by_len.items():
            hashed: dict[int, dict] = {}
            for g, items in grams.items():
                hashed.setdefault(int(ngrams(Words([g.decode("utf-8", "surrogatepass")], plain_words).hashes(), k)[0]), {})[g] = items
            self.by_len[k] = (np.array(sorted(hashed), np.uint64), hashed)

    def find(self, texts):
        """Per text: word count, merged hit intervals [from, to) in words, items."""
        w = Words(texts, plain_words)
        h, doc = w.hashes(), w.doc
        spans, items = [[] for _ in texts], [set() for _ in texts]
        for k, (keys, hashed) in self.by_len.items():
            g = ngrams(h, k)
            if not len(g):
                continue
            near = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for at in np.flatnonzero(keys[near] == g):
                d = int(np.searchsorted(doc, at, "right")) - 1
                if at + k > doc[d + 1]:
                    continue                                        # runs over the end of the text
                found = hashed[int(g[at])].get(w.raw[w.start[at]:w.end[at + k - 1]])
                if found is not None:                               # the words are the same, not only the hash
                    spans[d].append((int(at - doc[d]), int(at - doc[d]) + k))
                    items[d].update(found)
        return w.counts.tolist(), [merged(s) for s in spans], [sorted(i for i in s if i is not None) for s in items]


def merged(spans) -> list[list[int]]:
    """Union of half-open intervals, sorted."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(grams: DataFrame):
    """The windows in blocks of a broadcastable size, dealt by hash."""
    n = max(1, -(-grams.count() // BLOCK_WINDOWS))
    for i in range(n):
        yield [tuple(r) for r in grams.filter(F.pmod(F.xxhash64("gram"), F.lit(n)) == i).collect()]


_held: dict[str, GramSet] = {}          # the block a Python worker is at


def _look(shared, name: str, text: str, batches):
    """Find the windows of one block, and unite them with what is in ``decon``."""
    if name not in _held:
        _held.clear()
        _held[name] = GramSet(shared.value)
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
    for rb in text_chunks(batches, text):
        found = []
        for old, n, hit, items in zip(column(rb, "decon").to_pylist(), *_held[name].find(column(rb, text).to_pylist()), strict=True):
            if old is not None:
                hit, items = merged([*hit, *old["hit"]]), sorted({*items, *old["items"]})
            found.append({"n_words": n, "hit": hit, "items": items})
        cols = [pa.array(found, kind) if c == "decon" else column(rb, c) for c in rb.schema.names]
        yield pa.RecordBatch.from_arrays(cols, rb.schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``decon``: a struct of ``n_words``,
    ``hit`` (word intervals [from, to)) and ``items``. A column of that name, in
    any case, is replaced."""
    out = without(docs, "decon").select("*", F.lit(None).cast(HITS).alias("decon"))
    for rows in _blocks(store(windows(benchmark), "decon-windows")):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        out = out.mapInArrow(partial(_look, shared, uuid.uuid4().hex, text), out.schema)
    return out


def hit_words(decon) -> F.Column:
    return F.coalesce(F.aggregate(decon["hit"], F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0]), F.lit(0).cast("bigint"))


def is_contaminated(decon) -> F.Column:
    return (hit_words(decon) > 0) & (hit_words(decon) * SHARE >= decon["n_words"])


def without_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents. All columns stay, whatever
    they are called."""
    return apart(docs, {"text": text}, lambda d: scan(d, benchmark).filter(~is_contaminated(F.col("decon"))).drop("decon"))


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every hit span cut out of the text, from its first word to
    its last (what stands between words outside spans stays). All columns stay,
    whatever they are called."""
    return apart(docs, {"text": text}, lambda d: _cut(d, benchmark))


def _cut(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    def cut(batches):
        for rb in batches:
            texts = []
            for t, d in zip(column(rb, text).to_pylist(), column(rb, "decon").to_pylist(), strict=True):
                if d["hit"]:
                    raw = t.encode("utf-8", "surrogatepass")
                    line = np.frombuffer(raw.translate(_MAP), np.uint8) != 32
                    edge = np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))
                    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    at, keep = 0, []
                    for a, b in d["hit"]:
                        keep.append(raw[at:start[a]])
                        at = end[b - 1]
                    t = b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if n == text else column(rb, n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = docs.columns
    return scan(docs, benchmark, text).mapInArrow(cut, docs.schema)


def items_digest(decon) -> F.Column:
    """sha256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(decon["items"])), 256)
