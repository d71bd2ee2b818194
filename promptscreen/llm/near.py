"""N-gram Jaccard join of whole texts.

A text's set holds its distinct 5-word shingles (64-bit hashes); a text of
fewer words is one shingle, an empty text links with nothing. Two texts link
when ``100 * |intersection| >= 75 * |union|``.

Method: texts with the same words form one class, and only class
representatives are compared. Shingles get one global order, rare before
frequent by a count sketch whose size follows from the table's. Two linked sets
must share a shingle among the first quarter of each (the pigeonhole bound of
the threshold), and their sizes lie in one band or two neighbouring ones (bands
grow by 4/3). So the join's tiles are: one such shingle and one band, holding
the members of that band and of the next; a tile of more than ``TILE`` members
is cut into pairs of blocks by a hash of the class. Inside a tile, hashed bitmap
signatures are compared by bit counts, which bound the overlap from above; pairs
that pass get the exact intersection of their sorted shingle arrays.

Only components are wanted, so a tile does not compare all its pairs. First
each class is compared with one partner (the member that leads most of its
tiles), and what links is joined. Then tiles that still hold different
components are gone through: each class outside the tile's main component is
compared with the member most like it by bitmap, and the smallest. Last, the
members of tiles that the bitmaps still allow a partner in another component
meet again with their sorted arrays: every such pair is intersected exactly and
united at once, so a tile gives at most one link less than it has members.
Nothing is capped: every pair that could still join two components is tested.
Components come from min-label propagation with pointer jumping, as Spark joins.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.llm.common import (Words, apart, batch, column, discard, mix, ngrams, split_words, store, text_chunks,
                                     total_vectors)

SHINGLE = 5
# Powers of two: fewest and most counters of the frequency sketch (4 bytes each; one for 1024
# bytes of text), and bits of the membership filter (16 an id). Both are broadcast: 64 MB each at
# most. Beyond, more shingles share a counter and more texts pass the filter: results stay exact,
# tiles grow.
SKETCH_BITS = (21, 24)
FILTER_BITS = (20, 29)
BAND = np.log(4 / 3)        # sizes of linked sets differ by this factor at most


# ------------------------------------------------------------------ shingles ----
def class_number(words: bytes) -> int:
    """64-bit number of a text's words, joined by single spaces."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sorted distinct shingle hashes of all texts, the offsets of each text,
    and a 64-bit class number of each text's word sequence."""
    w = Words(texts, split_words)
    h, parts, classes = w.hashes(), [], []
    g = ngrams(h, SHINGLE)
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            s = np.unique(g[a:b - SHINGLE + 1])
        else:
            s = ngrams(h[a:b], n) if n else np.zeros(0, np.uint64)
        parts.append(s)
        classes.append(class_number(w.raw[w.start[a]:w.end[b - 1]] if n else b""))
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), off, classes


def prefix_length(n):
    """How many of a set's first shingles must hold one of any linked set's."""
    return n - (3 * n + 3) // 4 + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Signature of four to eight bits per shingle (half of that for long
    texts), a power of two long. Its length only sets how sharp the bound is."""
    per = 4 if len(shingles) <= 512 else 2
    bits = max(64, 1 << int(per * len(shingles) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Upper bound of the overlap: every bit of one signature that is not in
    the other stands for a shingle that is not in the other set."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y, na, nb = y, x, nb, na
    folded = np.bitwise_or.reduce(x.reshape(-1, len(y)), 0)
    return min(na - int(np.bitwise_count(folded & ~y).sum()), nb - int(np.bitwise_count(y & ~folded).sum()))


def enough(overlap, na, nb):
    return 100 * overlap >= 75 * (na + nb - overlap)


def table_bits(wanted: int, least: int, most: int) -> int:
    """Power of two of a table of about ``wanted`` places."""
    return min(max(int(wanted).bit_length(), least), most)


# ------------------------------------------------------------------- passes ----
def _signatures(log2, batches):
    """Per text: class, set size, and for the first of its class in this task
    the bitmap; at the end the task's sketch."""
    seen, sketch, slots, waiting = set(), np.zeros(1 << log2, np.uint32), [], 0
    shift = np.uint64(64 - log2)
    for rb in text_chunks(batches, "t"):
        s, off, classes = shingle_sets(column(rb, "t").to_pylist())
        maps, fresh = [], np.zeros(len(classes), bool)
        for i, c in enumerate(classes):
            fresh[i] = c not in seen
            seen.add(c)
            maps.append(bitmap(s[off[i]:off[i + 1]]) if fresh[i] and off[i + 1] > off[i] else None)
        keep = np.repeat(fresh, np.diff(off))
        slots.append((s[keep] >> shift).astype(np.int32))
        waiting += len(slots[-1])
        if waiting > 1 << log2:
            sketch += np.bincount(np.concatenate(slots), minlength=1 << log2).astype(np.uint32)
            slots, waiting = [], 0
        n = len(classes)
        yield batch(doc=column(rb, "i"), cls=pa.array(classes, pa.int64()), n=pa.array(np.diff(off), pa.int64()),
                    bits=pa.array(maps, pa.binary()), sketch=pa.nulls(n, pa.binary()))
    if slots:
        sketch += np.bincount(np.concatenate(slots), minlength=1 << log2).astype(np.uint32)
    yield batch(doc=pa.nulls(1, pa.int64()), cls=pa.nulls(1, pa.int64()), n=pa.nulls(1, pa.int64()), bits=pa.nulls(1, pa.binary()),
                sketch=pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary()))


def _postings(sketch, log2, batches):
    """The prefix shingles of the first text of each class in this task."""
    seen, shift, freq = set(), np.uint64(64 - log2), sketch.value
    for rb in text_chunks(batches, "t"):
        s, off, classes = shingle_sets(column(rb, "t").to_pylist())
        keys, cls, size = [], [], []
        for i, c in enumerate(classes):
            n = int(off[i + 1] - off[i])
            if c in seen or not n:
                continue
            seen.add(c)
            x = s[off[i]:off[i + 1]]
            p = prefix_length(n)
            f = freq[(x >> shift).astype(np.int64)]
            order = np.lexsort((x, f))[:p]
            keys.append(x[order]), cls.append(np.full(p, c)), size.append(np.full(p, n))
        if keys:
            yield batch(key=pa.array(np.concatenate(keys).view(np.int64)), cls=pa.array(np.concatenate(cls), pa.int64()),
                        n=pa.array(np.concatenate(size).astype(np.int32)))


def _shared(batches):
    """Rows sorted by (key, n, cls): drop repeats and keys of one class only;
    add the first class of the (key, size band). One row of a key is held back
    until a second class comes; a key of any length passes through in batches."""
    held = np.zeros((0, 3), np.int64)       # the only class of the last key so far
    last = None                             # (key, cls, band, leading class) of the last row, of a key with several
    for rb in batches:
        rows = np.stack([column(rb, c).to_numpy().astype(np.int64) for c in ("key", "cls", "n")], 1)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        key, cls = rows[:, 0], rows[:, 1]
        same = np.concatenate([[last is not None and last[:2] == (key[0], cls[0])], (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])])
        rows = rows[~same]
        if not len(rows):
            continue
        key, cls, n = rows.T
        new = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        many = size > 1
        goes_on = last is not None and last[0] == key[0]
        many[0] |= goes_on
        held = rows[-1:] if not many[-1] else held[:0]
        band = size_band(n)
        start = np.concatenate([[True], new[1:] | (band[1:] != band[:-1])])
        lead = cls[np.flatnonzero(start)[np.cumsum(start) - 1]]
        if goes_on and last[2] == band[0]:
            lead[:len(start) if start[1:].sum() == 0 else 1 + int(np.argmax(start[1:]))] = last[3]
        last = (int(key[-1]), int(cls[-1]), int(band[-1]), int(lead[-1])) if many[-1] else None
        out = np.repeat(many, size)
        if out.any():
            yield batch(key=pa.array(key[out]), cls=pa.array(cls[out]), n=pa.array(n[out].astype(np.int32)), lead=pa.array(lead[out]))


def size_band(n: np.ndarray) -> np.ndarray:
    """Sizes of linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / BAND).astype(np.int64)


def shared_keys(postings: DataFrame) -> DataFrame:
    """Stored ``(key, cls, n, lead)`` of the keys that several classes have."""
    return store(postings.repartition("key").sortWithinPartitions("key", "n", "cls")
                 .mapInArrow(_shared, "key long, cls long, n int, lead long"), "runs")


def leaders(runs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``: each class with the class that leads most of its runs,
    and with the smallest that leads one."""
    leads = runs.filter("cls <> lead").groupBy("cls", "lead").agg(F.count("*").alias("c")).groupBy("cls").agg(
        F.array_distinct(F.array(F.max_by("lead", F.struct(F.col("c"), -F.col("lead"))), F.min("lead"))).alias("leads"))
    lead = leads.select(F.col("cls").alias("a"), F.explode("leads").alias("b"))
    return lead.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --------------------------------------------------------------- components ----
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``links``; the label is the smallest
    node of its component. Large-star and small-star steps in turn: each node's
    neighbours are tied to its smallest one, until nothing changes. Minima are
    aggregated before the shuffle, so a hub needs no task of its own."""
    edges = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")

    def mark(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        return r[0], r[1]

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        small = store(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        discard(edges)
        edges, before = small, now
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# -------------------------------------------------------------- verification ----
def _bound(batches):
    """Keep pairs whose bitmap bound allows a link."""
    for rb in batches:
        rows = zip(*(column(rb, c).to_pylist() for c in ("xbits", "ybits", "xn", "yn")), strict=True)
        ok = [enough(min(overlap_bound(x, y, n, m), n, m), n, m) for x, y, n, m in rows]
        yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _exact(batches):
    """Keep pairs whose sorted shingle arrays overlap enough."""
    for rb in batches:
        ok = []
        for at in range(0, rb.num_rows, 128):
            part = rb.slice(at, 128)
            s, off, _ = shingle_sets(column(part, "x").to_pylist() + column(part, "y").to_pylist())
            n = part.num_rows
            ok += [linked(s[off[i]:off[i + 1]], s[off[n + i]:off[n + i + 1]]) for i in range(n)]
        yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _members(log2, batches):
    """Membership filter of ids, as packed bits."""
    bits = np.zeros(1 << log2, bool)
    for rb in batches:
        bits[_slot(column(rb, "doc").to_numpy(), log2)] = True
    yield batch(bits=pa.array([np.packbits(bits).tobytes()], pa.binary()))


def _slot(ids: np.ndarray, log2: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)


def _wanted(shared, log2, batches):
    """Class and text of the rows whose id may be wanted."""
    bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
    seen = set()
    for rb in batches:
        ids = column(rb, "i")
        may = np.asarray(ids.is_null()) | bits[_slot(ids.fill_null(0).to_numpy(zero_copy_only=False), log2)]
        rows = []
        for t in column(rb.filter(pa.array(may)), "t").to_pylist():
            if (c := class_number(b" ".join(split_words(t)))) not in seen:
                seen.add(c)
                rows.append((c, t))
        yield batch(cls=pa.array([r[0] for r in rows], pa.int64()), t=pa.array([r[1] for r in rows], pa.string()))


def texts_of(need: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Stored ``(cls, t)``: one text of each class in ``need``.
    Texts of the representatives travel (they compress, arrays do not)."""
    need = store(need.join(classes.select("cls", "doc"), "cls"), "needed")
    log2 = table_bits(need.count() * 16, *FILTER_BITS)
    bits = total_vectors(need.filter("doc is not null").select("doc").mapInArrow(partial(_members, log2), "bits binary"), "bits", np.uint8,
                         (1 << log2) // 8, add=np.bitwise_or)
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    found = texts.mapInArrow(partial(_wanted, shared, log2), "cls long, t string")
    held = store(found.join(need.select("cls"), "cls").dropDuplicates(["cls"]), "texts")
    discard(need)
    return held


def exact_links(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of classes ``(a, b)`` that link."""
    pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    held = texts_of(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), classes, texts)
    joined = (pairs.join(held.select(F.col("cls").alias("b"), F.col("t").alias("y")), "b")
              .join(held.select(F.col("cls").alias("a"), F.col("t").alias("x")), "a"))
    out = store(joined.select("a", "b", "x", "y").mapInArrow(_exact, "a long, b long"), "linked")
    discard(pairs, held)
    return out


# ------------------------------------------------------------------- tiles ----
TILE = 2048                 # members of a tile; larger ones are cut into pairs of blocks


class Members:
    """The members of a tile: class, set size, component and band flag as arrays,
    further columns as lists by their names."""

    def __init__(self, rows: list[tuple], names: list[str]):
        for k, name in enumerate(names):
            values = [r[k] for r in rows]
            setattr(self, name, np.array(values) if name in ("cls", "n", "comp", "own") else values)
        self._made: dict = {}

    def cache(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def outsiders(self) -> np.ndarray:
        """Members outside the most frequent component: one of them is in every pair."""
        values, counts = np.unique(self.comp, return_counts=True)
        return np.flatnonzero(self.comp != values[np.argmax(counts)]) if len(values) > 1 else np.zeros(0, np.int64)

    def partners(self, j: int, allowed) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components than ``j``'s that sizes and signatures
        allow a link with, and the bounds of their similarity. Two members of
        the next band are compared in that band's tile."""
        small, large = np.minimum(self.n, self.n[j]), np.maximum(self.n, self.n[j])
        can = np.flatnonzero((self.comp != self.comp[j]) & (4 * small >= 3 * large) & (self.own | self.own[j]))
        return allowed(self, can, j) if len(can) else (can, np.zeros(0))


def by_bitmap(rows: Members, can: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the members ``can`` whose bitmap allows a link with member ``j``'s."""
    def grouped():
        lengths = np.array([len(x) for x in rows.bits])
        return {int(x): (np.flatnonzero(lengths == x), np.frombuffer(b"".join(m for m in rows.bits if len(m) == x), np.uint64)
                         .reshape(int((lengths == x).sum()), -1)) for x in np.unique(lengths)}

    may = np.zeros(len(rows.n), bool)
    may[can] = True
    n, found, top = rows.n, [], []
    y0 = np.frombuffer(rows.bits[j], np.uint64)
    for i, x in rows.cache("bitmaps", grouped).values():
        here = may[i]
        if not here.any():
            continue
        i, x, y = i[here], x[here], y0
        if x.shape[1] > len(y):
            x = np.bitwise_or.reduce(x.reshape(len(x), -1, len(y)), 1)
        elif x.shape[1] < len(y):
            y = np.bitwise_or.reduce(y.reshape(-1, x.shape[1]), 0)
        most = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
        ok = enough(most, n[i], n[j])
        found.append(i[ok])
        top.append(most[ok] / (n[i[ok]] + n[j] - most[ok]))
    return (np.concatenate(found), np.concatenate(top)) if found else (can[:0], np.zeros(0))


def _per_tile(make, names: list[str], batches):
    """``make(tile, members)`` for each tile of rows sorted by tile."""
    where = ("key", "band", "tile")
    held: list = []
    current = None
    for rb in batches:
        cols = [column(rb, c).to_pylist() for c in (*where, *names)]
        for row in zip(*cols, strict=True):
            if row[:3] != current:
                if len(held) > 1:
                    yield from make(current, Members(held, names))
                held, current = [], row[:3]
            held.append(row[3:])
    if len(held) > 1:
        yield from make(current, Members(held, names))


def _best(allowed, tile, rows: Members):
    """Of each outsider the smallest and the most similar partner."""
    a, b, bound = [], [], []
    for j in rows.outsiders():
        i, s = rows.partners(j, allowed)
        if len(i):
            k = np.unique([np.lexsort((rows.cls[i], -s))[0], np.argmin(rows.cls[i])])
            a.append(np.full(len(k), rows.cls[j])), b.append(rows.cls[i[k]]), bound.append(s[k])
    if a:
        yield batch(a=pa.array(np.concatenate(a)), b=pa.array(np.concatenate(b)), bound=pa.array(np.concatenate(bound)))


def _wanting(allowed, tile, rows: Members):
    """The members that have a possible partner in another component."""
    wants = np.zeros(len(rows.n), bool)
    for j in rows.outsiders():
        i, _ = rows.partners(j, allowed)
        wants[i] = True
        wants[j] |= len(i) > 0
    k = int(wants.sum())
    if k:
        yield batch(key=pa.array([tile[0]] * k, pa.int64()), band=pa.array([tile[1]] * k, pa.int32()), tile=pa.array([tile[2]] * k, pa.int32()),
                    cls=pa.array(rows.cls[wants]), n=pa.array(rows.n[wants].astype(np.int32)), comp=pa.array(rows.comp[wants]),
                    own=pa.array(rows.own[wants]))


def _unite(allowed, tile, rows: Members):
    """Exact links that join different components, united as they are found:
    at most one less than there are members."""
    sets = rows.cache("sets", lambda: [np.frombuffer(x, np.uint64) for x in rows.shingles])
    a, b = [], []
    for j in rows.outsiders():
        i, s = rows.partners(j, allowed)
        for k in i[np.argsort(-s, kind="stable")]:
            if rows.comp[k] != rows.comp[j] and linked(sets[j], sets[k]):
                a.append(rows.cls[j]), b.append(rows.cls[k])
                rows.comp[rows.comp == rows.comp[j]] = rows.comp[k]
    if a:
        yield batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted shingle arrays overlap enough."""
    near = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return bool(enough(int((y[near] == x).sum()), len(x), len(y)))


def _sets(batches):
    for rb in text_chunks(batches, "t"):
        s, off, _ = shingle_sets(column(rb, "t").to_pylist())
        yield batch(cls=column(rb, "cls"), shingles=pa.array([s[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()))


def _one_of_equal(tiles: DataFrame, where: list[str], several: bool) -> DataFrame:
    """One of the tiles that have the same members (neighbouring shingles of one
    passage have); with ``several`` only of those that hold several components."""
    who = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    found = tiles.groupBy(*where).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g"), *who)
    if several:
        found = found.filter("lo <> hi")
    return found.groupBy("g", "x1", "x2").agg(F.min(F.struct(*where)).alias("at")).select("at.*")


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("key", "band", "tile").sortWithinPartitions("key", "band", "tile")


def open_tiles(runs: DataFrame, comp: DataFrame, payload: DataFrame) -> DataFrame:
    """Members of the tiles that hold different components, with the columns
    of ``payload``, dealt and sorted by tile."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(BAND))).cast("int")
    near = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))
    labelled = store(runs.drop("lead").join(comp.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "labelled")
    # sizes come in only where a shingle still holds several components
    members = store(labelled.join(_one_of_equal(labelled, ["key"], True), "key").withColumn("in", F.explode(near))
                    .select("key", "in.band", "cls", "n", "comp", "in.own"), "open")
    mixed = members.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("own").alias("any"),
                                               F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    mixed = mixed.filter("lo <> hi and any").select("key", "band", "blocks")
    tiles = members.join(mixed, ["key", "band"]).join(payload, "cls")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    return _dealt(tiles.withColumn("tile", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, block) * F.col("blocks") + F.greatest(x, block)))).drop("blocks"))


def united(runs: DataFrame, comp: DataFrame, payload: DataFrame, classes: DataFrame, texts: DataFrame, allowed) -> DataFrame:
    """Links ``(a, b)`` that join the components of ``comp`` as far as any pair
    in a tile does: possible pairs by ``allowed``, then exact sets."""
    names = ["cls", "n", "comp", "own"]
    more = [c for c in payload.columns if c != "cls"]
    wants = store(open_tiles(runs, comp, payload).mapInArrow(
        partial(_per_tile, partial(_wanting, allowed), [*names, *more]), "key long, band int, tile int, cls long, n int, comp long, own boolean"), "wanting")
    where = ["key", "band", "tile"]
    once = wants.join(_one_of_equal(wants, where, False), where)
    held = texts_of(wants.select("cls").distinct(), classes, texts)
    full = once.join(payload, "cls").join(held.mapInArrow(_sets, "cls long, shingles binary"), "cls")
    out = store(_dealt(full).mapInArrow(partial(_per_tile, partial(_unite, allowed), [*names, *more, "shingles"]), "a long, b long"), "united")
    discard(wants, held)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, label, component_id)``, one row per row of
    ``docs``. ``label`` tells components apart (null for empty texts);
    ``component_id`` is the smallest id of the component.

    Defined results: null and empty texts have no shingles and are their own
    component; rows with a null id take part, but cannot name a component;
    repeated rows are linked like any equal texts; an empty table gives none.
    """
    return _labelled(docs, text, doc_id).select("doc_id", "n_shingles", "label", "component_id")


def _labelled(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``near_duplicates`` with the class of each row's text, ``cls``."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    log2 = table_bits((texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) >> 10, *SKETCH_BITS)
    signed = store(texts.mapInArrow(partial(_signatures, log2), "doc long, cls long, n long, bits binary, sketch binary"), "signatures")
    sketch = total_vectors(signed.filter("sketch is not null"), "sketch", np.uint32, 1 << log2, unpack=zlib.decompress)
    rows = signed.filter("sketch is null")
    classes = store(rows.filter("n > 0").groupBy("cls").agg(F.min("doc").alias("doc"), F.max("n").alias("n"),
                                                            F.first("bits", ignorenulls=True).alias("bits")), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    del sketch
    runs = shared_keys(texts.mapInArrow(partial(_postings, shared, log2), "key long, cls long, n int"))

    # first: every class against the member that leads most of its tiles, and the smallest such member
    sides = classes.select("cls", "n", "bits")
    first = (leaders(runs).join(sides.toDF("a", "xn", "xbits"), "a").join(sides.toDF("b", "yn", "ybits"), "b")
             .select("a", "b", "xn", "yn", "xbits", "ybits").mapInArrow(_bound, "a long, b long"))
    links = exact_links(first, classes, texts)
    comp = store(components(links), "components")

    # then: every class that shares a tile with another component, against the smallest member that
    # the bitmaps allow and the one most like it
    bits = classes.select("cls", "bits")
    tiles = (open_tiles(runs, comp, bits).mapInArrow(partial(_per_tile, partial(_best, by_bitmap), ["cls", "n", "comp", "own", "bits"]),
                                                     "a long, b long, bound double")
             .groupBy("a").agg(F.array_distinct(F.array(F.max_by("b", F.struct("bound", "b")), F.min("b"))).alias("b")))
    more = exact_links(tiles.select("a", F.explode("b").alias("b")), classes, texts)
    if not more.isEmpty():
        links = store(links.unionByName(more), "found")
        comp = store(components(links), "components")
    # last: all pairs left that could join two components
    more = united(runs, comp, bits, classes, texts, by_bitmap)
    if not more.isEmpty():
        comp = store(components(links.unionByName(more)), "components")

    ids = classes.select("cls", "doc").join(comp.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = ids.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = ids.select("cls", "label").join(names, "label")
    out = rows.select("doc", "cls", "n").join(named, "cls", "left")
    empty = F.col("n") == 0
    return out.select(F.col("doc").alias("doc_id"), "cls", F.col("n").alias("n_shingles"), F.when(~empty, F.col("label")).alias("label"),
                      F.when(empty, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def _class(text: pd.Series) -> pd.Series:
    return pd.Series([class_number(b" ".join(split_words(t))) for t in text], dtype="int64")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id,
    null ids last, then by the number of its words' class and by md5 of the text.
    Rows are told by id and class, so an id repeated with another text is another
    row. Empty texts link with nothing: one row of each id stays, and all
    without an id. All columns stay, whatever they are called."""
    return apart(docs, {"text": text, "doc_id": doc_id}, _one_of_each)


def _one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    row, cls, rank = "_n_row", "_n_cls", "_n_rank"
    found = _labelled(docs, text, doc_id)
    first = (found.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cls")).alias("first"))
             .select(F.col("first.doc_id").alias(row), F.col("first.cls").alias(cls)))
    empty = found.filter("label is null").select(F.col("doc_id").alias(row), F.col("cls").alias(cls)).distinct()
    keep = first.unionByName(empty).toDF("_n_keep", "_n_keep_cls")
    mine = docs.withColumns({row: F.col(doc_id).cast("bigint"), cls: F.pandas_udf(_class, "long")(F.col(text))})
    kept = mine.join(keep, F.col(row).eqNullSafe(F.col("_n_keep")) & (F.col(cls) == F.col("_n_keep_cls")), "left_semi")
    order = Window.partitionBy(row, cls).orderBy(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    nameless = F.col(row).isNull() & (F.col(cls) == F.lit(class_number(b"")))
    one = kept.filter(~nameless).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return one.select(*docs.columns).unionByName(kept.filter(nameless).select(*docs.columns))
