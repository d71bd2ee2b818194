"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group; groups stand in the order of
their text's md5. The smallest capacity is searched for which a greedy walk
(open a shard, add groups while they fit) needs no more than the wanted number
of shards; the walk with that capacity gives the cuts.

The walk needs prefix sums over all groups, of which there may be billions. So
the order is first cut into ``2**12`` cells by md5 prefix, and only their sums
come to the driver. They bound the best capacity from both sides, and the
bounds tell which cells a cut can fall into. Only those cells are cut again by
four more bits, in Spark, until each of them is a single group. What the driver
holds is thus bounded by the number of shards, not by the number of groups, and
the result is the exact optimum over all groups.

Defined results: null texts have no bytes and equal each other and the empty
text; a group larger than the capacity cannot occur (the capacity is at least
the largest group); an empty table gives no rows; repeated rows share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.llm.common import apart, store

SHARDS, OVERHEAD = 24, 8
FIRST_DIGITS, MORE_DIGITS = 3, 2        # hex digits of the first cut, and of each further one
ADDED = ("size", "text_crc32", "shard", "slot")


def text_bytes(text) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def walk(sizes: list[int], capacity: int) -> list[int]:
    """Greedy cuts: the index of the first item of each further shard."""
    cuts, run = [], 0
    for i, s in enumerate(sizes):
        if run + s > capacity and run:
            cuts.append(i)
            run = 0
        run += s
    return cuts


def smallest_capacity(sizes: list[int], shards: int, low: int, high: int) -> int:
    """Binary search of the smallest feasible capacity in [low, high]."""
    while low < high:
        mid = (low + high) // 2
        if max(sizes, default=0) <= mid and len(walk(sizes, mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def _fluid_cuts(cells: list[tuple], capacity: int, shards: int, greedy: bool) -> list[int]:
    """Bounds of the token position of every cut: with ``greedy`` each shard
    is as full as the capacity allows; otherwise it stops one cell earlier."""
    ends, out, at = [], [], 0
    for _, size, _, _ in cells:
        at += size
        ends.append(at)
    import bisect
    start = 0
    for _ in range(shards - 1):
        limit = start + capacity
        if limit >= at:
            break
        if greedy:
            start = limit
        else:                       # the last group end at or below the limit is at or after the cell's begin,
            i = bisect.bisect_right(ends, limit)        # or exactly at the end of the cell before
            begin = ends[i - 1] if i else 0
            if begin <= start:      # the cell holds the whole shard: nothing better is known than its largest group
                begin = max(start, limit - cells[i][2])
            start = begin
        out.append(start)
    return out


def best_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """``groups``: ``key`` (32 hex digits) and ``size``, one row per group.
    Returns the capacity and, for each further shard, the key of its first group."""
    def cells_of(df, digits):
        rows = (df.groupBy(F.substring("key", 1, digits).alias("k"))
                .agg(F.sum("size"), F.max("size"), F.count("*")).collect())
        return [(r[0], int(r[1]), int(r[2]), int(r[3])) for r in rows]

    cells = sorted(cells_of(groups, FIRST_DIGITS))
    if not cells:
        return 0, []
    while True:
        sizes, total = [c[1] for c in cells], sum(c[1] for c in cells)
        low = max(max(c[2] for c in cells), -(-total // shards))
        # cells as atoms: a contiguous partition of cells is one of groups, so this is an upper bound
        high = smallest_capacity(sizes, shards, max(low, max(sizes)), total)
        single = all(c[3] == 1 for c in cells)
        # a cut lies between the slowest walk at the low capacity and the fullest walk at the high one
        slow, fast = _fluid_cuts(cells, low, shards, False), _fluid_cuts(cells, high, shards, True)
        spans = [(a, fast[i] if i < len(fast) else total) for i, a in enumerate(slow)]
        begin, open_cells = 0, []
        for c in cells:
            end = begin + c[1]
            if c[3] > 1 and any(a < end and begin <= b for a, b in spans):
                open_cells.append(c)
            begin = end
        if single or not open_cells:
            break
        wanted, digits = [c[0] for c in open_cells], {len(c[0]) for c in open_cells}
        fresh = []
        for d in sorted(digits):
            keys = [k for k in wanted if len(k) == d]
            fresh += cells_of(groups.filter(F.substring("key", 1, d).isin(keys)), d + MORE_DIGITS)
        gone = set(wanted)
        cells = sorted([c for c in cells if c[0] not in gone] + fresh)
    capacity = smallest_capacity([c[1] for c in cells], shards, low, high)
    return capacity, [cells[i][0] for i in walk([c[1] for c in cells], capacity)]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``size`` (UTF-8 bytes plus 8),
    ``text_crc32``, ``shard`` (from 0) and ``slot`` (from 0, without gaps in
    each shard, by the md5 of the id). Columns of these names, in any case, are
    replaced; all others stay, whatever they are called."""
    return apart(docs, {"text": text, "doc_id": doc_id}, lambda d: _shard(d, shards), ADDED)


def _shard(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    keep = docs.columns
    raw = text_bytes(F.col(text))
    keyed = docs.select(*keep, F.md5(raw).alias("_s_key"), (F.length(raw) + OVERHEAD).cast("bigint").alias("_s_size"),
                        F.crc32(raw).alias("_s_crc"))
    narrow = store(keyed.select(doc_id, "_s_key", "_s_size"), "shard-rows")
    groups = narrow.groupBy(F.col("_s_key").alias("key")).agg(F.sum("_s_size").alias("size"))
    _, cuts = best_cuts(store(groups, "shard-groups"), shards)

    def placed(df):
        # an order bucket by the id spreads every shard, and every group, over many tasks
        at = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
        number = F.lit(0)
        for c in cuts:
            number = number + (F.substring("_s_key", 1, len(c)) >= c).cast("int")
        return df.withColumn("shard", number).withColumn("_s_at", at).withColumn("_s_b", F.substring("_s_at", 1, 3))

    before = Window.partitionBy("shard").orderBy("_s_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed(narrow).groupBy("shard", "_s_b").agg(F.count("*").alias("_s_n"))
               .withColumn("_s_off", F.coalesce(F.sum("_s_n").over(before), F.lit(0))).drop("_s_n"))
    inside = Window.partitionBy("shard", "_s_b").orderBy("_s_at", doc_id, "_s_key")
    out = placed(keyed).join(F.broadcast(offsets), ["shard", "_s_b"])     # at most 4,096 rows a shard
    return out.select(*keep, F.col("_s_size").alias("size"), F.col("_s_crc").alias("text_crc32"), "shard",
                      (F.col("_s_off") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"))
