"""The exact top-k terms of a corpus without counting every term.

Most distinct 1-2 grams of a large corpus are rare and never reach the
vocabulary, but a plain count shuffles all of them. Two passes avoid that:

1. A mergeable summary: occurrences by two independent hashes of the term into
   ``buckets`` buckets each. It is summed before the shuffle, its size does not
   depend on the corpus, and the smaller of a term's two buckets bounds its count
   from above.
2. Exact statistics of the candidates, the terms whose bound reaches a limit.

Every term left out occurs less often than the limit. So if the ``k``-th
candidate occurs that often, the top ``k`` are among the candidates; if not, its
count becomes the limit and the second pass is repeated, which settles it. With
fewer than ``k`` candidates the limit falls until all terms are candidates. The
result is exact in every case; only the number of rows shuffled depends on the
summary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir

BUCKETS = 1 << 17           # of each hash; one long each
SIDES = 2
OVERSIZE = 2                # the first limit leaves this many times k buckets of a hash


@dataclass
class Summary:
    """Occurrences by bucket, ``(SIDES, buckets)``."""
    totals: np.ndarray

    @property
    def buckets(self) -> int:
        return self.totals.shape[1]

    def start(self, k: int) -> int:
        """A limit that leaves about ``OVERSIZE * k`` buckets of each hash."""
        keep = OVERSIZE * k
        if keep >= self.buckets:
            return 1
        return max(1, int(min(np.partition(t, -keep)[-keep] for t in self.totals)))

    def bound(self, term: Column) -> Column:
        """Most times the term can occur, from the row of :meth:`frame`."""
        return F.least(*[F.get(f"_side{s}", bucket(term, s, self.buckets)) for s in range(SIDES)])

    def frame(self, spark) -> DataFrame:
        """One row with an array per hash."""
        return spark.createDataFrame(pa.table({f"_side{s}": pa.array([t.tolist()], pa.list_(pa.int64()))
                                               for s, t in enumerate(self.totals)}))


def bucket(term: Column, side: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(side)), F.lit(buckets)).cast("int")


def summary(docs: DataFrame, spec: T.TfidfSpec, text_col: str = "prompt", buckets: int = BUCKETS) -> Summary:
    """One pass over the texts; at most ``SIDES * buckets`` rows come to the driver."""
    terms = docs.select(F.explode(T.terms_column(text_col, spec)).alias("term"))
    at = F.posexplode(F.array(*[bucket(F.col("term"), s, buckets) for s in range(SIDES)])).alias("side", "bucket")
    rows = terms.select(at).groupBy("side", "bucket").count().toArrow()
    totals = np.zeros((SIDES, buckets), np.int64)
    totals[rows["side"].to_numpy(), rows["bucket"].to_numpy()] = rows["count"].to_numpy()
    return Summary(totals)


def candidate_stats(docs: DataFrame, spec: T.TfidfSpec, found: Summary, limit: int, text_col: str = "prompt",
                    label_col: str | None = "label") -> DataFrame:
    """Exact statistics of the terms whose bound reaches ``limit``."""
    rows = T.term_rows(docs, spec, text_col, label_col)
    if limit > 1:
        rows = rows.crossJoin(F.broadcast(found.frame(docs.sparkSession))).filter(found.bound(F.col("term")) >= limit)
    return T.row_stats(rows, label_col)


def top_term_stats(docs: DataFrame, spec: T.TfidfSpec, text_col: str = "prompt", label_col: str | None = "label",
                   buckets: int = BUCKETS) -> DataFrame:
    """Stored statistics ``(term, cnt, df, df_h, df_b)`` of a set of terms that
    holds the ``max_features`` most frequent ones (ties by term)."""
    ensure_checkpoint_dir(docs.sparkSession)
    k = spec.max_features
    found = summary(docs, spec, text_col, buckets)
    limit = found.start(k)
    while True:
        stats = candidate_stats(docs, spec, found, limit, text_col, label_col).checkpoint(eager=True)
        last = stats.orderBy(F.col("cnt").desc()).offset(k - 1).limit(1).select("cnt").first()
        if limit <= 1 or (last is not None and last["cnt"] >= limit):
            return stats
        limit = last["cnt"] if last is not None else max(1, limit // 8)
