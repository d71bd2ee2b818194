"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.session import ensure_checkpoint_dir

# Rows of a lookup side that may be broadcast after a count.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only after checking its row count.

    Used for lookup tables whose size does not grow with the scanned data
    (per-stratum quotas, a lexicon) but has no static bound. The table is
    written to the checkpoint folder first, so the count materializes it once and
    the join reads the stored rows instead of recomputing it (a quota table
    aggregates the whole input), and no cache is left behind. Above the limit the join stays a shuffle join and AQE's skew
    handling splits hot keys.
    """
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    return F.broadcast(small) if small.count() <= max_rows else small
