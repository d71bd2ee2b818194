"""Scalar column expressions: decisions, probabilities, ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptscreen.constants import DECIMALS, SEED, THRESHOLD
from promptscreen.functions.text import col_


def decide(p, threshold: float = THRESHOLD, inclusive: bool = True) -> Column:
    """0/1 decision. ``inclusive`` is ``p >= t``; ``False`` is ``p > t`` (argmax)."""
    p = col_(p)
    return (p >= threshold if inclusive else p > threshold).cast("int")


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z)))


def logit_of(p, eps: float = 1e-12) -> Column:
    """Log odds of a probability, finite also at 0 and 1."""
    q = F.least(F.greatest(col_(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def softmax2(z0, z1) -> Column:
    """Harmful probability from two class logits (index 1 = harmful)."""
    return sigmoid(col_(z1) - col_(z0))


def verdict(p, threshold: float = THRESHOLD) -> Column:
    return F.when(col_(p) > threshold, F.lit("HARMFUL")).otherwise(F.lit("BENIGN"))


def round4(c) -> Column:
    """Half-even rounding to 4 places, as result tables publish probabilities."""
    return F.bround(col_(c), 4)


def r6(c) -> Column:
    return F.round(col_(c), DECIMALS)


def order_key(id_col, salt: str, seed: int = SEED) -> Column:
    """Deterministic pseudo-random order: md5 of seed|salt|id (hex string)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt),
                             col_(id_col).cast("string")))


def content_key(*cols) -> Column:
    """128-bit identity (32 hex digits) from content, for rows that arrive
    without a key. Each part carries its length, and null is marked, so no two
    different rows give the same text to the hash."""
    parts = [F.coalesce(F.concat(F.octet_length(col_(c).cast("string")).cast("string"), F.lit(":"),
                                 col_(c).cast("string")), F.lit("n")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def content_id(*cols) -> Column:
    """60 bits of :func:`content_key` as a number, for row sets that join a
    table with numeric ids and are far below 10^8 rows (attack results)."""
    return F.conv(F.substring(content_key(*cols), 1, 15), 16, 10).cast("bigint")


def face_color(norm_score) -> Column:
    """RGB of a normalised attribution: red for positive, blue for negative."""
    s = col_(norm_score)

    def clamp(x):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    r = F.when(s > 0, F.lit(1.0)).otherwise(F.lit(1.0) + s)
    g = F.when(s > 0, F.lit(1.0) - s).otherwise(F.lit(1.0) + s)
    b = F.when(s > 0, F.lit(1.0) - s).otherwise(F.lit(1.0))
    return F.struct(clamp(r).alias("r"), clamp(g).alias("g"), clamp(b).alias("b"))
