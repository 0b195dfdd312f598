"""Deterministic uniforms: a function of row, target and purpose, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
#: Purposes get ranges of seeds of their own, so that no two draws share a stream.
NATIVE, HIDE, ANCHOR, TRAIN, POOL, ORDER = (k * 1_000_003 for k in range(1, 7))


def uniform(e, days, target, seed) -> Column:
    """A number in [0, 1) from integers below 2^27; any of them a column or a constant."""
    e, days, target, seed = (x if isinstance(x, Column) else F.lit(x) for x in (e, days, target, seed))
    long = lambda x: x.cast("long")
    first = F.pmod(long(e) * 7919 + long(days) * 104729 + long(target) * 1299709 + long(seed), F.lit(PRIME).cast("long"))
    second = F.pmod(first * 48271, F.lit(PRIME).cast("long"))
    # A product of the number with a part of itself: sums in the key don't show in the draws.
    return F.pmod(second * (second % 39989 + 1), F.lit(PRIME).cast("long")).cast("double") / float(PRIME)
