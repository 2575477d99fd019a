"""Repeatable pseudo-random values, computed from the row itself.

``rand()`` gives other rows after a retry or another partitioning; a hash of seed and key gives the
same draw for the same row always.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int, *parts: Column) -> Column:
    """A hex string that orders rows pseudo-randomly for one seed. Null parts are skipped."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _bits(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def draw(low: int, high: int, key: Column) -> Column:
    """An integer in [low, high]."""
    return F.lit(low) + _bits(key) % F.lit(high - low + 1)


def chance(per_mille: int, key: Column) -> Column:
    """True for about ``per_mille`` of 1000 keys."""
    return _bits(key) % F.lit(1000) < F.lit(per_mille)
