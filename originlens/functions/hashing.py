"""Seeded pseudo-random columns. md5 of (seed, keys) depends on the row's key only, so a
draw survives repartitioning and task retries, which ``rand`` does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_hex(seed, *keys) -> Column:
    """md5 hex digest of ``seed:key1:key2``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def uniform(seed, *keys) -> Column:
    """DOUBLE in [0, 1) from the first eight hex digits of :func:`md5_hex`."""
    head = F.conv(F.substring(md5_hex(seed, *keys), 1, 8), 16, 10)
    return head.cast("bigint").cast("double") / F.lit(4294967296.0)


def rand_int(lo: int, hi: int, seed, *keys) -> Column:
    """INT in [lo, hi], both ends included."""
    return (F.lit(lo) + F.floor(uniform(seed, *keys) * F.lit(float(hi - lo + 1)))).cast("int")


def rand_range(lo: float, width: float, seed, *keys) -> Column:
    """DOUBLE in [lo, lo + width)."""
    return F.lit(float(lo)) + F.lit(float(width)) * uniform(seed, *keys)
