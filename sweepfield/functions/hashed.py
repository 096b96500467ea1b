"""Seeded randomness from row keys.

A hash of (seed, keys) gives the same number whatever the partitioning and
however often a task is retried, which rand() does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col

_SPAN = float(2**52)


def uniform(seed: int, *keys) -> Column:
    """Uniform on (0, 1)."""
    h = F.xxhash64(F.lit(int(seed)).cast("long"), *(col(k) for k in keys))
    return (F.pmod(h, F.lit(2**52)).cast("double") + 0.5) / F.lit(_SPAN)


def uniform_between(low: float, high: float, seed: int, *keys) -> Column:
    return F.lit(low) + uniform(seed, *keys) * F.lit(high - low)


def gaussian(seed: int, *keys) -> Column:
    """Standard normal by Box-Muller from two independent hashes."""
    u = uniform(seed, F.lit(1), *keys)
    v = uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def shuffle_key(seed: int, *keys) -> Column:
    return F.xxhash64(F.lit(int(seed)).cast("long"), *(col(k) for k in keys))
