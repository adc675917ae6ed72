"""Random numbers that depend on a seed and keys alone, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(2 * seed, *keys), uniform(2 * seed + 1, *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)
