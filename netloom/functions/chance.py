"""Random columns that depend on a seed and on the row's own key, never on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 6031769


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """In [0, 1), one value per key."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(stream), *keys), F.lit(2**53)) / F.lit(float(2**53))


def generator(seed: int, *stream: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & (2**63 - 1), *stream])))


def draw(seed: int, a: int, b: int, below: int) -> int:
    """A whole number below a bound, hashed from its arguments (the finalizer of splitmix64, fixed values, twice)."""
    x = seed ^ (a * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03)
    for _ in range(2):
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return (x * below) >> 64
