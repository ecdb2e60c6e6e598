"""Random numbers that depend only on a seed and counters, so that any partitioning gives the same ones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *counters: Column) -> Column:
    """From 0 (excluded) to 1: the first 13 hexadecimal digits of the MD5 of seed and counters. A null
    counter counts as the word null."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in counters])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def normal(seed: int, *counters: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(seed, *counters, F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, *counters, F.lit("b")))
