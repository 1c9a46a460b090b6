"""Uniform draws keyed by data.

A draw is a hash of the seed and of the row's own keys, so it does not depend on
partitioning, task retries or row order, which ``rand(seed)`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str, portable: bool = False) -> Column:
    """Double in [0, 1) for the given keys.

    ``portable`` uses md5, which other SQL engines can repeat; the default is the
    much cheaper 64-bit xxhash.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    if portable:
        text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
        high = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10)
        return high.cast("double") / F.lit(float(1 << 48))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
