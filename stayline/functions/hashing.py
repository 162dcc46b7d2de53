"""Layout-independent pseudo-random numbers from a key.

``md5("<seed>:<key>")`` gives the same value in every engine, whatever the
partitioning, so splits, samples and random policies can be reproduced anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52  # 13 hexadecimal digits: exact as long and as double


def hash_number(seed: int | str, key: Column) -> Column:
    """Integer in [0, 2**52) from the first 13 hexadecimal digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_uniform(seed: int | str, key: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_number(seed, key).cast("double") / F.lit(float(2**HASH_BITS))
