"""One deterministic source of randomness.

Every shuffle, sample and draw in the package is an md5 of ``seed|part|part``.
The value depends only on the row, never on partitioning, task attempts or the
order rows arrive in, so a lost executor recomputes exactly the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60  # fifteen hex digits: the widest prefix that fits a signed BIGINT


def hash_hex(seed: int, *parts: Column | str) -> Column:
    """The 32-digit md5 of the seed and the given columns."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_int(seed: int, *parts: Column | str) -> Column:
    """The leading 60 bits of :func:`hash_hex` as a non-negative BIGINT."""
    return leading_int(hash_hex(seed, *parts))


def leading_int(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 15), 16, 10).cast("bigint")
