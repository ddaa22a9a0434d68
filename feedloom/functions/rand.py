"""Seeded pseudo-random numbers that depend on the row's key alone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: the largest whole hex prefix that a double holds exactly


def uniform(seed, key: Column) -> Column:
    """A uniform number in (0, 1) from the hash of `seed:key`.

    Being a function of the key it is the same in every pass, on every executor and after a retry,
    which `rand()` is not.
    """
    return (uniform_bits(seed, key).cast("double") + 0.5) / float(16**HEX_DIGITS)


def uniform_bits(seed, key: Column) -> Column:
    """The same number as a whole one of 52 bits, for exact cuts."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", seed, key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")
