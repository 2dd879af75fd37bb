"""Small numeric columns: medians, units, rounding and random variates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.bits import U32_MASK


def median(values: Sequence[Column]) -> Column:
    """Median of columns of one row; the mean of the middle two for an even number."""
    n = len(values)
    ordered = F.sort_array(F.array(*values))
    upper = F.get(ordered, F.lit(n // 2)).cast("double")
    if n % 2:
        return upper
    return (F.get(ordered, F.lit(n // 2 - 1)).cast("double") + upper) / 2


def integer_median(values: Sequence[Column]) -> Column:
    """:func:`median` of bigint columns. Up to four need no sorting: their sum without
    the extremes is the middle one, or the middle two together."""
    n = len(values)
    if n > 4:
        return median(values)
    total = reduce(lambda a, b: a + b, values)
    if n >= 3:
        total = total - F.least(*values) - F.greatest(*values)
    return total.cast("double") if n % 2 else total.cast("double") / 2


def median_of_five(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    return F.get(F.sort_array(F.array(a, b, c, d, e)), F.lit(2))


def gbps(bytes_per_second: Column) -> Column:
    return bytes_per_second * 8 / 1e9


def round2(x: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(x, 2)


def threshold_u32(p: float) -> int:
    """A uniform 32-bit value is below this with probability ``p``."""
    return 1 << 32 if p >= 1.0 else int(U32_MASK * p)


def uniform_open(u32: Column) -> Column:
    """A 32-bit value as a uniform double strictly between 0 and 1."""
    return (u32.cast("double") + 0.5) / 4294967296.0


def geometric(u: Column, p: float) -> Column:
    """Geometric variate on 1, 2, ... from a uniform in (0, 1)."""
    if p >= 1.0:
        return F.lit(1).cast("bigint")
    return F.greatest(F.ceil(F.log(u) / F.log(F.lit(1.0 - p))), F.lit(1)).cast("bigint")
