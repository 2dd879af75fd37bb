"""Bit-level columns. All 32-bit values travel as non-negative bigints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MASK = 0xFFFFFFFF


def trailing_zeros(v: Column) -> Column:
    """Zero bits below the lowest set bit; 0 for 0."""
    lowest = v.bitwiseAND(-v)
    return F.when(v == 0, F.lit(0)).otherwise(F.bit_count(lowest - 1)).cast("int")


def leading_ones(v: Column) -> Column:
    """Set bits above the highest clear bit of a 32-bit value."""
    clear = v.bitwiseXOR(F.lit(U32_MASK))
    return F.when(clear == 0, F.lit(32)).otherwise(32 - F.length(F.bin(clear))).cast("int")


def bit(v: Column, position: int | Column) -> Column:
    """0 or 1, the bit of ``v`` at ``position``."""
    return F.getbit(v, position if isinstance(position, Column) else F.lit(position)).cast("int")


def bits_msb_first(v: Column) -> Column:
    """The 32 bits of ``v`` as an array, most significant bit first."""
    return F.transform(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), lambda i: bit(v, i))


def clear_bits_lsb_first(v: Column) -> Column:
    """Array whose element j is 1 exactly when bit j of ``v`` is 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: 1 - bit(v, i))


def floor_mean(a: Column, b: Column) -> Column:
    """``floor((a + b) / 2)`` without forming ``a + b``."""
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def lane(h: Column, i: int) -> Column:
    """The i-th 16-bit lane of a 64-bit hash, lowest first."""
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF))


def column_index(h: Column, cols: int) -> Column:
    """Position of a hash in a row of ``cols`` cells, a power of two."""
    return h.bitwiseAND(F.lit(cols - 1))


def sign(h: Column, sign_bit: int) -> Column:
    """+1 when the sign bit of a hash is set, -1 otherwise."""
    return F.when(h.bitwiseAND(F.lit(1 << sign_bit)) != 0, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")


def flat_index(row: Column, col: Column, cols: int) -> Column:
    return row.cast("bigint") * cols + col


def row_of(flat: Column, cols: int) -> Column:
    """Row of a flat index; ``cols`` is a power of two."""
    return F.shiftright(flat, cols.bit_length() - 1).cast("int")


def col_of(flat: Column, cols: int) -> Column:
    return column_index(flat, cols).cast("int")
