"""Keyed tables of ``size`` slots: counters, last values and lookups.

Slot = ``x mod size``. Every build is one aggregate with partial results per task,
so a slot that receives most rows is no hot spot. ``seq`` orders the writes and is
unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.lookup import spread_join

#: Constant stored by the writes that do not store their value.
MARKER = 0xFEDC

#: Tables of up to this many slots (16 bytes each) are shipped to every task.
BROADCAST_SLOTS = 1 << 20


def slot(x: Column, size: int) -> Column:
    return F.pmod(x.cast("bigint"), F.lit(size))


def _by_slot(rows: DataFrame, size: int, x: str):
    return rows.groupBy(slot(F.col(x), size).alias("key"))


def increment(rows: DataFrame, size: int, x: str = "x") -> DataFrame:
    """Number of rows per slot."""
    return _by_slot(rows, size, x).agg(F.count(F.lit(1)).alias("value"))


def increment_after_insert(rows: DataFrame, size: int, x: str = "x") -> DataFrame:
    """As :func:`increment`, but the first touch of a slot stores 0."""
    return _by_slot(rows, size, x).agg((F.count(F.lit(1)) - 1).alias("value"))


def last_write(rows: DataFrame, size: int, x: str = "x", seq: str = "seq") -> DataFrame:
    """Value of the last write per slot."""
    return _by_slot(rows, size, x).agg(F.max_by(x, seq).cast("bigint").alias("value"))


def write_after_insert(rows: DataFrame, size: int, x: str = "x", seq: str = "seq") -> DataFrame:
    """The first touch stores :data:`MARKER`, later ones their value."""
    only_touch = F.count(F.lit(1)) == 1
    value = F.when(only_touch, F.lit(MARKER)).otherwise(F.max_by(x, seq)).cast("bigint")
    return _by_slot(rows, size, x).agg(value.alias("value"))


def write_constant(rows: DataFrame, size: int, x: str = "x") -> DataFrame:
    """Every touched slot holds :data:`MARKER`."""
    return _by_slot(rows, size, x).agg(F.lit(MARKER).cast("bigint").alias("value"))


def lookup(
    probes: DataFrame, table: DataFrame, size: int, x: str = "x", *, default: int | None = None
) -> DataFrame:
    """Add ``value`` of the slot of every probe row, ``default`` where it is empty.

    Beyond ``BROADCAST_SLOTS`` the probing rows are shuffled once, those of a hot slot in parts.
    """
    # Slots out of range are never asked for, and each has one row: the size bounds what is broadcast, whatever the table holds.
    side = table.where(F.col("key").between(0, size - 1)).groupBy(F.col("key").alias("_key")).agg(F.max("value").alias("value"))
    if size <= BROADCAST_SLOTS:
        found = probes.join(F.broadcast(side), slot(F.col(x), size) == F.col("_key"), "left").drop("_key")
    else:
        found = spread_join(probes.withColumn("_key", slot(F.col(x), size)), side, ["_key"]).drop("_key")
    return found if default is None else found.withColumn("value", F.coalesce("value", F.lit(default)))


def table_checksum(rows: DataFrame, hash_of_row: Column) -> DataFrame:
    """XOR of one hash per row: equal tables give equal sums in any row order."""
    return rows.agg(F.coalesce(F.bit_xor(hash_of_row), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("n"))
