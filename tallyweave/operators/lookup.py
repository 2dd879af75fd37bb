"""Lookups in tables too large to be shipped to every task: one shuffle of the probing rows, hot keys in parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import stored

#: Probing rows of one key that stay together, unless there are so many keys with more that these are
#: more than ``HOT_KEYS``.
ROWS_TOGETHER, HOT_KEYS = 1_000_000, 10_000


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def spread_join(probes: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``probes`` with ``side``, which has a row per value of ``keys`` at most; null equals null.

    Probing rows are counted by key first, which is combined where they are read. A key with more than ``ROWS_TOGETHER`` rows is
    dealt out in parts, and its row of ``side`` goes to each of them.
    """
    counts = stored(probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "probes")
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    least = max(ROWS_TOGETHER, total // HOT_KEYS)  # no more than HOT_KEYS keys have as many rows
    hot = counts.where(F.col("_rows") > least)
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_rows") / least).cast("int").alias("_parts"))

    def parted(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(hot), _same(keys, "_h_"), "left").drop(*[f"_h_{k}" for k in keys])
        return found.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    dealt = parted(probes).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).drop("_parts")
    copies = parted(side).withColumn("_s__part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    copies = copies.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    joined = dealt.join(copies.hint("merge"), _same([*keys, "_part"], "_s_"), "left")
    return joined.drop("_part", "_s__part", *[f"_s_{k}" for k in keys])
