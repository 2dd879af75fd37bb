"""Frequent keys in bounded space: counts that lose the same from every key (Misra-Gries), mergeable in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.topk import top_per_group


def keep_frequent(counts: DataFrame, keys: Sequence[str], size: int, *, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., keys..., n)`` of at most ``size`` keys per group of ``by``; counts ``n`` of a key are added up first.

    What the largest key that finds no place has is taken from every key, so a key loses no more than N / (size + 1) of a
    total of N, over all merges of kept counts with new ones together. A key that was seen more often is kept.
    """
    summed = counts.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), *[F.col(k).asc() for k in keys]]
    ranked = top_per_group(summed, by, order, size + 1, shard_on=keys)
    cut = F.max(F.when(F.col("rank") == size + 1, F.col("n"))).over(Window.partitionBy(*by))
    left = ranked.withColumn("n", F.col("n") - F.coalesce(cut, F.lit(0)))
    return left.where((F.col("rank") <= size) & (F.col("n") > 0)).select(*by, *keys, "n")
