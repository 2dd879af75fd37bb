"""Ordered scans over long series without one task per series.

A series is cut into chunks of its order value. Rows look back inside their chunk
only; what crosses a chunk border comes from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _join_on(df: DataFrame, chunks: DataFrame, group: Sequence[str]) -> DataFrame:
    renamed = chunks.select(*[F.col(c).alias(f"_j_{c}") if c in (*group, "_chunk") else F.col(c) for c in chunks.columns])
    condition = F.col("_chunk") == F.col("_j__chunk")
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_j_{g}"))
    return df.join(renamed, condition, "left").drop("_j__chunk", *[f"_j_{g}" for g in group])


def running_sum(
    df: DataFrame, group: Sequence[str], order: str, chunk: Column, sums: dict[str, str]
) -> DataFrame:
    """Add inclusive running sums ``{new: source}`` of each group in ``order``.

    ``chunk`` must not decrease with ``order``; pairs (group, order) are unique.
    """
    df = df.withColumn("_chunk", chunk)
    totals = df.groupBy(*group, "_chunk").agg(*[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()])
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_on(df, offsets, group)
    return joined.withColumns(
        {new: F.sum(src).over(inside) + F.col(f"_o_{new}") for new, src in sums.items()}
    ).drop("_chunk", *[f"_o_{n}" for n in sums])


def neighbour(
    df: DataFrame, group: Sequence[str], order: str, chunk: Column, values: dict[str, str], *, ahead: bool = False
) -> DataFrame:
    """Add the previous (or, ``ahead``, next) row's values ``{new: source}``; null at the end."""
    df = df.withColumn("_chunk", chunk)
    pick, shift = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    edges = df.groupBy(*group, "_chunk").agg(*[pick(src, order).alias(f"_e_{new}") for new, src in values.items()])
    across = Window.partitionBy(*group).orderBy("_chunk")
    borders = edges.select(*group, "_chunk", *[shift(f"_e_{n}").over(across).alias(f"_n_{n}") for n in values])
    inside = Window.partitionBy(*group, "_chunk").orderBy(order)
    found = df.withColumns(
        {f"_i_{new}": shift(F.struct(F.col(src).alias("v"))).over(inside) for new, src in values.items()}
    )
    joined = _join_on(found, borders, group)
    return joined.withColumns(
        {
            new: F.when(F.col(f"_i_{new}").isNotNull(), F.col(f"_i_{new}")["v"]).otherwise(F.col(f"_n_{new}"))
            for new in values
        }
    ).drop("_chunk", *[f"_i_{n}" for n in values], *[f"_n_{n}" for n in values])
