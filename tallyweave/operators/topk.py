"""Ranking within groups, and heavy-hitter lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import stored
from tallyweave.spec import SketchSpec

#: Keys (counted) that are shipped to every task at most.
BROADCAST_KEYS = 100_000


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, *, shard_on: Sequence[str]
) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``, starting at 1.

    For small ``k`` Spark limits each task's share of a group to k rows before the
    shuffle (its window group limit). Larger ``k`` would send whole groups to one
    task, so those are cut to k per shard of the group first.
    """
    conf = df.sparkSession.conf
    limit = int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        shards = int(conf.get("spark.sql.shuffle.partitions"))
        shard = F.pmod(F.xxhash64(*[F.col(c) for c in shard_on]), F.lit(shards))
        local = Window.partitionBy(*group, "_shard").orderBy(*order)
        df = (
            df.withColumn("_shard", shard)
            .withColumn("_rank", F.row_number().over(local))
            .filter(F.col("_rank") <= k)
            .drop("_shard", "_rank")
        )
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def heap_order(spec: SketchSpec) -> list[Column]:
    """Estimates descending; ties by key, so that results repeat."""
    return [F.col("est").desc(), *[F.col(k).asc() for k in spec.keys]]


def merge_heaps(heaps: DataFrame, spec: SketchSpec, *, k: int | None = None) -> DataFrame:
    """One list per layer from partial ones: estimates of a key are summed, then ranked."""
    summed = heaps.groupBy("layer", "deepest", *spec.keys).agg(F.sum("est").alias("est"))
    ranked = top_per_group(summed, ["layer"], heap_order(spec), k or spec.heap_size, shard_on=spec.keys)
    return ranked.select("layer", "rank", "est", *spec.keys, "deepest")


def merge_exact(parts: DataFrame, spec: SketchSpec, *, lists: Sequence[str], k: int | None = None) -> DataFrame:
    """The ``k`` largest sums per layer over all lists, exactly, without adding up every key.

    ``parts`` holds the whole of every list, not only its top: positive estimates, a key once per list
    (``lists``) and layer. Three phases. The tops of the lists give sums whose k-th is a first floor. Every entry of at least the floor divided by
    the number of lists is added up next, which gives a better floor, and what a key can still gain in the
    lists that have not shown it. Keys that can reach the floor are then looked up in all lists.
    """
    k = k or spec.heap_size
    order, own = heap_order(spec), ["layer", "deepest", *spec.keys]
    number = parts.select(*lists).distinct().count()
    if not number:
        return parts.select("layer", F.lit(0).alias("rank"), "est", *spec.keys, "deepest")

    def summed(entries: DataFrame) -> DataFrame:
        return entries.groupBy(*own).agg(F.sum("est").alias("est"), F.count(F.lit(1)).alias("seen"))

    def floor(sums: DataFrame, name: str) -> DataFrame:
        ranked = top_per_group(sums, ["layer"], order, k, shard_on=spec.keys)
        last = ranked.where(F.col("rank") == k).select(F.col("layer").alias("_layer"), F.col("est").alias(name))
        return stored(last, "floors")  # a row per layer

    def beside(entries: DataFrame, floors: DataFrame) -> DataFrame:
        return entries.join(F.broadcast(floors), F.col("layer") == F.col("_layer"), "left").drop("_layer")

    tops = top_per_group(parts, [*lists, "layer"], order, k, shard_on=spec.keys)
    sent_from = floor(summed(tops), "first").withColumn("least", F.ceil(F.col("first") / number)).drop("first")
    sent = beside(parts, sent_from).where(F.col("least").isNull() | (F.col("est") >= F.col("least")))
    shown = stored(summed(sent), "shown")

    best = beside(beside(shown, floor(shown, "second")), sent_from)
    reach = F.col("est") + (F.lit(number) - F.col("seen")) * (F.col("least") - 1)
    kept = best.where(F.col("second").isNull() | F.col("least").isNull() | (reach >= F.col("second")))
    kept = stored(kept.select(*[F.col(c).alias(f"_k_{c}") for c in ("layer", *spec.keys)]), "reach")
    small = kept.count() <= BROADCAST_KEYS
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("layer", *spec.keys)])
    whole = parts.join(F.broadcast(kept) if small else kept, same, "left_semi")
    ranked = top_per_group(summed(whole), ["layer"], order, k, shard_on=spec.keys)
    return ranked.select("layer", "rank", "est", *spec.keys, "deepest")


def top_k(heap: DataFrame, layer: int, k: int, spec: SketchSpec) -> DataFrame:
    """The ``k`` first entries of a layer; empty when layer or k is out of range."""
    in_range = 0 <= layer < spec.layers and 0 <= k <= spec.heap_size
    if not in_range:
        return heap.filter(F.lit(False))
    return heap.filter((F.col("layer") == layer) & (F.col("est") != 0)).orderBy(*heap_order(spec)).limit(k)
