"""Packet and byte counters and the rates derived from them.

Counters are long tables ``(by..., ts, packets, bytes)``. Time is the only order;
series are scanned in chunks (see :mod:`tallyweave.operators.ordered`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.numeric import round2
from tallyweave.operators import ordered
from tallyweave.session import stored

#: Samples a chunk should hold at least; one day at most when samples are frequent.
CHUNK_SAMPLES = 3600


def counter_aggregates(packets: bool = True, bytes: bool = True) -> list[Column]:
    """The counters a flow table is reduced to."""
    out = []
    if packets:
        out.append(F.count(F.lit(1)).alias("packets"))
    if bytes:
        out.append(F.coalesce(F.sum(F.col("wire_len").cast("bigint")), F.lit(0)).alias("bytes"))
    return out


def totals(flows: DataFrame, by: Sequence[str] = (), **which: bool) -> DataFrame:
    """Counters per group; with both turned off only the groups are left."""
    counters = counter_aggregates(**which)
    return flows.groupBy(*by).agg(*counters) if counters else flows.select(*by).distinct()


def per_protocol(flows: DataFrame) -> DataFrame:
    return flows.groupBy("proto").agg(F.count(F.lit(1)).alias("packets"))


def _chunk(ts: Column, seconds: int) -> Column:
    """Chunk of a sample: whole days, so that it follows ``ts`` in any time zone."""
    days = max(1, math.ceil(seconds * CHUNK_SAMPLES / 86400))
    return F.floor(F.unix_date(ts.cast("date")) / days)


def per_interval(
    flows: DataFrame, seconds: int = 1, *, by: Sequence[str] = (), fill: bool = True, **which: bool
) -> DataFrame:
    """Counts per tumbling interval, named by its start ``ts``.

    ``fill`` adds zero rows for empty intervals between the first and the last of a
    series. It runs the counting at once and stores its small result.
    """
    if not counter_aggregates(**which):
        raise ValueError("intervals need a counter that is on")
    counted = (
        flows.groupBy(*by, F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(*counter_aggregates(**which))
        .withColumn("ts", F.col("_w")["start"])
    )
    values = [c for c in counted.columns if c in ("packets", "bytes")]
    counted = counted.select(*by, "ts", *values)
    return fill_intervals(stored(counted, "intervals"), seconds, by=by) if fill else counted


#: Slots of a hole that one row spreads out at a time.
HOLE_SLOTS = 4096


def fill_intervals(intervals: DataFrame, seconds: int = 1, *, by: Sequence[str] = ()) -> DataFrame:
    """Each row also fills the hole up to its successor with zero rows."""
    step = F.expr(f"interval {seconds} seconds")
    values = [c for c in intervals.columns if c in ("packets", "bytes")]
    following = ordered.neighbour(intervals, by, "ts", _chunk(F.col("ts"), seconds), {"_next": "ts"}, ahead=True)
    last = F.coalesce(F.col("_next") - step, F.col("ts"))
    # A long hole is cut into stretches first, so that no row holds all its slots.
    stretch = F.expr(f"interval {seconds * HOLE_SLOTS} seconds")
    cut = following.withColumn("_last", last).withColumn("_from", F.explode(F.sequence(F.col("ts"), F.col("_last"), stretch)))
    until = F.least(F.col("_last"), F.col("_from") + stretch - step)
    slots = cut.withColumn("_slot", F.explode(F.sequence(F.col("_from"), until, step)))
    own = F.col("_slot") == F.col("ts")
    return slots.select(
        *by,
        F.col("_slot").alias("ts"),
        *[F.when(own, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values],
    )


def snapshots(intervals: DataFrame, seconds: int = 1, *, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counters as a sampler would read them after every interval."""
    values = [c for c in intervals.columns if c in ("packets", "bytes")]
    summed = ordered.running_sum(
        intervals, by, "ts", _chunk(F.col("ts"), seconds), {f"_sum_{v}": v for v in values}
    )
    return summed.select(*by, "ts", *[F.col(f"_sum_{v}").alias(v) for v in values])


def interval_deltas(intervals: DataFrame, value: str = "packets", *, by: Sequence[str] = ()) -> DataFrame:
    """Deltas where the counts per interval are at hand: the counts themselves."""
    return intervals.select(*by, "ts", F.col(value).alias("delta"))


def counter_deltas(
    counters: DataFrame, value: str = "packets", seconds: int = 1, *, by: Sequence[str] = ()
) -> DataFrame:
    """``delta`` between consecutive samples of a cumulative counter.

    Samples before anything was counted emit nothing; the first delta is against 0.
    """
    live = counters.filter(F.col(value) > 0).select(*by, "ts", value)
    seen = ordered.neighbour(live, by, "ts", _chunk(F.col("ts"), seconds), {"_prev": value})
    return seen.select(*by, "ts", (F.col(value) - F.coalesce(F.col("_prev"), F.lit(0))).alias("delta"))


def bounded(samples: DataFrame, count: int, seconds: int = 1) -> DataFrame:
    """The samples of the first ``count`` intervals after the earliest one."""
    start = samples.agg(F.min("ts")).scalar()
    return samples.filter(F.col("ts") < start + F.expr(f"interval {seconds * count} seconds"))


def numbered(samples: DataFrame, seconds: int = 1, *, by: Sequence[str] = ()) -> DataFrame:
    """Add the position ``sample`` of every row in its series, from 1."""
    ones = samples.withColumn("_one", F.lit(1))
    chunk = _chunk(F.col("ts"), seconds)
    return ordered.running_sum(ones, by, "ts", chunk, {"sample": "_one"}).drop("_one")


def discard_warm_up(
    samples: DataFrame, count: int = 1, seconds: int = 1, *, by: Sequence[str] = ()
) -> DataFrame:
    """Drop the first ``count`` samples of every series."""
    return numbered(samples, seconds, by=by).filter(F.col("sample") > count).drop("sample")


def average_rate(deltas: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean delta without the first sample, to two decimals; null below two samples."""
    others = F.count(F.lit(1)) - 1
    rest = F.sum("delta") - F.min_by("delta", "ts")
    return deltas.groupBy(*by).agg(round2(F.when(others > 0, rest / others)).alias("avg_rate"))


def peak_rate(deltas: DataFrame, seconds: int = 1, *, by: Sequence[str] = ()) -> DataFrame:
    """Largest delta after two warm-up samples; the last two samples always count.

    Chunks are reduced to their first two samples and the maximum of the others, so
    only these meet in one place.
    """
    sample = F.struct("ts", "delta")
    chunks = (
        deltas.groupBy(*by, _chunk(F.col("ts"), seconds).alias("_chunk"))
        .agg(F.sort_array(F.collect_list(sample)).alias("_s"))
        .select(
            *by,
            F.slice("_s", 1, 2).alias("_head"),
            F.array_max(F.transform(F.slice("_s", F.lit(3), F.size("_s") + 1), lambda x: x["delta"])).alias("_rest"),
            F.size("_s").alias("_n"),
        )
    )
    whole = chunks.groupBy(*by).agg(
        F.sort_array(F.flatten(F.collect_list("_head"))).alias("_heads"),
        F.max("_rest").alias("_rest"),
        F.sum("_n").alias("_n"),
    )
    n = F.col("_n")
    # The last two samples are warm-up samples only in series of three or fewer.
    skipped = F.when(n >= 4, 2).when(n == 3, 1).otherwise(0)
    steady = F.array_max(F.transform(F.slice("_heads", skipped + 1, F.greatest(F.size("_heads"), F.lit(1))), lambda x: x["delta"]))
    return whole.select(*by, F.greatest(steady, F.col("_rest")).alias("peak_rate"))


def throughput(delta: Column, units_per_packet: int) -> Column:
    """Work units per second in millions."""
    return delta * units_per_packet / 1e6
