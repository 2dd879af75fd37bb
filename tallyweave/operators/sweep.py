"""Error of sampled summaries over a grid of sampling probabilities and seeds.

One pass serves all probabilities: the gates of a seed are nested, since a slot
that passes at p passes at every larger p. Rows are folded by the smallest
probability that admits them and the cells of larger ones are running sums of
those small tables, so the packets are never multiplied by the grid of p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import numeric
from tallyweave.functions.bits import sign
from tallyweave.functions.hashing import hash_columns, with_hashes
from tallyweave.operators.cells import cell_id, count_keys
from tallyweave.operators.estimate import BROADCAST_CELLS
from tallyweave.operators.sampling import gate_draws
from tallyweave.session import stored
from tallyweave.spec import SketchSpec

# The grid of the published experiments.
SWEEP_P = (0.01, *[round(0.05 * i, 2) for i in range(1, 20)], 1.0)
SWEEP_SEEDS = (1234, 2375, 3522, 23738, 1918)


def _array(values: Sequence[str]) -> Column:
    """A literal array, parsed at once instead of built from single literals."""
    return F.expr(f"array({', '.join(values)})")


def _first_admitting(draw: str, ps: Sequence[float]) -> Column:
    """Number of the smallest probability whose gate a draw passes; ``len(ps)`` for none.

    That is the number of thresholds up to the draw.
    """
    passed = (f"CAST({draw} >= {numeric.threshold_u32(p)}L AS INT)" for p in ps)
    return F.expr(" + ".join(passed))


def sweep_cells(
    packets: DataFrame, spec: SketchSpec, packet_id: str, ps: Sequence[float], seeds: Sequence[int]
) -> DataFrame:
    """``(cell, values)``: for every cell of a summary its value in all runs, run ``seed number * len(ps) + probability
    number``.

    Updates are folded by one long key, run * layer_size + cell, which aggregates far faster than
    seed, probability and cell apart.
    """
    ps = sorted(ps)
    hashed = with_hashes(packets.select(packet_id, *spec.keys), spec)
    numbered_seeds = _array([f"named_struct('i', {i}, 'v', {seed})" for i, seed in enumerate(seeds)])
    runs = hashed.withColumn("_run", F.explode(numbered_seeds))
    draws = gate_draws(spec, packet_id, seed=F.col("_run.v"))
    drawn = runs.withColumns({f"_d{row}": draw for row, draw in enumerate(draws)})
    updates = []
    for row, h in enumerate(hash_columns(spec)):
        cell = cell_id(F.col("_run.i") * len(ps), row, F.col(h), spec)
        updates += [F.col(f"_d{row}"), cell, sign(F.col(h), spec.sign_bit)]
    # The thresholds are compared after the generator, once in the generated code and
    # not once per row: a method that grows too long is not compiled.
    slots = drawn.select(F.stack(F.lit(spec.rows), *updates).alias("_draw", "cell", "value"))
    admitted = (
        slots.withColumn("_first", _first_admitting("_draw", ps))
        .filter(F.col("_first") < len(ps))
        .select((F.col("cell") + F.col("_first") * spec.layer_size).alias("cell"), "value")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
    )
    # One array per cell: value k of a seed's part is what the probabilities up to number k have admitted.
    cell, step = F.col("cell"), F.lit(spec.layer_size).cast("bigint")
    entries = F.map_from_entries(F.collect_list(F.struct(F.floor(cell / step).cast("int").alias("run"), "value")))
    found = admitted.groupBy(F.pmod(cell, step).alias("cell")).agg(entries.alias("runs"))
    width = len(ps)

    def total(run: Column) -> Column:
        upto = F.sequence(run - F.pmod(run, F.lit(width)), run)
        return F.aggregate(upto, F.lit(0).cast("bigint"), lambda sums, r: sums + F.coalesce(F.element_at("runs", r), F.lit(0)))

    return found.select("cell", F.transform(F.sequence(F.lit(0), F.lit(width * len(seeds) - 1)), total).alias("values"))


def sweep_estimates(
    packets: DataFrame,
    spec: SketchSpec,
    packet_id: str,
    ps: Sequence[float] = SWEEP_P,
    seeds: Sequence[int] = SWEEP_SEEDS,
) -> DataFrame:
    """Estimate and true count of every key for every (p, seed).

    A key is probed once per row for all runs; it is multiplied by them after the joins.
    """
    ps = sorted(ps)
    # A row per cell of one run, so at most ``layer_size`` rows.
    cells = stored(sweep_cells(packets, spec, packet_id, ps, seeds), "sweep-cells")
    bounded = len(ps) * len(seeds) * spec.layer_size <= BROADCAST_CELLS

    runs = [(seed, p) for seed in seeds for p in ps]
    grid = _array([f"named_struct('i', {i}, 'p', {p!r}D, 'seed', {seed})" for i, (seed, p) in enumerate(runs)])
    probes = with_hashes(count_keys(packets, spec), spec)
    for row, h in enumerate(hash_columns(spec)):
        side = cells.select(F.col("cell").alias("_cell"), F.col("values").alias(f"_v{row}"))
        at = cell_id(F.lit(0), row, F.col(h), spec)
        probes = probes.join(F.broadcast(side) if bounded else side, at == F.col("_cell"), "left").drop("_cell")
    probes = probes.withColumn("_run", F.explode(grid))
    values = [
        sign(F.col(h), spec.sign_bit) * F.coalesce(F.get(f"_v{row}", F.col("_run.i")), F.lit(0))
        for row, h in enumerate(hash_columns(spec))
    ]
    return probes.select(
        *spec.keys, F.col("_run.p").alias("p"), F.col("_run.seed").alias("seed"), "n",
        (numeric.integer_median(values) / F.col("_run.p")).alias("est"),
    )


def sweep_error(estimates: DataFrame) -> DataFrame:
    """Mean absolute and mean signed error per probability."""
    error = F.col("est") - F.col("n")
    return estimates.groupBy("p").agg(
        F.avg(F.abs(error)).alias("mean_abs_error"),
        F.avg(error).alias("mean_error"),
        F.count(F.lit(1)).alias("estimates"),
    )
