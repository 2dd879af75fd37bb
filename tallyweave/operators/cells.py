"""Building, merging and reshaping the cells of frequency summaries.

A summary is a DataFrame ``(layer, row, col, value)``; a cell that is absent is 0.
Building one is a projection, a small generator and a two-phase aggregate: every
task folds its rows into at most ``spec.cell_count`` partial cells, so only those
are shuffled, whatever the number of rows or the weight of a single key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import bits
from tallyweave.functions.hashing import hash_columns, with_hashes
from tallyweave.spec import SketchSpec

CELL = ("layer", "row", "col")


def deepest_layer(layer_hash: Column, spec: SketchSpec) -> Column:
    """Deepest layer of a key: each further clear bit after bit 0 goes one deeper."""
    rest = layer_hash.bitwiseAND(F.lit(0xFFFFFFFE))
    last = F.lit(spec.layers - 1)
    return F.when(rest == 0, last).otherwise(F.least(bits.trailing_zeros(rest) - 1, last)).cast("int")


def cell_id(layer: Column, row: int, h: Column, spec: SketchSpec) -> Column:
    """Number of the cell a hash falls into."""
    offset = layer.cast("bigint") * spec.layer_size + row * spec.cols
    return offset + bits.column_index(h, spec.cols)


def number_cells(cells: DataFrame, spec: SketchSpec, by: Sequence[str] = ()) -> DataFrame:
    """Cells as ``(by..., cell, value)`` with the flat cell number."""
    if "cell" in cells.columns:
        return cells.select(*by, "cell", "value")
    flat = bits.flat_index(F.col("layer") * spec.rows + F.col("row"), F.col("col"), spec.cols)
    return cells.select(*by, flat.alias("cell"), "value")


def unnumber_cells(flat: DataFrame, spec: SketchSpec, by: Sequence[str] = ()) -> DataFrame:
    """The inverse of :func:`number_cells`."""
    line = bits.row_of(F.col("cell"), spec.cols)
    return flat.select(
        *by,
        F.floor(line / spec.rows).cast("int").alias("layer"),
        F.pmod(line, F.lit(spec.rows)).alias("row"),
        bits.col_of(F.col("cell"), spec.cols).alias("col"),
        "value",
    )


def fold(
    hashed: DataFrame,
    spec: SketchSpec,
    weights: Sequence[Column],
    *,
    signed: bool,
    layer: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum per-row weights of hashed rows into numbered cells ``(by..., cell, value)``.

    Rows of weight 0 update nothing.
    """
    layer = F.lit(0) if layer is None else layer
    updates = []
    for row, (name, weight) in enumerate(zip(hash_columns(spec), weights)):
        h = F.col(name)
        value = weight.cast("bigint")
        if signed:
            value = bits.sign(h, spec.sign_bit) * value
        updates += [cell_id(layer, row, h, spec), value]
    return (
        hashed.select(*by, F.stack(F.lit(spec.rows), *updates).alias("cell", "value"))
        .filter(F.col("value") != 0)
        .groupBy(*by, "cell")
        .agg(F.sum("value").alias("value"))
    )


def count_keys(
    flows: DataFrame,
    spec: SketchSpec,
    *,
    by: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact row count ``n`` per key; hot keys are folded before the shuffle.

    The table is usually read twice, for cells and for candidates. The condition at
    the end always holds, as n is never 0, whatever ``extra`` comes to; it keeps all counters in
    use by every reader, so that their plans agree and Spark shuffles the counts once and
    reuses the exchange.
    """
    extra = extra or {}
    aggregates = [F.count(F.lit(1)).alias("n"), *[agg.alias(name) for name, agg in extra.items()]]
    counted = flows.groupBy(*by, *spec.keys).agg(*aggregates)
    return counted.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in extra], F.col("n") > 0))


def build(
    flows: DataFrame,
    spec: SketchSpec,
    *,
    signed: bool,
    weight: Column | None = None,
    layered: bool = False,
    by: Sequence[str] = (),
    pre_aggregate: bool = False,
) -> DataFrame:
    """Cells over all rows, one summary per value of ``by``.

    ``weight`` is what a row adds (1 by default). ``pre_aggregate`` counts each key
    first: worth its shuffle when the hash is costly and keys repeat a lot.
    """
    weight = F.lit(1) if weight is None else weight
    if pre_aggregate:
        flows = flows.groupBy(*by, *spec.keys).agg(F.sum(weight).alias("_n"))
        weight = F.col("_n")
    else:
        flows = flows.select(*by, *spec.keys, weight.cast("bigint").alias("_n"))
        weight = F.col("_n")
    hashed = with_hashes(flows, spec, layer_hash=layered)
    layer = None
    if layered:
        hashed = hashed.withColumn("_layer", deepest_layer(F.col("_hl"), spec))
        layer = F.col("_layer")
    flat = fold(hashed, spec, [weight] * spec.rows, signed=signed, layer=layer, by=by)
    return unnumber_cells(flat, spec, by)


def build_count_min(flows: DataFrame, spec: SketchSpec, **options) -> DataFrame:
    """One cell per row of the summary is raised for every input row."""
    return build(flows, spec, signed=False, **options)


def build_count_sketch(flows: DataFrame, spec: SketchSpec, **options) -> DataFrame:
    """As count-min, but every update carries the sign of its hash."""
    return build(flows, spec, signed=True, **options)


def merge(*cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cell-wise sum of summaries built with the same spec."""
    together = reduce(lambda a, b: a.unionByName(b), cells)
    return together.groupBy(*by, *CELL).agg(F.sum("value").alias("value"))


def nest_numbered(flat: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()) -> DataFrame:
    """:func:`nested` for numbered cells."""
    cell, step = F.col("cell"), F.lit(spec.layer_size).cast("bigint")
    credited = F.explode(F.sequence(F.pmod(cell, step), cell, step))
    return flat.select(*by, credited.alias("cell"), "value").groupBy(*by, "cell").agg(F.sum("value").alias("value"))


def nested(cells: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()) -> DataFrame:
    """Layers as subsets of each other: layer j holds every key whose deepest layer is j or more.

    Keys only update their deepest layer, so each cell is also credited to the
    layers above it.
    """
    return unnumber_cells(nest_numbered(number_cells(cells, spec, by), spec, by=by), spec, by)


def to_row_arrays(cells: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()) -> DataFrame:
    """One dense array of ``cols`` values per row of every layer.

    Rows are put together apart from each other: sorted cells of a row, zeros in the holes between them.
    """
    zero = F.lit(0).cast("bigint")
    numbered = number_cells(cells, spec, by)
    line, col = bits.row_of(F.col("cell"), spec.cols), bits.col_of(F.col("cell"), spec.cols)
    entries = numbered.select(*by, line.cast("int").alias("_line"), F.struct(col.cast("int").alias("col"), "value").alias("_e"))
    # Every row of every summary is there, with or without cells.
    groups = numbered.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    lines = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(spec.layers * spec.rows - 1))).alias("_line"))
    lines = lines.withColumn("_e", F.lit(None).cast(entries.schema["_e"].dataType))
    rows = entries.union(lines).groupBy(*by, "_line").agg(F.sort_array(F.collect_list("_e")).alias("_s"))

    def filled(entry: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_s"), i - 1)["col"])
        return F.concat(F.array_repeat(zero, entry["col"] - before - 1), F.array(entry["value"]))

    last = F.when(F.size("_s") == 0, F.lit(-1)).otherwise(F.element_at("_s", -1)["col"])
    whole = F.concat(F.flatten(F.transform("_s", filled)), F.array_repeat(zero, F.lit(spec.cols - 1) - last))
    return rows.select(
        *by, F.floor(F.col("_line") / spec.rows).cast("int").alias("layer"),
        F.pmod("_line", F.lit(spec.rows)).cast("int").alias("row"), whole.alias("values"),
    )


def to_dense(cells: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()) -> DataFrame:
    """One ``rows x cols`` matrix per layer."""
    arrays = to_row_arrays(cells, spec, by=by).groupBy(*by, "layer")
    found = arrays.agg(F.sort_array(F.collect_list(F.struct("row", "values"))).alias("_r"))
    return found.select(*by, "layer", F.transform("_r", lambda r: r["values"]).alias("values"))


def to_long(dense: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Matrices back to the non-zero cells."""
    return (
        dense.select(*by, "layer", F.posexplode("values").alias("row", "_row"))
        .select(*by, "layer", "row", F.posexplode("_row").alias("col", "value"))
        .filter(F.col("value") != 0)
    )
