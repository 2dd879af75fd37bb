"""Point estimates: probing cells with tables of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import bits, net, numeric
from tallyweave.functions.hashing import hash_columns, with_hashes
from tallyweave.operators.cells import cell_id, number_cells, to_dense
from tallyweave.operators.lookup import spread_join
from tallyweave.session import stored
from tallyweave.spec import SketchSpec

#: Summaries of up to this many cells (16 bytes each) are shipped to every task.
BROADCAST_CELLS = 1 << 20
#: Cells of a layer that are packed into one row at most.
PACKED_CELLS = 1 << 18


def probe(
    hashed: DataFrame, cells: DataFrame, spec: SketchSpec, *, layer: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``_v0.._v{rows-1}``, the cell each hash column points at.

    While the cells fit the broadcast bound there is one map-side equi-join per row against the same numbered cells, and the
    probing table is not shuffled. The spec bounds the cells of one summary; those of several (``by``) are counted. Beyond the
    bound the cells of a layer become one row of arrays, which the probing rows meet in one shuffle.
    """
    layer = F.lit(0) if layer is None else layer
    table = number_cells(cells, spec, by)
    if by:
        table = stored(table, "cells")
        bounded = table.count() <= BROADCAST_CELLS
    else:
        bounded = spec.cell_count <= BROADCAST_CELLS
    if not bounded and spec.layer_size <= PACKED_CELLS:
        return _probe_packed(hashed, table, spec, layer, by)
    hashed = hashed.withColumns(
        {f"_c{r}": cell_id(layer, r, F.col(h), spec) for r, h in enumerate(hash_columns(spec))}
    )
    for row in range(spec.rows):
        side = table.select(
            *[F.col(b).alias(f"_b_{b}") for b in by],
            F.col("cell").alias("_cell"),
            F.col("value").alias(f"_v{row}"),
        )
        matches = F.col(f"_c{row}") == F.col("_cell")
        for b in by:
            matches = matches & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        hashed = hashed.join(F.broadcast(side) if bounded else side, matches, "left")
        hashed = hashed.drop("_cell", f"_c{row}", *[f"_b_{b}" for b in by])
    return hashed.fillna(0, [f"_v{r}" for r in range(spec.rows)])


def _probe_packed(hashed: DataFrame, table: DataFrame, spec: SketchSpec, layer: Column, by: Sequence[str]) -> DataFrame:
    packed = to_dense(table, spec, by=by).withColumnsRenamed({"layer": "_layer", "values": "_cells"})
    found = spread_join(hashed.withColumn("_layer", layer.cast("int")), packed, [*by, "_layer"])
    at = {
        f"_v{r}": F.coalesce(F.get(F.get("_cells", F.lit(r)), bits.column_index(F.col(h), spec.cols)), F.lit(0))
        for r, h in enumerate(hash_columns(spec))
    }
    return found.withColumns(at).drop("_layer", "_cells")


def fold_minimum(spec: SketchSpec) -> Column:
    values = [F.col(f"_v{r}") for r in range(spec.rows)]
    return F.least(*values) if len(values) > 1 else values[0]


def fold_median(spec: SketchSpec) -> Column:
    """Median of the signed cells as a double."""
    return numeric.integer_median(
        [bits.sign(F.col(h), spec.sign_bit) * F.col(f"_v{r}") for r, h in enumerate(hash_columns(spec))]
    )


def _estimated(keys: DataFrame, cells: DataFrame, spec: SketchSpec, fold: Column, by) -> DataFrame:
    hashed = with_hashes(keys, spec)
    found = probe(hashed, cells, spec, by=by)
    return found.select(*[c for c in keys.columns], fold.alias("est"))


def estimate_min(
    keys: DataFrame, cells: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()
) -> DataFrame:
    """Count-min estimate ``est`` of every key row; never below the true count."""
    return _estimated(keys, cells, spec, fold_minimum(spec), by)


def estimate_median(
    keys: DataFrame,
    cells: DataFrame,
    spec: SketchSpec,
    *,
    floor: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Count-sketch estimate ``est`` of every key row, scaled up by the sampling rate.

    ``floor`` gives the integer form.
    """
    median = fold_median(spec)
    if spec.p < 1.0:
        median = median / F.lit(spec.p)
    if floor:
        median = F.floor(median)
    return _estimated(keys, cells, spec, median, by)


def parse_query_keys(queries: DataFrame) -> DataFrame:
    """Text 5-tuples to key columns; rows that do not parse get no answer."""
    parsed = {
        "src_ip": net.ip_to_long(F.col("src_ip")),
        "dst_ip": net.ip_to_long(F.col("dst_ip")),
        "proto": net.in_range_int(F.col("proto"), 255),
        "src_port": net.in_range_int(F.col("src_port"), 65535),
        "dst_port": net.in_range_int(F.col("dst_port"), 65535),
    }
    return queries.withColumns(parsed).dropna(subset=list(parsed))
