"""Layered summaries: heavy hitters per layer and statistics computed from them.

A layer hash sends each key to its deepest layer; layer j of the nested view holds
about one key in 2^j. Functions of the whole frequency vector follow from the
heavy hitters of all layers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.hashing import with_hashes
from tallyweave.operators import topk
from tallyweave.operators.cells import build_count_sketch, count_keys, deepest_layer, fold, nest_numbered, number_cells
from tallyweave.operators.estimate import fold_median, probe
from tallyweave.session import stored
from tallyweave.spec import SketchSpec


def build_layered(flows: DataFrame, spec: SketchSpec, **options) -> DataFrame:
    """Count-sketch cells of every key's deepest layer."""
    return build_count_sketch(flows, spec, layered=True, **options)


def layers_of(keys: DataFrame, spec: SketchSpec) -> DataFrame:
    """Add the layer hash and the deepest layer of every key."""
    hashed = with_hashes(keys, spec, layer_hash=True)
    return hashed.select(
        *keys.columns, F.col("_hl").alias("layer_hash"), deepest_layer(F.col("_hl"), spec).alias("deepest")
    )


def heavy_hitters(
    candidates: DataFrame,
    nested_cells: DataFrame,
    spec: SketchSpec,
    *,
    k: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` largest estimates of every layer (and group of ``by``).

    ``candidates`` holds each key once. A key is a candidate in all layers down to
    its deepest, two on average. An estimate must be positive to be listed.
    """
    listed = estimates(candidates, nested_cells, spec, by=by)
    ranked = topk.top_per_group(
        listed, [*by, "layer"], topk.heap_order(spec), k or spec.heap_size, shard_on=spec.keys
    )
    return ranked.select(*by, "layer", "rank", "est", *spec.keys, "deepest")


def placed(candidates: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()) -> DataFrame:
    """Candidates with their hashes, one row for every ``layer`` down to their ``deepest``."""
    hashed = with_hashes(candidates.select(*by, *spec.keys), spec, layer_hash=True)
    hashed = hashed.withColumn("deepest", deepest_layer(F.col("_hl"), spec)).drop("_hl")
    return hashed.withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("deepest"))))


def estimates(
    candidates: DataFrame, nested_cells: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()
) -> DataFrame:
    """Positive estimates ``(by..., layer, est, keys..., deepest)`` of candidates in all their layers."""
    return _estimates(placed(candidates, spec, by=by), nested_cells, spec, by=by)


def _estimates(rows: DataFrame, nested_cells: DataFrame, spec: SketchSpec, *, by: Sequence[str]) -> DataFrame:
    probed = probe(rows, nested_cells, spec, layer=F.col("layer"), by=by)
    median = fold_median(spec)
    if spec.p < 1.0:
        median = median / F.lit(spec.p)
    listed = probed.select(*by, "layer", F.floor(median).cast("bigint").alias("est"), *spec.keys, "deepest")
    return listed.filter(F.col("est") > 0)


def summarize(
    flows: DataFrame, spec: SketchSpec, *, by: Sequence[str] = ()
) -> DataFrame:
    """Heavy hitters of all layers straight from flow rows, one list per group of ``by``.

    Keys are counted once; both the cells and the candidates come from that one
    shuffled table.
    """
    counts = count_keys(flows, spec, by=by)
    hashed = with_hashes(counts, spec, layer_hash=True)
    deepest = deepest_layer(F.col("_hl"), spec)
    cells = fold(hashed, spec, [F.col("n")] * spec.rows, signed=True, layer=deepest, by=by)
    return heavy_hitters(counts, nest_numbered(cells, spec, by=by), spec, by=by)


def sampling_rate(rows: int, spec: SketchSpec) -> int:
    """One in how many keys of the first layer makes its floor; layer j takes 2^j times as many.

    A layer's sample then has about ``rows / rate`` keys, and about ``rate * heap_size / 2^j`` keys of it reach the floor. The power
    of two at which both sums over layers are about equal moves the fewest keys.
    """
    best = math.sqrt(max(1, rows) * spec.layers / (2 * spec.heap_size))
    return 1 << max(0, round(math.log2(max(1.0, best))))


def floors(flows: DataFrame, nested_cells: DataFrame, spec: SketchSpec, rate: int) -> DataFrame:
    """``(layer, floor, floor_key)``: the last listed estimate and key among some keys of each layer.

    The list of all keys can only end higher, so what comes after this entry is in no list. A layer
    with fewer sampled keys than a list has places has no floor. At most one row per layer.
    """
    share = F.pmod(F.xxhash64(F.lit(spec.seed), *spec.keys), F.lit(rate))
    some = placed(flows, spec).where(share < F.expr("shiftleft(1L, layer)"))
    listed = _estimates(some.distinct(), nested_cells, spec, by=())
    ranked = topk.top_per_group(listed, ["layer"], topk.heap_order(spec), spec.heap_size, shard_on=spec.keys)
    last = ranked.where(F.col("rank") == spec.heap_size)
    return last.select(F.col("layer").alias("_layer"), F.col("est").alias("floor"), F.struct(*spec.keys).alias("floor_key"))


def summarize_pruned(flows: DataFrame, spec: SketchSpec) -> DataFrame:
    """What :func:`summarize` gives, without shuffling every key: for tables of which most keys are rare.

    The cells are folded where the rows are read. A sample of keys, the denser the deeper the layer, gives every layer
    a floor; a second pass estimates the rows as they are read and only keys that reach the floor are
    shuffled and ranked. Rows are estimated once for each of their layers, two on average, so tables
    of few keys that repeat a lot are better counted first.
    """
    if spec.p < 1.0:
        raise ValueError("sampled summaries are built from gates, not from all rows")
    flows = flows.select(*spec.keys)
    cells = stored(number_cells(build_layered(flows, spec), spec), "layered-cells")
    nested = stored(nest_numbered(cells, spec), "nested-cells")
    found = stored(floors(flows, nested, spec, sampling_rate(flows.count(), spec)), "floors")

    listed = estimates(flows, nested, spec).join(F.broadcast(found), F.col("layer") == F.col("_layer"), "left")
    level = (F.col("est") == F.col("floor")) & (F.struct(*spec.keys) <= F.col("floor_key"))
    reach = listed.where(F.col("floor").isNull() | (F.col("est") > F.col("floor")) | level)
    reach = reach.select("layer", "est", *spec.keys, "deepest").distinct()
    ranked = topk.top_per_group(reach, ["layer"], topk.heap_order(spec), spec.heap_size, shard_on=spec.keys)
    return ranked.select("layer", "rank", "est", *spec.keys, "deepest")


# Functions of one frequency, for gsum. ---------------------------------------


def g_distinct(x: Column) -> Column:
    return F.signum(x)


def g_l1(x: Column) -> Column:
    return x


def g_f2(x: Column) -> Column:
    return x * x


def g_entropy(x: Column) -> Column:
    """``x ln x``, 0 where it is not defined."""
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def gsum(heap: DataFrame, spec: SketchSpec, g: Callable[[Column], Column]) -> DataFrame:
    """Estimate of the sum of ``g(frequency)`` over all keys, as one row ``gsum``.

    The recursion over layers unrolls to one weighted sum over the heap: layer j
    counts 2^j times, and above the last layer a key that also lives one layer
    deeper counts negatively, because the doubled deeper layer has counted it.
    """
    layer = F.col("layer")
    last = layer == spec.layers - 1
    weight = F.when(~last & (F.col("deepest") > layer), F.lit(-1.0)).otherwise(F.lit(1.0))
    term = F.pow(F.lit(2.0), layer) * weight * g(F.col("est").cast("double"))
    return heap.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("gsum"))


def count_distinct(heap: DataFrame, spec: SketchSpec) -> DataFrame:
    """Estimated number of distinct keys, as one row ``distinct_keys``."""
    return gsum(heap, spec, g_distinct).select(F.col("gsum").alias("distinct_keys"))
