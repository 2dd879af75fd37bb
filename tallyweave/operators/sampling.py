"""Sampled updates: each (packet, row) slot updates its cell with probability p.

The gate of a slot is a hash of a natural packet id, so the same packets are
sampled however the input is partitioned or retried.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import kernels, numeric
from tallyweave.functions.bits import U32_MASK
from tallyweave.functions.hashing import md5_u32, with_hashes
from tallyweave.operators.cells import count_keys, deepest_layer, fold, unnumber_cells
from tallyweave.spec import SketchSpec


def gate_draws(
    spec: SketchSpec,
    packet_id: str,
    purpose: str = "row",
    count: int | None = None,
    seed: Column | None = None,
) -> list[Column]:
    """Repeatable uniform 32-bit values of a packet, one per row."""
    count = spec.rows if count is None else count
    seed = F.lit(spec.sample_seed) if seed is None else seed
    if spec.family in ("md5", "md5_rows"):
        digests = range((count + 3) // 4)
        draws = [draw for i in digests for draw in md5_u32(purpose, seed, i, F.col(packet_id))]
        return draws[:count]
    words = [F.xxhash64(F.lit(purpose), seed, F.lit(i), F.col(packet_id)) for i in range((count + 1) // 2)]
    halves = [half for w in words for half in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(U32_MASK)))]
    return halves[:count]


def gate_columns(spec: SketchSpec) -> list[str]:
    return [f"_g{r}" for r in range(spec.rows)]


def with_gates(packets: DataFrame, spec: SketchSpec, packet_id: str) -> DataFrame:
    """Add ``_g0..``, 1 where the slot of that row is sampled and 0 elsewhere."""
    threshold = numeric.threshold_u32(spec.p)
    draws = gate_draws(spec, packet_id)
    return packets.withColumns(
        {g: (draw < F.lit(threshold)).cast("int") for g, draw in zip(gate_columns(spec), draws)}
    )


def build_sampled(
    packets: DataFrame,
    spec: SketchSpec,
    packet_id: str,
    *,
    layered: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Count-sketch cells of the sampled slots, unscaled.

    Packets without a sampled slot are dropped before their key is hashed.
    """
    gated = with_gates(packets.select(*dict.fromkeys([*by, packet_id, *spec.keys])), spec, packet_id)
    sampled = gated.filter(reduce(lambda a, b: a + b, [F.col(g) for g in gate_columns(spec)]) > 0)
    hashed = with_hashes(sampled, spec, layer_hash=layered)
    layer = deepest_layer(F.col("_hl"), spec) if layered else None
    flat = fold(hashed, spec, [F.col(g) for g in gate_columns(spec)], signed=True, layer=layer, by=by)
    return unnumber_cells(flat, spec, by)


def count_sampled_keys(
    packets: DataFrame, spec: SketchSpec, packet_id: str, *, refresh_p: float | None = None
) -> DataFrame:
    """True count ``n`` and sampled updates per row of every key, in one aggregate.

    With ``refresh_p`` the column ``refreshes`` counts the packets that would have
    refreshed the heavy-hitter list.
    """
    gated = with_gates(packets, spec, packet_id)
    extra = {f"n{r}": F.sum(g) for r, g in enumerate(gate_columns(spec))}
    if refresh_p is not None:
        draw = gate_draws(spec, packet_id, "refresh", 1)[0]
        hit = (draw < F.lit(numeric.threshold_u32(refresh_p))).cast("int")
        extra["refreshes"] = F.sum(hit)
    return count_keys(gated, spec, extra=extra)


def build_from_counts(counts: DataFrame, spec: SketchSpec, *, layered: bool = False) -> DataFrame:
    """Numbered cells from the output of :func:`count_sampled_keys`."""
    hashed = with_hashes(counts, spec, layer_hash=layered)
    layer = deepest_layer(F.col("_hl"), spec) if layered else None
    return fold(hashed, spec, [F.col(f"n{r}") for r in range(spec.rows)], signed=True, layer=layer)


# Geometric skipping -----------------------------------------------------------

#: Packets per block of the geometric walk.
BLOCK_PACKETS = 64


def _numbers(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers as rows of little-endian bytes."""
    return values.astype(f"<i{width}").view(np.uint8).reshape(-1, width)


def gap_draws(blocks: np.ndarray, idx: int, spec: SketchSpec) -> np.ndarray:
    """Uniform 32-bit values, the ``idx``-th of every block: the upper half of Spark's ``xxhash64('gap', seed, block, idx)``."""
    if spec.family in ("md5", "md5_rows"):
        texts = (f"gap|{spec.sample_seed}|{block}|{idx}" for block in blocks.tolist())
        return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts], np.uint64)
    start = kernels.xxhash64(np.frombuffer(b"gap", np.uint8)[None], 42)
    start = kernels.xxhash64(_numbers(np.array([spec.sample_seed]), 4), start)
    found = kernels.xxhash64(_numbers(blocks, 8), np.repeat(start, len(blocks)))
    return kernels.xxhash64(_numbers(np.full(len(blocks), idx), 4), found) >> np.uint64(32)


def walk(blocks: np.ndarray, spec: SketchSpec) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``blocks``, slots) that geometric walks visit, each from before the first slot of its block to its end.

    A block has ``BLOCK_PACKETS * rows`` slots and gaps are at least 1. A block draws until it has reached its end, so the
    draws grow with p. The geometric law has no memory, hence a walk that restarts in every block
    samples the same way as an endless one, and any task can walk a block by itself.
    """
    slots = BLOCK_PACKETS * spec.rows
    going, at = np.arange(len(blocks)), np.full(len(blocks), -1, np.int64)
    found, visited = [going[:0]], [at[:0]]
    idx = 0
    while len(going):
        if spec.p < 1.0:
            uniform = (gap_draws(blocks[going], idx, spec) + 0.5) / 4294967296.0
            at = at + np.maximum(np.ceil(np.log(uniform) / math.log(1.0 - spec.p)), 1).astype(np.int64)
        else:
            at = at + 1
        going, at = going[at < slots], at[at < slots]
        found.append(going)
        visited.append(at)
        idx += 1
    return np.concatenate(found), np.concatenate(visited)


def geometric_slots(blocks: DataFrame, spec: SketchSpec, block: str = "block") -> DataFrame:
    """Sampled slots ``(ordinal, row)`` of every block."""

    @F.arrow_udf("array<int>")
    def visited(column: pa.Array) -> pa.Array:
        place, slot = walk(np.asarray(column), spec)
        order = np.lexsort((slot, place))
        ends = np.searchsorted(place[order], np.arange(len(column) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot[order], pa.int32()))

    found = blocks.where(F.col(block).isNotNull()).select(block, F.explode(visited(block)).alias("_at"))
    return found.select(
        (F.col(block) * BLOCK_PACKETS + F.floor(F.col("_at") / spec.rows)).alias("ordinal"),
        F.pmod(F.col("_at"), F.lit(spec.rows)).cast("int").alias("row"),
    )


def with_geometric_gates(packets: DataFrame, spec: SketchSpec, packet_id: str) -> DataFrame:
    """Gates as in :func:`with_gates`, drawn by geometric skipping over packet ids.

    Each record batch walks the blocks its packets are in; only ids go to Python, nothing is shuffled or joined. Packets that lie in
    the order of their ids share their walks. A packet without an id is not sampled.
    """

    @F.arrow_udf("int")
    def rows_hit(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        numbers = np.asarray(ids.fill_null(0).cast(pa.int64()))
        blocks, of = np.unique(numbers // BLOCK_PACKETS, return_inverse=True)
        place, slot = walk(blocks, spec)
        marks = np.zeros((len(blocks), BLOCK_PACKETS), np.int32)
        np.bitwise_or.at(marks, (place, slot // spec.rows), np.int32(1) << (slot % spec.rows).astype(np.int32))
        return pa.array(np.where(known, marks[of, numbers % BLOCK_PACKETS], 0), pa.int32())

    marked = packets.withColumn("_hit", rows_hit(F.col(packet_id).cast("bigint")))
    gates = {g: F.shiftright("_hit", r).bitwiseAND(F.lit(1)) for r, g in enumerate(gate_columns(spec))}
    return marked.withColumns(gates).drop("_hit")


def build_geometric(packets: DataFrame, spec: SketchSpec, packet_id: str) -> DataFrame:
    """Count-sketch cells of the slots a geometric walk visits."""
    gated = with_geometric_gates(packets.select(packet_id, *spec.keys), spec, packet_id)
    sampled = gated.filter(reduce(lambda a, b: a + b, [F.col(g) for g in gate_columns(spec)]) > 0)
    hashed = with_hashes(sampled, spec)
    return unnumber_cells(fold(hashed, spec, [F.col(g) for g in gate_columns(spec)], signed=True), spec)
