"""Summaries over streams of flow rows.

Sums of cells commute with the order of arrival, so a stream ends with the same
cells as a batch job over the same rows. State is bounded by the number of cells
(times the open windows), not by the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.functions.hashing import with_hashes
from tallyweave.operators.cells import build, deepest_layer, fold, nest_numbered, unnumber_cells
from tallyweave.operators.frequent import keep_frequent
from tallyweave.operators.layered import heavy_hitters
from tallyweave.operators.rates import counter_aggregates
from tallyweave.sources import schemas as S
from tallyweave.spec import SketchSpec
from tallyweave.streaming.tables import FoldedTable, VersionedTable


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_cells(
    stream: DataFrame,
    spec: SketchSpec,
    table: VersionedTable,
    checkpoint: str,
    *,
    signed: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Accumulate one summary for ever; ``table`` holds its current cells."""
    cells = build(stream, spec, signed=signed)
    writer = cells.writeStream.outputMode("complete").foreachBatch(lambda df, batch: table.write(df, batch))
    return _start(writer, checkpoint, trigger)


def windowed_cells(
    stream: DataFrame, spec: SketchSpec, window: str, delay: str, *, signed: bool = False
) -> DataFrame:
    """One summary per tumbling event-time window, as a streaming DataFrame."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.withColumn("window", F.window("ts", window))
    return build(timed, spec, signed=signed, by=("window",))


def start_windowed_cells(
    stream: DataFrame,
    spec: SketchSpec,
    table: FoldedTable,
    checkpoint: str,
    *,
    window: str,
    delay: str,
    signed: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Add the cells of every window to ``table`` once the watermark has passed it; see :func:`read_windowed_cells`."""
    return start_final(windowed_cells(stream, spec, window, delay, signed=signed), table, checkpoint, trigger=trigger)


def start_final(result: DataFrame, table: FoldedTable, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Store rows of a streaming aggregate when they are final; open windows are only in the state."""
    return _start(result.writeStream.outputMode("append").foreachBatch(table.write), checkpoint, trigger)


def start_updates(result: DataFrame, table: FoldedTable, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Store the changed rows of a streaming aggregate; ``table`` keeps the last row of every key."""
    return _start(result.writeStream.outputMode("update").foreachBatch(table.write), checkpoint, trigger)


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch whose state can be read."""
    return spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId")).first()[0]


def read_state(spark: SparkSession, checkpoint: str, values: Sequence[str], *, batch: int | None = None) -> DataFrame:
    """Groups of the streaming aggregate of a checkpoint, and their sums under the names ``values``, as the last
    committed micro-batch (or ``batch``) left them. The query may be running: it is neither stopped nor asked."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint)
    sums = [F.col(f"value.{f.name}").alias(name) for f, name in zip(state.schema["value"].dataType, values, strict=True)]
    return state.select("key.*", *sums)


def state_cells(spark: SparkSession, checkpoint: str, spec: SketchSpec) -> DataFrame:
    """Current cells of a summary that :func:`start_cells` is building."""
    return unnumber_cells(read_state(spark, checkpoint, ["value"]), spec)


def read_windowed_cells(spark: SparkSession, table: FoldedTable, checkpoint: str, spec: SketchSpec) -> DataFrame:
    """Cells of all windows as of one micro-batch: final ones from the table, open ones from the state."""
    batch = committed_batch(spark, checkpoint)
    still_open = unnumber_cells(read_state(spark, checkpoint, ["value"], batch=batch), spec, ("window",))
    return table.read(batch).unionByName(still_open)


def interval_counters(stream: DataFrame, interval: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Packets and bytes per interval, as a streaming DataFrame."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", interval).alias("window")).agg(*counter_aggregates())


def start_heavy_hitters(
    stream: DataFrame,
    spec: SketchSpec,
    cells: VersionedTable,
    heap: VersionedTable,
    pool: VersionedTable,
    checkpoint: str,
    *,
    pool_size: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep cells and the heavy-hitter list of every layer current.

    Candidates are the keys of ``pool``, which keeps frequent keys of every layer in bounded space, and the listed ones:
    a key that makes up more than 1 / (``pool_size`` + 1) of the packets of a layer is always among them, whenever it came. Their
    estimates come from the merged cells, stored in numbered form. ``heap`` is rewritten last. A micro-batch is read
    once, to count its keys.
    """
    size = pool_size or 16 * spec.heap_size

    def update(df: DataFrame, batch: int) -> None:
        counts = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n")).persist()
        try:
            hashed = with_hashes(counts, spec, layer_hash=True).withColumn("deepest", deepest_layer(F.col("_hl"), spec))
            added = fold(hashed, spec, [F.col("n")] * spec.rows, signed=True, layer=F.col("deepest"))
            in_layers = hashed.select(F.explode(F.sequence(F.lit(0), "deepest")).alias("layer"), *spec.keys, "n")
            if batch > 0:
                both = added.unionByName(cells.read(batch - 1))
                added = both.groupBy("cell").agg(F.sum("value").alias("value"))
                in_layers = in_layers.unionByName(pool.read(batch - 1))
            cells.write(added, batch)
            pool.write(keep_frequent(in_layers, spec.keys, size, by=("layer",)), batch)
        finally:
            counts.unpersist()
        candidates = pool.read(batch).select(*spec.keys)
        if batch > 0:
            candidates = candidates.unionByName(heap.read(batch - 1).select(*spec.keys))
        current = nest_numbered(cells.read(batch), spec)
        heap.write(heavy_hitters(candidates.distinct(), current, spec), batch)

    return _start(stream.writeStream.foreachBatch(update), checkpoint, trigger)


def start_tee(
    stream: DataFrame,
    count: Callable[[DataFrame, int], None],
    forward_path: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Count packets and forward the counted ones: ``count`` sees every micro-batch."""

    def handle(df: DataFrame, batch: int) -> None:
        df.persist()  # read once for both
        try:
            count(df, batch)
            forwarded = df.filter(F.col("verdict") == S.COUNTED)
            forwarded.write.mode("overwrite").parquet(f"{forward_path}/batch={batch}")
        finally:
            df.unpersist()

    return _start(stream.writeStream.foreachBatch(handle), checkpoint, trigger)
