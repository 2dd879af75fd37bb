"""Small helpers around DataFrames for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a record batch on its way to a Python worker, unless the session sets its own: a worker and its executor
#: hold a few batches each, and whole partitions of texts would fit one of Spark's default size.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on the record batches of every partition. Workers live on after a task, so they give freed memory back."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return df.mapInArrow(run, T.StructType.fromDDL(schema))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on every record batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return map_batches(df, run, schema)


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows (a number the caller has counted), else as it is."""
    return F.broadcast(df) if rows <= limit else df


def id_text(column: str | Column) -> Column:
    """An id as text for hashing; null becomes the empty string."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
