"""Saved summaries and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources import schemas as S


def write_cells(cells: DataFrame, path: str) -> None:
    """Save a summary; it is small, so one file is enough. The cells are summed in parallel first."""
    cells.repartition(1).write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CELLS).parquet(path)


def append_run_log(results: DataFrame, path: str, partition_by: tuple[str, ...] = ("p",)) -> None:
    """Append result rows as CSV, one folder per value of the partition columns."""
    results.write.mode("append").partitionBy(*partition_by).csv(path, header=False)
