"""Tables that a stream writes after every micro-batch: small ones that it rewrites, and ones that grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Folders:
    """Numbered folders below a path; only complete ones, with a commit marker, count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """Complete folders, lowest number first."""
        path, files = self._files()
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in found if files.exists(marker(f"{self.folder(kind, n)}/_SUCCESS"))]

    def delete(self, kind: str, number: int) -> None:
        _, files = self._files()
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(kind, number)), True)


class VersionedTable:
    """The versions of a small result, one folder each.

    A version is the id of the micro-batch that made it. A batch that is run again after a failure overwrites its
    own folder only. Readers take the newest version whose commit marker is there, so they never see half a
    version, and one they hold stays until ``keep`` newer ones are written.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 8) -> None:
        self.spark = spark
        self.path = path
        self.keep = keep
        self._folders = _Folders(spark, path)

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return self._folders.numbers("version")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._folders.folder("version", version))
        for old in self.versions()[: -self.keep]:
            self._folders.delete("version", old)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._folders.folder("version", version))

    def latest(self) -> DataFrame:
        return self.read(self.versions()[-1])


class FoldedTable:
    """Rows of all micro-batches, of which earlier ones are folded together.

    A micro-batch writes a folder of its own, named by its id, so one that is run again replaces its own rows only. When ``every`` of
    them have come together, those before the running one (which are committed) become one base, so that reading takes a
    base and no more than ``every`` + 1 folders, whatever the number of batches. With ``keys`` only the last row of a key
    counts, and older ones go with the folding; without, all rows stay. What a base has taken in is deleted one
    folding later, so that readers keep what they hold.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), every: int = 16) -> None:
        self.spark = spark
        self.keys = list(keys)
        self.every = every
        self._folders = _Folders(spark, path)

    def _sources(self, upto: int | None = None) -> tuple[int, list[str]]:
        """The newest base, and the folders that make the table up to a batch."""
        bases = [b for b in self._folders.numbers("base") if upto is None or b <= upto]
        base = bases[-1] if bases else -1
        parts = [b for b in self._folders.numbers("batch") if b > base and (upto is None or b <= upto)]
        found = [self._folders.folder("base", base)] if bases else []
        return base, found + [self._folders.folder("batch", b) for b in parts]

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*folders)
        if not self.keys:
            return rows
        values = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        last = F.max_by(F.struct(*values, "_batch"), "_batch")
        return rows.groupBy(*self.keys).agg(last.alias("_last")).select(*self.keys, "_last.*")

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as of now, or as batch ``upto`` left it (one of the last ``every`` batches)."""
        return self._read(self._sources(upto)[1]).drop("_batch")

    def write(self, df: DataFrame, batch: int) -> None:
        before, folders = self._sources(batch - 1)
        if len(folders) - (before >= 0) >= self.every:
            self._read(folders).write.mode("overwrite").parquet(self._folders.folder("base", batch - 1))
            for kind in ("base", "batch"):
                for old in self._folders.numbers(kind):
                    if old < before or (kind == "batch" and old == before):
                        self._folders.delete(kind, old)
        df.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(self._folders.folder("batch", batch))
