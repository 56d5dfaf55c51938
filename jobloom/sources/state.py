"""State tables on plain Parquet: each change is a new version, and readers see whole versions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class StateTable:
    """A folder of versions. One writer at a time; a version counts once its ``_SUCCESS`` file is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{found[-1] if version is None else version}")

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write ``rows``, which may read the current version, as the next one."""
        new = (self.versions() or [0])[-1] + 1
        writer = rows.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/v{new}")
        return new

    def append(self, rows: DataFrame) -> int:
        return self.replace(self.read().unionByName(rows) if self.versions() else rows)

    def prune(self, keep: int = 2) -> list[int]:
        """Drop all but the latest versions; the dropped ones."""
        gone = self.versions()[:-keep]
        for v in gone:
            self._fs.delete(self._at(f"{self.path}/v{v}"), True)
        return gone
