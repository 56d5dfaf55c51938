"""Progress reports from a stream, kept as folded parts by batch, so that a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.plans.transitions import folded_parts, progress_parts
from jobloom.sources.state import StateTable

REPORTS = "job_id long, worker_id long, turn long, delta long, state string"
PARTS = "job_id long, worker_id long, key string, turn long, value string, delta long"


class Ledger:
    """A folder with the parts of each batch, and a table of versions in which older batches are folded together.

    A batch is written under its number and replaces what a failed try has left there. What the table covers is listed
    in the table itself, so a batch that comes again after it was folded isn't read twice. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folded = StateTable(spark, f"{path}/folded")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that are there and not yet folded."""
        if not self._fs.exists(self._at(f"{self.path}/batches")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/batches"))]
        return sorted(n for n in (int(x[2:]) for x in names if x.startswith("n=") and self._fs.exists(self._at(f"{self.path}/batches/{x}/_SUCCESS"))) if n > self.covered())

    def covered(self) -> int:
        """The last batch that is folded; -1 for none."""
        if not self.folded.versions():
            return -1
        return self.folded.read().agg(F.max("upto")).first()[0]

    def add(self, reports: DataFrame, number: int) -> None:
        """Reports (job_id, worker_id, turn, delta, state) of batch ``number``; one that was folded already is left out."""
        if number > self.covered():
            # Dealt before the parts are made: a task that reads a large file would sort all parts of it.
            folded_parts(progress_parts(reports.repartition("job_id", "worker_id"))).write.mode("overwrite").parquet(f"{self.path}/batches/n={number}")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that is there now; call it again for what came since."""
        stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def parts(self) -> DataFrame:
        """All reports folded, in the form that ``transitions.flush_parts`` takes. Batches may have come in any order."""
        found = [self.spark.read.schema(PARTS).parquet(f"{self.path}/batches/n={n}") for n in self.batches()]
        if self.folded.versions():
            found.append(self.folded.read().filter("job_id is not null").drop("upto"))
        whole = self.spark.createDataFrame([], PARTS)
        for part in found:
            whole = whole.unionByName(part)
        return folded_parts(whole)

    def compact(self) -> None:
        """Fold all batches into a new version of the table, then drop their folders."""
        done = self.batches()
        if not done:
            return
        mark = self.spark.createDataFrame([(None,) * 6], PARTS)  # so that a table without parts still says what it covers
        self.folded.replace(self.parts().unionByName(mark).withColumn("upto", F.lit(done[-1])))
        for n in done:
            self._fs.delete(self._at(f"{self.path}/batches/n={n}"), True)
        self.folded.prune()
