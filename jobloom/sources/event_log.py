"""A log of events in a shared folder as a Spark data source: streams write batches to it and follow it by position.

Writers leave files under names of their own; a batch counts once its manifest is there, which lists its files and their
positions in the log. So an attempt that failed leaves no line behind, and a batch that is committed twice is there once.
Readers keep the position up to which they have read as their offset. Where the log can't be reached, they report the
position they had and try again after a pause that doubles. One stream writes to a log at a time.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

EVENT = "id long, channel string, payload string"
SCHEMA = f"position long, {EVENT}"
#: Columns of a file of rows, an Arrow stream.
_STORED = pa.schema([("id", pa.int64()), ("channel", pa.string()), ("payload", pa.string())])
FIRST_PAUSE, LONGEST_PAUSE = 0.5, 60.0
#: Rows that a reading task takes, in whole files.
TASK_ROWS = 100_000


class Log:
    """Manifests and files of a log; any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def manifests(self) -> list[dict]:
        """In the order of positions, whatever order the folder lists them in; the last one's end is the log's. Raises OSError if
        the log is away."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/batches", allow_not_found=False))
        out = [json.loads(self.read(f.path)) for f in found if f.base_name.endswith(".json")]
        # A batch without rows starts where the next one does, and comes before it.
        return sorted(out, key=lambda m: (m["start"], m["end"]))

    def make(self) -> None:
        for part in ("batches", "rows"):
            self.fs.create_dir(f"{self.path}/{part}", recursive=True)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        with self.fs.open_output_stream(path) as f:
            f.write(data)

    def drop(self, names: list[str]) -> None:
        for name in names:
            try:
                self.fs.delete_file(f"{self.path}/rows/{name}")
            except OSError:
                pass  # gone already

    def commit(self, batch: int, files: list[dict]) -> None:
        """The manifest of a batch; its rows come after all that is there. A batch that has one keeps it."""
        known = self.manifests()
        if any(m["batch"] == batch for m in known):
            self.drop([f["name"] for f in files])
            return
        start = known[-1]["end"] if known else 0
        at, listed = start, []
        for f in files:
            listed.append(f | {"start": at})
            at += f["rows"]
        there = f"{self.path}/batches/{batch:012d}"
        self.write(f"{there}.tmp", json.dumps({"batch": batch, "start": start, "end": at, "files": listed}).encode())
        self.fs.move(f"{there}.tmp", f"{there}.json")


@dataclass
class Wrote(WriterCommitMessage):
    name: str
    rows: int


@dataclass
class Files(InputPartition):
    files: list
    start: int
    end: int

    def __init__(self, files: list, start: int, end: int) -> None:
        super().__init__(None)
        self.files, self.start, self.end = files, start, end


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        Log(path).make()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, rows = f"{uuid.uuid4().hex}.arrow", 0
        log = Log(self.path)
        with contextlib.ExitStack() as stack:
            out = None
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = stack.enter_context(pa.ipc.new_stream(stack.enter_context(log.fs.open_output_stream(f"{log.path}/rows/{name}")), _STORED))
                out.write_batch(pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in _STORED], schema=_STORED))
                rows += batch.num_rows
        return Wrote(name, rows)

    def commit(self, messages: list, batchId: int) -> None:
        files = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        Log(self.path).commit(int(batchId), files)

    def abort(self, messages: list, batchId: int) -> None:
        Log(self.path).drop([m.name for m in messages if m is not None and m.rows])


def _rows(path: str, part: Files, after: int, channel: str | None) -> Iterator[pa.RecordBatch]:
    log = Log(path)
    for f in part.files:
        at = f["start"]
        with log.fs.open_input_stream(f"{log.path}/rows/{f['name']}") as data, pa.ipc.open_stream(data) as stored:
            for batch in stored:
                place = pa.array(range(at, at + batch.num_rows), type=pa.int64())
                at += batch.num_rows
                row_id, where, payload = batch.columns
                keep = pc.and_(pc.greater_equal(place, part.start), pc.less(place, part.end))
                keep = pc.and_(keep, pc.fill_null(pc.greater(row_id, after), True))
                if channel is not None:
                    keep = pc.and_(keep, pc.fill_null(pc.equal(where, channel), False))
                yield pa.RecordBatch.from_arrays([place, row_id, where, payload], names=["position", *_STORED.names]).filter(keep)


def _parts(manifests: list[dict], start: int, end: int) -> list[Files]:
    files = [f for m in manifests for f in m["files"] if f["start"] < end and f["start"] + f["rows"] > start]
    out, held, size = [], [], 0
    for f in files:
        held.append(f)
        size += f["rows"]
        if size >= TASK_ROWS:
            out.append(Files(held, start, end))
            held, size = [], 0
    return [*out, Files(held, start, end)] if held else out


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, after: int, channel: str | None) -> None:
        self.path, self.after, self.channel = path, after, channel
        self.seen, self.pause, self.not_before = 0, 0.0, 0.0

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        if time.monotonic() >= self.not_before:
            try:
                found = Log(self.path).manifests()
                self.seen, self.pause = max(self.seen, found[-1]["end"] if found else 0), 0.0
            except OSError:
                self.pause = min(LONGEST_PAUSE, self.pause * 2 or FIRST_PAUSE)
                self.not_before = time.monotonic() + self.pause
        return {"position": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.seen = max(self.seen, end["position"])
        return _parts(Log(self.path).manifests(), start["position"], end["position"])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.after, self.channel)


class _Reader(DataSourceReader):
    def __init__(self, path: str, after: int, channel: str | None) -> None:
        self.path, self.after, self.channel = path, after, channel

    def partitions(self) -> list[Files]:
        found = Log(self.path).manifests()
        return _parts(found, 0, found[-1]["end"] if found else 0) or [Files([], 0, 0)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.after, self.channel)


class EventLog(DataSource):
    """Options: ``path``; for readers ``after``, the last id that was seen, and ``channel``."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple:
        return self.options["path"], int(self.options.get("after", -1)), self.options.get("channel")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._options())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self.options["path"])


def publish(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All events (id, channel, payload) that the stream has now, each micro-batch as one batch of the log."""
    stream.sparkSession.dataSource.register(EventLog)
    Log(path).make()
    query = stream.selectExpr("cast(null as long) as position", "id", "channel", "payload").writeStream.format("event_log").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def follow(spark: SparkSession, path: str, after: int = -1, channel: str | None = None) -> DataFrame:
    """The log as a stream: events with ids beyond ``after``, of one channel if it is given."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").option("path", path).option("after", str(after))
    return (reader if channel is None else reader.option("channel", channel)).load()


def read(spark: SparkSession, path: str, after: int = -1, channel: str | None = None) -> DataFrame:
    spark.dataSource.register(EventLog)
    reader = spark.read.format("event_log").option("path", path).option("after", str(after))
    return (reader if channel is None else reader.option("channel", channel)).load()
