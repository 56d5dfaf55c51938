"""WARC archives as a chunked record table.

``chunked`` cuts payloads into rows of at most ``CHUNK`` bytes, ``write_archives`` streams these into gzip-compressed WARC/1.1 files, one member per record; ``read_chunks`` streams
files back as rows (record_id, chunk_no, payload, ...) of at most ``CHUNK`` bytes, by the standard heads alone, so that
archives of other writers can be read as well. A record's name is a custom UUID (version 8) that holds the page's id, so
no head line of our own is needed; names of another kind have no page_id. A digest and a byte count run along
with the chunks and stand complete on the last one, so no record is ever held whole by the reader. Files live in the
folder that driver and executors share and are reached through Arrow's file systems (local folders, object stores,
HDFS), never through a task's own disk.

Records with equal payloads of at least ``LEAST_BYTES``: the one with the smallest page_id is a response, the others
revisit it. Smaller ones are all responses.

A task that runs again writes a file of another name; only files that a finished task reports are in the manifest,
which is a table in the shared folder.

Cases: null html is an empty payload; control characters in urls are percent-coded; repeated rows of the smallest
page_id are responses each; rows without page_id revisit the smallest page_id of their payload, or are responses if
there is none. Extra columns are ignored. Records of any type are read; one without an HTTP block is its block, one without
a stated SHA-256 has none to be held against. Very long payloads are read and written in chunks; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import new_path, table, written

LEAST_BYTES = 100
CHUNK = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: The first 48 bits of our records' names, which tell them from others.
_MARK = int.from_bytes(hashlib.sha256(b"page records").digest()[:6], "big")
_NAME = "<urn:uuid:"


def record_id(page_id) -> str:
    """A page's record name: mark, version, whether there is an id with its upper two bits, variant, its lower 62 bits."""
    bits = 0 if page_id is None else (1 << 64) | (page_id & (1 << 64) - 1)
    return f"{_NAME}{uuid.UUID(int=_MARK << 80 | 8 << 76 | bits >> 62 << 64 | 2 << 62 | bits & (1 << 62) - 1)}>"


def page_of(name: str | None) -> int | None:
    """The page id in a record's name, or None."""
    try:
        bits = uuid.UUID((name or "").removeprefix(_NAME).removesuffix(">")).int
    except ValueError:
        return None
    if bits >> 76 != _MARK << 4 | 8 or not bits >> 66 & 1:
        return None
    page_id = (bits >> 64 & 3) << 62 | bits & (1 << 62) - 1
    return page_id - (1 << 64) if page_id >> 63 else page_id


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to). Payloads are joined with decisions once."""
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    # Digests of payloads that occur once need no decision, so only the others are joined, by digest.
    large = rows.filter(F.octet_length("payload") >= LEAST_BYTES).select("payload_digest", "page_id")
    shared = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1")
    shared = shared.select(F.col("payload_digest").alias("shared_digest"), "first_id")
    joined = rows.join(shared, F.col("payload_digest") == F.col("shared_digest"), "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"))


def _head(page_id, url: str | None, kind: str, digest: str, refers_to, block: int) -> bytes:
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Decided rows as chunk rows: chunk_no from 0, ``chunks`` of them, payload cut to ``chunk`` bytes; a revisit has
    one without payload. The chunks of a record follow each other."""
    size = F.octet_length("payload")
    n = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(size / chunk))).cast("int")
    out = rows.withColumn("payload_bytes", size.cast("long")).withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return out.select("page_id", "url", "payload_digest", "record_type", "refers_to", "payload_bytes", "chunks", "chunk_no", part.alias("payload"))


def write_archives(rows: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Manifest (file, records, bytes) of the files written below ``folder``. A task holds chunks, never a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, records, size, gz = None, None, 0, 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, digest, kind, refers_to, total, chunks, no = (batch.column(i)[at].as_py() for i in range(8))
                data = memoryview(batch.column(8)[at].as_buffer() or b"")
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                parts = []
                if no == 0:
                    gz, http = zlib.compressobj(1, zlib.DEFLATED, 31), _HTTP % total
                    block = len(http) + (total if kind == "response" else 0)
                    parts.append(gz.compress(_head(page_id, url, kind, digest, refers_to, block) + http))
                parts.append(gz.compress(data))
                if no == chunks - 1:
                    parts += [gz.compress(b"\r\n\r\n"), gz.flush()]
                    records += 1
                for x in parts:
                    out.write(x)
                    size += len(x)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], type=pa.int64()), pa.array([size], type=pa.int64())], names=["file", "records", "bytes"])

    return chunked(rows, chunk).mapInArrow(run, "file string, records long, bytes long")


class Reader:
    """Records of one archive as chunks; memory is one chunk and one compressed block."""

    def __init__(self, stream, chunk: int = CHUNK) -> None:
        self.stream, self.chunk, self.buffer, self.gz, self.rest, self.done = stream, chunk, bytearray(), zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while True:
            if self.gz.eof:
                self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            data = self.gz.unconsumed_tail or self.rest or self.stream.read(self.chunk)
            self.rest = b""
            if not data:
                return False
            if got := self.gz.decompress(bytes(data), self.chunk):
                self.buffer += got
                return True

    def _until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a head")
                return None
        head = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return head

    def _take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def _http(self, left: int) -> int:
        """Take an HTTP head off a block of ``left`` bytes; its length, or that of the block if it doesn't end there."""
        while (at := self.buffer.find(b"\r\n\r\n", 0, left)) < 0 and len(self.buffer) < left:
            if not self._more():
                raise ValueError("the archive ends within a record")
        taken = at + 4 if at >= 0 else left
        del self.buffer[:taken]
        return taken

    def __iter__(self) -> Iterator[tuple]:
        """Rows of ``CHUNK_SCHEMA``; the digest is on a record's last chunk."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in head.decode(errors="replace").split("\r\n")[1:])}
            left = int(fields["content-length"])
            name, kind, refers = fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-refers-to")
            if fields.get("content-type", "").startswith("application/http"):
                left -= self._http(left)
            stated = fields.get("warc-payload-digest", "")
            stated = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
            running, size, no = hashlib.sha256(), 0, 0
            while True:
                data = self._take(min(self.chunk, left))
                left -= len(data)
                running.update(data)
                size += len(data)
                yield name, page_of(name), kind, page_of(refers), stated, no, data, not left, size, running.hexdigest() if not left else None
                no += 1
                if not left:
                    break
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record is longer than its head says")


_CHUNKS = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("chunk_no", pa.int64()), ("payload", pa.binary()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest", pa.string())]
CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to long, stated_digest string, chunk_no long, payload binary, last boolean, bytes_so_far long, digest string"


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The record table of the manifest's files; without ``payloads`` the digests run but bytes aren't passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], names=[n for n, _ in _CHUNKS])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for row in Reader(stream, chunk):
                        if not payloads:
                            row = (*row[:6], None, *row[7:])
                            if not row[7]:
                                continue
                        rows.append(row)
                        held += len(row[6] or b"")
                        if held >= 8 * CHUNK or len(rows) >= 4096:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return manifest.select("file").mapInArrow(run, CHUNK_SCHEMA)


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write all pages; manifest and folder."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    return written(write_archives(decided(pages), folder), "warc-manifest"), folder


def report(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives say.

    Digests are those computed while reading; a record whose stated digest differs stops the query. A revisit takes
    size and digest from the response that it refers to.
    """
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    records = read_chunks(manifest.repartition(parts, "file"), folder, payloads=False)
    right = F.when((F.col("record_type") != "response") | F.col("stated_digest").isNull() | (F.col("digest") == F.col("stated_digest")), F.col("digest")).otherwise(F.raise_error(F.lit("a payload digest differs from its head")))
    records = written(records.withColumn("digest", right).select("page_id", "record_type", "refers_to", "stated_digest", "bytes_so_far", "digest"), "warc-records")
    responses = records.filter("record_type = 'response'").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    revisits = records.filter("record_type = 'revisit'")
    # Any response of the referred page with the stated digest will do; repeated rows are equal.
    origin = responses.groupBy("page_id", "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes")).select(F.col("page_id").alias("origin"), F.col("payload_digest").alias("origin_digest"), "payload_bytes")
    met = revisits.join(origin, (F.col("refers_to") == F.col("origin")) & (F.col("stated_digest") == F.col("origin_digest")), "left")
    return responses.unionByName(met.select("page_id", "payload_bytes", F.col("origin_digest").alias("payload_digest"), "record_type", "refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*archived(table(spark, sf_dir, "pages")))


ORACLE = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
m as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when m.first_id is not null and m.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when m.first_id is not null and m.first_id <> p.page_id then m.first_id end as refers_to
from p left join m using (payload_digest)
"""
