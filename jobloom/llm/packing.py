"""Packing in space-filling-curve order.

A document's vector is the mean of fixed random directions of its token ids, projected to ``DIMS`` dimensions. Each
dimension is cut at quantiles into ``2**BITS`` cells, and the cell's place on a Hilbert curve is the document's key.
Documents are dealt to ranges of the key, sorted by it, and neighbours along the curve are laid end to end into
sequences of ``LENGTH`` tokens. What is left at the end of a range goes into sequences whose lengths are its binary
digits: lengths that are powers of two need no padding, so nothing is padded at all.

A key that fills several ranges, such as that of many copies, is spread over all of them by a hash of the id.

Quantiles and the bounds of ranges come from at most ``SAMPLE`` documents or ``RANGE_SAMPLE`` for each range, whichever is
more (those whose hashed id comes first). They shape the order and the balance of ranges only; every document is packed
whole.

Cases: null text counts as empty, and an empty text is one token, the closing id; rows that are equal in key, id and
text stand in any order; longer documents are cut over as many sequences as they need; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import slices, table, text_of
from jobloom.llm.tokens import VOCABULARY, encode

LENGTH = 1024
DIMS = 3
BITS = 10
SAMPLE = 4096
#: Documents sampled for each range: 3.2 million rows of 32 bytes on the driver for 100,000 ranges.
RANGE_SAMPLE = 32
END_ID = 0
IDS = 1 << 16
_SEED = 5


def _directions() -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((IDS, DIMS)).astype(np.float32)


_DIRECTIONS = _directions()


def vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Mean direction of each document's ids; every document has one id at least."""
    sizes = np.array([len(x) for x in ids])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(_DIRECTIONS[np.concatenate(ids)], starts, axis=0, dtype=np.float64) / sizes[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of cells on the Hilbert curve (Skilling's transpose, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def keys(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return hilbert(np.stack([np.searchsorted(edges[i], v[:, i], side="right") for i in range(DIMS)], axis=1))


def _encoded(text: str, name: str) -> np.ndarray:
    return np.append(encode(text, name), np.uint32(END_ID))


def _sampled(docs: DataFrame, name: str, most: int) -> np.ndarray:
    """Vectors and lengths of a bounded sample: DIMS + 1 numbers for each of at most 2 * most rows reach the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    few = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(few), "doc_id", "left_semi").select("text").limit(2 * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                ids = [_encoded(t.as_py(), name) for t in batch.column(0)]
                v = vectors(ids)
                yield pa.RecordBatch.from_arrays([*[pa.array(v[:, i]) for i in range(DIMS)], pa.array([float(len(x)) for x in ids])], names=[*[f"v{i}" for i in range(DIMS)], "n"])

    found = texts.mapInArrow(run, ", ".join(f"v{i} double" for i in range(DIMS)) + ", n double").toArrow()
    rows = np.stack([found.column(i).to_numpy() for i in range(DIMS + 1)], axis=1)
    return rows[np.lexsort(rows.T[::-1])]


def range_bounds(key: np.ndarray, tokens: np.ndarray, parts: int) -> np.ndarray:
    """Keys that cut the sample into parts of as many tokens."""
    order = np.argsort(key, kind="stable")
    reached = np.cumsum(tokens[order])
    at = np.searchsorted(reached, np.arange(1, parts) / parts * reached[-1])
    return key[order][at]


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences for the last ``n`` tokens of a range: its binary digits, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if n >> b & 1]


class _Writer:
    """Lays documents end to end. The open sequence's pieces wait, as the last one may be cut shorter."""

    def __init__(self, part: int) -> None:
        self.next, self.open, self.room, self.rows = part << 40, [], LENGTH, []

    def piece(self, doc_id, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

    def _full(self, pieces: list, length: int) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.piece(doc_id, start, ids, total, self.next, offset)
            offset += len(ids)
        assert offset == length
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            take = min(self.room, total - at)
            self.open.append((doc_id, at, ids[at : at + take], total))
            at, self.room = at + take, self.room - take
            if not self.room:
                self._full(self.open, LENGTH)
                self.open, self.room = [], LENGTH

    def close(self) -> None:
        waiting = self.open[::-1]
        for length in cut_lengths(LENGTH - self.room):
            room, now = length, []
            while room:
                doc_id, start, ids, total = waiting.pop()
                if len(ids) > room:
                    waiting.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                now.append((doc_id, start, ids, total))
                room -= len(ids)
            self._full(now, length)
        self.open, self.room = [], LENGTH

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=NAMES)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def packed(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """One row of ``SCHEMA`` for each piece. A sequence's length is the sum of its pieces; none is padded."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _sampled(docs, name, max(SAMPLE, RANGE_SAMPLE * parts))
    sample, tokens = found[:, :DIMS], found[:, DIMS]
    cells = np.arange(1, 1 << BITS) / (1 << BITS)
    edges = np.quantile(sample, cells, axis=0).T if len(sample) else np.zeros((DIMS, len(cells)))
    bounds = range_bounds(keys(sample, edges), tokens, parts) if len(sample) else np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            ids = [_encoded(t.as_py(), name) for t in batch.column(1)]
            key = keys(vectors(ids), edges)
            low, high = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
            salt = np.array([zlib.crc32(str(d).encode()) for d in batch.column(0).to_pylist()], dtype=np.int64)
            part = (low + salt % (high - low + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key), batch.column(0), pa.array([x.astype("<u2").tobytes() for x in ids], type=pa.binary())], names=["part", "key", "doc_id", "ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, here = None, None
        for batch in batches:
            for part, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != here:
                    if writer:
                        writer.close()
                        yield writer.taken()
                    writer, here = _Writer(part), part
                writer.add(doc_id, np.frombuffer(ids.as_py(), dtype="<u2"))
                if len(writer.rows) >= 8192:
                    yield writer.taken()
        if writer:
            writer.close()
            yield writer.taken()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "part int, key long, doc_id long, ids binary")
    dealt = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "doc_id")
    return dealt.select("part", "doc_id", "ids").mapInArrow(lay, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
