"""SimHash near-duplicates, searched with a Gray-order hierarchical index.

A fingerprint bit is set if more than half of the XXH64 hashes (seed 42) of a text's word shingles have it.
Fingerprints link at ``DISTANCE`` or fewer differing bits; documents of linked fingerprints form a component.

Search: equal fingerprints are first collapsed. The rest are sorted by Gray rank over the whole table and cut into
ranges of neighbours. A node of the index is a group of neighbours: it holds the bits on which everything below agrees,
and of these only the ones that its parent lacks. The upper nodes lead to ``PARTS`` groups in each range; each range has a tree of its own.
Every fingerprint goes from the root through the upper nodes, adding up its differences, and is sent to those ranges
only that it can still reach, there down the range's tree, and leaves a group as soon as the differences pass the
distance. A pair is looked for once, from the range that comes first.

A fingerprint that meets more than ``DENSE`` others in a range is not paired with all of them: these are explored as a
forest, in which what has been found leaves the index. So links span the same components as all pairs would, and their
number grows with the rows. The number of ranges follows the number of fingerprints (``RANGE_ROWS`` to each, or up to
``LEAST_RANGES`` smaller ones); the driver and each task hold ``PARTS`` patterns and masks for each range, 1 KB.
A fingerprint of eight bytes is sent to the ranges that it can reach, itself and later ones: of a table of 10^4 to one or two,
of one of 10^9 at random to some seventy, as 8 bits of a range settle little against a distance of four.

Cases: null text counts as empty; a text without words has fingerprint zero and links like any other; texts of fewer
words than a shingle have one shingle; very long texts
are hashed whole, in eight bytes a shingle. Rows without id get the
smallest id of their component, null if none has one. Repeated rows keep one result each; equal texts are one
fingerprint, so ties need no rule. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import slices, table, text_of, written
from jobloom.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of a full range of the index. A table of fewer than ``LEAST_RANGES`` of these is cut into up to that
#: many smaller ones, of ``LEAST_ROWS`` or more, so that several tasks search it.
RANGE_ROWS = 1 << 22
LEAST_RANGES, LEAST_ROWS = 64, 1 << 12
#: Upper nodes below a range: groups of its neighbours, whose shared bits say more than the range's.
PARTS = 64
#: Children of a node of the index.
FAN = 4
#: Groups that a search looks at side by side; beyond it, the queries are halved.
FRONTIER = 1 << 19
#: Fingerprints that are sent in one row.
SENT_ROWS = 1024
#: Neighbours in one range from which a fingerprint's links are explored as a forest, and how many such wait.
DENSE = 64
DENSE_ROWS = 1 << 18


def fingerprint(data: bytes) -> int:
    """Of UTF-8 bytes; ASCII white space parts words and only A-Z are lower-cased."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, n - WORDS + 1))], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A fingerprint bit is set if more than half of the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    ones = sum(np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for some in np.array_split(hashes, 1 + len(hashes) // 65_536))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(col):
    """Place of a bit pattern in the reflected Gray sequence."""
    for n in (32, 16, 8, 4, 2, 1):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, n))
    return col


class GrayIndex:
    """Leaves (``ones``: bits that are set, ``zeros``: bits that are not) in Gray order under a tree of shared bits.

    A leaf that is one fingerprint settles all bits; one that stands for a range settles those its rows share.
    """

    def __init__(self, ones: np.ndarray, zeros: np.ndarray | None = None) -> None:
        zeros = ~ones if zeros is None else zeros
        self.size = len(ones)
        levels = [(ones, ones | zeros)]
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones, ones | zeros))
        # A child keeps only the bits that its parent has not settled.
        self.levels = [(p, m & ~np.repeat(above[1], FAN)[: len(m)]) for (p, m), above in zip(levels, levels[1:], strict=False)] + levels[-1:]
        self.left: list[np.ndarray] = []  # leaves of each node that no one has taken, once someone has

    def near(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``q``, leaf) of all leaves not taken that differ from a query in at most ``most`` settled bits."""
        if not self.size or not len(q):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        who, at, far = np.arange(len(q), dtype=np.int32), np.zeros(len(q), dtype=np.int32), np.zeros(len(q), dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            far = far + np.bitwise_count((pattern[at] ^ q[who]) & mask[at])
            keep = np.flatnonzero(far <= most) if not self.left else np.flatnonzero((far <= most) & (self.left[depth][at] > 0))
            who, at, far = who[keep], at[keep], far[keep]
            if not depth or not len(at):
                return who, at
            if len(at) > FRONTIER and len(q) > 1:
                half = len(q) // 2
                (a, x), (b, y) = self.near(q[:half], most), self.near(q[half:], most)
                return np.concatenate([a, b + np.int32(half)]), np.concatenate([x, y])
            below = len(self.levels[depth - 1][0])
            at = (at[:, None] * np.int32(FAN) + np.arange(FAN, dtype=np.int32)).ravel()
            who, far = np.repeat(who, FAN), np.repeat(far, FAN)
            if at.max() >= below:
                inside = at < below
                who, at, far = who[inside], at[inside], far[inside]
        raise AssertionError

    def take(self, at: np.ndarray) -> None:
        if not self.left:
            self.left = [np.ones(self.size, dtype=np.int32)]
            while len(self.left) < len(self.levels):
                self.left.append(np.add.reduceat(self.left[-1], np.arange(0, len(self.left[-1]), FAN)))
        for counts in self.left:
            np.subtract.at(counts, at, 1)
            at = at // FAN


def forest(x: np.ndarray, y: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (place in ``x``, place in ``y``), both in Gray order, that span what all links between the two sets span.

    From each row not yet reached, one component is explored to its end before the next begins; rows that were reached
    leave the indexes, so the work grows with the rows, not with the links.
    """
    sides, out, every = (GrayIndex(x), GrayIndex(y)), [], (x, y)
    for start in range(len(x)):
        if sides[0].left and not sides[0].left[0][start]:
            continue
        sides[0].take(np.array([start]))
        waiting = [(0, start)]
        while waiting:
            side, here = waiting.pop()
            found = sides[1 - side].near(every[side][here : here + 1], most)[1]
            if len(found):
                sides[1 - side].take(found)
                for other in found.tolist():
                    out.append((other, here) if side else (here, other))
                    waiting.append((1 - side, other))
    return out


def _ranked(x: np.ndarray) -> np.ndarray:
    """In Gray order."""
    rank = x.copy()
    for n in (32, 16, 8, 4, 2, 1):
        rank ^= rank >> np.uint64(n)
    return x[np.argsort(rank)]


def _ranges(batches: Iterator[pa.RecordBatch], range_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (rank, fp) of neighbouring ranges, sorted, as rows (start, ones, zeros, rows) of one range each; ``ones`` and
    ``zeros`` are the shared bits of its parts."""

    def out(ranks: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        cuts = np.arange(0, len(x), -(-len(x) // PARTS))
        shared = [pa.array([np.bitwise_and.reduceat(y, cuts).tobytes()], type=pa.binary()) for y in (x, ~x)]
        return pa.RecordBatch.from_arrays([pa.array(ranks[:1]), *shared, pa.array([x.tobytes()], type=pa.binary())], names=["start", "ones", "zeros", "rows"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        size += batch.num_rows
        while size > range_rows:
            ranks, fps = (np.concatenate(c) for c in zip(*held, strict=True))
            yield out(ranks[:range_rows], fps[:range_rows])
            held, size = [(ranks[range_rows:], fps[range_rows:])], size - range_rows
    if size:
        yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, kind, fps) sorted by range and kind: a range's rows (0), then what is looked for in it (1), some at
    a time. Memory is one range's tree, one row and ``DENSE_ROWS`` dense queries."""
    a, b, size = [], [], 0
    here, parts, index, dense = None, [], None, []

    def links(force: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal a, b, size
        if a and (force or size > 65_536):
            columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)]
            a, b, size = [], [], 0
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def met(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal size
        apart = x != y
        a.append(np.minimum(x, y)[apart])
        b.append(np.maximum(x, y)[apart])
        size += len(x)

    def explored() -> None:
        nonlocal dense
        if dense:
            x, y = _ranked(np.unique(np.concatenate(dense))), parts[0]
            i, j = np.array(forest(x, y), dtype=np.int64).reshape(-1, 2).T
            met(x[i], y[j])
            dense = []

    for batch in batches:
        for start, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(data.as_buffer(), dtype=np.uint64)
            if start != here:
                explored()
                here, parts, index = start, [], None
            if not kind:
                parts.append(x)
                continue
            if index is None:
                parts = [_ranked(np.concatenate(parts))]
                index = GrayIndex(parts[0])
            rows = parts[0]
            who, at = index.near(x, DISTANCE)
            many = np.bincount(who, minlength=len(x)) > DENSE
            if many.any():
                dense.append(x[many])
                few = ~many[who]
                who, at = who[few], at[few]
            met(x[who], rows[at])
            yield from links()
            if sum(map(len, dense)) > DENSE_ROWS:
                explored()
                yield from links()
    explored()
    yield from links(True)


def links(distinct: DataFrame, range_rows: int = RANGE_ROWS, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """Of distinct fingerprints (fp), links (a, b) that span the same components as all pairs within the distance."""
    n = distinct.count()
    ranges = max(1, min(least_ranges, n // LEAST_ROWS), n // range_rows)
    dealt = distinct.select(gray_rank(F.col("fp")).alias("rank"), "fp").repartitionByRange(ranges, "rank").sortWithinPartitions("rank")
    leaves = written(dealt.mapInArrow(lambda batches: _ranges(batches, range_rows), "start long, ones binary, zeros binary, rows binary"), "simhash-ranges")
    # The upper nodes' leaves: two numbers for each part of a range, so 1 KB for each range.
    upper = leaves.select("start", "ones", "zeros").orderBy("start").collect()
    starts = np.array([r["start"] for r in upper], dtype=np.int64)
    ones, zeros = (np.frombuffer(b"".join(bytes(r[c]) for r in upper), dtype=np.uint64) for c in ("ones", "zeros"))
    owner = np.repeat(np.arange(len(upper)), [len(r["ones"]) // 8 for r in upper])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(ones, zeros)

        def out(to: list, kind: list, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(to, type=pa.int64()), pa.array(kind, type=pa.int8()), pa.array(rows, type=pa.binary())], names=["start", "kind", "fps"])

        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, own = np.frombuffer(data.as_buffer(), dtype=np.uint64), int(np.searchsorted(starts, start))
                for at in range(0, len(x), SENT_ROWS):
                    some = x[at : at + SENT_ROWS]
                    who, part = index.near(some, DISTANCE)
                    to = owner[part]
                    pairs = np.unique(to[to >= own] * SENT_ROWS + who[to >= own])  # a range once, whichever of its parts
                    to, who = pairs // SENT_ROWS, pairs % SENT_ROWS
                    cuts = np.flatnonzero(np.diff(to)) + 1
                    groups = zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True)
                    met = [(int(starts[to[i]]), 1, some[who[i:j]].tobytes()) for i, j in groups]
                    yield out(*map(list, zip((start, 0, some.tobytes()), *met, strict=True)))

    dealt = leaves.select("start", "rows").mapInArrow(sent, "start long, kind byte, fps binary").repartition(max(ranges, 2), "start").sortWithinPartitions("start", "kind")
    return dealt.mapInArrow(_searched, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, range_rows: int = RANGE_ROWS, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    marked = written(with_fingerprints(docs), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), range_rows, least_ranges))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return marked.join(classes, marked.fp == classes.class_fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
