"""Near-duplicates by exact Jaccard similarity of word shingles, found by prefix filtering.

Texts link if their sets of ``WORDS``-word shingles have a Jaccard similarity of ``NUMERATOR / DENOMINATOR`` or more;
documents of linked texts form a component. Words are those of ``simhash``; shingles are compared by the upper 56 bits of XXH64.

Search: equal sets are one node. Candidates come in two ways, and each is confirmed on the whole sets.

First, what the SimHash index of ``simhash`` links at ``simhash.DISTANCE`` bits, over fingerprints of these shingles.
That finds most copies but can't reach a similarity of 0.8, at which fingerprints differ in ten bits on average; so the
rest is found by prefixes: under any one order of all shingles, two sets that link share a shingle among the first
``n - ceil(0.8 n) + 1`` of each (Bayardo et al., 2007). The order is by hash, with shingles found to be common last,
the most common at the very end; it decides the work and never the result. Shingles of all texts are counted, in chunks
of ``CHUNK``: what occurs once in a chunk isn't passed on. The place of a key in a set bounds what the set can share with
another one from there on, and so the size of a partner that it first meets under this key (``_largest``). All pairs
that keep these bounds are candidates, but under a key of more than ``KEY_ROWS`` nodes all are first held against the
one that has the key in the earliest place, and what that links needs no further pairs among itself.
Bounds on size and on ``BUCKETS`` bucket counts, which no pair that links can miss, come before the whole sets.

Cases: null text counts as empty; texts without words are equal to each other and link to nothing else; texts of fewer
than ``WORDS`` words have one shingle; very long texts are one set each; an empty table gives no rows. Rows without id
are left out. Repeated rows keep one result each; different texts under one id each have a row. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import simhash
from jobloom.llm.base import slices, text_of, written
from jobloom.llm.components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
SEED = 42
KEY_ROWS = 32
COMMON, MOST_COMMON = 8, 50_000
CHUNK = 1 << 20
BUCKETS = 64
NEIGHBOURS = 6
#: Steps of a prefix that a key tells apart, in the eight bits that a stored hash leaves free.
STEPS = 256
#: Candidates' nodes up to which these are broadcast, so that only their sets are shuffled (2 MB).
FEW = 1 << 18


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = data.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))], dtype=np.uint64))


def _stored(x: np.ndarray) -> bytes:
    """The upper 56 bits of each hash, which keep their order."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _read(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 7, 8), dtype=np.uint8)
    out[:, 1:] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 7)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def counts(x: np.ndarray) -> np.ndarray:
    """How many hashes fall into each bucket, 255 at most; two sets differ in no fewer shingles than their counts do."""
    return np.minimum(np.bincount((x % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) with the set's name, size, bucket counts, fingerprint and hashes; the last three once for
    each set and task, so that many copies don't carry them along."""
    seen: set[int] = set()
    for batch in slices(batches):
        found = [shingles(t.as_py()) for t in batch.column(1)]
        packed = [x.tobytes() for x in found]
        node = [int.from_bytes(hashlib.md5(p, usedforsecurity=False).digest()[:8], "big", signed=True) for p in packed]
        new = []
        for name in node:
            new.append(name not in seen)
            seen.add(name)
        once = lambda make: [make(x) if first else None for x, first in zip(found, new, strict=True)]
        prints = once(lambda x: int(np.array([simhash.majority(x)], dtype=np.uint64).view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(node, type=pa.int64()), pa.array([len(x) for x in found], type=pa.int32()), pa.array(once(lambda x: counts(x).tobytes()), type=pa.binary()), pa.array(once(_stored), type=pa.binary()), pa.array(prints, type=pa.int64())],
            names=["doc_id", "node", "n", "counts", "hashes", "fp"],
        )


def _often(sets: DataFrame) -> np.ndarray:
    """Shingles of many sets, rarer ones first; ``MOST_COMMON`` of them at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            x = np.concatenate([np.zeros(0, dtype=np.uint64), *held])
            held.clear()
            x.sort()
            starts = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]]))
            n = np.diff(np.append(starts, len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[starts[n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

        for batch in slices(batches):
            for packed in batch.column(0):
                held.append(_read(packed.as_py()))
                size += len(held[-1])
            if size >= CHUNK:
                yield counted()
                size = 0
        yield counted()

    found = sets.select("hashes").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    common = found.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toPandas()["key"].to_numpy(dtype=np.int64)
    return common.view(np.uint64)[::-1].copy()


def _prefix(n: int) -> int:
    """How many first shingles of a set of ``n`` any set that links to it must meet."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1 if n else 0


def _largest(n: int, step: int) -> int:
    """Size of the largest set that can link to a set of ``n`` if the first shingle they share is at ``step`` of its
    prefix: the sets share ``n - place`` shingles at most, and must share t / (1 + t) of both sizes."""
    place = -(-step * _prefix(n) // STEPS)
    return (NUMERATOR + DENOMINATOR) * (n - place) // NUMERATOR - n


def _prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, node, n): the first shingles of each set, those of ``common`` last and in its order. The key's low bits say
    at which of ``STEPS`` steps of the prefix the shingle is, rounded down."""
    order = np.argsort(common)
    known = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, nodes, sizes = [np.zeros(0, dtype=np.uint64)], [], []
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _read(packed.as_py())
                n = len(x)
                first = _prefix(n)
                if n and len(known):
                    place = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    late = known[place] == x
                    x = np.concatenate([x[~late], x[late][np.argsort(order[place[late]])]])
                keys.append(x[:first] << np.uint64(8) | np.arange(first, dtype=np.uint64) * np.uint64(STEPS) // np.uint64(max(first, 1)))
                nodes += [node] * first
                sizes += [n] * first
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int32())], names=["key", "node", "n"])

    return sets.select("node", "hashes").mapInArrow(run, "key long, node long, n int")


def _close(n: str, m: str):
    """Whether sets of these sizes can link."""
    return (F.col(n) * DENOMINATOR >= F.col(m) * NUMERATOR) & (F.col(m) * DENOMINATOR >= F.col(n) * NUMERATOR)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (2, 3))
        n = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
        # Sets of n shingles together that link differ in at most (1 - t) / (1 + t) n of them.
        keep = np.abs(a - b).sum(axis=1, dtype=np.int64) * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * n
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            x, y = _read(p.as_py()), _read(q.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * DENOMINATOR >= (len(x) + len(y) - both) * NUMERATOR)
        keep = pa.array(keep, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _met(rows: DataFrame, key_rows: int) -> DataFrame:
    """Rows of ``_prefixes`` as (many, key, a, n_a, most_a, b, n_b): the pairs under a key of up to ``key_rows`` nodes, and
    for a key of more each node, the size of its largest partner there, and the node in whose prefix the key comes
    earliest. A task holds no more than that many rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["many", "key", "a", "n_a", "most_a", "b", "n_b"]
        types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        out: list[tuple] = []
        here, held, many, last = None, [], False, None

        def ended() -> None:
            if not many:
                out.extend((0, None, x[0], None, None, y[0], None) for i, x in enumerate(held) for y in held[:i] if x[1] <= y[2] and y[1] <= x[2])

        for batch in batches:
            for place, node, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key, most = place >> 8, _largest(n, place & 255)
                if key != here:
                    ended()
                    here, held, many = key, [], False
                if many:
                    if node != last:
                        out.append((1, key, node, n, most, *held[0][:2]))
                        last = node
                    continue
                if held and node == held[-1][0]:  # a copy from another task
                    continue
                held.append((node, n, most))
                if len(held) > key_rows:
                    many, last = True, node
                    out.extend((1, key, *x, *held[0][:2]) for x in held)
            if len(out) > 65_536:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    dealt = rows.repartition(F.shiftright("key", 8)).sortWithinPartitions("key", F.xxhash64("node"), "node")
    return dealt.mapInArrow(run, "many byte, key long, a long, n_a int, most_a int, b long, n_b int")


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link; ``sets`` may have a node more than once."""

    def beside(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            own = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            pairs = pairs.join(own, side)
        return pairs.select("a", "b", *[f"{c}_{s}" for c in columns for s in ("a", "b")])

    few = written(beside(pairs, nodes, "counts", "n").mapInArrow(_may_link, "a long, b long"), f"{label}-maybe")
    ids = few.select(F.col("a").alias("node")).unionByName(few.select(F.col("b").alias("node"))).distinct()
    own = sets.join(F.broadcast(ids) if ids.count() <= FEW else ids, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    return written(beside(few, own, "hashes").mapInArrow(_links, "a long, b long"), f"{label}-links")


def _printed(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or linked: each node with the smallest of its fingerprint, and each of
    these with up to ``NEIGHBOURS`` that its fingerprint links to, drawn by hash, so that a cluster hangs together
    without all its pairs."""
    least = written(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("b")), "jaccard-prints")
    same = nodes.filter("n > 0").select("fp", F.col("node").alias("a")).join(least, "fp").filter("a <> b").select("a", "b")
    links = simhash.links(least.select("fp"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    drawn = both.groupBy("a").agg(*[F.min_by("b", F.xxhash64("a", "b", F.lit(k))).alias(f"b{k}") for k in range(NEIGHBOURS)])
    drawn = drawn.select("a", F.array_distinct(F.array(*[f"b{k}" for k in range(NEIGHBOURS)])).alias("b")).select("a", F.explode("b").alias("b"))
    links = drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = links.join(least.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    return same.unionByName(met.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, component_id) of every document that has an id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).filter("doc_id is not null")
    sets = texts.mapInArrow(_sets, "doc_id long, node long, n int, counts binary, hashes binary, fp long")
    made = written(sets, "jaccard-sets")
    marks, sets = made.select("doc_id", "node"), made.filter("hashes is not null").select("node", "hashes")
    firsts = written(marks.groupBy("node").agg(F.min("doc_id").alias("first_id")), "jaccard-firsts")
    nodes = written(made.filter("hashes is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "counts", "fp")]), "jaccard-nodes")

    met = written(_met(_prefixes(sets, _often(sets)), key_rows), "jaccard-met")
    small, large = met.filter("many = 0"), met.filter("many = 1")

    centred = large.filter((F.col("a") != F.col("b")) & _close("n_a", "n_b")).select("a", "b")
    first = _confirmed(_printed(nodes).unionByName(centred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, sets, "jaccard-first")

    # Pairs of one component are settled; under a large key, any other pair has a row outside the centre's component.
    roots = components(first)
    rooted = lambda df, side: df.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    kept = written(rooted(rooted(large.select("key", "a", F.col("n_a").alias("n"), F.col("most_a").alias("most"), "b"), "a"), "b").withColumn("other", F.col("root_a") != F.col("root_b")).select("key", F.col("a").alias("node"), "n", "most", F.col("root_a").alias("root"), "other"), "jaccard-large")
    left = kept.filter("other").select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("root").alias("root_a"))
    right = kept.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("root").alias("root_b"), "other")
    pairs = left.join(right, "key").filter((F.col("root_a") != F.col("root_b")) & (~F.col("other") | (F.col("a") < F.col("b"))) & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a")))
    beside = rooted(rooted(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "a"), "b").filter("root_a <> root_b")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(beside.select("a", "b")).distinct()
    second = _confirmed(both, nodes, sets, "jaccard-second")

    roots = components(first.unionByName(second))
    marked = firsts.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = marked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = marked.join(least, "root").select(F.col("node").alias("class_node"), "component_id")
    return marks.join(classes, F.col("node") == F.col("class_node")).select("doc_id", "component_id")
