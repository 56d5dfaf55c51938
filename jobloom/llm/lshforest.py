"""Near-duplicates by Jaccard similarity of word shingles, found with an LSH forest of MinHash signatures.

Texts link if their sets of ``WORDS``-word shingles have a Jaccard similarity of 0.8 or more (``jaccard.NUMERATOR`` /
``DENOMINATOR``); documents of linked texts form a component. Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are
lower-cased; a text of fewer words than a shingle has one shingle, the whole sequence.

Search: equal sets are one node. A signature is cut into ``TREES`` labels of ``DEPTH`` MinHash values each. In the order
of one tree's labels, nodes whose labels share a prefix are neighbours, and the longer the prefix, the nearer. All nodes
that share ``LEVELS[0]`` values are a region; a region of more than ``REGION`` nodes is parted by further values, level by
level, until its parts are small or the labels end. So the depth of the common prefix that makes two nodes
candidates follows how crowded their part of the order is. Regions are keys of DataFrames, never groups in a task: they
are counted with partial aggregates, and rows of a crowded one meet others by joins, which Spark splits.

Candidates of a region, first: each node with the region's centre, the node that has most company over all trees. What
these links settle needs no more pairs. Then, in regions that hold more than one component, pairs of different
components, of which one is always outside the centre's: all of them in small regions; in those that are still crowded
at the labels' end, the pairs that share an edit against the centre which a pair that links can't do without (``_edits``).
So nothing is capped, and many copies of one text are never paired with each other. Each candidate is confirmed on the whole sets.

Recall: two sets of similarity s meet under a prefix of d values in a share 1 - (1 - s ** d) ** TREES of cases. At 0.8
that leaves out 3e-8 at three values, 3e-6 at four, 0.0007 at six and 0.012 at eight, where regions are that crowded;
at 0.9 it is 2e-6 at eight. Links of larger similarity, and ways round over other documents, make up for some of these.

Cases: null text counts as empty; texts without words have no shingles and each is a component of its own; very long
texts are hashed whole, in eight bytes a shingle; copies are one node, so ties need no rule. Rows without id get the
smallest id of their component, null if none has one, and are not kept. Repeated rows keep one result each; different
texts under one id each have a row. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm import jaccard
from jobloom.llm.base import slices, table, text_of, written
from jobloom.llm.components import components
from jobloom.llm.jaccard import DENOMINATOR, NUMERATOR

WORDS = 2
#: Labels of a signature and MinHash values of a label, of ``BYTES`` bytes each.
TREES, DEPTH, BYTES = 24, 8, 2
#: Values that make a region, and those by which crowded ones are parted further.
LEVELS = (3, 4, 6, DEPTH)
#: Nodes beyond which a region is crowded.
REGION = 32
#: Shingles that meet all hash functions at a time (6 MB).
BLOCK = 4096

_MASKS, _FACTORS = (np.random.default_rng(11).integers(0, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(x: np.ndarray) -> bytes:
    """Labels of a set of hashes, one tree's after another's: of each function, the lowest bytes of the least value."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), BLOCK):
        least = np.minimum(least, ((x[at : at + BLOCK, None] ^ _MASKS) * _FACTORS).min(axis=0))
    # Products of odd numbers keep the lowest bits of what goes in; the middle ones depend on half of the hash.
    return (least >> np.uint64(24)).astype(">u2").tobytes()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) with the set's name and size, and once for each set and task its counts, hashes and labels."""
    seen: set[int] = set()
    for batch in slices(batches):
        found = [jaccard.shingles(t.as_py(), WORDS) for t in batch.column(1)]
        node, new = [], []
        for x in found:
            name = int.from_bytes(hashlib.md5(x.tobytes(), usedforsecurity=False).digest()[:8], "big", signed=True) if len(x) else None
            node.append(name)
            new.append(name is not None and name not in seen)
            seen.add(name)
        once = lambda make: pa.array([make(x) if first else None for x, first in zip(found, new, strict=True)], type=pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(node, type=pa.int64()), pa.array([len(x) for x in found], type=pa.int64()), once(lambda x: jaccard.counts(x).tobytes()), once(jaccard._stored), once(signature)],
            names=["doc_id", "node", "n", "counts", "hashes", "labels"],
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of a node: its region's key, and the values by which the region may be parted."""
    first, whole = LEVELS[0] * BYTES, DEPTH * BYTES
    trees = np.arange(TREES, dtype=np.uint64)
    for batch in slices(batches, 4096):
        n = batch.num_rows
        labels = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, TREES, whole)
        key = np.zeros((n, TREES), dtype=np.uint64) + trees
        for k in range(first):
            key = key * np.uint64(256) + labels[:, :, k]  # five bits of the tree and six bytes: nothing is lost
        rest = labels[:, :, first:].reshape(n * TREES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.repeat(batch.column(1).to_numpy(), TREES).astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(whole - first), n * TREES, [None, pa.py_buffer(rest.tobytes())]).cast(pa.binary())],
            names=["key", "node", "n", "rest"],
        )


def regions(nodes: DataFrame, most: int = REGION) -> DataFrame:
    """(key, node, n, size) of the nodes (node, n, labels) that have a neighbour, each in its region in every tree."""
    rows, out = nodes.select("node", "n", "labels").mapInArrow(_rows, "key long, node long, n int, rest binary"), []
    for level, depth in enumerate(LEVELS):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        found = written(rows.join(sizes, "key"), "forest-level")
        last = depth == DEPTH
        out.append((found if last else found.filter(F.col("size") <= most)).select("key", "node", "n", "size"))
        crowded = found.filter(F.col("size") > most)
        if last or not crowded.limit(1).count():
            break
        more = (LEVELS[level + 1] - depth) * BYTES
        rows = crowded.select(F.xxhash64("key", F.substring("rest", 1, more)).alias("key"), "node", "n", F.expr(f"substring(rest, {more + 1})").alias("rest"))
    members = out[0]
    for one in out[1:]:
        members = members.unionByName(one)
    return members


def _centred(members: DataFrame) -> DataFrame:
    """Members with their region's centre and its size: the node that is in company most, over all trees. What copies
    were made from has the values that most of them have, and so stands in the large region of nearly every tree."""
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    met = members.join(company, "node")
    centre = met.groupBy("key").agg(F.max(F.struct("company", F.xxhash64("node").alias("h"), "node", "n")).alias("c"))
    return written(members.join(centre.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("n_centre")), "key"), "forest-members")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, n_centre, node, n, root, other, hashes, mid) as a row for each shingle by which a node differs from the
    centre. Of these a partner shares one among the first ``kept``, one outside the centre's component among the first ``near``,
    in any order that all nodes have in common.

    Sets link if they differ in no more than a ninth of their sizes together, and what both change alike is no
    difference. So two nodes share at least half of 9 e - n, added up for both, in ninths; the centre's is -n. The least for a partner
    is the centre's own, and for one outside the centre's component more than the centre's size.
    """
    weight = (DENOMINATOR + NUMERATOR) // (DENOMINATOR - NUMERATOR)
    for batch in slices(batches):
        edits, counts, kept, near = [np.zeros(0, dtype=np.uint64)], [], [], []
        for size, other, own, mid in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7), strict=True):
            x = jaccard._read(own.as_py())
            edits.append(np.setxor1d(x, jaccard._read(mid.as_py()), assume_unique=True))
            e = len(edits[-1])
            excess = weight * e - len(x)
            to_all, to_others = max(1, -((size - excess) // (2 * weight))), max(1, -(-(excess + size + 1) // (2 * weight)))
            counts.append(e)
            near.append(e - to_others + 1)
            kept.append(e - to_all + 1 if other else near[-1])
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        columns = [batch.column(0), batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(counts, type=pa.int32()), pa.array(kept, type=pa.int32()), pa.array(near, type=pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(edits).view(np.int64)), *[c.take(at) for c in columns]], names=["edit", "centre", "node", "n", "root", "other", "e", "kept", "near"])


def _shared(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Edits of the nodes of crowded regions, rarest first, that a partner must share one of; ``near`` says which ones for a
    partner outside the centre's component, ``e`` how many edits the node has and ``after`` how many of them come later."""
    ids = crowd.select("node").unionByName(crowd.select(F.col("centre").alias("node"))).distinct()
    ids = F.broadcast(ids) if ids.count() <= jaccard.FEW else ids
    held = written(sets.join(ids, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "forest-crowd")
    both = crowd.join(held, "node").join(held.select(F.col("node").alias("centre"), F.col("hashes").alias("mid")), "centre")
    rows = both.select("centre", "n_centre", "node", "n", "root", "other", "hashes", "mid").mapInArrow(_edits, "edit long, centre long, node long, n int, root long, other boolean, e int, kept int, near int")
    rows = written(rows.filter("kept > 0"), "forest-edits")
    often = rows.groupBy("centre", "edit").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("centre", "node").orderBy("often", "edit"))
    ranked = rows.join(often, ["centre", "edit"]).withColumn("rank", rank).filter("rank <= kept")
    return written(ranked.select("centre", "edit", "node", "n", "root", "other", "e", (F.col("e") - F.col("rank")).alias("after"), (F.col("rank") <= F.col("near")).alias("near")), "forest-ranked")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(left: DataFrame, right: DataFrame, on: list[str], more: Column | None = None) -> DataFrame:
    """Pairs of nodes of different components, the left one outside its centre's."""

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*on, F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in (*on, "node")])

    fits = (F.col("root_a") != F.col("root_b")) & (~F.col("other_b") | (F.col("a") < F.col("b"))) & jaccard._close("n_a", "n_b")
    return side(left.filter("other"), "a").join(side(right, "b"), on).filter(fits if more is None else fits & more).select(*_ordered("a", "b"))


def links(nodes: DataFrame, sets: DataFrame, most: int = REGION) -> DataFrame:
    """Of nodes (node, n, counts, labels) and their sets (node, hashes), confirmed links (a, b) that span the components."""
    members = _centred(regions(nodes, most))
    star = members.filter(F.col("node") != F.col("centre")).filter(jaccard._close("n", "n_centre"))
    first = jaccard._confirmed(star.select(*_ordered("node", "centre")).distinct(), nodes, sets, "forest-first")

    roots = components(first)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("own")), "centre", "left").withColumn("other", F.col("root") != F.coalesce("own", "centre"))
    mixed = rooted.filter("other").select("key").distinct()
    rooted = written(rooted.join(mixed, "key", "left_semi").select("key", "node", "n", "size", "centre", "n_centre", "root", "other"), "forest-rooted")
    few = rooted.filter(F.col("size") <= most)

    # What is left of crowded regions meets by shared edits; a node meets a centre once, whatever the tree.
    crowd = written(rooted.filter(F.col("size") > most).select("centre", "n_centre", "node", "n", "root", "other").distinct(), "forest-others")
    edits = _shared(crowd, sets)
    # From the first edit that two nodes share, what comes after it in both bounds what they share.
    weight = (DENOMINATOR + NUMERATOR) // (DENOMINATOR - NUMERATOR)
    enough = (F.least("after_a", "after_b") + 1) * (2 * weight) >= (F.col("e_a") + F.col("e_b")) * weight - F.col("n_a") - F.col("n_b")
    few = few.select("key", "node", "n", "root", "other")
    pairs = _apart(few, few, ["key"]).unionByName(_apart(edits, edits.filter("near"), ["centre", "edit"], enough))
    return first.unionByName(jaccard._confirmed(pairs.distinct(), nodes, sets, "forest-second"))


def near_duplicates(docs: DataFrame, most: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    made = written(texts.mapInArrow(_nodes, "doc_id long, node long, n long, counts binary, hashes binary, labels binary"), "forest-sets")
    marks = made.select("doc_id", "node", "n")
    once = made.filter("hashes is not null")
    nodes = written(once.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "counts", "labels")]), "forest-nodes")

    roots = components(links(nodes, once.select("node", "hashes"), most))
    firsts = marks.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    marked = firsts.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = marked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = marked.join(least, "root").select(F.col("node").alias("class_node"), "component_id")
    found = marks.join(classes, F.col("node") == F.col("class_node"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of different sets that share a shingle are compared; the closure runs over sets, not documents.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, list_sort(list_distinct(case when len(ws) < 2 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end)) as g from w
), c as (
  select g, min(doc_id) as node, len(g) as n from s where len(g) > 0 group by g
), e as (select node, n, unnest(g) as x from c),
l as (
  select a.node as a, b.node as b from e a join e b on a.x = b.x and a.node < b.node and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), u as (select a, b from l union all select b, a from l),
r as (
  select node as a, node as b from c
  union
  select r.a, u.b from r join u on r.b = u.a
), k as (select a as node, min(b) as component_id from r group by a)
select s.doc_id, len(s.g)::bigint as n_shingles, coalesce(k.component_id, s.doc_id) as component_id, s.doc_id = coalesce(k.component_id, s.doc_id) as kept
from s left join c on s.g = c.g left join k on c.node = k.node
"""
