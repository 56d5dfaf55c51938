"""Reversible incremental line dedup: sharded cuckoo filters before exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of fewer than ``LEAST_CHARS`` code
points are left alone. A key that two or more documents hold loses its lines everywhere but in its owner, the smallest
of them.

``LineIndex`` keeps

- ``rows`` (key, doc_id): the exact references;
- ``counts`` (key, documents, owner): exact reference counts of the keys that two or more documents hold;
- ``filters``: for each shard of the keys one cuckoo filter with every key that has rows, once.

``insert`` asks the filters first. A key that its filter doesn't know is new for certain: its count is that of the
batch. Only keys that a filter may know meet the exact rows, where false alarms are found out. ``delete`` takes the
rows of documents, counts again the keys that they held, and takes from the filters the keys that no document holds any
more; what is left is what would be there had these documents never come. A filter that would get too full is made
again, with room for twice as many keys, from the exact rows of its shard. The query builds its index by ``BATCHES``
inserts and takes the lines that go from the counts.

Cases: null text is one empty line, and so is an empty one; very long texts are split into all their lines; rows
without id are kept whole and count as no document; repeated rows of an id are one document and each is answered,
different texts under one id hold the keys of both; ties can't occur, as the owner is the smallest id; keys are 128-bit
digests; an empty table gives no rows; extra columns are ignored, whatever their names (``cleaned`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import new_path, slices, table, text_of, written

LEAST_CHARS = 10
SHARDS = 64
SHARD_ROWS = 200_000
#: Inserts by which the query builds its index.
BATCHES = 2
HOT = 1000
HOT_DOCUMENTS = 1000
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class CuckooFilter:
    """Buckets of four 16-bit tags; a key's tag is in one of two of them. All keys of a call are placed together.

    Keys are rows of 16 bytes. Tags that find no place after ``KICKS`` rounds of moving others wait in ``stash``, with
    their buckets, so nothing is ever lost. A key is added once and removed only if it was added.
    """

    SLOTS, KICKS, LOAD = 4, 400, 0.8

    def __init__(self, items: int = 64) -> None:
        n = 1
        while n * self.SLOTS * self.LOAD < items:
            n *= 2
        self.cells, self.items, self.stash = np.zeros((n, self.SLOTS), dtype=np.uint16), 0, np.zeros(0, dtype=np.uint64)

    def room(self, more: int) -> bool:
        return self.items + more <= self.cells.size * self.LOAD

    @staticmethod
    def _tags(keys: np.ndarray) -> np.ndarray:
        return np.maximum(keys.view("<u2")[:, 0], 1)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view("<u8")[:, 1] & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def _others(self, places: np.ndarray, tags: np.ndarray) -> np.ndarray:
        return places ^ (tags.astype(np.int64) * 0x5BD1E995 & (len(self.cells) - 1))

    def _stashed(self, places: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """One number for a tag and its two buckets, whichever of them is given."""
        return np.minimum(places, self._others(places, tags)).astype(np.uint64) << np.uint64(16) | tags

    def _settled(self, at: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Put tags into free slots; which of them found one."""
        done = np.zeros(len(at), dtype=bool)
        for _ in range(self.SLOTS):
            wait = np.flatnonzero(~done)
            one = wait[np.unique(at[wait], return_index=True)[1]]  # one for each bucket at a time
            free = self.cells[at[one]] == 0
            one, slot = one[free.any(axis=1)], free.argmax(axis=1)[free.any(axis=1)]
            if not len(one):
                break
            self.cells[at[one], slot] = tags[one]
            done[one] = True
        return done

    def add(self, keys: np.ndarray) -> None:
        tags, at = self._tags(keys), self._places(keys)
        self.items += len(keys)
        for kick in range(self.KICKS):
            left = ~self._settled(at, tags)
            tags, at = tags[left], self._others(at[left], tags[left])
            left = ~self._settled(at, tags)
            tags, at = tags[left], at[left]
            if not len(at):
                return
            # Tags that found no place push out others: one for each bucket, from a slot that changes by round.
            one = np.unique(at, return_index=True)[1]
            slot = (at[one] + kick) % self.SLOTS
            pushed = self.cells[at[one], slot]
            self.cells[at[one], slot] = tags[one]
            tags[one] = pushed
            at[one] = self._others(at[one], pushed)
        self.stash = np.concatenate([self.stash, self._stashed(at, tags)])

    def has(self, keys: np.ndarray) -> np.ndarray:
        tags, at = self._tags(keys), self._places(keys)
        found = (self.cells[at] == tags[:, None]).any(axis=1) | (self.cells[self._others(at, tags)] == tags[:, None]).any(axis=1)
        return found | np.isin(self._stashed(at, tags), self.stash) if len(self.stash) else found

    def remove(self, keys: np.ndarray) -> None:
        tags, at = self._tags(keys), self._places(keys)
        self.items -= len(keys)
        while len(tags):
            # Equal tags of the same buckets one after another; any copy is as good as another.
            one = np.unique(self._stashed(at, tags), return_index=True)[1]
            left = one
            for there in (at, self._others(at, tags)):
                hit = self.cells[there[left]] == tags[left, None]
                own = hit.any(axis=1)
                self.cells[there[left[own]], hit[own].argmax(axis=1)] = 0
                left = left[~own]
            for x in self._stashed(at[left], tags[left]).tolist():
                held = np.flatnonzero(self.stash == x)
                if not len(held):
                    raise ValueError("a key is removed that the filter doesn't have")
                self.stash = np.delete(self.stash, held[0])
            rest = np.ones(len(tags), dtype=bool)
            rest[one] = False
            tags, at = tags[rest], at[rest]

    def dump(self) -> bytes:
        return np.array([len(self.cells), self.items], dtype="<i8").tobytes() + self.cells.astype("<u2").tobytes() + self.stash.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(0)
        n, out.items = np.frombuffer(data, "<i8", 2).tolist()
        out.cells = np.frombuffer(data, "<u2", n * cls.SLOTS, 16).reshape(n, cls.SLOTS).copy()
        out.stash = np.frombuffer(data, "<u8", offset=16 + 2 * n * cls.SLOTS).copy()
        return out


def _digests(keys) -> np.ndarray:
    """Rows of 16 bytes."""
    return np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 16)


def line_key(line: str) -> bytes | None:
    key = line.strip(_BLANK)
    return hashlib.md5(key.translate(_LOWER).encode(), usedforsecurity=False).digest() if len(key) >= LEAST_CHARS else None


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key), each once per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for line in text.as_py().split("\n") if (k := line_key(line)) is not None}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(keys, type=pa.binary())], names=["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).filter("doc_id is not null").mapInArrow(run, "doc_id long, key binary")


def _shard(key, shards: int):
    return F.pmod(F.crc32(key), F.lit(shards)).cast("int")


_COUNTS = "key binary, documents long, owner long"


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("documents"), F.min("doc_id").alias("owner"))


class LineIndex:
    """See above. ``insert`` and ``delete`` leave the index as it is and return another."""

    def __init__(self, rows: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, room: int = 64, blank: bool = False) -> None:
        """``room``: keys that a new filter has room for, at least."""
        self.rows, self.counts, self.filters, self.shards, self.room, self.blank = rows, counts, filters, shards, room, blank

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = SHARDS, room: int = 64) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(none("key binary, doc_id long"), none(_COUNTS), none("shard int, filter binary"), shards, room, blank=True)

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, batches: int = BATCHES) -> LineIndex:
        """By so many inserts, dealt by hashed id. Unless told, as many shards as leave some ``SHARD_ROWS`` rows to one."""
        rows = line_keys(docs).distinct().select("key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
        path = new_path(docs.sparkSession, "line-rows")
        rows.write.partitionBy("batch").parquet(path)
        rows = docs.sparkSession.read.schema("key binary, doc_id long, batch int").parquet(path)
        n = rows.count()
        shards = shards or max(SHARDS, n // SHARD_ROWS)
        index = cls.empty(docs.sparkSession, shards, n // shards)
        for batch in range(batches):
            index = index._inserted(rows.filter(F.col("batch") == batch).select("key", "doc_id"), apart=True)
        return index

    def insert(self, docs: DataFrame) -> LineIndex:
        """With further documents; rows that are there already change nothing."""
        return self._inserted(written(line_keys(docs).distinct().select("key", "doc_id"), "line-new"))

    def _changed(self, keys: DataFrame, step, schema: str) -> DataFrame:
        """``step`` over each shard's keys (key, ...) and its filter."""
        keyed = keys.withColumn("shard", _shard(F.col("key"), self.shards))
        return keyed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(step, schema)

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) that a filter may know."""
        if self.blank:
            return keys.limit(0)
        columns = keys.columns

        def probe(own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(old):
                return own[columns].iloc[:0]
            return own[CuckooFilter.load(bytes(old["filter"].iloc[0])).has(_digests(own["key"]))][columns]

        return self._changed(keys, probe, keys.schema)

    def _inserted(self, new: DataFrame, apart: bool = False) -> LineIndex:
        """``apart``: no document of ``new`` has rows yet."""
        batch = written(_counted(new), "line-batch")
        known = written(self.known(batch).select("key"), "line-known")
        # Only keys that a filter may know meet the exact rows; the others are new for certain.
        there = written(self.rows.join(known, "key", "left_semi").select("key", "doc_id"), "line-there")
        if not apart:
            new = written(new.join(there, ["key", "doc_id"], "left_anti").select("key", "doc_id"), "line-rows")
            batch = written(_counted(new), "line-batch")
        held = written(_counted(there), "line-held")
        fresh = batch.join(held, "key", "left_anti")
        # A row for each key on either side, however many documents hold it.
        both = held.unionByName(batch.join(held, "key", "left_semi")).groupBy("key").agg(F.sum("documents").alias("documents"), F.min("owner").alias("owner"))
        counts = written(fresh.unionByName(both).filter("documents > 1").unionByName(self.counts.join(held, "key", "left_anti")), "line-counts")
        return LineIndex(self.rows.unionByName(new), counts, self._grown(fresh.select("key")), self.shards, self.room)

    def _grown(self, keys: DataFrame) -> DataFrame:
        """The filters with further keys; those that would get too full are made again from the exact rows."""

        room = self.room

        def grow(own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.load(bytes(old["filter"].iloc[0])) if len(old) else CuckooFilter(max(room, len(own)))
            full = not made.room(len(own))
            if not full:
                made.add(_digests(own["key"]))
            shard = int((own if len(own) else old)["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "filter": [made.dump()], "full": [full]}).astype({"shard": "int32"})

        tried = written(self._changed(keys, grow, "shard int, filter binary, full boolean"), "line-filters")
        full = tried.filter("full").select("shard")
        done = tried.filter("not full").select("shard", "filter")
        if full.isEmpty():
            return done

        def again(own: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter(2 * len(own))
            made.add(_digests(own["key"]))
            return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "filter": [made.dump()]}).astype({"shard": "int32"})

        every = self.rows.select("key").distinct().unionByName(keys).withColumn("shard", _shard(F.col("key"), self.shards)).join(full, "shard", "left_semi")
        return written(done.unionByName(every.groupBy("shard").applyInPandas(again, "shard int, filter binary")), "line-filters")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of ``doc_ids`` (doc_id): the state as if they had never been inserted."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        hit = written(self.rows.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-hit")
        rows = written(self.rows.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-rows")
        left = written(_counted(rows.join(hit, "key", "left_semi")), "line-left")
        counts = written(self.counts.join(hit, "key", "left_anti").unionByName(left.filter("documents > 1")), "line-counts")

        def shrink(own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.load(bytes(old["filter"].iloc[0]))
            if len(own):
                made.remove(_digests(own["key"]))
            return pd.DataFrame({"shard": [int(old["shard"].iloc[0])], "filter": [made.dump()]}).astype({"shard": "int32"})

        last = hit.join(left, "key", "left_anti")
        return LineIndex(rows, counts, written(self._changed(last, shrink, "shard int, filter binary"), "line-filters"), self.shards, self.room)

    def drops(self) -> DataFrame:
        """(doc_id, key) of the lines that go.

        Keys with a ``1/HOT`` share of all rows or more are ``HOT`` at most, whatever the data: these are broadcast
        (if ``HOT_DOCUMENTS`` have them at least), so that a line of very many documents doesn't meet in one task. The
        others are joined by key.
        """
        shared = self.counts
        least = max(HOT_DOCUMENTS, self.rows.count() // HOT + 1)
        hot = shared.filter(F.col("documents") >= least).select(F.col("key").alias("hot_key"), F.col("owner").alias("hot_owner"))
        marked = self.rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
        rest = marked.filter("hot_key is null").select("doc_id", "key").join(shared.filter(F.col("documents") < least).select("key", "owner"), "key")
        return marked.filter("doc_id <> hot_owner").select("doc_id", "key").unionByName(rest.filter("doc_id <> owner").select("doc_id", "key"))


def kept_text(text: str, gone: set[bytes]) -> tuple[str, int, int]:
    """The text without the lines of ``gone``, its number of lines and of those dropped."""
    lines = text.split("\n")
    left = [x for x in lines if not gone or line_key(x) not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def _with_drops(docs: DataFrame, index: LineIndex, columns: list[str]) -> DataFrame:
    drops = index.drops().groupBy("doc_id").agg(F.collect_list("key").alias("_llm_gone")).withColumnRenamed("doc_id", "_llm_gone_id")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("doc_id").cast("long").alias("_llm_doc_id"), text_of(docs).alias("_llm_text"))
    return rows.join(drops, F.col("_llm_doc_id") == F.col("_llm_gone_id"), "left")


def decisions(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    joined = _with_drops(docs, index or LineIndex.build(docs), []).select("_llm_doc_id", "_llm_text", "_llm_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [kept_text(t.as_py(), set(g.as_py() or ())) for t, g in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[1] for f in found], type=pa.int64()), pa.array([f[2] for f in found], type=pa.int64()), pa.array([hashlib.sha256(f[0].encode()).hexdigest() for f in found], type=pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def cleaned(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The documents with what is left of their texts; ``n_chars``, if there is one, follows."""

    @F.pandas_udf("string")
    def keep(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([kept_text(t, {bytes(k) for k in g} if g is not None else set())[0] for t, g in zip(texts, gone, strict=True)], dtype=object)

    joined = _with_drops(docs, index or LineIndex.build(docs), docs.columns)
    text = F.when(F.col("_llm_gone").isNull(), F.col("text")).otherwise(keep("_llm_text", "_llm_gone"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


ORACLE = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as n from documents
), keyed as (
  select doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), shared as (
  select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), marked as (
  select k.doc_id, n, line, (s.key is not null and k.doc_id <> s.owner) as gone from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
