"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window is ``WINDOW``
consecutive words of an item, or the whole item if it has fewer. Each word of the benchmark becomes one symbol; a text
becomes a string of symbols, with one symbol for all foreign words, and is scanned once. Positions in that string are
word numbers, and these lead back to code points of the text.

The automaton's patterns are anchors: an item's words in pieces of ``ANCHOR``, one after another. Any window of ten
words holds a whole piece, so where a piece occurs, the words beside it are held against the item's own, and what
agrees over a whole window is hit. A benchmark of n words thus needs n nodes, a tenth of what its windows would need.
An anchor that more than ``CROWDED`` places have (items made from one template) is replaced by longer ones: for each
place it can have in a window, the words before it and as many after it as it takes until few places are left, or the
whole window, which then stands for all items that have it. So a place in a text is held against ``CROWDED`` places for
each length of anchor, however many items begin alike; only items that are found cost a step each, once a document.
One task builds the automaton and writes it to the shared folder; each Python worker reads it once. It is one automaton
at any size, and documents are read once and never shuffled; a worker's memory must hold it, with some 120 bytes for
each word of the benchmark's different items (the building task 300: 0.7 GB for 20 MB of text).

Cases: null and empty texts have no words, and items without words have no window; items without an id mark words but
are not counted; items repeated under one id count once; very long texts are scanned whole; repeated rows are answered
each; an empty benchmark leaves all clean; an empty table gives no rows. Extra columns are ignored, whatever their names
(``clean`` keeps them).
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from jobloom.llm.base import new_path, slices, table, text_of

WINDOW = 10
#: Words of an anchor: any window holds one that starts at a multiple of it.
ANCHOR = (WINDOW + 1) // 2
#: Places that an anchor may have in the benchmark before it is made longer.
CROWDED = 16
#: A symbol is so many characters, one of each of as many alphabets of this size: nodes with few children are fast.
CHARS, LETTERS = 3, 128
#: Words that have a symbol of their own; further ones share symbols and are told apart when words are compared.
SYMBOLS = LETTERS**CHARS
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOREIGN = "\x00" * CHARS


def _lower(text: str) -> str:
    """A-Z only: bytes beyond ASCII have no case."""
    return text.encode().lower().decode()


def words(text: str) -> list[str]:
    return _WORD.findall(_lower(text))


class Automaton:
    """Of some items (item_id, text)."""

    def __init__(self, items: Iterable[tuple]) -> None:
        self.symbols: dict[str, str] = {}
        self.shared: dict[str, int] = {}  # words beyond SYMBOLS, by number
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        owners: dict[bytes, set] = {}
        for item_id, text in items:
            if found := words(text or ""):
                line = "".join(map(self._symbol, found))
                owners.setdefault(self._codes(found, line).tobytes(), set()).add(item_id)
        self.owners = list(owners.values())
        flat, anchors, depth = array("i"), [array("i") for _ in range(4)], array("i")
        for sequence, packed in enumerate(owners):
            own = np.frombuffer(packed, dtype=np.int32)
            line = [self._spelled(int(n)) for n in own]
            whole = len(own) < WINDOW
            size = len(own) if whole else ANCHOR
            for at in range(0, len(own) - size + 1, size):
                key = "".join(line[at : at + size])
                # Anchors with one key are a chain, the last of them in the tree.
                depth.append(1 + (depth[before] if (before := self.tree.get(key, -1)) >= 0 else 0))
                self._add(anchors, key, len(flat) + at, sequence, size)
            flat.frombytes(own.tobytes())
        self.flat = np.array(flat, dtype=np.int32)
        sizes = [len(packed) // 4 for packed in owners]
        self.stops = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.stops - np.array(sizes, dtype=np.int64)
        self.groups: list[np.ndarray] = []  # sequences that share a window, by the number that its row has
        self._thin(anchors, depth)
        self.place, self.before, self.sequence, self.size = (np.array(c, dtype=np.int32) for c in anchors)
        if len(self.place):
            self.tree.make_automaton()
        else:
            self.tree = None
        self.chains: dict[int, np.ndarray] = {}

    def _add(self, anchors: list[array], key: str, place: int, sequence: int, size: int) -> None:
        row = (place, self.tree.get(key, -1), sequence, size)
        self.tree.add_word(key, len(anchors[0]))
        for column, value in zip(anchors, row, strict=True):
            column.append(value)

    def _thin(self, anchors: list[array], depth: array) -> None:
        """Longer anchors in place of those that too many places have."""
        crowded = [(key, last) for key, last in self.tree.items() if depth[last] > CROWDED and len(key) == ANCHOR * CHARS]
        windows: dict[bytes, list[np.ndarray]] = {}
        for key, last in crowded:
            rows = []
            while last >= 0:
                rows.append((anchors[0][last], anchors[2][last]))
                last = anchors[1][last]
            self.tree.remove_word(key)
            place, sequence = np.array(rows, dtype=np.int64).T
            whole = self.stops[sequence] - self.starts[sequence] < WINDOW
            for at, own in zip(place[whole].tolist(), sequence[whole].tolist(), strict=True):
                self._add(anchors, key, at, own, ANCHOR)
            for ahead in range(WINDOW - ANCHOR + 1):
                first = place - ahead
                fits = ~whole & (first >= self.starts[sequence]) & (first + WINDOW <= self.stops[sequence])
                first, own = first[fits], sequence[fits]
                for size in range(ahead + ANCHOR, WINDOW + 1):
                    if not len(first):
                        break
                    line = np.ascontiguousarray(self.flat[first[:, None] + np.arange(size)])
                    _, group, count = np.unique(line.view(f"V{4 * size}").ravel(), return_inverse=True, return_counts=True)
                    if size == WINDOW:
                        order = np.argsort(group, kind="stable")
                        for part in np.split(order, np.cumsum(count)[:-1]):
                            windows.setdefault(line[part[0]].tobytes(), []).append(np.stack([first[part], own[part]]))
                        break
                    few = count[group] <= CROWDED
                    for at, mine, codes in zip(first[few].tolist(), own[few].tolist(), line[few].tolist(), strict=True):
                        self._add(anchors, "".join(map(self._spelled, codes)), at, mine, size)
                    first, own = first[~few], own[~few]
        known: dict[bytes, int] = {}
        for packed, parts in windows.items():
            owners = np.unique(np.concatenate([p[1] for p in parts])).astype(np.int32)
            number = known.setdefault(owners.tobytes(), len(known))
            if number == len(self.groups):
                self.groups.append(owners)
            key = "".join(map(self._spelled, np.frombuffer(packed, dtype=np.int32).tolist()))
            self._add(anchors, key, int(parts[0][0, 0]), number, WINDOW)

    @staticmethod
    def _spelled(number: int) -> str:
        number, out = (number - 1) % SYMBOLS, []
        for k in range(CHARS):
            out.append(chr(1 + k * LETTERS + number % LETTERS))
            number //= LETTERS
        return "".join(out)

    def _symbol(self, word: str) -> str:
        found = self.symbols.get(word)
        if found is None:
            number = len(self.symbols) + 1
            found = self.symbols[word] = self._spelled(number)
            if number > SYMBOLS:
                self.shared[word] = number
        return found

    def _codes(self, found: list[str], line: str) -> np.ndarray:
        """The words' numbers, 0 for foreign ones."""
        digits = np.frombuffer(line.encode("utf-32-le"), dtype=np.int32).reshape(-1, CHARS)
        out = ((digits - 1 - LETTERS * np.arange(CHARS)) * LETTERS ** np.arange(CHARS)).sum(axis=1) + 1
        out = np.where(digits[:, 0] == 0, 0, out).astype(np.int32)
        if self.shared:
            for i, w in enumerate(found):
                if w in self.shared:
                    out[i] = self.shared[w]
        return out

    def _chain(self, anchor: int) -> np.ndarray:
        if anchor not in self.chains:
            out, at = [], anchor
            while at >= 0:
                out.append(at)
                at = int(self.before[at])
            self.chains[anchor] = np.array(out)
        return self.chains[anchor]

    def scan(self, found: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs (first, last + 1) of hit words, and the items whose windows occur."""
        if self.tree is None or not found:
            return [], set()
        get = self.symbols.get
        line = "".join([get(w, _FOREIGN) for w in found])
        met = list(self.tree.iter(line))
        if not met:
            return [], set()
        # Foreign words on both sides, so that no place beside an anchor is outside.
        codes = np.zeros(len(found) + 2 * WINDOW, dtype=np.int32)
        codes[WINDOW:-WINDOW] = self._codes(found, line)
        hit, sequences, groups = [], set(), set()
        for end, anchor in met:
            chain = self._chain(anchor)
            size = int(self.size[anchor])
            end = end // CHARS
            start = end + 1 - size
            if size == WINDOW:
                window = codes[start + WINDOW : end + 1 + WINDOW]
                for row in chain.tolist():
                    if (self.flat[self.place[row] : self.place[row] + WINDOW] == window).all():
                        hit.append((start, end + 1))
                        groups.add(int(self.sequence[row]))
                continue
            beside = WINDOW - size
            offsets = np.arange(-beside, WINDOW)
            own, place = self.sequence[chain], self.place[chain, None] + offsets
            inside = (place >= self.starts[own, None]) & (place < self.stops[own, None])
            same = inside & (self.flat[np.clip(place, 0, len(self.flat) - 1)] == codes[start + WINDOW + offsets])
            left = np.logical_and.accumulate(same[:, :beside][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, beside + size :], axis=1).sum(axis=1)
            whole = self.stops[own] - self.starts[own] == size
            good = same[:, beside : beside + size].all(axis=1) & (whole & (size < WINDOW) | (left + right + size >= WINDOW))
            if good.any():
                left, right = np.where(whole, 0, left)[good], np.where(whole, 0, right)[good]
                hit.append((start - int(left.max()), end + 1 + int(right.max())))
                sequences.update(own[good].tolist())
        for group in groups:
            sequences.update(self.groups[group].tolist())
        runs: list[tuple[int, int]] = []
        for a, b in sorted(hit):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return runs, set().union(*(self.owners[s] for s in sequences))


def built(benchmark: DataFrame) -> tuple[str, str]:
    """Folder and name of the benchmark's automaton, which one task builds."""
    folder = new_path(benchmark.sparkSession, "automaton")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of(benchmark).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton((i, t.as_py()) for batch in slices(batches) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}"
        with store.open_output_stream(name, compression=None) as out:
            pickle.dump(made, out)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    one = items.coalesce(1).mapInArrow(build, "name string").first()
    return folder, one["name"] if one else ""


@functools.lru_cache(maxsize=1)
def loaded(folder: str, name: str) -> Automaton:
    """Once for each Python worker; a benchmark without rows has no file."""
    if not name:
        return Automaton(())
    with fs.FileSystem.from_uri(folder)[0].open_input_stream(name, compression=None) as stream:
        return pickle.load(stream)


def _line(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Code point offsets of runs of words; lower-casing A-Z moves none."""
    at = [m.span() for m in _WORD.finditer(_lower(text))]
    return [[at[a][0], at[b - 1][1]] for a, b in runs]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each document; ``spans`` are the hit passages in code points of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    where = built(benchmark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = loaded(*where)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = words(text)
                runs, ids = automaton.scan(found)
                out.append((doc_id, len(found), sum(b - a for a, b in runs), len(ids - {None}), _line(ids), bool(runs), spans_of(text, runs) if runs else []))
            columns = list(zip(*out, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(scan, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, all columns kept."""
    where = built(benchmark)

    @F.pandas_udf(BooleanType())
    def untouched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = loaded(*where)
        for texts in batches:
            yield texts.map(lambda t: not automaton.scan(words(t))[0]).astype(bool)

    return docs.filter(untouched(text_of(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.array_join(x.cast("array<string>"), ":")), ","))


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
  select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') as win
  from (select item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) as i from b where len(ws) > 0)
), ks as (select distinct k from bw), dw as (
  select doc_id, i, k, array_to_string(ws[i + 1 : i + k], ' ') as win from (select doc_id, ws, k, unnest(range(len(ws) - k + 1)) as i from w, ks where len(ws) >= k)
), m as (select d.doc_id, d.i, d.k, bw.item_id from dw d join bw on d.k = bw.k and d.win = bw.win),
p as (select distinct doc_id, unnest(range(i, i + k)) as p from m),
hit as (select doc_id, count(*) as n_hit from p group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from m group by doc_id),
runs as (select doc_id, min(p) as a, max(p) as b from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as g from p) group by doc_id, g),
parts as (
  select doc_id, unnest(ws) as w, unnest(string_split_regex(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')[1 : len(ws)]) as gap, unnest(range(len(ws))) as i
  from w join (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents) using (doc_id) where doc_id in (select doc_id from hit)
), place as (select doc_id, i, length(w) as n, sum(length(gap) + length(w)) over (partition by doc_id order by i) as stop from parts),
sp as (select r.doc_id, string_agg((x.stop - x.n)::bigint::varchar || ':' || y.stop::bigint::varchar, ',' order by r.a) as spans from runs r join place x on r.doc_id = x.doc_id and r.a = x.i join place y on r.doc_id = y.doc_id and r.b = y.i group by r.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
from w left join hit using (doc_id) left join it using (doc_id) left join sp using (doc_id)
"""
