"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

A rolling hash of every ``K`` consecutive code points; of every ``WINDOW`` consecutive hashes the smallest is
chosen, the rightmost one on ties, and kept with its position. Any passage of at least ``K + WINDOW - 1`` code
points that two texts share yields a hash that both have.

Cases: null text counts as empty; an empty text has an empty fingerprint; a text shorter than ``K`` has one hash,
that of the whole text at position 0; a text with fewer than ``WINDOW`` hashes is one window. Two empty
fingerprints are alike (1.0), an empty and a non-empty one are not (0.0). Very long texts are fingerprinted whole;
repeated rows are answered each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import numbers, table, text_of

K = 12
WINDOW = 32
STEP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def kgram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of every k-gram: differences of one running polynomial sum, then mixed."""
    n = len(codes)
    k = min(k, n)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _chosen(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    h = kgram_hashes(codes, k)
    n = len(h)
    # One number orders by hash first and prefers the rightmost position on ties.
    key = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    keep = np.ones(len(least), dtype=bool)
    keep[1:] = least[1:] != least[:-1]
    at = (_LOW - (least[keep] & _LOW)).astype(np.int64)
    return h[at], at


def winnow(text: str, k: int = K, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions in code points, both ascending by position.

    Long texts are taken ``step`` windows at a time, so that memory beyond the text itself stays bounded.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    w = min(window, grams)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, grams - w + 1, step):
        h, at = _chosen(codes[start : min(start + step, grams - w + 1) + w + k - 2], k, w)
        at = at + start
        repeated = int(bool(found) and at[0] == found[-1][1][-1])  # the last window before chose it too
        if len(at) > repeated:
            found.append((h[repeated:], at[repeated:]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many leading code points of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", pa.list_(pa.int32())), ("next_doc_id", pa.int64()),
]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, next_doc_id long"


def compared(doc_id, text: str, own: tuple[np.ndarray, np.ndarray], next_id, next_text: str, of_next: np.ndarray) -> dict:
    new = edited(text, next_text)
    of_new = winnow(new)[0]
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": as_text(own[0]), "edited_fingerprint": as_text(of_new),
        "near_edited": likeness(own[0], of_new), "near_next": likeness(own[0], of_next), "positions": own[1].astype(np.int32), "next_doc_id": next_id,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in FIELDS], names=[n for n, _ in FIELDS])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block and id, each block followed by the first row of the next: each row meets the one after it."""
    last, rows, size = None, [], 0
    for batch in batches:
        for block, tail, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if tail and last is None:
                continue
            text = text.as_py()
            own = winnow(text)
            if last is not None and last[0] == block:
                rows.append(compared(*last[1:], doc_id, text, own[0]))
                size += len(text)
            last = None if tail else (block, doc_id, text, own)
            if len(rows) >= 512 or size > 2_000_000:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _place(bounds: list[int], col):
    """Number of bounds at or below ``col``, less one; about two square roots of their number are looked at."""
    step = max(1, math.isqrt(len(bounds)))
    at_most = lambda values: F.size(F.filter(values, lambda x: x <= col))
    coarse = at_most(numbers(bounds[::step], "long")) - 1
    return coarse * step + at_most(F.slice(numbers(bounds, "long"), coarse * step + 1, F.lit(step))) - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and the likeness to both neighbours in id order.

    Documents are dealt once, into blocks of ascending ``doc_id`` (ties by text; null ids come first), as many as
    there are shuffle partitions. A block starts at an id that occurs, so the row after a block's last is known
    beforehand: it goes to that block as well, and each document meets the next one while its block streams by.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    order = F.coalesce(F.col("doc_id"), F.lit(least))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).select(order.alias("sid"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ids.agg(F.min("sid").alias("first"), F.percentile_approx("sid", [i / parts for i in range(1, parts)], 20 * parts).alias("cuts")).first()
    if found.first is None:
        return spark.createDataFrame([], SCHEMA)
    bounds = sorted({found.first, *found.cuts})
    block = _place(bounds, F.col("sid"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("sid", order).withColumn("block", block)
    opens = F.element_at(numbers(bounds, "long"), F.col("block") + 1) == F.col("sid")
    before = F.pmod(F.col("block") - 1, F.lit(len(bounds)))
    own, ahead = F.struct(F.col("block").alias("block"), F.lit(False).alias("tail")), F.struct(before.alias("block"), F.lit(True).alias("tail"))
    dealt = rows.select("sid", "doc_id", "text", F.explode(F.when(opens, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.block", "to.tail", "sid", "doc_id", "text").repartitionById(len(bounds), F.col("block").cast("int")).sortWithinPartitions("block", "tail", "sid", "text")
    return dealt.select("block", "tail", "doc_id", "text").mapInArrow(_in_order, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
