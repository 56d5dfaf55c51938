"""Embedding whitening from a singular value decomposition that is merged up a tree of partitions.

Vectors are cut to whole steps, ``floor(64 c) + OFFSET``. Each task goes through its rows in blocks and keeps one state: the
count, the exact sums, the mean, and the singular values and right vectors of the centred rows, of full rank. Two
states are merged by decomposing both factors, one under the other, with one more row that corrects for the different
means (Ross et al., 2008); no dimension is cut on the way, so the result is that of all rows at once. States meet ``FAN``
at a time, level by level; a state is as large as the square of the dimensions, however many rows it stands for, and
only the last one reaches the driver. A second pass over the rows whitens them and merges the covariance of what comes
out, centred, in the same tree: ``identity_error`` is measured on the rows, not derived from the factors.

Cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out, and so are those that
don't have the most common length (of equally common ones the longer). Entries beyond 2**44 either way count as that. A row
without id is answered like any other; repeated rows count and are answered each. Components without variance (fewer
rows than dimensions, constant columns) have null ``whitened`` and take no part in ``identity_error``; equal eigenvalues
come in any order. ``deviation`` is null beyond the range of a long. No rows that count give an empty result; very long
vectors cost their square in memory. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import table, written

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**50
#: Rows that are decomposed at a time, and states that are merged at a time.
BLOCK, FAN = 4096, 8

_STATE = "part long, n long, sums binary, mean binary, scale binary, vectors binary"


@dataclass
class State:
    """Of some rows: their count, exact sums, mean, and the singular values and right vectors of the centred rows."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums.tobytes(), self.mean.tobytes(), self.values.tobytes(), self.vectors.tobytes()


def read(n, sums, mean, values, vectors) -> State:
    floats = lambda data: np.frombuffer(data, dtype=np.float64)
    return State(int(n), np.frombuffer(sums, dtype=np.int64), floats(mean), floats(values), floats(vectors).reshape(-1, len(floats(mean))))


def block(y: np.ndarray) -> State:
    """Of whole numbers, a row each."""
    sums = y.astype(np.int64).sum(axis=0)
    mean = sums / len(y)
    _, values, vectors = np.linalg.svd(y - mean, full_matrices=False)
    return State(len(y), sums, mean, values, vectors)


def merged(a: State, b: State) -> State:
    n = a.n + b.n
    step = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    _, values, vectors = np.linalg.svd(np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, step]), full_matrices=False)
    sums = a.sums + b.sums
    return State(n, sums, sums / n, values, vectors)


@dataclass
class Spread:
    """Of some rows: their count, mean and centred products."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def row(self, part: int) -> tuple:
        return part, self.n, b"", self.mean.tobytes(), b"", self.products.tobytes()


def spread(w: np.ndarray) -> Spread:
    mean = w.mean(axis=0)
    return Spread(len(w), mean, (w - mean).T @ (w - mean))


def spread_merged(a: Spread, b: Spread) -> Spread:
    n, apart = a.n + b.n, b.mean - a.mean
    return Spread(n, a.mean + apart * (b.n / n), a.products + b.products + np.outer(apart, apart) * (a.n / n * b.n))


def read_spread(n, sums, mean, values, products) -> Spread:
    mean = np.frombuffer(mean, dtype=np.float64)
    return Spread(int(n), mean, np.frombuffer(products, dtype=np.float64).reshape(len(mean), len(mean)))


@dataclass
class Whitening:
    """What is fitted: ``components`` rows are unit eigenvectors by falling eigenvalue, ``rank`` of them with variance."""

    n: int
    sums: np.ndarray  # of the steps without OFFSET
    eigenvalues: np.ndarray
    trace: float
    components: np.ndarray
    rank: int

    def whitened(self, y: np.ndarray) -> np.ndarray:
        k = self.rank
        return (y - self.sums / self.n) @ self.components[:k].T / np.sqrt(self.eigenvalues[:k])


def vectors(batch: pa.RecordBatch, column: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their entries in steps without OFFSET."""
    col = batch.column(column)
    fits = pc.fill_null(pc.equal(pc.list_value_length(col), width), False)
    flat = col.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    finite = np.isfinite(flat).all(axis=1)
    keep = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite]
    return keep, np.clip(np.floor(flat[finite] * STEPS), -LARGEST, LARGEST)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(vectors(batch.slice(at, BLOCK), 0, width)[1])
            size += len(held[-1])
            if size >= BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _folded(df: DataFrame, width: int, make: Callable, merge: Callable, load: Callable) -> object | None:
    """One state of all rows of the only column: a state for each task, then ``FAN`` merged at a time."""
    names = ["part", "n", "sums", "mean", "scale", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for y in _blocks(batches, width):
            state = make(y) if state is None else merge(state, make(y))
        if state is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([state.row(TaskContext.get().partitionId())], columns=names), preserve_index=False)

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        states = [load(*r[1:]) for r in rows[names].itertuples(index=False)]
        while len(states) > 1:
            states = [merge(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
        return pd.DataFrame([states[0].row(int(rows["part"].iloc[0]) // FAN)], columns=names)

    states = written(df.mapInArrow(run, _STATE), "whitening-states")
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last:
        states = states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(together, _STATE)
        last //= FAN
    return load(*states.first()[1:])


def _width(df: DataFrame, vector: str) -> int | None:
    found = df.groupBy(F.size(vector).alias("width")).count().filter("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    return found and found["width"]


def _entries(df: DataFrame, vector: str) -> DataFrame:
    return df.select(df[vector].cast("array<double>").alias("vector"))


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """From all vectors that count; None if there are none."""
    width = _width(df, vector)
    found = width and _folded(_entries(df, vector), width, block, merged, read)
    if not found:
        return None
    values = found.values**2 / found.n
    rank = int((found.values > found.values[:1].max(initial=0) * max(found.n, width) * np.finfo(float).eps).sum())
    return Whitening(found.n, found.sums, values, float(values.sum()), found.vectors, rank)


def identity_error(df: DataFrame, model: Whitening, most: int = COMPONENTS, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = min(most, model.rank)
    if not k:
        return 0.0
    found = _folded(_entries(df, vector), len(model.sums), lambda y: spread(model.whitened(y)[:, :k]), spread_merged, read_spread)
    return float(np.abs(found.products / found.n - np.eye(k)).max())


def deviations(y: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over dimensions of (n y - sums) ** 2, exact; None beyond the range of a long."""
    largest = int(np.abs(y).max(initial=0)) * model.n + int(np.abs(model.sums).max(initial=0))
    if largest**2 * y.shape[1] < 1 << 63:
        return ((model.n * y.astype(np.int64) - model.sums) ** 2).sum(axis=1).tolist()
    found = ((model.n * y.astype(np.int64).astype(object) - model.sums.astype(object)) ** 2).sum(axis=1)
    return [x if x < 1 << 63 else None for x in found.tolist()]


def transform(df: DataFrame, model: Whitening | None, most: int = COMPONENTS, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that counts and component."""
    ids = df.select(df[row_id].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    width = len(model.sums)
    shown, k, error = min(most, width), min(most, model.rank), identity_error(df, model, most, vector)
    share = np.zeros(shown)
    share[: min(shown, len(model.eigenvalues))] = model.eigenvalues[:shown] / model.trace if model.trace else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                keep, y = vectors(part, 1, width)
                rows = len(keep)
                white = np.full((rows, shown), np.nan)
                white[:, :k] = model.whitened(y)[:, :k]
                blank = np.isnan(white)
                each = pa.array(np.repeat(np.arange(rows), shown))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep)).take(each),
                        pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * shown, model.n)),
                        pa.array(deviations(y, model), type=pa.int64()).take(each),
                        pa.array(white.ravel(), mask=blank.ravel()),
                        pa.array(np.tile(share, rows)),
                        pa.array(np.full(rows * shown, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return ids.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return transform(rows, fit(rows))
