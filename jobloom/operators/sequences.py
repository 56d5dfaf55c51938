"""Sequences in time, cut where a gap makes what follows independent of what came before.

Rows are counted by (key, cell), a cell being a span of time as long as the gap. Two neighbours that far apart never lie in
one cell, so the first and last moment of each cell show every gap. Cells are made with partial aggregates and their
number depends on the time that a key covers, not on its rows: no task gathers the rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, keys: list[str], gap_us: int, at: str = "us") -> DataFrame:
    """(keys, cell, first_us, last_us, n, piece) of rows with a moment in microseconds; a piece begins after a gap of
    ``gap_us`` or more and has the moment of its first row as its name."""
    cell = F.floor(F.col(at) / gap_us).alias("cell")
    found = rows.filter(F.col(at).isNotNull()).groupBy(*keys, cell).agg(F.min(at).alias("first_us"), F.max(at).alias("last_us"), F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy("cell")
    begins = F.col("first_us") - F.lag("last_us").over(by) >= gap_us
    marked = found.withColumn("begins", F.coalesce(begins, F.lit(True)))
    return marked.withColumn("piece", F.last(F.when(F.col("begins"), F.col("first_us")), ignorenulls=True).over(by)).drop("begins")


def with_pieces(rows: DataFrame, keys: list[str], gap_us: int, at: str = "us") -> DataFrame:
    """``rows`` with their ``piece``; null keys are a key of their own, rows without a moment have none."""
    found = cells(rows, keys, gap_us, at).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("cell").alias("_cell"), "piece")
    same = F.floor(F.col(at) / gap_us) == F.col("_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(found, same, "left").drop("_cell", *[f"_{k}" for k in keys])


def sessions(rows: DataFrame, keys: list[str], gap_us: int, at: str = "us") -> DataFrame:
    """(keys, first_us, last_us, n) of each run of rows with less than ``gap_us`` between neighbours."""
    return cells(rows, keys, gap_us, at).groupBy(*keys, "piece").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")).drop("piece")


def trailing(rows: DataFrame, key: str, back_us: int, row_id: str, parts: int = 8, at: str = "us") -> DataFrame:
    """(key, row_id, in_window, oldest_us): rows of the same key in (at - back_us, at] and the oldest of them.

    Time is cut into blocks of ``back_us / parts`` (the next smaller number of parts that divides it). A window ends in its row's block, holds the ``parts - 1`` blocks before it
    whole, and begins in the one before these. Rows of that one are handed on to the block where they may leave a
    window, and the whole blocks come as counts. So a task holds a block of a key and its halo, never the key.
    """
    parts = next(p for p in range(parts, 0, -1) if back_us % p == 0)
    size = back_us // parts
    slim = rows.select(F.col(key).alias("key"), F.col(row_id).alias("row"), F.col(at).alias("at")).filter("at is not null")
    # A row leaves the windows of rows at ``at + back_us`` and later; that moment lies in one of two blocks, or none that counts.
    leaves = slim.select("key", F.lit(None).cast("long").alias("row"), (F.col("at") + back_us).alias("t"), F.col("at").alias("halo"))
    both = slim.select("key", "row", F.col("at").alias("t"), F.lit(None).cast("long").alias("halo")).unionByName(leaves).withColumn("block", F.floor(F.col("t") / size))
    counts = both.groupBy("key", "block").agg(F.count_if(F.col("halo").isNull()).alias("n"), F.min(F.when(F.col("halo").isNull(), F.col("t"))).alias("least"))

    by = Window.partitionBy("key", "block").orderBy("t")
    own = F.sum(F.when(F.col("halo").isNull(), 1).otherwise(0)).over(by.rangeBetween(Window.unboundedPreceding, 0))
    still = by.rangeBetween(1, Window.unboundedFollowing)
    kept, oldest = F.count("halo").over(still), F.min("halo").over(still)
    first = F.min(F.when(F.col("halo").isNull(), F.col("t"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    found = both.select("key", "block", "row", "t", "halo", own.alias("own"), kept.alias("kept"), oldest.alias("oldest"), first.alias("first")).filter("halo is null")

    # Blocks that lie whole between the moment at which the window opens and the row's own block.
    whole = Window.partitionBy("key").orderBy("block")
    before = whole.rangeBetween(1 - parts, -1)
    spans = counts.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("between"), F.min("least").over(before).alias("least"))
    met = found.join(spans.select(F.col("key").alias("_key"), F.col("block").alias("_block"), "between", "least"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return met.select(F.col("key").alias(key), F.col("row").alias(row_id), (F.col("own") + F.col("kept") + F.col("between")).alias("in_window"), F.coalesce("oldest", "least", "first").alias("oldest_us"))

