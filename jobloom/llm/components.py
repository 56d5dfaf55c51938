"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.base import dropped, new_path

MOST_ROUNDS = 60


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), each node but the roots with the smallest node that it reaches: (node, root).

    Nulls and loops are left out; no links give an empty table. Each round is written to the shared folder and the
    one before it deleted, so neither lineage nor disk grows with the number of rounds.
    """
    spark = links.sparkSession
    schema = "a long, b long"

    def write(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "components")
        df.distinct().write.parquet(path)
        return path, spark.read.schema(schema).parquet(path)

    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    path, edges = write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large_path, large = write(both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        met = large.join(least, F.col("a") == F.col("k"))
        small = met.select("a", F.col("m").alias("b")).unionByName(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        old, (path, edges) = path, write(small)
        dropped(spark, large_path)
        dropped(spark, old)
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
