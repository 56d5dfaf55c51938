"""Exact percentiles of groups of any size, by narrowing the range of values in which a rank lies.

Equal values are counted first. Each pass deals the values of a group, by place between its least and greatest, into
``BINS`` and keeps the bin that holds the rank; from there on only the values of that bin are looked at. When no bin has more
than ``SMALL`` different values, these are put in order. No task or buffer holds more than that of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.shared import written

BINS, SMALL = 1024, 4096
MOST_PASSES = 64


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys of which any may be null."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, on).drop(*[f"_{k}" for k in keys])


def at_ranks(counted: DataFrame, keys: list[str], ranks: DataFrame, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(keys, rank, v) of ranks (keys, rank), counted from 0, among values (keys, v, n)."""
    spans = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"))
    open_ = _same(ranks.select(*keys, "rank"), spans.withColumn("below", F.lit(0).cast("long")), keys)
    by = [*keys, "rank"]
    for _ in range(MOST_PASSES):
        open_ = written(open_, "selection")
        inside = _same(counted, open_.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), keys).filter("v between _lo and _hi")
        if (open_.agg(F.max("m")).first()[0] or 0) <= small:
            before = F.sum("n").over(Window.partitionBy(*by).orderBy("v")) - F.col("n") + F.col("below")
            return inside.withColumn("before", before).filter("rank >= before and rank < before + n").select(*by, "v")
        place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("v").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
        dealt = inside.groupBy(*by, place.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"), F.first("below").alias("below"))
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("bin")) - F.col("n") + F.col("below")
        open_ = dealt.withColumn("before", before).filter("rank >= before and rank < before + n").select(*by, "lo", "hi", "m", F.col("before").alias("below"))
    raise RuntimeError("values did not part")


def percentiles(counted: DataFrame, keys: list[str], shares: dict[str, float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(keys, one column for each share) of values (keys, v, n), between neighbours in proportion. Null values don't count; a
    group without others has no row."""
    counted = counted.filter("v is not null and n > 0").groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = totals.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * share).alias("at")) for name, share in shares.items()])).alias("w")).select(*keys, "w.name", "w.at")
    sides = wanted.select(*keys, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = written(at_ranks(counted, keys, sides, bins, small), "percentiles")
    low = _same(wanted.withColumn("rank", F.floor("at")), found.withColumnRenamed("v", "low"), [*keys, "rank"])
    both = _same(low.withColumn("rank", F.ceil("at")), found.withColumnRenamed("v", "high"), [*keys, "rank"])
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares])
