"""Counters, gauges and exponential histograms as mergeable rows.

A point is (name, kind, labels, scale, bucket, n, total, least, most). Counters and gauges have one row for each set of
labels, with the value in ``n``. Histograms have one for each bucket: at scale s, bucket i holds values in
(base ** i, base ** (i + 1)] for base = 2 ** 2 ** -s (the public exponential histogram of OpenTelemetry); values of zero or less have
bucket null. Merging histograms first brings them to their lowest scale, two buckets into one for each step down, and goes
on until a series has at most ``BUCKETS`` of them. Both only shift bucket numbers, so points merge in any order and grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, BUCKETS = 3, 160
COLUMNS = ["name", "kind", "labels", "scale", "bucket", "n", "total", "least", "most"]


def _labels(labels: list[str]) -> Column:
    """Label values by name, in order, as JSON; missing ones are left out."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(labels)])) if labels else F.lit("{}")


def _point(name: str, kind: str, n: Column) -> list[Column]:
    none = lambda t: F.lit(None).cast(t)
    return [F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col("labels"), none("int").alias("scale"), none("long").alias("bucket"), n.cast("long").alias("n"), none("double").alias("total"), none("double").alias("least"), none("double").alias("most")]


def counter(rows: DataFrame, name: str, labels: list[str], amount: Column | None = None, kind: str = "counter") -> DataFrame:
    """Rows (or ``amount``) by labels. Points of one counter add up; of a gauge, ``latest`` keeps one sample."""
    total = F.count("*") if amount is None else F.sum(amount)
    return rows.groupBy(_labels(labels).alias("labels")).agg(total.alias("n")).select(*_point(name, kind, F.col("n")))


def gauge(rows: DataFrame, name: str, labels: list[str], amount: Column | None = None) -> DataFrame:
    return counter(rows, name, labels, amount, "gauge")


def bucket_of(value: Column, scale: int = SCALE) -> Column:
    """The number of the value's bucket; powers of two, which are bounds at any scale, don't depend on rounding."""
    value = value.cast("double")
    octave = F.round(F.log2(value))
    exact = F.pow(F.lit(2.0), octave) == value
    place = F.when(exact, F.ceil(octave * 2.0**scale)).otherwise(F.ceil(F.log2(value) * 2.0**scale))
    return F.when(value > 0, place.cast("long") - 1)


def histogram(rows: DataFrame, name: str, labels: list[str], value: Column, scale: int = SCALE) -> DataFrame:
    """Null and NaN values are left out."""
    given = rows.select(_labels(labels).alias("labels"), value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    found = given.groupBy("labels", bucket_of(F.col("v"), scale).alias("bucket")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    return merged(found.select(F.lit(name).alias("name"), F.lit("histogram").alias("kind"), "labels", F.lit(scale).alias("scale"), "bucket", "n", "total", "least", "most"))


def merged(*points: DataFrame, most: int = BUCKETS) -> DataFrame:
    """Points of any number of tables as one: counters and gauges of equal labels add up, histograms meet at a scale at
    which a series has no more than ``most`` buckets."""
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in points])
    by = ["name", "kind", "labels"]
    lowest = every.groupBy(*by).agg(F.min("scale").alias("to"))
    met = every.join(lowest.withColumnsRenamed({c: f"_{c}" for c in by}), F.expr(" and ".join(f"{c} = _{c}" for c in by))).drop(*[f"_{c}" for c in by])
    down = lambda c, steps: F.floor(c / F.pow(F.lit(2.0), steps)).cast("long")
    met = met.withColumn("bucket", down(F.col("bucket"), F.coalesce(F.col("scale") - F.col("to"), F.lit(0))))
    spans = met.groupBy(*by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    wide = lambda k: down(F.col("hi"), F.lit(k)) - down(F.col("lo"), F.lit(k)) >= most
    steps = F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), wide))  # halving narrows a span, so these are the first ones
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in by], F.coalesce(steps, F.lit(0)).alias("steps"))
    fitted = met.join(spans, F.expr(" and ".join(f"{c} = _{c}" for c in by)))
    fitted = fitted.select(*by, (F.col("to") - F.col("steps")).cast("int").alias("scale"), down(F.col("bucket"), F.col("steps")).alias("bucket"), "n", "total", "least", "most")
    return fitted.groupBy(*by, "scale", "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).select(*COLUMNS)


def quantile(points: DataFrame, share: float) -> DataFrame:
    """(name, labels, count, total, bound): the upper bound of the bucket in which the share of all values lies, within
    the greatest value seen."""
    from pyspark.sql import Window

    by = Window.partitionBy("name", "labels")
    running = F.sum("n").over(by.orderBy(F.col("bucket").asc_nulls_first()))
    rows = points.filter("kind = 'histogram'").withColumn("upto", running).withColumn("count", F.sum("n").over(by)).withColumn("all", F.sum("total").over(by)).withColumn("peak", F.max("most").over(by))
    upper = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (F.col("bucket") + 1) * F.pow(F.lit(2.0), -F.col("scale"))))
    return rows.filter(F.col("upto") >= F.ceil(F.col("count") * share)).groupBy("name", "labels").agg(F.first("count").alias("count"), F.first("all").alias("total"), F.min(F.least(upper, F.col("peak"))).alias("bound"))
