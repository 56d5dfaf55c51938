"""Tables laid out for lookups: a folder for each part of the hashed id, rows in order of id, Bloom filters of other keys.

A lookup by id names its parts, so only their folders are listed and read, and in them the row groups whose range of ids
fits. A lookup by another key reads the filters of all files, and rows of those row groups only that may hold the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
PART = "_part"


def part_of(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(parts))


def lay_out(rows: DataFrame, path: str, row_id: str = "id", keys: list[str] | None = None, parts: int = PARTS, expected: int = 1_000_000) -> None:
    """Write ``rows``; ``keys`` get Bloom filters that hold ``expected`` values a file with one false hit in a hundred."""
    writer = rows.withColumn(PART, part_of(F.col(row_id), parts)).repartition(parts, PART).sortWithinPartitions(PART, row_id).write.partitionBy(PART)
    for key in [row_id, *(keys or [])]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected))
    # A key that fits a dictionary is kept in one, and then the dictionary decides; the filters are for the others.
    writer.parquet(path)


def by_ids(spark: SparkSession, path: str, ids: list, row_id: str = "id", parts: int = PARTS) -> DataFrame:
    """Rows of a list of ids; an id that is listed twice gives its row once, null ids none."""
    ids = [i for i in dict.fromkeys(ids) if i is not None]
    rows = spark.read.parquet(path)
    if not ids:
        return rows.drop(PART).limit(0)
    named = [part_of(F.lit(i).cast(dict(rows.dtypes)[row_id]), parts) for i in ids]
    wanted = spark.range(1).select(F.array(*named)).first()[0]
    return rows.filter(F.col(PART).isin(sorted(set(wanted))) & F.col(row_id).isin(ids)).drop(PART)


def by_key(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key).isin([v for v in dict.fromkeys(values) if v is not None])).drop(PART)
