"""Importance resampling towards a target distribution (Xie et al., 2023), in DataFrame functions only.

Features are all runs of 1 to ``LONGEST`` consecutive words, hashed by crc32 into ``BUCKETS`` buckets. Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. The features of all source texts and of all target texts
are exploded and counted by bucket; a bucket's gain is the scaled logarithm of the ratio of its smoothed shares. The gains,
a table of ``BUCKETS`` rows at any size of input, are broadcast to the exploded features and summed by document, which
Spark does in part before its shuffle. A draw without replacement is the top of the scores with Gumbel noise, which depends
on the seed and the document's id alone. Scores are sorted by range; a document's rank is its place in its range plus the rows
of all ranges before it.

Cases: null and empty texts have no features, weight 0 and no rank, as they have fewer than ``LEAST_WORDS`` words; very
long texts count whole; equal scores go to the smaller id; rows repeated with their id have the same score, and ranks one
after the other. A row without id has no score, is never drawn and isn't one of the documents whose share is drawn. An
empty target leaves smoothed gains; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.base import ascii_lower, table, text_of, written

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
#: Fixed by the contract: scores and gains are whole thousandths.
SCALE = 1000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def features(words: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to ``longest`` words, joined by a blank."""
    if longest == 1:
        return words

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(1, longest + 1)])


def bucket(feature: Column) -> Column:
    return F.crc32(feature.cast("binary")) % BUCKETS


def counted(df: DataFrame, longest: int, name: str) -> DataFrame:
    """(bucket, features in it)."""
    each = df.select(F.explode(features(words(text_of(df)), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature")).alias("bucket")).agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) of all buckets: ``BUCKETS`` rows, whatever the input."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(counted(source, longest, "s"), "bucket", "left").join(counted(target, longest, "t"), "bucket", "left").fillna(0)
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    total = lambda x: F.sum(x).over(Window.partitionBy())  # noqa: E731  of BUCKETS rows
    ratio = (t + 1) * (total(s) + BUCKETS) / ((s + 1) * (total(t) + BUCKETS))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: DataFrame, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), words(text_of(docs)).alias("words"))
    each = found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(features(F.col("words"), longest)).alias("feature"))
    each = each.select("row", "doc_id", "n_words", bucket(F.col("feature")).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    summed = each.groupBy("row", "doc_id").agg(F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.sum("gain").alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0).cast("long")
    return summed.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``scored`` with their rank among those drawn: ranges of scores, sorted, each after the rows of those before."""
    open_ = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = percent * scores.filter(open_).count() // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id"), F.col("row")]
    dealt = scores.withColumn("may", open_).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "resampling-order")
    span = F.shiftright("place", 33)
    # A row for each range, so as many as the shuffle has partitions.
    ends = placed.groupBy(span.alias("span")).agg(F.count("*").alias("rows"))
    before = ends.select("span", (F.sum("rows").over(Window.orderBy("span")) - F.col("rows")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn("span", span).join(F.broadcast(before), "span")
    return found.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; those with a rank are drawn."""
    return ranked(written(scored(docs, gains(docs, target, longest), longest, seed), "resampling-scores"), percent, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 by its table, which comes from the polynomial, over the bytes of the distinct words.
ORACLE = r"""
with crc as (
  select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tbl
  from (select unnest(range(256)) as i)
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), e as (select doc_id, unnest(ws) as w from d), f as (select unnest(ws) as w from b),
v as (select distinct w, hex(encode(w)) as x from (select w from e union all select w from f)),
k as (
  select w, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, y: xor(c >> 8, tbl[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket
  from v, crc
), s as (select bucket, count(*) as s from e join k using (w) group by bucket),
t as (select bucket, count(*) as t from f join k using (w) group by bucket),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from e) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from f) + 10000)::double)))::bigint as gain
  from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)
), m as (select doc_id, count(*) as n, sum(gain) as gain from e join k using (w) join g using (bucket) group by doc_id),
c as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(gain::double / n), 0)::bigint as weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h
  from d left join m using (doc_id)
), z as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296)))::bigint as score from c),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as many from z where n_features >= 20)
select z.doc_id, n_features, weight, score, case when rank <= 10 * many // 100 then rank end as rank from z left join r using (doc_id)
"""
