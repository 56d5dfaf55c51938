"""Token ids and exact length histograms.

Ids are those of a public byte-level vocabulary, with nothing added. Its two files, one for each library, hold the
same vocabulary; the one of ranks is read faster. Texts with the spelling of a special token go to the library that
knows special tokens, so ids always equal those of the first file.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.base import slices, table, text_of, written

VOCABULARY = "byte_bpe_50k"
_SPECIAL = "<|endoftext|>"
#: Code points that are encoded at once; longer texts are cut only where no token can span the cut.
PIECE = 1_000_000


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file is: an absolute path as it stands, else one of the public tokenizers' files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _whole(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text cut before a single space between two non-space characters: such a space starts a token."""
    at, n = 0, len(text)
    while n - at > most:
        cut = at + most
        low = at + most // 2
        while cut > low and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace()):
            cut -= 1
        if cut == low:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, name: str = VOCABULARY) -> np.ndarray:
    """Token ids of a text."""
    import public_tokenizers

    if _SPECIAL in text:
        return np.array(_whole(vocabulary_path(f"{name}.json")).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    ranks = _ranks(vocabulary_path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    if len(text) <= PIECE:
        return np.array(ranks.encode_ordinary(text), dtype=np.uint32)
    return np.concatenate([np.array(ranks.encode_ordinary(p), dtype=np.uint32) for p in pieces(text)])


def lengths(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(n_tokens) of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py(), name)) for t in batch.column(0)], type=pa.int64())], names=["n_tokens"])

    return docs.select(text_of(docs).alias("text")).mapInArrow(count, "n_tokens long")


#: Lengths that one window task sums up; the blocks themselves are summed in a second, much smaller window.
BLOCK = 256


def histogram(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Exact histogram of encoded lengths with running sums, one row for each length that occurs.

    Columns: ``n_tokens``, ``n_docs`` and ``tokens`` of that length; ``docs_at_most``/``tokens_at_most`` and
    ``docs_longer``/``tokens_longer`` below and above; ``truncated_total``, the tokens left if every document is cut
    at this length; ``quantile``, the share of documents of at most this length. Any other limit's answers follow
    from the row just below it: see ``at_limit``.

    Documents are counted by length before the shuffle, so a hot length is one row per task. Sums run within blocks
    of ``BLOCK`` lengths and over the blocks' totals.

    Cases: null text counts as empty (0 tokens); very long texts are encoded whole, a piece at a time; repeated rows
    count each time; an empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    # Counts are few; they are written so that the texts are encoded once for the three uses below.
    counts = written(lengths(docs, name).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    whole = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    own = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(blocks, "block").crossJoin(F.broadcast(whole))  # one row
    out = out.withColumn("docs_at_most", F.sum("n_docs").over(own) + F.col("d0")).withColumn("tokens_at_most", F.sum("tokens").over(own) + F.col("t0"))
    out = out.withColumn("docs_longer", F.col("all_docs") - F.col("docs_at_most")).withColumn("tokens_longer", F.col("all_tokens") - F.col("tokens_at_most"))
    return out.select("n_tokens", "n_docs", "tokens", "docs_at_most", "tokens_at_most", "docs_longer", "tokens_longer", (F.col("tokens_at_most") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"), (F.col("docs_at_most") / F.col("all_docs")).alias("quantile"))


def at_limit(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_longer, truncated_total, lost_tokens) for context limits, from a histogram."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context long")
    fits = F.col("n_tokens") <= F.col("context")
    sums = counts.join(F.broadcast(wanted)).groupBy("context").agg(
        F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_longer"),
        F.sum(F.when(fits, F.col("tokens")).otherwise(F.col("n_docs") * F.col("context"))).alias("truncated_total"),
        F.sum(F.when(fits, 0).otherwise(F.col("n_docs") * (F.col("n_tokens") - F.col("context")))).alias("lost_tokens"),
    )
    return wanted.join(sums, "context", "left").na.fill(0)


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents doesn't exceed."""
    wanted = counts.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return wanted.join(counts, F.col("quantile") >= F.col("share"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))
