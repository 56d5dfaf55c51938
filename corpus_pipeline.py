"""Corpus pipeline: five of the training-data operators one after another over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next stage's docs. All but the last keep the columns of documents.

- toxicity: documents that the classifier rejects go.
- line_dedup: lines that an earlier document holds go; ``text`` and ``n_chars`` are what is left.
- near_dedup: of each component of near-duplicates (Jaccard similarity of 5-word shingles 0.8 or more) the document with the smallest id stays. Documents without id stay.
- decontamination: documents that hold a window of a benchmark item go.
- packing: the rest is packed; one row for each piece.

A stage is called once its predecessor's result has been written, and deletes the tables behind that result.

Cases: null texts count as empty and stay unless they are copies of one another; very long texts are read whole; rows
without id stay in near_dedup and line_dedup and are packed; repeated rows are one document to line_dedup and near_dedup,
and different texts under one id go together if either is a copy of a smaller id's; ties go to the smallest id; empty
tables give empty results; extra columns stay, whatever their names, up to the last stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontamination, jaccard, linededup, packing, toxicity
from jobloom.llm.base import dropped, recorded, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cleaned(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left_anti")


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


#: Tables that a stage has written for its result, by stage.
_made: dict[str, list[str]] = {}


def _tidy(name: str, stage: Stage, before: str | None) -> Stage:
    """The stage, which first deletes the tables behind its predecessor's result: that has been written by then."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _made.pop(before, ()):
            dropped(spark, path)
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _made.setdefault(name, []).extend(paths)
        return out

    return run


_ORDER = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontamination", contaminated), ("packing", packs)]
STAGES: list[tuple[str, Stage]] = [(name, _tidy(name, stage, _ORDER[k - 1][0] if k else None)) for k, (name, stage) in enumerate(_ORDER)]

#: Stages learn a classifier and hash shingles, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = written(found, f"pipeline-{name}")
        for path in held:
            dropped(spark, path)
        held = paths
    return STAGES[-1][1](spark, docs, sf_dir)
