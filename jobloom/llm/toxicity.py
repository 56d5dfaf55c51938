"""Toxicity: a counterfactual-regularised linear classifier over the words of a text and how they begin.

Training rows are the labelled documents whose crc32 of the id (as text) modulo 5 is not 0, of which at most
``TRAINING_ROWS`` (those whose hashed id comes first), texts counted once. Features are words, and for the first
``STEMS`` letters of words how often (``COUNTS``) and with what share (``SHARES``) of the words they occur. Those are
taken that occur in at least ``LEAST_DOCS`` texts, more often with the label, and whose log-likelihood ratio against
it reaches ``LEAST_G2``, ``MOST_FEATURES`` at most, strongest first. Identity terms, in four languages, are features
without stems.

Counterfactual sentences: of every ``SWAP_EVERY``-th training text, by its hash, two are made for each of ``SWAPS``
groups. Identity terms of the group that the text has are swapped for one term of the group and for another; a text that
has none gets either put in. Both are training rows with the text's label, and ``SWAP_PENALTY`` times the squared change
of the score from one to the other is part of the loss, next to logistic loss and a ridge; a mention as such is pulled to
no effect with the same weight. An identity term thus can't carry the score, whatever its company in the labels.

Scoring reads words only: labels, language, source and id are no inputs.

Cases: null and empty texts score as a text without features; very long texts are read whole; null labels and labels
without a document are left out; of several labels for one id or of equal texts the highest counts; without labels of
both kinds every score is 0. A score of exactly 0.5 counts as toxic. Repeated rows keep one result each; an empty table gives no rows. Extra columns are ignored,
whatever their names (``without_toxic`` keeps them).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from jobloom.llm.base import slices, table, text_of

TRAINING_ROWS = 6000
LEAST_DOCS = 3
LEAST_G2 = 12.0
MOST_FEATURES = 1000
RIDGE = 1.0
STEMS = (4, 5, 6)
COUNTS = (1, 2, 4)
SHARES = (0.01, 0.02, 0.04)
SWAP_PENALTY = 10.0
SWAP_EVERY = 5
SWAPS = 2
#: Groups of identity terms that may be swapped for each other, in English, German, French and Spanish.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "transgender", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimische", "christliche", "jüdische"),
    ("schwule", "lesben", "heterosexuelle"),
    ("ausländer", "flüchtlinge", "einwanderer", "deutsche", "türken"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulmane", "chrétienne", "juive"),
    ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("étrangers", "réfugiés", "immigrés", "français", "arabes"),
    ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmana", "cristiana", "judía"),
    ("homosexuales", "lesbianas", "heterosexuales"),
    ("extranjeros", "refugiados", "inmigrantes", "españoles", "gitanos"),
    ("discapacitados", "ciegos", "sordos", "viejos", "jóvenes"),
)
_WORD = re.compile(r"[^\W\d_]+")


_TERMS = frozenset(t for g in IDENTITY for t in g)


def swapped(text: str, group: tuple[str, ...], term: str) -> str:
    """The text with ``term`` for each term of the group, or put in after the first word if it has none."""
    own = frozenset(group)
    if any(w in own for w in _WORD.findall(text.lower())):
        return _WORD.sub(lambda m: term if m[0].lower() in own else m[0], text)
    first = _WORD.search(text)
    n = first.end() if first else 0
    return f"{text[:n]} {term}{text[n:]}"


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in an identity term only; the text's hash chooses groups and terms."""
    seed = zlib.crc32(text.encode())
    if seed % SWAP_EVERY:
        return []
    found = set(_WORD.findall(text.lower())) & _TERMS
    groups = [g for g in IDENTITY if found & set(g)] or [IDENTITY[(seed // 7 + k * 11) % len(IDENTITY)] for k in range(SWAPS)]
    pairs = []
    for k, g in enumerate(groups[:SWAPS]):
        i = (seed // 97 + k) % len(g)
        pairs.append((swapped(text, g, g[i]), swapped(text, g, g[(i + 1 + seed % (len(g) - 1)) % len(g)])))
    return pairs


def features(text: str, stems: frozenset[str] | None = None) -> set[str]:
    """Words of a text and the levels that its stems reach (of ``stems`` only, if given)."""
    seen = Counter(_WORD.findall(text.lower()))
    out, often = set(seen), Counter()
    for word, n in seen.items():
        if word not in _TERMS:
            for size in STEMS:
                if len(word) >= size and (stems is None or word[:size] in stems):
                    often[word[:size]] += n
    if often:
        total = sum(seen.values())
        for stem, n in often.items():
            out.update(f"{stem}*{k}" for k in COUNTS if n >= k)
            out.update(f"{stem}%{k}" for k in SHARES if n >= k * total)
    return out


def held_out(doc_id):
    """Whether crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text_id, toxic, words, swaps) of the bounded training set, equal texts once. ``swaps`` are pairs of sentences as
    what either has more and less than the text."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most_rows).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(few), "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.list_(pa.string())))
        for batch in slices(batches):
            found = [t.as_py() for t in batch.column(1)]
            words, swaps = [], []
            for t in found:
                own = features(t)
                words.append(sorted(own))
                swaps.append([[x for side in pair for x in (sorted(features(side) - own), sorted(own - features(side)))] for pair in counterfactuals(t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.crc32(t.encode()) << 32 | zlib.adler32(t.encode()) for t in found], type=pa.uint64()).cast(pa.int64(), safe=False), batch.column(0), pa.array(words, type=pa.list_(pa.string())), pa.array(swaps, type=kind)],
                names=["text_id", "toxic", "words", "swaps"],
            )

    rows = texts.select("toxic", "text").mapInArrow(tokens, "text_id long, toxic int, words array<string>, swaps array<array<array<string>>>")
    return rows.groupBy("text_id").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"), F.first("swaps").alias("swaps"))


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.stems = frozenset(re.split("[*%]", w)[0] for w in weights if "*" in w or "%" in w)

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in sorted(features(text, self.stems) & self.weights.keys()))
        return float(1 / (1 + np.exp(-min(max(z, -60), 60))))


def fit(rows: list[tuple[int, list[str], list]], features: list[str], penalty: float = SWAP_PENALTY) -> Model:
    """Newton steps on the penalised loss; rows are (label, features present, swaps). Without a penalty, the swapped
    sentences are left out, too."""
    terms = sorted(_TERMS)
    names = [*features, *[t for t in terms if t not in set(features)]]
    place = {w: i for i, w in enumerate(names)}
    d, n = len(names), len(rows)
    pairs = [(i, pair) for i, (_, _, swaps) in enumerate(rows) for pair in swaps] if penalty else []
    x, y = np.zeros((n + 2 * len(pairs), d + 1)), np.zeros(n + 2 * len(pairs))
    x[:, d] = 1
    for i, (label, present, _) in enumerate(rows):
        x[i, [place[w] for w in present if w in place]] = 1
        y[i] = label
    for k, (i, (more_a, less_a, more_b, less_b)) in enumerate(pairs):
        for at, more, less in ((n + 2 * k, more_a, less_a), (n + 2 * k + 1, more_b, less_b)):
            x[at], y[at] = x[i], y[i]
            x[at, [place[w] for w in more if w in place]] = 1
            x[at, [place[w] for w in less if w in place]] = 0
    # What the score changes by is linear in the weights, so the penalty is one matrix.
    changed = x[n::2] - x[n + 1 :: 2]
    pull = changed.T @ changed * (penalty * n / 100 / max(1, len(pairs)))
    del changed
    ridge = np.eye(d + 1) * RIDGE
    ridge[d, d] = 1e-3
    # A mention as such (all terms of a group together) is pulled to no effect as well.
    for t in terms:
        ridge[place[t], place[t]] += penalty
    w = np.zeros(d + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (p - y) + ridge @ w + pull @ w
        curve = ridge + pull
        for at in range(0, len(x), 1024):  # a block's copy at a time
            some = x[at : at + 1024]
            curve += (some * (p * (1 - p))[at : at + 1024, None]).T @ some
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model({k: float(v) for k, v in zip(names, w[:d], strict=True) if v}, float(w[d]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, penalty: float = SWAP_PENALTY) -> Model | None:
    """Feature choice runs on the executors; only the chosen words of bounded rows reach the driver."""
    rows = _training(docs, labels, most_rows).select("text_id", "toxic", "words", "swaps").persist()
    try:
        sizes = {r.toxic > 0: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
        if len(sizes) < 2:
            return None
        pos, neg = float(sizes[True]), float(sizes[False])
        seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("a"), F.sum((F.col("toxic") <= 0).cast("int")).alias("b"))
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
        a, b, m = F.col("a").cast("double"), F.col("b").cast("double"), F.col("a").cast("double") + F.col("b")
        n = pos + neg
        g2 = 2 * (part(a, m * pos / n) + part(b, m * neg / n) + part(pos - a, (n - m) * pos / n) + part(neg - b, (n - m) * neg / n))
        chosen = [r.word for r in seen.filter(((F.col("a") + F.col("b")) >= LEAST_DOCS) & (F.col("a") * neg > F.col("b") * pos)).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "word").limit(MOST_FEATURES).select("word").collect()]
        known = F.lit(chosen + sorted(_TERMS - set(chosen)))
        kept, swaps = F.array_intersect("words", known), F.transform("swaps", lambda pair: F.transform(pair, lambda x: F.array_intersect(x, known)))
        data = [(int(r.toxic > 0), list(r.kept), r.swaps) for r in rows.orderBy("text_id").select("toxic", kept.alias("kept"), swaps.alias("swaps")).collect()]
    finally:
        rows.unpersist()
    return fit(data, chosen, penalty)


SCHEMA = "doc_id long, score double"


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found = [model.score(t.as_py()) if model else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that the model doesn't reject, all columns kept."""
    @F.pandas_udf(BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model is None or model.score(t) < 0.5).astype(bool)

    return docs.filter(clean(text_of(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
