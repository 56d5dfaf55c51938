"""LSH forest, whitening and resampling against brute force: all pairs, an eigendecomposition, the formulas one by one."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import lshforest, resampling, whitening

TEXTS = "doc_id long, text string"


# LSH forest


def shingles(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def by_all_pairs(rows):
    """(n_shingles, component) by row; rows without shingles are alone."""
    sets = [shingles(t) for _, t in rows]
    kinds = list({s for s in sets if s})
    parent = {s: s for s in kinds}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            least[root(s)] = min(least.get(root(s), d), d)
    return sorted(((d, len(s), least.get(root(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def copies(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, base = [], [word() for _ in range(60)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.55:  # edited copies of one text, from light to heavy
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7])):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.75 and rows:  # copies of what is there
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([0, 1, 2, 3, 30, 80]))]
        text = " ".join(w)
        rows.append((i, rng.choice([text, text, text.upper(), text.replace(" ", "\n\t")])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (0, rows[0][1]), (1, "other words under one id here")]


@pytest.mark.parametrize("seed,most", [(1, 32), (2, 4), (3, 2)])
def test_forest_equals_all_pairs(spark, seed, most):
    """With small regions nearly every copy lies in a crowded one, which shared edits settle."""
    rows = copies(seed)
    df = spark.createDataFrame(rows, TEXTS).withColumn("node", F.lit("extra")).withColumn("kept", F.lit(1)).repartition(3)
    got = lshforest.near_duplicates(df, most).collect()
    want = by_all_pairs(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert len({w[2] for w in want}) < len(rows) - 100


def test_forest_recall_of_planted_pairs(spark):
    """Pairs of 0.80 to 0.83: at three values a region loses one in 10 ** 7, so all of them link; below 0.8 none does."""
    rng = random.Random(7)
    rows, linked = [], set()
    for k in range(150):
        w = [f"w{k}x{rng.randrange(10**6)}" for _ in range(91)]
        other = list(w)
        for at in rng.sample(range(5, 85, 9), rng.choice([5, 6])):
            other[at] = f"y{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 100 * len(a & b) >= 80 * len(a | b):
            linked.add(2 * k)
    got = {r.doc_id: r.component_id for r in lshforest.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    assert {d - 1 for d, c in got.items() if d % 2 and c == d - 1} == linked and 20 < len(linked) < 130


def test_forest_of_nothing_and_of_long_texts(spark):
    assert lshforest.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    got = lshforest.near_duplicates(spark.createDataFrame([(5, long), (3, long + " end"), (4, "one")], TEXTS)).collect()
    assert sorted(map(tuple, got)) == [(3, 60_000, 3, True), (4, 1, 4, True), (5, 59_999, 3, False)]


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    x, y = (np.frombuffer(lshforest.signature(s), dtype=">u2") for s in (a, b))
    assert len(x) == lshforest.TREES * lshforest.DEPTH and abs((x == y).mean() - 0.8) < 0.1
    assert lshforest.signature(a) == lshforest.signature(a[::-1].copy())


# Whitening


def brute(vectors):
    """By the definition, in exact sums and an eigendecomposition of the whole covariance."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    y = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)
    return n, deviation, y, values[order], axes[:, order]


def vectors(seed, n=500, width=40):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) * np.linspace(3, 0.1, width) @ rng.normal(size=(width, width)) + rng.normal(size=width) * 50).astype(np.float32)


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("parts,block", [(1, 4096), (11, 16), (40, 7)])
def test_whitening_equals_an_eigendecomposition(spark, monkeypatch, parts, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    data = vectors(3)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumn("n", F.lit("x")).repartition(parts)
    n, deviation, y, values, axes = brute(data)
    out = whitening.transform(df, whitening.fit(df)).toPandas()
    assert len(out) == n * 32 and set(out["vec_id"]) == set(range(n)) and (out["n"] == n).all()
    first = out[out["component"] == 1].set_index("vec_id").sort_index()
    assert first["deviation"].tolist() == deviation.tolist()
    white = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = y @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white * sign - want).max() < 1e-8
    share = out.drop_duplicates("component").set_index("component")["explained"].sort_index().to_numpy()
    assert np.allclose(share, values[:32] / values.sum(), rtol=1e-10)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(32)).max()
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9 and error < 1e-9


def test_merges_lose_no_dimension():
    """In any tree the last state spans all rows: its factor has the same products."""
    y = np.floor(vectors(9, 300) * 64).astype(float)
    whole = whitening.block(y)
    rng = random.Random(1)
    for size in (1, 13, 64):
        states = [whitening.block(y[at : at + size]) for at in range(0, len(y), size)]
        while len(states) > 1:
            a, b = (states.pop(rng.randrange(len(states))) for _ in range(2))
            states.append(whitening.merged(a, b))
        one = states[0]
        assert one.n == whole.n and (one.sums == whole.sums).all() and len(one.values) == 40
        assert np.allclose(one.values, whole.values, rtol=1e-10)
        centred = y - y.mean(axis=0)
        assert np.allclose((one.vectors.T * one.values**2) @ one.vectors, centred.T @ centred, rtol=1e-9, atol=1e-5)


def test_whitening_of_few_equal_and_large_rows(spark):
    def run(rows):
        df = spark.createDataFrame(rows, VECTORS)
        return whitening.transform(df, whitening.fit(df)).orderBy("vec_id", "component").collect()

    assert run([]) == [] and run([(1, None), (2, [float("nan")])]) == []
    one = run([(1, [1.0, 2.0, 3.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, 0.0, 0.0) for k in (1, 2, 3)]
    two = run([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0])])
    assert [r.explained for r in two[:2]] == [1.0, 0.0] and two[1].whitened is None and abs(two[0].identity_error) < 1e-12
    huge = run([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (None, [1.0, 1.0])])
    assert len(huge) == 6 and huge[0].vec_id is None
    assert [r.deviation for r in huge if r.vec_id == 1] == [None, None]


# Resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def drawn(docs, target, longest=1, percent=10):
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    place = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(words(text)):
                counts[place(f)] += 1
    a, b = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (a + 10_000) / ((s[k] + 1.0) * (b + 10_000)))) for k in range(10_000)]
    rows = []
    for d, text in docs:
        fs = runs(words(text))
        weight = math.floor(sum(gain[place(f)] for f in fs) / len(fs)) if fs else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(fs), weight, score, None, len(words(text))])
    pool = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 50)])
def test_resampling_equals_the_formulas(spark, longest, percent):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "Of", "naïve", "ÄRGER", "x1", "日本", "token", "zz", str(rng.randrange(50))])
    docs = [(i, rng.choice([" ", "-", "\x00"]).join(word() for _ in range(rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(250)]
    docs += [(900, None), (901, "..."), (None, " ".join(["the"] * 30)), (7, docs[7][1]), (8, "a " * 5000)]
    target = ["the token zz", None, "", "Of naïve x1 the"]
    df = spark.createDataFrame(docs, TEXTS).withColumn("weight", F.lit("x")).withColumn("row", F.lit(1)).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resampled(df, bench, percent, longest).collect()), key=repr)
    assert got == drawn(docs, target, longest, percent)


def test_resampling_of_nothing(spark):
    none, bench = spark.createDataFrame([], TEXTS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resampled(none, bench).count() == 0
    one = spark.createDataFrame([(1, "word " * 25)], TEXTS)
    assert resampling.resampled(one, bench.limit(0), percent=100).first()["rank"] == 1


def test_resampling_has_no_python_in_its_plan(spark):
    plan = resampling.resampled(spark.createDataFrame([(1, "a")], TEXTS).filter("doc_id > 0"), spark.createDataFrame([(1, "a")], "item_id long, text string"))
    text = resampling.scored(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), spark.range(10_000).select(F.col("id").alias("bucket"), F.lit(1).cast("long").alias("gain")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "BroadcastHashJoin" in text and plan.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("module,name", [(lshforest, "op11_lsh_forest"), (resampling, "op13_importance_resampling")])
def test_queries_equal_their_sql(spark, module, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = module.query(spark, sf)
    cursor = con.execute(module.ORACLE)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
