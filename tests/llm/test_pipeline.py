import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from jobloom.llm import jaccard, queries, toxicity
from test_scans import slow_hits
from test_tables import check_packing, slow_lines
from test_winnowing_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def brute(docs, items, model):
    """Ids and texts that each filtering stage leaves."""
    docs = [(i, t) for i, t in docs if model.score(t or "") < 0.5]
    out = [dict(docs)]
    held = defaultdict(set)
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 2 or i == min(held[key(x)]))) for i, t in docs]
    out.append(dict(docs))
    fps = [slow_fingerprint(t) for _, t in docs]
    least = {}
    for (i, _), c in zip(docs, slow_components(fps)):
        least[c] = min(least.get(c, i), i)
    docs = [(i, t) for (i, t), c in zip(docs, slow_components(fps)) if least[c] == i]
    out.append(dict(docs))
    docs = [(i, t) for i, t in docs if not slow_hits(t, items)[-1]]
    out.append(dict(docs))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = brute(rows, items, model)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text for i, r in got.items()} == want[k]
        assert all(r.n_chars == len(r.text) for r in got.values())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(final, {i: [t] for i, t in want[-1].items()})
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, final))
    assert len(want[0]) > len(want[2]) > len(want[3]) > 0
    assert hashlib.sha256(str(slow_lines(rows)[:3]).encode()).hexdigest()


def slow_jaccard_components(texts):
    cut = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(cut, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.mark.parametrize("key_rows", [jaccard.KEY_ROWS, 3])
def test_near_stage_takes_five_words_and_similarity(spark, key_rows):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, "one", "One", "two words"]
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randrange(6, 250))]
        for n in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, key_rows).collect()}
    want = slow_jaccard_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want != slow_components([slow_fingerprint(t) for t in texts])
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()} == set(want)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, block int, fp string"
    rows = [(1, None, None, None, None, None, "x"), (1, None, None, None, None, None, "x"), (None, "a b c", "en", None, 5, 1, None), (2, "", "", "", 0, 2, ""), (3, "w " * 9000, "en", "s", 18000, 3, "y")]
    df = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, SF)
            assert out.columns == df.columns
            assert out.count() <= docs.count()
    assert corpus_pipeline.packs(spark, df, SF).count() >= 5


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered_queries_cover_every_row(spark, name):
    df = entry.queries()[name](spark, SF)
    key = {"op8_length_histogram": None, "op10_warc": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    rows = df.toPandas()
    if key is None:
        assert rows.n_docs.sum() == 200
        return
    ids = pd.read_parquet(f"{SF}/{key[0]}.parquet")[key[1]]
    assert set(rows[key[1]]) == set(ids)
    if name != "op6_curve_packing":
        assert len(rows) == len(ids)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_a_key_bounds_the_partners_first_met_under_it():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        drop = rng.random(len(x)) < rng.choice([0.02, 0.1, 0.2])
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 1 << 56, int(drop.sum() * rng.random()), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not both or both * jaccard.DENOMINATOR < (len(x) + len(y) - both) * jaccard.NUMERATOR:
            continue
        first = np.intersect1d(x, y)[0]
        for a, b in ((x, y), (y, x)):
            place, size = int(np.searchsorted(a, first)), jaccard._prefix(len(a))
            assert place < size
            assert len(b) <= jaccard._largest(len(a), place * jaccard.STEPS // size)


def test_stored_hashes_keep_their_upper_bits_and_order():
    x = np.unique(np.random.default_rng(4).integers(0, (1 << 64) - 1, 500, dtype=np.uint64))
    assert np.array_equal(jaccard._read(jaccard._stored(x)), x >> np.uint64(8))
    assert len(jaccard._read(jaccard._stored(x[:0]))) == 0
