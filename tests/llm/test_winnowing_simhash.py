import hashlib
import random

import numpy as np
import pytest
import xxhash

from jobloom.llm import simhash, winnowing
from jobloom.llm.components import components


def slow_winnow(text, k=winnowing.K, w=winnowing.WINDOW):
    h = winnowing.kgram_hashes(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), k)
    top = [int(x) >> 32 for x in h]
    w = min(w, len(h))
    at = set()
    for i in range(len(h) - w + 1 if len(h) else 0):
        at.add(max(range(i, i + w), key=lambda j: (-top[j], j)))
    return [(int(h[i]), i) for i in sorted(at)]


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 43, 44, 300, 2000])
def test_winnow_is_rightmost_minimum(n):
    rng = random.Random(n)
    for alphabet in ("ab", "abcdefghijklmnop éß𝄞"):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        h, at = winnowing.winnow(text)
        assert [(int(a), int(b)) for a, b in zip(h, at)] == slow_winnow(text)
        for step in (1, 7, 100):
            assert [x.tolist() for x in winnowing.winnow(text, step=step)] == [h.tolist(), at.tolist()]


def test_shared_passage_is_found():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(winnowing.K + winnowing.WINDOW - 1)
    for _ in range(30):
        a, b = winnowing.winnow(word(200) + shared + word(90))[0], winnowing.winnow(word(33) + shared)[0]
        assert set(a.tolist()) & set(b.tolist())


def rows(n=40):
    rng = random.Random(3)
    out = [(i * 3, "".join(rng.choice("abc dé") for _ in range(rng.randrange(0, 300)))) for i in range(n)]
    return [*out, (500, ""), (501, None), (502, "x" * 20_000), (503, out[5][1]), (None, "no id"), (9, out[3][1])]


def test_fingerprints_of_all_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "text as block").repartition(3)
    got = sorted(winnowing.fingerprints(df).collect(), key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_chars))
    inorder = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] if r[0] is not None else -1, r[1]))
    want = []
    for k, (i, t) in enumerate(inorder):
        following = inorder[(k + 1) % len(inorder)][1]
        new = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), winnowing.as_text(winnowing.winnow(t)[0])))
    assert [r[:4] for r in got] == sorted(want, key=lambda r: (r[0] if r[0] is not None else -1, r[1]))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_of_one_and_no_row(spark):
    one = winnowing.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.next_doc_id, r.near_next) for r in one] == [(1, 1, 1.0)]
    assert winnowing.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("dense, ranges", [(simhash.DENSE, simhash.LEAST_RANGES), (3, 7), (0, 1)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, dense, ranges):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "LEAST_ROWS", 1)  # else so few are one range
    rng = random.Random(7)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(15):
            w = b.split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += ["", None, " \n", "one", "One", "two words", base[0], base[0].upper(), "École   x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as fp", "'x' as fingerprint")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, least_ranges=ranges).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)


def test_near_duplicates_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {3}


def close_values(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 1 + n // 50, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return simhash._ranked(np.unique(rng.choice(centres, n) ^ flip() ^ flip()))


@pytest.mark.parametrize("n", [1, 2, 9, 64, 65, 700])
@pytest.mark.parametrize("frontier", [simhash.FRONTIER, 1])
def test_gray_index_finds_all_pairs(monkeypatch, n, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    x = close_values(n, n)
    who, at = simhash.GrayIndex(x).near(x, 4)
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 4}
    assert sorted(zip(who.tolist(), at.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 9, 64, 65, 700])
def test_forest_spans_what_all_links_span(n):
    every = close_values(2 * n, n)
    x, y = every[::2], every[1::2]
    found = simhash.forest(x, y)
    assert len(set(found)) == len(found) < len(every)
    assert all((int(x[i]) ^ int(y[j])).bit_count() <= 4 for i, j in found)

    def groups(links):
        root = list(range(len(x) + len(y)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            a, b = find(i), find(len(x) + j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(root))]

    assert groups(found) == groups((i, j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= 4)


@pytest.mark.parametrize("range_rows", [200, 1 << 18])
def test_links_of_a_skewed_cluster(spark, monkeypatch, range_rows):
    """A third of all fingerprints in one cluster, the rest far apart: all components, and far fewer links than pairs."""
    monkeypatch.setattr(simhash, "DENSE", 8)
    monkeypatch.setattr(simhash, "LEAST_ROWS", 1)
    rng = np.random.default_rng(3)
    bits = np.uint64(1) << rng.integers(0, 64, (1000, 2)).astype(np.uint64)
    x = np.unique(np.concatenate([np.uint64(0x123456789ABCDEF0) ^ bits[:, 0] ^ bits[:, 1], rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = simhash.links(fps, range_rows=range_rows, least_ranges=8).collect()
    want = slow_components([int(v) for v in x])
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = find(place[r.a]), find(place[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(x))] == want
    assert len(found) < 60 * len(x)


def test_upper_nodes_prune_ranges(spark):
    """A fingerprint is sent only to ranges whose shared bits it can reach."""
    rng = np.random.default_rng(4)
    x = simhash._ranked(np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)))
    cuts = np.array_split(x, 1024)
    upper = simhash.GrayIndex(np.array([np.bitwise_and.reduce(c) for c in cuts]), np.array([np.bitwise_and.reduce(~c) for c in cuts]))
    who, at = upper.near(x[::100], 4)
    assert len(who) < 0.5 * len(x[::100]) * len(cuts)
    assert all(np.bitwise_count(cuts[j] ^ x[::100][i]).min() > 4 for i in range(3) for j in set(range(1024)) - set(at[who == i].tolist()))


@pytest.mark.parametrize("least_rows,most", [(simhash.LEAST_ROWS, 1.5), (145, 4.0)])
def test_copies_of_the_corpus(spark, monkeypatch, least_rows, most):
    """How often a fingerprint of the corpus is sent: about once at scale 0.1, and seldom where ranges are far too small."""
    monkeypatch.setattr(simhash, "LEAST_ROWS", least_rows)
    sizes = []
    write = simhash.written

    def watched(df, label):
        out = write(df, label)
        sizes.append((label, out))
        return out

    monkeypatch.setattr(simhash, "written", watched)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = simhash.with_fingerprints(docs).select("fp").distinct()
    simhash.links(fps).count()
    rows = sizes[-1][1].select("start", "ones", "zeros", "rows").orderBy("start").collect()
    ranges = [np.frombuffer(bytes(r["rows"]), dtype=np.uint64) for r in rows]
    index = simhash.GrayIndex(*(np.frombuffer(b"".join(bytes(r[c]) for r in rows), dtype=np.uint64) for c in ("ones", "zeros")))
    owner = np.repeat(np.arange(len(rows)), [len(r["ones"]) // 8 for r in rows])
    sent = 0
    for k, x in enumerate(ranges):
        who, part = index.near(x, simhash.DISTANCE)
        sent += len({(w, o) for w, o in zip(who.tolist(), owner[part].tolist(), strict=True) if o >= k})
    assert sent / sum(map(len, ranges)) <= most and sum(map(len, ranges)) > 9000


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
