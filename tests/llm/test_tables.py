import gzip
import hashlib
import io
import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobloom.llm import linededup, packing, tokens, warc

TEXTS = ["", None, "one", "Hello world, hello  again\n\nnew   line \t tab", "<|endoftext|> x", "é" * 50, "𝄞 clef", "word " * 3000, "a b", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (None, "no id"), (2, "again")], "doc_id long, text string").selectExpr("*", "0 as n_tokens", "'x' as part").repartition(3)


def whole_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = whole_ids.t = getattr(whole_ids, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_named_library(monkeypatch):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "don't", "I'll", "x1", "99", "é", "—", "word", "_", "𝄞", " ", "²"]
    many = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 80))) for _ in range(500)]
    for t in [t for t in TEXTS if t] + many:
        assert tokens.encode(t).tolist() == whole_ids(t), t
    monkeypatch.setattr(tokens, "PIECE", 20)
    monkeypatch.setattr(tokens.pieces, "__defaults__", (20,))
    for t in many:
        assert tokens.encode(t).tolist() == whole_ids(t), t


def test_histogram(spark, docs):
    n = [len(whole_ids(t or "")) for t in [*TEXTS, "no id", "again"]]
    got = tokens.histogram(docs).orderBy("n_tokens").collect()
    assert {r.n_tokens: r.n_docs for r in got} == Counter(n)
    for r in got:
        assert r.docs_longer == sum(x > r.n_tokens for x in n) and r.truncated_total == sum(min(x, r.n_tokens) for x in n)
        assert r.tokens_longer == sum(x for x in n if x > r.n_tokens) and abs(r.quantile - sum(x <= r.n_tokens for x in n) / len(n)) < 1e-12
    hist = tokens.histogram(docs)
    for r in tokens.at_limit(hist, [0, 1, 7, 100, 10**6]).collect():
        assert (r.docs_longer, r.truncated_total, r.lost_tokens) == (sum(x > r.context for x in n), sum(min(x, r.context) for x in n), sum(max(0, x - r.context) for x in n))
    for r in tokens.quantiles(hist, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) / len(n) >= r.share)
    assert tokens.histogram(docs.limit(0)).count() == 0


def test_hilbert_walks_to_neighbours():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert(cells, bits=3)
    assert sorted(key) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, texts_by_id):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    for doc_id, texts in texts_by_id.items():
        if len(texts) > 1:
            assert sum(r.length for r in pieces[doc_id]) == sum(len(whole_ids(t or "")) + 1 for t in texts)
            continue
        ids, at = np.array([*whole_ids(texts[0] or ""), 0], dtype="<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(pieces) == set(texts_by_id)


def test_packing(spark, docs):
    by_id = defaultdict(list)
    for i, t in [*enumerate(TEXTS), (None, "no id"), (2, "again")]:
        by_id[i].append(t)
    check_packing(packing.packed(docs).collect(), by_id)
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_many_copies(spark):
    texts = ["same text"] * 300 + ["other words here %d" % i for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.packed(df).collect()
    check_packing(rows, {i: [t] for i, t in enumerate(texts)})
    assert len({r.sequence_id >> 40 for r in rows if r.doc_id < 300}) > 1  # the copies fill several ranges


def slow_lines(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or i == min(held[key(x)])]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def line_rows(seed=3, n=60):
    rng = random.Random(seed)
    lines = ["shared line number %d" % i for i in range(15)] + ["short", "", "  Shared LINE number 3\t", "éÉ shared line é", "ÉÉ shared line é", "\x0bshared line number 4\x0c\r", " shared line number 5"]
    rows = [(i * 2, "\n".join(rng.choice(lines + [f"own line {i} {k}" for k in range(9)]) for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    return [*rows, (501, None), (502, ""), (None, "shared line number 1\nx"), (4, rows[9][1]), (503, "shared line number 1\n" * 4000)]


@pytest.mark.parametrize("hot", [1000, 4])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_DOCUMENTS", hot)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "1 as key", "2 as owner", "3 as gone_id", "4 as whole").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.decisions(df).collect())
    assert got == slow_lines(rows)
    left = linededup.cleaned(df)
    assert left.columns == df.columns
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in left.collect()) == sorted(x[3] for x in slow_lines(rows))
    assert linededup.decisions(df.limit(0)).count() == 0


def state(index):
    rows = sorted((r.doc_id, bytes(r.key).hex()) for r in index.rows.collect())
    filters = {r["shard"]: linededup.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()}
    for _, key in rows:
        assert filters[zlib.crc32(bytes.fromhex(key)) % index.shards].has(linededup._digests([bytes.fromhex(key)])).all()
    assert sum(int((f.cells != 0).sum()) + len(f.stash) for f in filters.values()) == len({k for _, k in rows}) == sum(f.items for f in filters.values())
    held = defaultdict(set)
    for i, k in rows:
        held[k].add(i)
    assert sorted((bytes(r.key).hex(), r.documents, r.owner) for r in index.counts.collect()) == sorted((k, len(v), min(v)) for k, v in held.items() if len(v) > 1)
    return rows


@pytest.mark.parametrize("shards", [3])
def test_line_index_is_reversible(spark, shards):
    rows = [r for r in line_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = df.filter("doc_id % 4 = 0"), df.filter("doc_id % 4 <> 0")
    whole, part = linededup.LineIndex.build(df, shards), linededup.LineIndex.build(old, shards)
    grown = part.insert(new)
    assert state(grown) == state(whole)
    assert state(grown.insert(new)) == state(whole)
    back = grown.delete(new.select("doc_id"))
    assert state(back) == state(part)
    assert state(back.insert(new)) == state(whole)
    assert state(linededup.LineIndex.build(df, shards, batches=3)) == state(whole)
    assert state(linededup.LineIndex.empty(spark, shards).insert(df)) == state(whole)
    assert sorted(map(tuple, linededup.decisions(df, back.insert(new)).collect())) == sorted(map(tuple, linededup.decisions(df).collect()))


def test_filters_decide_what_meets_the_exact_rows(spark):
    """With filters that know nothing, keys of an earlier batch are taken for new and their lines stay."""
    df = spark.createDataFrame([(1, "the same long line"), (2, "the same long line"), (3, "another long line")], "doc_id long, text string")
    first = linededup.LineIndex.build(df.filter("doc_id <> 2"), 2)
    assert first.insert(df.filter("doc_id = 2")).counts.count() == 1
    none = first.filters.rdd.map(lambda r: (r["shard"], bytearray(linededup.CuckooFilter(64).dump()))).toDF("shard int, filter binary")
    blind = linededup.LineIndex(first.rows, first.counts, none, 2)
    assert blind.insert(df.filter("doc_id = 2")).counts.count() == 0


@pytest.mark.parametrize("n", [3, 3000, 1_000_000])
def test_cuckoo_filter_deletes(n):
    keys = np.random.default_rng(n).integers(0, 256, (n, 16), dtype=np.uint8)
    f = linededup.CuckooFilter(n)
    for some in np.array_split(keys, 3):
        f.add(some)
    f = linededup.CuckooFilter.load(f.dump())
    assert f.has(keys).all() and f.items == n
    other = np.random.default_rng(n + 1).integers(0, 256, (n, 16), dtype=np.uint8)
    assert f.has(other).mean() < 0.001
    f.remove(keys[: n // 2])
    assert f.has(keys[n // 2 :]).all() and f.has(keys[: n // 2]).mean() < 0.001
    f.add(keys[: n // 2])
    assert f.has(keys).all()
    f.remove(keys)
    assert not f.cells.any() and not len(f.stash) and not f.items


def test_cuckoo_filter_over_its_room_stays_exact():
    """Far more keys than slots, many of one tag and bucket: the stash has the rest."""
    keys = np.random.default_rng(1).integers(0, 256, (200, 16), dtype=np.uint8)
    keys[:50, :2], keys[:50, 8:] = 7, 9
    f = linededup.CuckooFilter(16)
    assert not f.room(200)
    f.add(keys)
    f = linededup.CuckooFilter.load(f.dump())
    assert len(f.stash) and f.has(keys).all()
    f.remove(keys[:40])
    assert f.has(keys[40:]).all()
    f.remove(keys[40:])
    assert not f.cells.any() and not len(f.stash)


def page_rows():
    big = "".join(random.Random(5).choice("abc <>é\r\n") for _ in range(700_000))
    same = "y" * 100
    return [(1, "http://a/ x\n", same), (2, None, same), (9, "u", same), (3, "u", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (7, "é", big), (8, "u", big), (10, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 9), (None, "u", same), (1, "u", same)]


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as digest").repartition(3)
    manifest, folder = warc.archived(pages)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        goes = h in first and first[h] != i
        want.append((i if i is not None else -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if goes else "response", first[h] if goes else -1))
    got = [(r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in warc.report(manifest, folder).collect()]
    assert sorted(got) == sorted(want)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    chunks = warc.read_chunks(manifest, folder, chunk=1000).collect()
    texts = defaultdict(list)
    for c in sorted((c for c in chunks if c.record_type == "response" and c.page_id is not None), key=lambda c: c.chunk_no):
        assert len(c.payload) <= 1000
        texts[c.page_id].append(c)
    assert b"".join(bytes(c.payload) for c in texts[7]).decode() == rows[7][2]
    assert [c.digest is not None for c in texts[7]] == [c.last for c in texts[7]] == [False] * (len(texts[7]) - 1) + [True]


def test_warc_empty(spark):
    assert warc.report(*warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_record_names_hold_page_ids():
    for i in (0, 1, -1, 2**62, 2**63 - 1, -(2**63), 12345678901):
        assert warc.page_of(warc.record_id(i)) == i
    assert len(warc.record_id(5)) == len("<urn:uuid:>") + 36 and uuid.UUID(warc.record_id(5)[10:-1]).version == 8
    assert warc.page_of(warc.record_id(None)) is warc.page_of(None) is warc.page_of("<urn:uuid:x>") is None
    assert warc.page_of(f"<urn:uuid:{uuid.uuid4()}>") is None


def test_reader_takes_archives_of_other_writers():
    def member(*lines, block):
        return gzip.compress(("\r\n".join(["WARC/1.0", *lines, f"content-length:{len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n")

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"a" * 2500
    data = member("WARC-Type: warcinfo", "Content-Type: application/warc-fields", block=b"software: x\r\n\r\ny")
    data += member("warc-type:response", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABC", block=page)
    data += member("WARC-Type: response", "Content-Type: application/http", block=b"HTTP/1.1 204 No Content")
    data += member("WARC-Type: resource", "Content-Type: text/plain", block=b"")
    got = defaultdict(list)
    for row in warc.Reader(io.BytesIO(data), 1000):
        assert row[1] is row[3] is row[4] is None and len(row[6]) <= 1000
        got[len(got) if row[5] == 0 else len(got) - 1].append(row)
    assert [rows[0][2] for rows in got.values()] == ["warcinfo", "response", "response", "resource"]
    assert [b"".join(r[6] for r in rows) for rows in got.values()] == [b"software: x\r\n\r\ny", b"a" * 2500, b"", b""]
    assert got[1][0][0] == "<urn:uuid:1>" and got[1][-1][9] == hashlib.sha256(b"a" * 2500).hexdigest() and [r[7] for r in got[1]] == [False, False, True]
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(data[:-40]), 1000))


def test_neighbours_along_the_curve_are_packed_together(spark):
    """Two kinds of text that alternate by id: nearly all sequences hold one kind only."""
    kinds = ["alpha beta gamma delta " * 20, "7 3 9 1 4 8 2 " * 20]
    rows = [(i, kinds[i % 2] + f" {i}") for i in range(600)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = defaultdict(set)
    for p in pieces:
        held[p.sequence_id].add(p.doc_id % 2)
    assert sum(len(x) == 1 for x in held.values()) >= 0.9 * len(held)


def test_sample_grows_with_ranges(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert len(packing._sampled(docs, packing.VOCABULARY, 100)) == 100
    assert len(packing._sampled(docs.limit(0), packing.VOCABULARY, 100)) == 0
