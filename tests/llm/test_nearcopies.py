import random

import numpy as np
import pyarrow as pa
import pytest

from plyframe.llm import nearcopies as N
from plyframe.llm.simhash import golay


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    docs, group = [], {}
    for g in range(12):
        base = text(rng.choice([60, 150, 400]))
        for c in range(rng.choice([2, 3, 60])):
            w = list(base)
            for _ in range(len(base) // 120 if c else 0):
                w[rng.randrange(len(w))] = word()
            group[len(docs)] = g
            docs.append(" ".join(w))
    for _ in range(80):
        group[len(docs)] = 100 + len(docs)
        docs.append(" ".join(text(rng.choice([3, 8, 90, 300]))))
    return docs, group


@pytest.mark.parametrize("small,share", [(32, 2048), (4, 16)])
def test_planted_groups(spark, monkeypatch, small, share):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "SHARE", share)
    docs, group = corpus()
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    rows = [(i, t, "k", 3) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n int")
    got = {r.doc_id: r.component_id for r in N.groups(df).collect()}
    assert got == {i: first[g] for i, g in group.items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, "a b c d e f"), (2, "A B c d E f"), (3, None), (4, ""), (5, "one"), (6, "two"), (7, long), (8, long + " tail"), (7, long), (None, "one"), (9, "the the " * 300), (10, "the the " * 350)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, salt string")
    got = sorted((r.doc_id, r.component_id) for r in N.groups(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (7, 7), (8, 7), (9, 9), (10, 9)]
    kept = N.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 9]
    assert N.groups(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_bits_tell_similarity():
    docs, _ = corpus()
    rng = random.Random(2)
    base = docs[-1] if len(docs[-1]) > 500 else max(docs, key=len)
    w = base.split()
    copies = [base]
    for n in range(1, 12):
        v = list(w)
        for _ in range(n):
            v[rng.randrange(len(v))] = "zz"
        copies.append(" ".join(v))
    bits = N.projections(pa.array(copies)) > 0
    for c, row in zip(copies, bits):
        s = jaccard(base, c)
        expected = N.BITS * np.arccos(2 * s / (1 + s)) / np.pi
        assert abs((row ^ bits[0]).sum() - expected) < 60


def test_soft_decoding_picks_near_codewords():
    x = np.random.default_rng(4).normal(size=(400, 23)).astype(np.float32)
    best, second = N.decoded(x)
    hard = ((x > 0) << np.arange(23)).sum(axis=1)
    low, high, patterns = golay()

    def cost(index):
        word = index << 11
        word ^= low[word & 4095] ^ high[word >> 12]
        assert not (low[word & 4095] ^ high[word >> 12]).any()
        return (np.abs(x) * ((word ^ hard)[:, None] >> np.arange(23) & 1)).sum(axis=1)

    plain = (hard ^ patterns[low[hard & 4095] ^ high[hard >> 12], 0]) >> 11
    assert (cost(best) <= cost(plain) + 1e-5).all() and (cost(best) <= cost(second) + 1e-5).all() and (cost(best) < cost(plain) - 1e-5).any()


def test_all_pairs_of_a_large_bucket_count():
    rng = np.random.default_rng(6)
    base = rng.random(N.BITS) < 0.5
    rows = np.array([base ^ np.isin(np.arange(N.BITS), rng.choice(N.BITS, 300, replace=False)) for _ in range(1000)] + [base])
    fps = np.packbits(rows, axis=1, bitorder="little").view(np.uint64)
    limit = N.most_apart()
    found = N.compared(fps, limit)
    links = found[0] if isinstance(found, tuple) else found
    root = list(range(len(fps)))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    assert np.bitwise_count(fps[0] ^ fps[1]).sum() > limit and len(set(root)) == 1 and len(links) == 1000


def test_near_pairs_of_a_hot_key_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARE", 8)
    rng = np.random.default_rng(9)
    apart = rng.random((50, N.BITS)) < 0.5
    fps = np.packbits(np.concatenate([apart, apart]), axis=1, bitorder="little")
    keyed = spark.createDataFrame([(5, n) for n in range(100)], "key bigint, node bigint")
    nodes = spark.createDataFrame([(n, bytearray(row.tobytes())) for n, row in enumerate(fps)], "node bigint, fp binary")
    links = N.linked(N.salted(keyed).join(nodes, "node"), "bigint", N.most_apart()).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links} == {(n, n + 50) for n in range(50)}


def test_one_id_with_several_texts(spark):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 9999, n))
    a, b, c = text(80), text(90), text(70)
    rows = [(1, a, 5), (2, a, 6), (2, b, 7), (2, b, 7), (3, c, 8), (3, c, 8), (4, b, 9), (2, None, 1), (None, a, 2)]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id int, text string, node int"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, 5), (2, b, 7), (3, c, 8), (2, None, 1), (None, a, 2)], key=str)
