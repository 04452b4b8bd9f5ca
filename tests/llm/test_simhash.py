import random

import numpy as np
import xxhash

from plyframe.llm import simhash
from plyframe.llm.components import components


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    for weight in range(3):
        w = rng.integers(0, 1 << 23, 20000)
        v = w.copy()
        for _ in range(weight):
            v ^= 1 << rng.integers(0, 23, len(v))
        a, b = simhash.codewords(w), simhash.codewords(v)
        assert ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2)).all()
    assert set((simhash.codewords(np.arange(1 << 14)) >= 0).sum(1)) == {1, 6}


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps[:20]):
        for _ in range(4):
            g = f
            for _ in range(rng.randrange(5)):
                g ^= 1 << rng.randrange(64)
            fps.append(g)
    dense = rng.getrandbits(64)
    fps += [dense ^ 1 << i ^ 1 << j for i in range(0, 64, 9) for j in range(i)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    want = {}
    for f, c in zip(fps, brute_components(range(len(fps)), [f & (1 << 64) - 1 for f in fps])):
        want.setdefault(c, set()).add(f)
    for limit in (2, 32):
        monkeypatch.setattr(simhash, "DENSE", limit)
        got = {}
        for node, root in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect():
            got.setdefault(root, set()).add(node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "δ", "e\tf", "g h", "ÉÀ", "z\x0bz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 9, 60])))) for i in range(1, 80)]
    rows += [(i + 100, t) for i, t in rows[:20]] + [(200, None), (201, ""), (202, "  \n"), (203, "x" * 50000), (5, rows[4][1])]
    long = " ".join(f"w{i}" for i in range(20000))
    rows += [(300, long), (301, long + " tail")]
    df = spark.createDataFrame([(a, b, "s", 0, 1) for a, b in rows], "doc_id bigint, text string, fp string, component_id int, id int")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "a b c d")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(None, 4), (None, None), (4, 4)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
