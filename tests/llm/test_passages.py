import random

import numpy as np

from plyframe.llm import passages as P


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(12))] for _ in range(2))
        assert P.distance(a, b) == brute_distance(a, b)


def test_minimizers():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(4), [40, 1, 3, 90])
    h = rng.integers(0, 1 << 60, len(doc)).astype(np.uint64)
    want = set()
    for d in range(4):
        at = np.flatnonzero(doc == d)
        for s in range(-P.WINDOW + 1, len(at)):
            own = at[max(0, s) : s + P.WINDOW]
            want.add(int(own[h[own].argmin()]))
    assert P.minimizers(h, doc).tolist() == sorted(want)


def test_chains_are_best():
    rng = random.Random(8)
    cost = P.K / (2 * P.MAX_GAP)
    for _ in range(200):
        n = rng.randrange(2, 9)
        x, y = sorted(rng.sample(range(100), n)), [rng.randrange(60) for _ in range(n)]
        best = [0.0] * n
        for i in range(n):
            best[i] = P.K + max([0.0, *(best[j] - cost * (x[i] - x[j] + y[i] - y[j] - 2 * P.K) for j in range(i) if y[j] < y[i])])
        found = P.chains(x, y)
        total = lambda c: len(c) * P.K - sum(cost * (x[b] - x[a] + y[b] - y[a] - 2 * P.K) for a, b in zip(c, c[1:]))
        assert all(y[a] < y[b] for c in found for a, b in zip(c, c[1:]))
        if max(best) > P.K:
            assert abs(total(found[0]) - max(best)) < 1e-9


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(60), text(55), text(120)]
    docs, planted = [], set()
    seen = set()
    for d in range(60):
        body = text(rng.choice([10, 200, 900]))
        if rng.random() < 0.5:
            k = rng.randrange(3)
            p = list(passages[k])
            for _ in range(rng.choice([0, 0, 3])):
                p[rng.randrange(20, 40)] = "edited"
            at = rng.randrange(len(body))
            body[at:at] = p
            if k in seen:
                planted.add(d)
            seen.add(k)
        docs.append((d, " ".join(body)))
    return docs, planted


def test_planted_passages(spark):
    docs, planted = corpus()
    docs += [(100, docs[3][1]), (101, docs[5][1].upper()), (102, None), (103, ""), (None, docs[3][1]), (7, docs[7][1]), (104, "x " * 40)]
    long = " ".join(f"w{i}" for i in range(30000))
    docs += [(110, long), (111, "head " + long)]
    df = spark.createDataFrame([(a, b, 5, len(b or ""), "r") for a, b in docs], "doc_id bigint, text string, seed int, n_chars int, row string")
    rows = P.repeats(df).collect()
    of = dict(docs[:-2]) | dict(docs[-2:])
    size = {d: len((t or "").split()) for d, t in docs}
    exact = {100, 111} | ({101} if size[5] >= 50 else set()) - set()
    assert {r.doc_id for r in rows} - {100, 101, 111} == planted
    assert {r.doc_id for r in rows} >= {d for d in exact if d != 100 or size[3] >= 50}
    for r in rows:
        a, b = of[r.doc_id].lower().split()[r.start_word : r.end_word], of[r.src_doc_id].lower().split()[r.src_start_word : r.src_end_word]
        assert r.src_doc_id < r.doc_id and len(a) == r.n_words >= 50
        assert 1 - brute_distance(a[:300], b[:300]) / max(len(a[:300]), len(b[:300])) >= 0.75
    kept = {r.doc_id: r for r in P.cut_repeats(spark, df, "").collect() if r.doc_id is not None}
    assert P.cut_repeats(spark, df, "").columns == df.columns
    assert 111 in kept and kept[111].text == "head" and kept[111].n_chars == 4
    for d in planted:
        assert len(kept[d].text.split()) <= size[d] - 50
    for d, t in docs:
        if d is not None and d not in planted and d not in (7, 100, 101, 111):
            assert kept[d].text == t
    assert P.repeats(df.limit(0)).count() == 0 and P.cut_repeats(spark, df.limit(0), "").count() == 0


def test_without():
    assert P.without("a b  c d", [(1, 3)]) == "a  d".replace("  ", "  ")
    assert P.without("a b c", [(0, 3)]) == "" and P.without("a b c", [(2, 9), (1, 3)]) == "a"


def test_all_passages_of_a_chain(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], []
    for gap, sizes in ((20, [60, 60]), (60, [60, 60, 60]), (45, [200, 60]), (120, [60, 60, 60])):
        shared = [text(n) for n in sizes]
        for _ in range(2):
            body, places = text(30), []
            for part in shared:
                places.append((len(body), len(body) + len(part)))
                body += part + text(gap)
            docs.append((len(docs), " ".join(body)))
        want += [(len(docs) - 1, *p) for p in places]
    rows = P.repeats(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in rows) == want


def test_both_copies_of_a_passage_meet_its_source(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    part = text(60)
    docs = [(1, " ".join(text(40) + part + text(40))), (2, " ".join(part + text(40) + part + text(9)))]
    rows = P.repeats(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in rows) == [(2, 0, 60), (2, 100, 160)]


def test_a_run_is_matched_in_order(spark):
    rng = random.Random(18)
    line = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(12)]
    docs = [(1, " ".join(line * 9)), (2, " ".join(["other"] + line * 9))]
    rows = P.repeats(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert any((r.start_word, r.end_word) == (1, 109) for r in rows)


def test_parts_that_are_first_elsewhere(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], []
    for sizes in ((30, 30), (20, 20, 20), (40, 40, 40)):
        lines = [text(n) for n in sizes]
        docs += [(len(docs) + k, " ".join(text(30) + line + text(30))) for k, line in enumerate(lines)]
        whole = sum(lines, [])
        docs += [(len(docs), " ".join(text(25) + whole + text(25))), (len(docs) + 1, " ".join(text(35) + whole + text(5)))]
        want.append((len(docs) - 1, len(docs) - 2, 35, 35 + len(whole)))
    rows = P.repeats(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in rows) == want


def test_edited_passages_are_found(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    docs = []
    for _ in range(80):
        part = text(80)
        copy = list(part)
        for i in rng.sample(range(80), 12):
            copy[i] = word()
        docs += [(len(docs) + k, " ".join(text(40) + p + text(40))) for k, p in enumerate((part, copy))]
    rows = P.repeats(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert len({r.doc_id for r in rows}) >= 76 and all(r.n_words >= 50 and r.similarity >= 0.8 for r in rows)


def test_one_id_with_several_texts(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    part, other = text(60), text(122)
    docs = [(1, " ".join(text(30) + part)), (2, " ".join(text(20) + part + text(20))), (2, " ".join(other)), (2, " ".join(other)), (3, " ".join(part + text(5))), (None, " ".join(part))]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    rows = P.repeats(df).collect()
    assert sorted((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in rows) == [(2, 1, 20, 80), (3, 1, 0, 60)]
    kept = sorted((r.doc_id or 0, r.text) for r in P.cut_repeats(spark, df, "").collect())
    assert sorted(t.split() for i, t in kept if i == 2) == sorted([other] * 2 + [docs[1][1].split()[:20] + docs[1][1].split()[80:]])
    assert (1, docs[0][1]) in kept and (0, docs[5][1]) in kept


def test_a_line_that_most_documents_have(spark, monkeypatch):
    rng = random.Random(37)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    line, part = text(20), text(60)
    docs = [(i, " ".join(text(30) + line + text(10) + (part if i in (40, 900) else []) + text(9))) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(7)
    rows = [sorted((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in P.repeats(df).collect())]
    monkeypatch.setattr(P, "HOT", 1)  # no seed is very frequent
    rows.append(sorted((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in P.repeats(df).collect()))
    assert rows[0] == rows[1] == [(900, 40, 60, 120)]
