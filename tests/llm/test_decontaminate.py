import random

import duckdb
import pyarrow as pa

from plyframe.llm import decontaminate as D


def brute(docs, items):
    out = []
    for d, text in docs:
        w = D.words(text)
        for i, item in items:
            need = D.shingles(D.words(item))
            if need:
                k = len(next(iter(need)))
                have = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
                if len(need & have) >= 0.8 * len(need) - 1e-9:
                    out.append((d, i, len(need & have), len(need)))
    return sorted(out, key=repr)


def data():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["É", "x\x0by", "日本"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([5, 6, 9, 16, 31, 60, 130]))) for i in range(40)] + [(50, "only three words"), (51, ""), (52, None), (53, "  \n"), (3, text(20)), (55, "same same same same same same same")]
    docs = []
    for d in range(150):
        body = text(rng.choice([0, 3, 40, 300, 4000])).split()
        for _, item in rng.sample(items, 2):
            w = (item or "").split()
            if w and rng.random() < 0.6:
                if rng.random() < 0.5 and len(w) > 8:
                    w[rng.randrange(len(w))] = "changed"
                at = rng.randrange(len(body) + 1)
                body[at:at] = w
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else "\t".join(body)))
    return docs + [(900, None), (901, ""), (None, items[4][1]), (7, docs[7][1]), (902, items[9][1] + " tail " * 30000)], items


def test_against_brute_force_and_sql(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(a, b, "c", 1.0) for a, b in docs], "doc_id bigint, text string, item_id string, shared double")
    it = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items)
    assert want
    got = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in D.contained(df, it).collect()]
    assert sorted(got, key=repr) == want
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    got = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in D.contained(df, it).collect()]
    assert sorted(got, key=repr) == want
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": [d for d, _ in items], "text": [t for _, t in items]}))
    assert sorted(((r[0], r[1], r[2], r[3]) for r in con.execute(D.OP5_SQL).fetchall()), key=repr) == want


def test_filter_and_empty(spark, tmp_path):
    docs, items = data()
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id bigint, text string, row string, n_chars int")
    kept = D.clean(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    bad = {d for d, *_ in brute(docs, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)
    none = spark.createDataFrame([], "item_id int, text string")
    assert D.contained(df, none).count() == 0 and D.contained(df.limit(0), none).count() == 0


def test_items_of_repeated_words_stay_small():
    import pickle
    import tracemalloc

    rng = random.Random(3)
    items = [(n, "same " * n) for n in (20, 200, 1000, 5000, 20000)] + [(1, "a b c d e f g " * 900), (2, " ".join(f"w{i}" for i in range(300)))]
    docs = [(0, "x same same same same same y"), (1, "same same same same"), (2, "q " * 50 + "a b c d e f g " * 3), (3, items[-1][1] + " z"), (4, "a b c d e f " * 9)]
    docs += [(5 + i, " ".join(rng.choices("abcdefg", k=400))) for i in range(20)]
    tracemalloc.start()
    index = D.Index(items)
    found = index.search(pa.array([t for _, t in docs]))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and len(pickle.dumps(index)) < 4 << 20
    tracemalloc.stop()
    assert sorted(((docs[t][0], items[i][0], s, n) for t, i, s, n in found), key=repr) == brute(docs, items)
