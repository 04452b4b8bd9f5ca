import random
import zlib

from pyspark.sql import functions as F

from plyframe.llm import langid as L


def brute_phrases(text, sample, letters):
    code = lambda s: "".join(c if c == " " or c in letters else "\x01" for c in s)
    text, sample, n = code(text), code(sample), 0
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_against_brute_force(monkeypatch):
    rng = random.Random(7)
    for block in (1024, 7, 1):
        monkeypatch.setattr(L, "BLOCK", block)
        samples = {"b": "banana bandana é", "a": "abc abd  xyz!", "c": "日本語 ab"}
        model = L.Model(samples)
        texts = ["".join(rng.choice("abnd xyzé日q1!.\n") for _ in range(rng.randrange(60))) for _ in range(120)] + [None, "", "123", "\U00020000ab \U0001f389", "BANANA"]
        count, length = model.phrases(texts)
        letters = set(model.code)
        for t, row, n in zip(texts, count, length):
            clean = L.normal(t or "")
            assert n == len(clean)
            assert row.tolist() == [brute_phrases(clean, model.texts[k], letters) for k in model.langs]


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(50):
        s = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 15)))
        steps = L.automaton(s)

        def known(t):
            at = 0
            for c in t:
                if c not in steps[at]:
                    return False
                at = steps[at][c]
            return True

        for _ in range(40):
            t = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6)))
            assert known(t) == (t in s)


def test_tables(spark):
    rng = random.Random(3)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(30))
    rows = [(i, make(["the", "ing", "er"]) if i % 2 else make(["eau", "é", "que"]), "en" if i % 2 else "fr", 1.5) for i in range(80)]
    rows += [(None, rows[1][1], "en", 0.0), (200, None, "en", 0.0), (201, "", None, 0.0), (202, "12 !", "fr", 0.0), (203, rows[0][1] * 400, None, 0.0), (5, rows[5][1], "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    model = L.train(df.where(L.chosen(F.col("doc_id"))))
    got = L.predict(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(80)) and by[None].lang_pred == "en" and by[203].lang_pred == "fr"
    assert all((by[i].lang_pred, by[i].score, by[i].phrases) == ("und", 0.0, 0) for i in (200, 201, 202))
    assert [r.c for r in df.where("doc_id is not null").select("doc_id", L.chosen(F.col("doc_id")).alias("c")).collect()] == [zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in rows if r[0] is not None]
    kept = L.keep_known(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    none = L.train(df.limit(0))
    assert none.langs == [] and {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0
    one = L.Model({"en": rows[1][1]})
    assert {r.lang_pred for r in L.predict(df.where("doc_id < 10"), one).collect()} == {"en"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_CHARS", 300)
    df = spark.createDataFrame([(i, "ab " * (20 + i), "x") for i in range(500)] + [(900, "longer " * 99, "y")], "doc_id bigint, text string, lang string")
    model = L.train(df)
    assert set(model.langs) == {"x", "y"} and L.train(df.withColumn("lang", F.when(F.col("doc_id") == 900, "y"))).langs == ["y"]
    nulls = df.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.col("text")))
    assert set(L.train(nulls).langs) == {"x", "y"}
    assert all(0 < len(t) <= 301 for t in model.texts.values())


def test_held_out_accuracy(spark):
    rows = L.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
