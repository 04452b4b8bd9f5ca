import random

import numpy as np
import pytest

import corpus_pipeline
from plyframe.llm import sentencepieces


def corpus():
    rng = random.Random(21)
    syllables = {"en": ["the", "ing", "er", "tion", "w", "sh"], "fr": ["eau", "é", "oui", "que", "ç", "ment"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 6))) for _ in range(n))

    items = [(i, text("en", 30)) for i in range(3)]
    docs = [(i, text("en" if i % 3 else "fr", rng.randrange(60, 200)), "en" if i % 3 else "fr") for i in range(60)]
    shared = text("en", 70)
    docs += [(100, docs[4][1], "en"), (101, "12345 !!", "en"), (102, None, "en"), (103, "", None)]
    docs += [(110, text("en", 80) + " " + shared, "en"), (111, text("en", 90) + " " + shared + " " + text("en", 20), "en")]
    docs += [(120, text("en", 300) + " " + items[1][1] + " " + text("en", 300), "en")]
    return docs, items, shared


@pytest.mark.parametrize("extra", [False, True])
def test_every_decision(spark, tmp_path, extra):
    docs, items, shared = corpus()
    rows = [(*d[:2], d[2], "src0", len(d[1] or ""), 1) for d in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int")
    (df if extra else df.drop("row")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {d[0] for d in docs} - {100, 101, 102, 103, 120}
    assert set(got) == clean
    text = dict((d[0], d[1]) for d in docs)
    e = sentencepieces.Encoder(sentencepieces.load())
    for i, r in got.items():
        assert r.text == (text[i] if i != 111 else text[i].replace(shared + " ", "")) or i == 111 and shared not in r.text and r.text.split() == text[i].replace(shared, "").split()
        assert r.lossless and r.n_tokens == len(r.ids) and e.decode(np.array(r.ids)).decode() == r.text and r.n_chars == len(r.text)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    _, items, _ = corpus()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0, name
