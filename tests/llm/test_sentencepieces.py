import random

import numpy as np
import sentencepiece

from plyframe.llm import sentencepieces as S

TEXTS = ["", " ", "  a  b ", "日本 𝔘é\x00", "▁a▁b ▁", "a\n\n\tb  ", "internationalization " * 40, "x" * 3000 + " " + "yz" * 90, "the the, The.\nthe"]


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_without_dropout_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)
    e = S.Encoder(S.load(), dropout=0)
    texts = [t for t in TEXTS if "▁" not in t]
    assert [ids(r) for r in e.encode(texts)] == [sp.encode(t) for t in texts]


def test_dropout_varies_by_seed_and_is_lossless():
    base = [ids(r) for r in S.Encoder(S.load(), dropout=0).encode(TEXTS)]
    a, b = S.Encoder(S.load(), seed=1, dropout=0.3), S.Encoder(S.load(), seed=2, dropout=0.3)
    one, two = a.encode(TEXTS), b.encode(TEXTS)
    assert one == S.Encoder(S.load(), seed=1, dropout=0.3).encode(TEXTS[::-1])[::-1]
    assert one != two and ids(one[6]) != base[6] and len(ids(one[6])) > len(base[6])
    repeats = S.Encoder(S.load(), seed=1, dropout=0.3).encode(["internationalization " * 40])[0]
    assert len({repeats[i : i + 8] for i in range(0, len(repeats) - 8, 4)}) > 8
    for raw, t in zip(one, TEXTS):
        assert a.decode(np.frombuffer(raw, "<i4")).decode() == t
    c = S.Encoder(S.load(), dropout=1.0)
    assert all(len(ids(r)) >= len(t) for r, t in zip(c.encode(TEXTS), TEXTS))


def test_arrays_and_heap_agree():
    rng = random.Random(2)
    e = S.Encoder(S.load(), dropout=0.25)
    e.build()
    for k in range(150):
        word = " " + "".join(rng.choices(["th", "er", "ing", "a", "é", "x", "日", "▁"], k=rng.randrange(1, 20)))
        points, key = np.array(list(map(ord, word))), S.mix(np.array([k], np.uint64))
        assert next(e.rows(points[None, :], np.ones((1, len(word)), bool), key)) == e.ids_of(e.agenda(points, key[0]))


def test_tables(spark):
    rows = [(i, t, i, "n") for i, t in enumerate(TEXTS)] + [(90, None, 0, "n"), (None, "a b", 1, None), (0, "", 0, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, row string")
    e = S.Encoder(S.load())
    out = S.encode(df, e)
    assert out.columns == ["doc_id", "text", "row", "ids", "n_tokens", "lossless"]
    got = S.decode(out, e).collect()
    assert len(got) == len(rows) and all(r.lossless and r.decoded == r.text for r in got)
    assert {r.n_tokens for r in got if r.text is None} == {0} and all((r.ids is None) == (r.text is None) for r in got)
    assert S.encode(df.limit(0), e).count() == 0
