import random

from plyframe.llm import tokencounts as T


def test_suffix_sums_against_brute_force(spark):
    rng = random.Random(6)
    n = [rng.choice([0, 1, 5, 1023, 1024, 1025, 5000, rng.randrange(9000)]) for _ in range(400)]
    sums = T.suffix_sums(T.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens bigint")))
    rows = sums.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        over = [x for x in n if x >= r.n_tokens]
        assert (r.docs, r.docs_ge, r.tokens_ge, r.total_docs, r.total_tokens) == (n.count(r.n_tokens), len(over), sum(over), len(n), sum(n))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
        assert abs(r.share_le - sum(x <= r.n_tokens for x in n) / len(n)) < 1e-12
    got = {r.context_limit: (r.docs_over, r.truncated_tokens) for r in T.at_limits(sums, [0, 3, 1024, 99999]).collect()}
    assert got == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (0, 3, 1024, 99999)}
    assert {r.share: r.n_tokens for r in T.quantiles(sums, [0.5, 1.0]).collect()} == {q: min(v for v in n if sum(x <= v for x in n) >= q * len(n)) for q in (0.5, 1.0)}


def test_lengths(spark):
    counter = T.Counter(T.load())
    texts = ["", None, "Hello world's  \n\n x", "a" * 60000, "日本語 🎉", "the the", "the the"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "x", "n")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in T.lengths(df, counter).collect()}
    e = counter.lengths(["x"]) and counter.encoding
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i] == len(ids) and e.decode(ids) == (t or "")
    assert got[None] == 1
    assert T.suffix_sums(T.histogram(T.lengths(df.limit(0), counter))).count() == 0
