import itertools
import random

import duckdb
from pyspark.sql import functions as F

from plyframe.llm import urls as U


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:k], rest[k:]
    k = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:k]


def brute_rule(host, path, rules=U.RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


URLS = ["http://Example.ORG/en/12?x=1", "https://a.b.example.org/es/", "http://example.org/es", "http://notexample.org/es/1", "ftp://x.COM/fr/1#a", "http://y.com/de/", "http://y.com", "http://z.net/de/", None, "", "no scheme/org/", "://org/", "http://org/x", "http://É.Org/é", "a://b://c.org/", "http://u.org?x=/y", "http://h.com\n/fr/x", "http://.org/", "http://org", "http://" + "a." * 3000 + "org/"]


def test_parts_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[1], None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in U.judged(df, []).collect()), key=repr)
    want = []
    for i, u, _ in rows:
        h, p = brute_parts(u)
        r = brute_rule(h, p)
        want.append((i is None, i or 0, h, p, r and r.host + r.path, r.verdict if r else "allow"))
    assert got == sorted(want, key=repr)
    assert U.judged(df.limit(0), []).count() == 0


def test_mined_rules(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        spam, promo = rng.random() < 0.1, rng.random() < 0.3
        host = "spam.net" if spam else rng.choice(["a.net", "b.net", "c.info"])
        url = f"http://{host}/{rng.choice(['en', 'fr'])}/{rng.randrange(99)}" + ("?promo=1" if promo else "")
        rows.append((url, rng.random() < (0.95 if spam else 0.9 if promo and host == "a.net" else 0.02)))
    rows += [(None, True), ("http://a.net/", None)]
    mined = U.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    found = {m.tokens for m in mined}
    assert ("host:spam.net",) in found and ("host:a.net", "query:promo") in found
    clean = [(u, b) for u, b in rows if u is not None and b is not None]
    assert {(m.tokens, round(m.confidence, 9)) for m in mined} == brute_rules(clean)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(clean)], "page_id int, url string")
    for size in (500, 2):
        monkeypatch.setattr(U, "RULES_AT_ONCE", size)
        for r in U.judged(df, mined).collect():
            own = set(spark_tokens(clean[r.page_id][0]))
            fit = [m for m in mined if set(m.tokens) <= own]
            assert r.verdict == ("block" if fit else "allow")
            assert r.confidence == (max(m.confidence for m in fit) if fit else None)
    assert U.mine(spark.createDataFrame(rows[:5], "url string, bad boolean")) == []


def brute_rules(rows):
    """Every combination of tokens, without FP-growth."""
    sets = [(frozenset(spark_tokens(u)), b) for u, b in rows]
    n, share = len(sets), sum(b for _, b in sets) / len(sets)
    subsets = {frozenset(c) for own in {s for s, b in sets if b} for k in range(1, len(own) + 1) for c in itertools.combinations(own, k)}
    kept = []
    for own in sorted(subsets, key=lambda s: (len(s), sorted(s))):
        fits = [b for s, b in sets if own <= s]
        m, conf = sum(fits), sum(fits) / len(fits)
        if m >= max(U.MIN_ROWS, U.MIN_SHARE * n) and conf >= share + U.CERTAINTY * (1 - share) and (m - len(fits) * share) / (len(fits) * share * (1 - share)) ** 0.5 >= U.DEVIATIONS:
            if not any(own > k and c >= conf for k, c in kept):
                kept.append((own, conf))
    return {(tuple(sorted(k)), round(c, 9)) for k, c in kept}


def test_rules_at_a_high_share_of_bad_urls_and_many_tokens(spark):
    rng = random.Random(5)
    keys = "&".join(f"k{i}=1" for i in range(40))
    rows = [(f"http://spam.net/x/{i}?{keys}", True) for i in range(300)] + [(f"http://h{i % 7}.net/y/{i}?{keys}", rng.random() < 0.7) for i in range(300)]
    mined = U.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert any(m.tokens == ("host:spam.net",) and m.confidence == 1 for m in mined)
    assert U.mine(spark.createDataFrame([(u, True) for u, _ in rows], "url string, bad boolean")) == []


def test_a_page_has_the_label_of_the_document_it_shows(spark):
    pages = spark.createDataFrame([(5, "http://a.net/en/17?x=3"), (17, "http://b.net/fr/5.html"), (6, "http://c.net/"), (7, None), (8, "http://d.net/12345678901234567890")], "page_id int, url string")
    labels = spark.createDataFrame([(17, 0, 0), (5, 1, 0), (5, 1, None), (None, 0, 1)], "doc_id int, quality int, toxic int")
    assert sorted(map(tuple, U.labelled(pages, labels).collect()), key=str) == [("http://a.net/en/17?x=3", True), ("http://b.net/fr/5.html", False)]


def test_given_rules_by_sql(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = U.url_given_rules(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute("select page_id, host, path, rule, verdict from (" + U.URL_GIVEN_RULES_SQL + ")").fetchall(), key=str)


def spark_tokens(url):
    host, path = brute_parts(url)
    import re

    out = [f"scheme:{url.split('://')[0]}", f"host:{host}", f"top:{host.split('.')[-1]}"]
    out += [f"segment:{re.sub(r'[0-9]+', '#', s)}" for s in path.split("/") if s]
    return out + (["query:promo"] if "?promo" in url else [])


def test_tokens(spark):
    df = spark.createDataFrame([("https://A.b.c/x/12.html?k=1&z#top",), (None,)], "url string")
    a, b = (r[0] for r in df.select(U.tokens(F.col("url"))).collect())
    assert a == ["scheme:https", "host:a.b.c", "top:c", "ending:html", "fragment:top", "segment:x", "segment:#", "query:k", "query:z"] and b == []
