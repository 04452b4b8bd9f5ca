import random

import pytest

from plyframe.llm import webtext as W

RNG = random.Random(12)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 8))) for _ in range(n))


def article(k):
    body = [words(12) for _ in range(k)]
    inner = "".join(f"<p class='x'>{b}" + ("</p>" if i % 2 else "") for i, b in enumerate(body))
    page = f"<html><head><title>no</title></head><body><header>Site</header><nav><ul><li><a href='/'>{words(1)}</a><li>{words(1)}</ul></nav><aside class=sidebar>{words(9)}</aside><main><article><h1>{body[0]}</h1>{inner}<p>Read more about our site</p><div id='comments'><article><p>{words(6)}</p></article></div><form>x<input></form></article></main><footer>&copy; {words(3)}</footer><script>var a='<p>no</p>';</script></body></html>"
    return page, " ".join([body[0], *body, "Read more about our site"])


def plain(k):
    body = [words(15) for _ in range(k)]
    page = f"<body><div class='menu'>{words(3)}</div><div><a href='#'>{words(2)}</a> <a>{words(2)}</a></div><div><h2>{body[0]}</h2>" + "".join(f"<p>{b}</p><ul><li>{b[:9]}</li></ul>" for b in body[1:]) + "</div><div>All rights kept</div></body>"
    return page, " ".join([body[0], *(x for b in body[1:] for x in (b, b[:9].strip()))])


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_pages_of_two_templates(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
    rows, want = [], {}
    for i in range(40):
        make = article if i % 2 else plain
        page, text = make(RNG.randrange(2, 7))
        rows.append((i, f"http://{'A' if i % 2 else 'b'}.org/{i}", page, "t"))
        want[i] = text
    odd = [None, "", "<", "just &amp; text\n\n x", "<p>a<b>b</b>c<br>d&nbsp;e<!-- <p>no</p>", "<div hidden>no</div><p>&lt;p&gt;</p>", "<script>never closed", "<p " + "x" * 1000, '<a "' * 500, "<div>" * 3000 + "deep"]
    expect = ["", "", "<", "just & text x", "abc d e", "<p>", "", "", None, "deep"]
    rows += [(100 + i, f"http://odd{i}.net", h, "t") for i, h in enumerate(odd)] + [(None, None, "<p>lost</p>", None), (0, rows[0][1], rows[0][2], "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = W.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r.text for r in got}
    assert {i: found[i] for i in want} == want
    for i, t in enumerate(expect):
        assert t is None or found[100 + i] == t, odd[i]
    assert found[None] == "lost" and W.main_text(df.limit(0)).count() == 0


def test_wrapper_grammar():
    page = lambda s: W.bare(W.Page(s).root)
    a = page("<div><p>one</p><p>two</p><hr><em>x</em></div><footer>f</footer>")
    b = page("<div><h2>t</h2><p>three</p></div><footer>f</footer>")
    assert W.expression(W.merged(a, b)) in ('<div>(<h2>"t"</>)?(<p>#</>)+("x")?</><footer></>',)
    c = page("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")
    assert W.expression(c) == "<dl>(<dt>#</><dd>#</>)+</>"
    mixed = page("<div></div>")
    for order in ("pho", "hop", "oph", "phph", "ohpo", "hhpoph"):
        mixed = W.merged(mixed, page("<div>" + "".join({"p": "<p>a</p>", "h": "<h3>b</h3>", "o": "<ol><li>c</ol>"}[k] for k in order) + "</div>"))
    assert len(W.expression(mixed)) < 200


def test_merging_in_any_order_keeps_counts():
    pages = [W.bare(W.Page(article(k)[0]).root) for k in (2, 3, 4, 5)]
    one, two = pages[0], pages[3]
    for p in pages[1:]:
        one = W.merged(one, p)
    for p in pages[2::-1]:
        two = W.merged(two, p)
    count = lambda w: sorted((x["k"], x["t"] or "", tuple(x["d"])) for x in W.leaves(w))
    assert count(one) == count(two)


def brute_common(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_sequence(monkeypatch):
    for cells in (1 << 26, 8):
        monkeypatch.setattr(W, "CELLS", cells)
        for _ in range(300):
            x, y = ([RNG.choice("abcd") for _ in range(RNG.randrange(14))] for _ in range(2))
            found = W.common(x, y)
            assert all(x[i] == y[j] for i, j in found) and len(found) == brute_common(x, y)
            assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_many_mixed_siblings_are_aligned():
    def page(n):
        return W.Page("<div>" + "".join(f"<{k}>{i}</{k}>" for i, k in enumerate(RNG.choices(["p", "h2", "pre", "div"], k=n))) + "</div>")

    a = page(30000)
    wrapper = W.Wrapper(W.merged(W.bare(a.root), W.bare(page(20000).root)))
    assert len(wrapper.kept(a)) == 30000
    assert len(W.Page("<pre>" * 20000 + "</b></ul>" * 20000 + "x").blocks) == 1


def rowset(spark, pages, parts):
    df = spark.createDataFrame([(i, f"http://one.org/{i}", p) for i, p in enumerate(pages)], "page_id int, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in W.main_text(df).collect()}


def test_nothing_of_an_article_goes_and_wrappers_decide_without_one(spark):
    math = "<p>Euler <math><mi>e</mi></math> and <i class='search'>search</i> done</p><section class='related-work'><h2>Related work</h2><p>{}</p></section>"
    pages, want = [], []
    for i in range(12):
        body = [words(20) for _ in range(3)]
        links = f"<div class='related'><a href='x'>{words(3)}</a><a href='y'>{words(2)}</a></div>" if i % 2 else ""
        pages.append(f"<body><div><a>{words(2)}</a></div><article><h2>Introduction</h2><p>{body[0]}</p>{math.format(body[1])}{links}</article><div>Terms of use</div></body>")
        want.append(f"Introduction {body[0]} Euler e and search done Related work {body[1]}")
    for i in range(12):  # no telling tag or class at all
        body = [words(25) for _ in range(2 + i % 3)]
        pages.append(f"<body><div><a>{words(2)}</a> <a>{words(1)}</a></div><section><div><p>Sign in to follow this site</p></div><div class=c{i}>{''.join(f'<p>{b}</p>' for b in body)}</div></section><table><tr><td>Terms of use</table></body>")
        want.append(" ".join(body))
    for part in (slice(0, 12), slice(12, 24)):
        first = rowset(spark, pages[part], 1)
        assert first == dict(enumerate(want[part]))
        assert rowset(spark, pages[part], 5) == first
