"""Main text of web pages, by wrappers inferred for each host as union-free regular expressions.

A page is a tree of blocks. Pages of one host are aligned one after the other: children that pair
up are merged, a child without partner becomes optional, neighbours of one kind and tandem groups
become repeated, and where texts differ a text becomes a slot. So a wrapper is built of sequences,
options, repetitions and slots, without unions; where a node's children come in no fixed order it is
generalised to a repeated group of optional children. A wrapper's size follows the kinds of blocks
that a host uses, not its number of pages.

Pages of one structure are merged where they are, in any order; only these wrappers are shuffled, and merged in the order
of their structures, in two rounds. So a host with a third of all pages is no hot spot and partitioning has no part in
the result. Pages are shuffled only where wrappers are too large to be broadcast, and then each host is dealt over
many partitions. A page is then aligned with its host's wrapper. Where a page marks its article, that is the main text,
else it's the container that has most of the slots' text over all of the host's pages, without blocks whose text is the same on
many different pages. Elements that say plainly that they are something else (menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like) are no part of it; of those that may (``WEAK_WORDS``) the wrapper decides: on
the host's pages they are mostly links, or the same text. Nothing else within an article goes.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import cut, slices, table
from plyframe.llm.urls import parts

#: Fixed values of HTML: elements without content, in-line ones, and those whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp select".split())
#: An opening element ends an open one of these, unless one of the others comes between.
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("table ul ol dl article section main div body aside nav blockquote".split())
#: Blocks before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Elements, roles and words of class or id that are no main text.
OTHER_TAGS = frozenset("head title nav header footer aside form button menu dialog input datalist fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies gdpr "
    "notice notices notification alert popup modal overlay menu nav navbar navigation header masthead topbar footer sidebar side aside related recommended share sharing social subscribe newsletter signup login search "
    "widget pagination pager toolbar skip hidden".split()
)
#: Of these, words that main text may have too, and words that say nothing beside them.
WEAK_WORDS = frozenset("related recommended search share sharing side skip social subscribe widget".split())
PLAIN_WORDS = frozenset("area bar bottom box block column container content group inner item left list main outer page panel post right section site slot text top unit user wrap wrapper".split())
#: Different pages on which a text must recur to be template; hashes kept to count them.
TEMPLATE_PAGES, KEPT_HASHES = 5, 8
#: Children beyond this many for each kind make a node a repeated group of options.
MOST_PER_KIND = 4
#: Cells of an alignment whose rows are all kept; larger ones are halved first.
CELLS = 1 << 26
#: Blocks nested deeper than this count as children of the last one.
DEEPEST = 120
SALTS, HOSTS_AT_ONCE = 64, 2000
#: Wrappers of all hosts together that are broadcast at most.
BROADCAST_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def says(names: str) -> int:
    """Whether classes and ids name other matter: 2, perhaps: 1, or not: 0. All words of one name must fit."""
    best = 0
    for name in names.split():
        words = {w.lower() for w in WORD.findall(name) if not w.isdigit()}
        if words <= OTHER_WORDS | PLAIN_WORDS and words & OTHER_WORDS:
            best = max(best, 1 if words & OTHER_WORDS <= WEAK_WORDS else 2)
    return best


def leaf(text: str, links: int, block: int, page: int) -> dict:
    kept = text if len(text) <= 80 else f"{zlib.crc32(text.encode()):08x}:{len(text)}"
    return {"l": "#", "t": kept, "k": len(text), "a": links, "d": [page], "b": [block]}


class Page:
    """Blocks of a page in order, whether each is in the article, and the tree that holds them."""

    def __init__(self, source: str | None) -> None:
        source = source or ""
        self.blocks: list[str] = []
        self.main: list[int] = []
        self.weak: list[bool] = []
        self.root = {"l": "", "c": []}
        self.hash = zlib.crc32(source.encode("utf-8", "surrogatepass"))
        #: Open elements: name, nearest tree node and its depth, whether it's other matter (2) or may be (1), rank as article, open links.
        self.open: list[tuple[str, dict, int, int, int, int]] = [("", self.root, 1, 0, 0, 0)]
        self.names: Counter[str] = Counter()
        self.text: list[str] = []
        self.links = 0
        at = 0
        scan = TOKEN.scanner(source)
        while (m := scan.search()) is not None:
            self.say(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.say(m[0][9:].removesuffix("]]>"), False)
            elif m[1] or m[4]:
                self.close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end and not (m[3] or "").endswith("/") else at if (m[3] or "").endswith("/") else len(source)
                scan = TOKEN.scanner(source, at)
            else:
                self.begin(name, m[3] if m[3] is not None else m[6] or "")
        self.say(source[at:])
        self.flush()
        folded(self.root)
        best = max(self.main, default=0)
        self.has_article = best > 0
        self.in_article = [m == best for m in self.main]

    def say(self, text: str, escaped: bool = True) -> None:
        if text and self.open[-1][3] < 2:
            text = html.unescape(text) if escaped and "&" in text else text
            self.text.append(text)
            if self.open[-1][5]:
                self.links += len(text)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.open[-1][1]["c"].append(leaf(text, min(self.links, len(text)), len(self.blocks), self.hash))
                self.blocks.append(text)
                self.main.append(self.open[-1][4])
                self.weak.append(self.open[-1][3] == 1)
            self.text, self.links = [], 0

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
        if name in VOID:
            if name not in INLINE and name != "br":
                self.flush()
            return
        if name not in INLINE:
            self.flush()
            if name in IMPLIED:
                self.end(IMPLIED[name])
            elif name in ENDS_P:
                self.end(("p",))
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip("/ \n\t") else {}
        style = found.get("style", "").replace(" ", "").lower()
        role = found.get("role", "").lower()
        sure = name in OTHER_TAGS or role in OTHER_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
        _, node, depth, other, above, links = self.open[-1]
        other = max(other, 2 if sure else 0 if name in INLINE or name in ("html", "body") else says(f"{found.get('class', '')} {found.get('id', '')}"))
        rank = 2 if name == "article" or found.get("itemprop") == "articleBody" else 1 if name == "main" or role == "main" else 0
        if name not in INLINE and depth < DEEPEST:
            own = {"l": name + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(found.get("class", "").split()))), "c": []}
            node["c"].append(own)
            node, depth = own, depth + 1
        self.open.append((name, node, depth, other, max(rank, above), links + (name == "a")))
        self.names[name] += 1

    def drop(self, first: int) -> None:
        for name, *_ in self.open[first:]:
            self.names[name] -= 1
        del self.open[first:]

    def end(self, names: tuple[str, ...]) -> None:
        if any(self.names[n] for n in names):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in names:
                    return self.drop(i)
                if self.open[i][0] in SCOPES:
                    return

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        if self.names[name]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == name:
                    return self.drop(i)
                if name in INLINE and self.open[i][0] not in INLINE:
                    return


def kinds(node: dict) -> set[str]:
    return {c["l"] for c in node.get("c", ())}


def alike(a: dict, b: dict) -> bool:
    """Whether neighbours of one label are repetitions of each other."""
    if a["l"] != b["l"]:
        return False
    x, y = kinds(a), kinds(b)
    return x <= y or y <= x or 2 * len(x & y) >= len(x | y)


def merged(a: dict, b: dict, again: bool = False) -> dict:
    """The wrapper of two nodes of one label; ``again``: they repeat within one page."""
    out = {k: a.get(k) or b.get(k) for k in ("o", "p") if a.get(k) or b.get(k)}
    out["l"] = a["l"]
    if again:
        out["p"] = 1
    if "c" not in a:
        out |= {"t": a["t"] if a["t"] == b["t"] else None, "k": a["k"] + b["k"], "a": a["a"] + b["a"], "d": sorted({*a["d"], *b["d"]})[:KEPT_HASHES]}
        if "b" in a or "b" in b:
            out["b"] = a.get("b", []) + b.get("b", [])
        return out
    x, y = a["c"], b["c"]
    if not a.get("loop") and not b.get("loop"):
        if [c["l"] for c in x] == [c["l"] for c in y]:
            out["c"] = [merged(p, q) for p, q in zip(x, y)]
            return out
        out["c"] = [merged(p, q) if p and q else optional(p or q) for p, q in aligned(x, y)]
        if len(out["c"]) <= MOST_PER_KIND * len(kinds(out)):
            return out
        x, y = out["c"], []
    by: dict[str, dict] = {}
    for c in [*x, *y]:
        by[c["l"]] = optional(merged(by[c["l"]], c, True) if c["l"] in by else c)
    out |= {"loop": 1, "c": [by[k] for k in sorted(by)]}
    return out


def optional(node: dict) -> dict:
    return node | {"o": 1}


def rows(x: list[str], y: list[str]) -> Iterator[int]:
    """For each beginning of x a row of bits: bit j is 0 where y's (j + 1)-th label lengthens the longest common sequence."""
    where: dict[str, int] = {}
    for j, c in enumerate(y):
        where[c] = where.get(c, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    yield row
    for c in x:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence, by rows of bits; of long ones x is halved, so memory stays bounded."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    a, b = x[low : len(x) - high], y[low : len(y) - high]
    out = [(i, i) for i in range(low)]
    if not a or not b:
        pass
    elif len(a) * len(b) <= CELLS or len(a) == 1:
        held, i, j, found = list(rows(a, b)), len(a), len(b), []
        while i and j:
            if held[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or held[i] >> (j - 1) & 1:
                    j -= 1
                    found.append((low + i, low + j))
        out += found[::-1]
    else:
        half = len(a) // 2
        for first in rows(a[:half], b):
            pass
        for last in rows(a[half:][::-1], b[::-1]):
            pass
        n = len(b)
        left = np.append(0, np.cumsum([not first >> j & 1 for j in range(n)]))
        right = np.append(0, np.cumsum([not last >> j & 1 for j in range(n)]))[::-1]
        cut_at = int((left + right).argmax())
        out += [(low + i, low + j) for i, j in common(a[:half], b[:cut_at])]
        out += [(low + half + i, low + cut_at + j) for i, j in common(a[half:], b[cut_at:])]
    return out + [(len(x) - k, len(y) - k) for k in range(high, 0, -1)]


def aligned(x: list[dict], y: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Children in order, paired where a longest common sequence of labels pairs them."""
    out, i, j = [], 0, 0
    for p, q in [*common([c["l"] for c in x], [c["l"] for c in y]), (len(x), len(y))]:
        out += [(c, None) for c in x[i:p]] + [(None, c) for c in y[j:q]]
        if p < len(x):
            out.append((x[p], y[q]))
        i, j = p + 1, q + 1
    return out


def folded(node: dict) -> None:
    """Makes repetitions of a page's node into repeated children: neighbours of a kind, then tandem groups."""
    out: list[dict] = []
    for c in node["c"]:
        if "c" in c:
            folded(c)
        if out and alike(out[-1], c):
            out[-1] = merged(out[-1], c, True)
        else:
            out.append(c)
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(out):
            label = [c["l"] for c in out[i : i + period]]
            if label == [c["l"] for c in out[i + period : i + 2 * period]]:
                group, n = {"l": f"({' '.join(label)})", "c": out[i : i + period], "p": 1}, i + period
                while [c["l"] for c in out[n : n + period]] == label:
                    group = group | {"c": [merged(p, q) for p, q in zip(group["c"], out[n : n + period])]}
                    n += period
                out[i:n] = [group]
            i += 1
    node["c"] = out


def bare(node: dict) -> dict:
    """A page's tree without what belongs to the page alone."""
    return {k: [bare(c) for c in v] if k == "c" else v for k, v in node.items() if k != "b"}


def expression(node: dict) -> str:
    """A wrapper as text: ``<p>...</p>``, ``(..)?``, ``(..)+``, template texts quoted, slots as ``#``."""
    inner = (json.dumps(node["t"], ensure_ascii=False) if node["t"] is not None else "#") if "c" not in node else "".join(map(expression, node["c"]))
    if "c" in node and node.get("loop"):
        inner = f"({inner})+"
    if "c" in node and node["l"] and not node["l"].startswith("("):
        inner = f"<{node['l']}>{inner}</>"
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[node.get("o", 0), node.get("p", 0)]
    return f"({inner}){mark}" if mark else inner


def leaves(node: dict) -> Iterator[dict]:
    if "c" in node:
        for c in node["c"]:
            yield from leaves(c)
    else:
        yield node


class Wrapper:
    """A host's wrapper and which of its texts are template or main."""

    def __init__(self, root: dict) -> None:
        self.root = root
        slots = [x for x in leaves(root) if x["t"] is None]
        for x in leaves(root):
            x["template"] = bool(slots) and x["t"] is not None and len(x["d"]) >= TEMPLATE_PAGES
            x["main"] = not x["template"] and 2 * x["a"] <= x["k"]
        self.inside(root)

    def inside(self, node: dict) -> None:
        """Keeps main what is below the deepest container that has most of the main text."""
        weight = lambda n: sum(x["k"] for x in leaves(n) if x["main"])
        total = weight(node)
        holds = lambda n: not n["l"].startswith("(") and any("c" in c for c in n.get("c", ()))
        while (heavy := [c for c in node.get("c", ()) if holds(c) and 2 * weight(c) > total]) and total:
            below = {id(x) for x in leaves(heavy[0])}
            for x in leaves(node):
                x["main"] &= id(x) in below
            node, total = heavy[0], weight(heavy[0])

    def kept(self, page: Page) -> list[str]:
        role: dict[int, dict] = {}
        self.match(page.root, self.root, role)
        out = []
        for i, text in enumerate(page.blocks):
            of = role.get(i)
            if page.weak[i] and of is not None and (of["template"] or 2 * of["a"] > of["k"]):
                continue
            if page.in_article[i] if page.has_article else of is None or of["main"]:
                out.append(text)
        return out

    def match(self, node: dict, of: dict, role: dict[int, dict]) -> None:
        if "c" not in node:
            role.update(dict.fromkeys(node["b"], of))
            return
        if of.get("loop"):
            by = {c["l"]: c for c in of["c"]}
            pairs = [(c, by.get(c["l"])) for c in node["c"]]
        else:
            pairs = aligned(node["c"], of["c"])
        for a, b in pairs:
            if a is not None and b is not None:
                self.match(a, b, role)


def structure(node: dict) -> str:
    """The labels of a page's tree, repetitions and options marked: pages that share it are merged leaf by leaf."""
    mark = "?" * node.get("o", 0) + "+" * node.get("p", 0) + "*" * node.get("loop", 0)
    return node["l"] + mark + ("(" + ",".join(map(structure, node["c"])) + ")" if "c" in node else "")


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of ``(host, html)``, wrapper as JSON: one row a host, inferred from all of its pages."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict] = {}

        def out() -> pa.RecordBatch:
            found = list(held.items())
            held.clear()
            columns = [[h for (h, _), _ in found], [k for (_, k), _ in found], [json.dumps(w) for _, w in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "kind", "wrapper"])

        for whole in batches:
            for b in slices(whole, 1):
                for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = bare(Page(source).root)
                    key = host, hashlib.md5(structure(own).encode("utf-8", "surrogatepass")).hexdigest()
                    held[key] = merged(held[key], own) if key in held else own
                    if len(held) >= HOSTS_AT_ONCE:
                        yield out()
        if held:
            yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, dict] = {}
        for kind, text in sorted(zip(group["kind"], group["wrapper"])):
            one = json.loads(text)
            by[kind] = merged(by[kind], one) if kind in by else one
        return pd.DataFrame({"host": [group["host"].iloc[0]], "kind": [min(by)], "wrapper": [json.dumps(reduce(merged, by.values()))]})

    found = pages.mapInArrow(infer, "host string, kind string, wrapper string")
    some = found.groupBy("host", F.substring("kind", 1, 2).alias("salt")).applyInPandas(join, "host string, kind string, wrapper string")
    return some.groupBy("host").applyInPandas(join, "host string, kind string, wrapper string").select("host", "wrapper")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for each row.

    Null and empty html have empty text, as have pages of template only. Pages without a host share one
    wrapper. Repeated rows each give their row; n_chars counts code points. Other columns aren't read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), parts(F.col(url_col))[0].alias("host"))
    known = cut(wrappers(rows.select("host", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Wrapper] = {}
        for whole in batches:
            for b in slices(whole, 2):
                texts = []
                for source, host, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                    if host not in own:
                        if len(own) >= HOSTS_AT_ONCE:
                            own.clear()
                        own[host] = Wrapper(json.loads(wrapper.as_py()))
                    texts.append(" ".join(own[host].kept(Page(source))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["id", "url", "text", "n_chars"])

    # Wrappers of few kilobytes each are sent to the pages where they are proven small; else pages
    # are dealt out, and every host over SALTS partitions.
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known), "host")
    else:
        salt = F.pmod(F.xxhash64("id", "url", "html"), F.lit(SALTS)).cast("int")
        every = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(every, ["host", "salt"])
    joined = joined.select("id", "url", "html", "host", "wrapper")
    out = joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
