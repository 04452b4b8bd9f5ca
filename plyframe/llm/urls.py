"""URL filtering by rules: given ones by host and path, mined ones by tokens. DataFrame functions only but for mining.

Given rules fit a host and its subdomains and a path prefix; the longest wins. Where none fits,
association rules decide: Spark's FP-growth finds token combinations of labelled URLs that occur
together with a bad label; those of enough support whose confidence is far enough above the share of bad URLs, by
itself and against chance, stay, unless a part of them is as sure. So rules can exist at any share of bad URLs. Rules are kept in an inverted index under their rarest token, so a URL meets
those of its own tokens only. Without a fitting rule a URL is allowed.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"
#: Mining: share and number of labelled bad URLs a rule needs; of what lies between the share of bad URLs and certainty, how much its
#: confidence must reach; and by how many standard deviations of chance it must do so.
MIN_SHARE, MIN_ROWS, CERTAINTY, DEVIATIONS = 0.002, 10, 0.2, 3.0
#: Tokens of a URL that combinations are made of: those that tell most by themselves. Rules are 2**TOKENS a URL at most.
TOKENS = 12
#: Mined rules in one expression; more of them take more expressions over the same row.
RULES_AT_ONCE = 500


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: Fixed rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    confidence: float
    support: float
    rarest: str


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """A host and the domains it is under, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as ``struct<length, rule, verdict>``; null if none does."""
    kind = "array<struct<host:string,path:string,rule:string,verdict:string>>"
    by_host: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        by_host[r.host].append(r)
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entry = lambda r: F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    index = F.create_map(*(x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))))
    there = F.flatten(F.transform(suffixes(host), lambda s: F.coalesce(F.try_element_at(index, s), F.array().cast(kind))))
    fits = F.filter(there, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def tokens(url: Column) -> Column:
    """What a URL is made of: scheme, host, top domain, path segments (digits as #), ending, query keys, fragment."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, path = parts(url)
    tagged = lambda tag, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag + ":"), v))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, r"\.\w+$", ""), r"\d+", "#"))
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    single = [("scheme", F.regexp_extract(url, r"^([^:/?#]*)://", 1)), ("host", host), ("top", F.substring_index(host, ".", -1)), ("ending", F.regexp_extract(path, r"\.(\w+)$", 1)), ("fragment", F.regexp_extract(url, r"#(.*)$", 1))]
    return F.array_distinct(F.concat(*(tagged(t, F.array(c)) for t, c in single), tagged("segment", segments), tagged("query", keys)))


def sure(n: Column, bad: Column, share: float) -> Column:
    """By how many standard deviations of chance n rows have more bad ones than that share."""
    return (bad - n * share) / F.sqrt(n * (share * (1 - share)))


def baskets(labelled: DataFrame) -> DataFrame:
    """``(items, bad)`` of ``labelled(url, bad)``: frequent tokens of each URL, at most TOKENS, and BAD where it is bad."""
    rows = cut(labelled.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("id"), "bad", tokens(F.col("url")).alias("own")))
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not n:
        return rows.select(F.col("own").alias("items"), "bad")
    each = rows.select("id", "bad", F.explode("own").alias("token"))
    told = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("m")).where(F.col("m") >= least(n))
    told = told.select("token", F.abs(sure(F.col("n"), F.col("m"), min(max(bad / n, 1e-9), 1 - 1e-9))).alias("tells"))
    best = each.join(told, "token").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("tells", "token")), False), 1, TOKENS)["token"].alias("best"))
    items = F.coalesce("best", F.array().cast("array<string>"))
    return rows.select("id", "bad").join(best, "id", "left").select(F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items).alias("items"), "bad")


def least(n: int) -> float:
    return max(MIN_SHARE * n, MIN_ROWS)


def mine(labelled: DataFrame) -> list[Mined]:
    """Rules of ``labelled(url, bad)``, the surest first.

    Null urls and null labels are passed over. Too few rows, or none or all bad, give no rule.
    """
    rows = cut(baskets(labelled))
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if n < MIN_ROWS or not 0 < bad < n:
        return []
    share = bad / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least(n) / n), minConfidence=share + CERTAINTY * (1 - share)).fit(rows.select("items"))
    single = {r.items[0]: r.freq for r in model.freqItemsets.where("size(items) = 1").collect()}
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).withColumn("m", F.col("support") * n)
    found = rules.where(sure(F.col("m") / F.col("confidence"), F.col("m"), share) >= DEVIATIONS).collect()
    kept: list[Mined] = []
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        own = frozenset(r.antecedent)
        if not any(own > frozenset(k.tokens) and k.confidence >= r.confidence for k in kept):
            kept.append(Mined(tuple(sorted(own)), r.confidence, r.support, min(own, key=lambda t: (single[t], t))))
    return sorted(kept, key=lambda k: (-k.confidence, -k.support, k.tokens))


def surest(own: Column, rules: list[Mined]) -> Column:
    """The surest mined rule whose tokens are all among ``own``, as ``struct<confidence, support, tokens>``."""
    kind = "struct<confidence:double,support:double,tokens:string>"
    best = []
    for at in range(0, len(rules), RULES_AT_ONCE):
        by: dict[str, list[Mined]] = defaultdict(list)
        for r in rules[at : at + RULES_AT_ONCE]:
            by[r.rarest].append(r)
        entry = lambda r: F.struct(F.lit(r.confidence).alias("confidence"), F.lit(r.support).alias("support"), F.array(*map(F.lit, r.tokens)).alias("need"))
        index = F.create_map(*(x for t, rs in by.items() for x in (F.lit(t), F.array(*map(entry, rs)))))
        none = F.array().cast("array<struct<confidence:double,support:double,need:array<string>>>")
        there = F.flatten(F.transform(own, lambda t: F.coalesce(F.try_element_at(index, t), none)))
        fits = F.filter(there, lambda r: F.size(F.array_except(r["need"], own)) == 0)
        best.append(F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), F.array_join(r["need"], " ").alias("tokens")))))
    return F.array_max(F.array(*best)) if best else F.lit(None).cast(kind)


def judged(pages: DataFrame, mined: list[Mined], rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict, mined_rule, confidence)`` for each row.

    Null or broken urls have empty host and path, fit no given rule and are allowed unless a mined
    rule fits. Repeated rows each give their row. Other columns aren't read.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("own"))
    rows = rows.select("id", "host", "path", fitting(F.col("host"), F.col("path"), rules).alias("given"), surest(F.col("own"), mined).alias("mined"))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.tokens").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))


def document(url: Column) -> Column:
    """The number of the document that a page shows: the last number in its url's path; null if there is none."""
    return F.regexp_extract(parts(url)[1], r"(\d+)\D*$", 1).try_cast("bigint")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, bad)``: a page's label is that of the document it shows; bad means toxic or of low quality."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return pages.select("url", document(F.col("url")).alias("doc_id")).join(bad, "doc_id").select("url", (F.col("bad") == 1).alias("bad"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, mine(labelled(pages, table(spark, sf_dir, "labels"))))


def url_given_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the given rules alone say of each page."""
    return judged(table(spark, sf_dir, "pages"), []).select("page_id", "host", "path", "rule", "verdict")


URL_GIVEN_RULES_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS row_id, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT row_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (row_id)
"""
