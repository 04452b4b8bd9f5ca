"""Exact token counts: a length histogram and its suffix sums.

Documents are encoded whole and counted by encoded length, which is all that is shuffled. Suffix
sums over the histogram then answer, for every context limit, how many documents reach it, how
many tokens there are in all, how many remain if each document is truncated there, and which
quantile it is. Sums run within blocks of lengths and over the blocks' totals, so no task sees
the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import cut, slices, table

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary of RANKS_PATH cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 64


class Counter:
    """Of a vocabulary's rank file; the encoding is built where it is used."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        self.ranks, self.pattern, self.encoding = ranks, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoding": None}

    def lengths(self, texts: list[str | None]) -> list[int]:
        if self.encoding is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
            self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(self.encoding.encode_ordinary(t)) if t else 0 for t in texts]


def load(path: str = RANKS_PATH) -> bytes:
    """A rank file's bytes, read on the driver and sent with the tasks (a vocabulary has a fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def lengths(docs: DataFrame, counter: Counter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)`` for each row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.lengths(b.column(1).to_pylist()), pa.int64())], names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def histogram(counted: DataFrame) -> DataFrame:
    """``(n_tokens, docs)`` of ``counted(n_tokens)``; every row is a document."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """A row for each length that occurs, as a context limit.

    docs have that length, docs_ge that or more, with tokens_ge tokens; total_docs and total_tokens
    are of all documents, truncated_tokens what is left if each keeps n_tokens at most, and
    share_le the share of documents of that length or less. An empty histogram gives no row.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").withColumn("docs_ge", F.sum("docs").over(within) + F.col("d_after")).withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("t_after"))
    return out.select(
        "n_tokens", "docs", "docs_ge", "tokens_ge", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_ge") + F.col("docs")) / F.col("total_docs")).alias("share_le"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, docs_over, truncated_tokens)`` for any limits, also lengths that don't occur."""
    over = F.col("n_tokens") > F.col("context_limit")
    wanted = sums.select("*", F.explode(F.array(*(F.lit(int(x)) for x in limits))).alias("context_limit"))
    return wanted.groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).cast("long").alias("docs_over"),
        F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.col("context_limit"))).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the least length that at least such a share of documents doesn't exceed."""
    wanted = sums.select("n_tokens", "share_le", F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"))
    return wanted.where("share_le >= share - 1e-12").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(cut(histogram(lengths(table(spark, sf_dir, "documents"), Counter(load())))))
