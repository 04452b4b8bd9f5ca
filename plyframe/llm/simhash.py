"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that
differ in at most two bits agree wholly in one segment (pigeonhole), and differ in at most two
bits in the next one. Words of 23 bits that differ in at most two bits share a codeword of the
[23,12,7] code within distance four of both; a word has one or six such codewords. So the keys
(segment number, its bits, a codeword index of the next segment) meet for every pair wanted,
and have 33 bits to tell others apart.

Pairs of a bucket are compared. Where near copies fill a bucket, its fingerprints are linked
through the words one bit away instead: two fingerprints at most two bits apart have such a word
in common, and all that share one are linked, so a row for each is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import cut, hex16, table
from plyframe.llm.components import components

#: Fixed values of the binary Golay code: generator polynomial, length, message bits.
GENERATOR, LENGTH, MESSAGE = 0b101011100011, 23, 12
#: Place and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of more distinct fingerprints are linked through words one bit away.
DENSE = 32
SEED = 42


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash over the XXH64 of k-word shingles, each counted as often as it occurs."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < k:
        pieces, n = iter([b" ".join(words)]), 1
    else:
        pieces, n = map(b" ".join, zip(*(words[i:] for i in range(k)))), len(words) - k + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for each row; null text counts as empty, which has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; error patterns by syndrome, -1 where there are fewer than six."""

    def rest(w: int) -> int:
        for i in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - (LENGTH - MESSAGE))
        return w

    unit = [rest(1 << i) for i in range(LENGTH)]
    patterns: list[list[int]] = [[] for _ in range(1 << (LENGTH - MESSAGE))]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = e = 0
            for i in bits:
                s, e = s ^ unit[i], e | 1 << i
            patterns[s].append(e)
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for out, shift in ((low, 0), (high, 12)):
        for i in range(len(out).bit_length() - 1):
            out[1 << i : 2 << i] = out[: 1 << i] ^ unit[i + shift]
    width = max(map(len, patterns))
    return low, high, np.array([p + [-1] * (width - len(p)) for p in patterns], np.int64)


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance four of each 23-bit word, -1 beyond the last."""
    low, high, patterns = golay()
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> (LENGTH - MESSAGE))


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of 64-bit fingerprints."""
    rows, out = [], []
    cutout = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    for i in range(3):
        near = codewords(cutout[(i + 1) % 3])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        out.append((np.int64(i) << 40) | (cutout[i][row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(out)


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` of ``nodes`` at most two bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            row, key = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key)], names=["fp", "key"])

    keyed = nodes.select("fp").mapInArrow(run, "fp bigint, key bigint")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    few, many = shared.where(F.col("n") <= DENSE), shared.where(F.col("n") > DENSE).select("fp").distinct()
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a.key == b.key) & (a.a < b.b) & (F.bit_count(a.a.bitwiseXOR(b.b)) <= 2)).select("a", "b")
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = cut(many.select("fp", F.explode(ball).alias("centre")))
    least = around.groupBy("centre").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "centre").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id, fp)`` for each row of ``docs``.

    Null or empty text has fingerprint zero and is linked like any other. Rows with the same
    text or the same id keep a row each. component_id is the least id reachable; null ids
    count only where a component has no other. An empty table gives no row. Other columns of
    ``docs`` are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col))
    nodes = own.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(links(nodes))
    # Cut, as below: a join whose other side is aggregated in the same task can't be split where a component is very large.
    roots = cut(linked.join(nodes, linked.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component")))
    of = linked.join(roots, "root").select(F.col("node").alias("fp"), "component")
    # Cut, so that the last join stands alone and Spark can split a fingerprint with very many rows.
    named = cut(nodes.join(of, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return own.join(named, "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
