"""Near copies by five-word similarity, with wide SimHash fingerprints and soft Golay decoding.

At a similarity of 0.8 about a seventh of all fingerprint bits differ, far more than two of 64. So
fingerprints have 2,048 bits: distinct shingles are added with hashed signs into 2,048 sums, and a
Walsh-Hadamard transform turns these into as many random projections, whose signs are the bits.
Segments of 23 projections are decoded to the nearest codeword of the [23,12,7] code, weak bits
counting little: nearby words are tried by flipping the weakest ones, and the two best codewords
make the keys. A pair of segments is a table; documents that meet in one of the tables are compared.
Two documents are linked if so few bits differ as a similarity of 0.8 leaves: angle / pi,
where the cosine is 2s / (1 + s), with two standard deviations' allowance; the bits tell s to within
about 0.02.

All pairs of a bucket count, but only links that join two groups yet apart come out, at most one a
document: a document that is in a group is compared with those that are in none. Of very large buckets
every two blocks meet in a task of their own. Documents come in one order in all tables, and links go to
a group's first one, so the links of a group are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.llm.common import Words, cut, keyed, mix, slices
from plyframe.llm.components import components
from plyframe.llm.simhash import LENGTH, MESSAGE, golay

K, SIMILARITY = 5, 0.8
BITS, TABLES, WEAK = 2048, 24, 3
#: Buckets up to this size are compared in one step; above SHARE documents they are dealt into blocks of about as many.
SMALL, SHARE = 32, 2048


def most_apart(similarity: float = SIMILARITY) -> int:
    """Bits that may differ: as many as are expected at this similarity, and two standard deviations."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(BITS * share + 2 * (BITS * share * (1 - share)) ** 0.5)


def projections(texts: pa.Array) -> np.ndarray:
    """A row of BITS projections for each text, of its distinct five-word shingles (all its words if fewer)."""
    w = Words(texts)
    n = len(w.first) - 1
    count, doc = np.diff(w.first), w.doc()
    parts = []
    for k in range(1, K + 1):
        hashes, at = w.shingles(k)
        own = doc[at]
        if k < K:
            keep = count[own] == k
            hashes, own = hashes[keep], own[keep]
        parts.append((hashes, own))
    hashes, own = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    once = np.unique(mix(hashes ^ mix(own.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    hashes, own = hashes[once], own[once]
    place = own * BITS + (hashes & np.uint64(BITS - 1)).astype(np.int64)
    sign = np.where(hashes >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    x = np.bincount(place, sign, n * BITS).astype(np.float32).reshape(n, BITS)
    step = 1
    while step < BITS:
        y = x.reshape(n, BITS // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, BITS)
        step *= 2
    return x


def decoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the best and second-best codeword for rows of LENGTH projections."""
    low, high, patterns = golay()
    size = np.abs(x)
    hard = ((x > 0) << np.arange(LENGTH)).sum(axis=1)
    weak = np.argsort(size, axis=1, kind="stable")[:, :WEAK]
    words, costs = [], []
    for flips in range(1 << WEAK):
        word = hard.copy()
        for i in range(WEAK):
            if flips >> i & 1:
                word ^= 1 << weak[:, i]
        word ^= patterns[low[word & 4095] ^ high[word >> 12], 0]
        wrong = word ^ hard
        cost = np.zeros(len(x), np.float32)
        for bit in range(LENGTH):
            cost += np.where(wrong >> bit & 1, size[:, bit], 0)
        words.append(word >> (LENGTH - MESSAGE))
        costs.append(cost)
    words, costs = np.array(words), np.array(costs)
    row = np.arange(len(x))
    best = words[costs.argmin(axis=0), row]
    costs = np.where(words == best, np.inf, costs)
    second = np.where(np.isinf(costs.min(axis=0)), best, words[costs.argmin(axis=0), row])
    return best, second


def keys(x: np.ndarray) -> np.ndarray:
    """Three keys for each table: both segments' best codewords, and the second-best one of either."""
    n = len(x)
    best, second = decoded(x[:, 1 : 1 + 2 * TABLES * LENGTH].reshape(n * 2 * TABLES, LENGTH))
    a, b = (v.reshape(n, TABLES, 2) for v in (best, second))
    table = np.arange(TABLES)[None, :] << 24
    return np.concatenate([table | p[:, :, 0] << 12 | q[:, :, 1] for p, q in ((a, a), (b, a), (a, b))], axis=1)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp, keys)``: 256 bytes and the keys of each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1, 2 << 20):
                for at in range(0, part.num_rows, 1024):
                    b = part.slice(at, 1024)
                    x = projections(b.column(1))
                    bits = np.packbits(x > 0, axis=1, bitorder="little")
                    own = keys(x)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bits], pa.binary()), lists], names=["id", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary, keys array<int>")


def compared(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect what is near in one bucket: each row of a group with the group's first one.

    Groups are those that all pairs of the bucket make; a row of a group is compared with all rows that
    are in no group yet.
    """
    links, n = [], len(fps)
    whole = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2, dtype=np.int32) <= limit if n <= SMALL else None
    free, rest = np.arange(n), fps
    while len(free) > 1:
        first = int(free[0])
        group, free, rest = [first], free[1:], rest[1:]
        for i in group:
            if not len(free):
                break
            near = whole[i, free] if whole is not None else np.bitwise_count(rest ^ fps[i]).sum(axis=1, dtype=np.int32) <= limit
            if near.any():
                group.extend(free[near].tolist())
                free, rest = free[~near], rest[~near]
        links.extend((first, j) for j in group[1:])
    return links


def salted(keyed: DataFrame) -> DataFrame:
    """``(key, node, salt)`` of ``(key, node)`` for keys of two nodes and more: any two nodes of a key share a salt.

    A key of more than SHARE nodes is dealt into blocks, and every two blocks have a salt.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / SHARE).cast("bigint")
    own = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.transform(F.sequence(F.lit(1), blocks - 1), lambda i: F.least(own, (own + i) % blocks) * blocks + F.greatest(own, (own + i) % blocks))
    salts = F.when(F.col("n") > SHARE, pairs).otherwise(F.array(F.lit(0).cast("bigint")))
    return keyed.join(sizes, "key").select("key", "node", F.explode(salts).alias("salt"))


def linked(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """Links ``(a, b)`` of ``rows(key, salt, node, fp)``, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            edge = starts(t)
            a, b = [], []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(fps)]):
                if j - i > 1:
                    links = compared(fps[i:j], limit)
                    a.extend(i + p for p, _ in links)
                    b.extend(i + q for _, q in links)
            node = t.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(v, pa.int64())) for v in (a, b)], names=["a", "b"])

        def starts(t: pa.Table) -> np.ndarray:
            key, salt = (t.column(c).to_numpy() for c in ("key", "salt"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            return np.flatnonzero(new)

        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows and len(edge := starts(held)) > 1:
                yield solve(held.slice(0, int(edge[-1])))
                held = held.slice(int(edge[-1]))
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = rows.select("key", "salt", "node", "fp").repartition("key", "salt").sortWithinPartitions("key", "salt", F.xxhash64("node"), "node")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id_col, component_id)`` for each row with an id: the least id of its group of near copies.

    Equal texts, null and empty ones among them, are one group. Rows without id are left out. Other columns
    aren't read; no document gives no row.
    """
    own = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    kind = own.schema["id"].dataType.simpleString()
    nodes = cut(own.groupBy("fp").agg(F.min("id").alias("node"), F.any_value("keys").alias("keys")))
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key")).select("node", F.col("key").cast("bigint").alias("key"))
    shared = salted(keyed).join(nodes.select("node", "fp"), "node")
    edges = linked(shared, kind, most_apart(similarity))
    roots = components(edges).select(F.col("node"), "root")
    named = cut(nodes.select("fp", "node").join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    return own.select("id", "fp").join(named, "fp").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one whose doc_id is least.

    Rows without doc_id can't be told apart and stay. Rows of one doc_id with other texts are documents of their own,
    in the order of a hash of their texts; of rows that repeat doc_id and text one stays.
    """
    rows = keyed(docs.select(F.col("doc_id").alias("doc"), F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")).where("doc is not null"))
    clash = "key" in rows.columns
    node = F.struct("doc", F.coalesce("key", F.lit(0).cast("bigint")).alias("key")) if clash else F.col("doc")
    nodes = rows.select(node.alias("node"), "text", *["row"] * clash)
    kept = cut(groups(nodes, "node").where("node = component_id").select("node").distinct())
    if clash:
        rows = nodes.join(kept, "node", "left_semi")
        several = rows.where("node.key <> 0").groupBy("node").agg(F.any_value("row").alias("row"))
        found = rows.where("node.key = 0").select("row").unionByName(several.select("row")).select("row.*")
    else:
        found = docs.join(kept, docs.doc_id == kept.node, "left_semi")
    return found.unionByName(docs.where("doc_id is null"))
