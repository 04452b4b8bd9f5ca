"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class c holds items of over c/2 and up to c shingles, c a power
of two. For it a document is read as overlapping blocks of 2c shingles, one every c, so that an item
that occurs lies within a block, and a containment of 0.8 bounds the Jaccard similarity of item and
block from below, however long the document is. The class takes as many hash functions, one to
a band, as leave a miss with a chance of at most one in a million. Where a block and an item share
a minimum, the document is a candidate. Items that mostly repeat themselves would need ever more hash functions; of
their few distinct shingles as many are looked up as none that contains 0.8 can lack all of. The exact share of the item's distinct shingles that the
whole document contains decides.

Items are sent to the documents in groups of bounded size, so a benchmark of any size takes
more passes, never more memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import Words, slices, table

WORDS, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Items with over one distinct shingle in so many are found by MinHash.
REPEATED = 2
#: Items and bytes of them sent to the documents at once.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(w: list[bytes], k: int = WORDS) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; the whole where there are fewer, none where there are none."""
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Index:
    """MinHash values of test items by shingle width and size class; few bands each, as an item's shingles are mostly distinct.

    Items whose shingles mostly repeat are few distinct ones: a document that contains 0.8 of n must hold
    one of any n - ceil(0.8 n) + 1 of them, so these least hashes of each are looked up.
    """

    def __init__(self, items: list[tuple[object, str]], containment: float = CONTAINMENT, width: int = WORDS) -> None:
        self.containment, self.width = containment, width
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.sets: dict[int, set[tuple[bytes, ...]]] = {}
        flat = Words(pa.array(self.texts, pa.string()))
        count = np.diff(flat.first)
        classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        few: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        own: dict[int, np.ndarray] = {}
        for k in range(1, width + 1):
            hashes, at = flat.shingles(k)
            doc = flat.doc()[at]
            for i in np.flatnonzero(count >= k if k == width else count == k).tolist():
                low, high = np.searchsorted(doc, (i, i + 1))
                own[i] = np.unique(hashes[low:high])
                if len(own[i]) * REPEATED >= high - low:
                    classes[k, 1 << int(high - low - 1).bit_length()].append(i)
                else:
                    few[k].append((own[i][: len(own[i]) - ceil(containment * len(own[i]) - 1e-9) + 1], i))
        self.classes = []
        for (k, size), members in sorted(classes.items()):
            least = min(len(own[i]) for i in members)
            block = 2 * size if size > 1 else 1
            jaccard = containment * least / (block + (1 - containment) * least)
            bands = 1 if block == 1 else max(1, ceil(log(MISS) / log(1 - min(jaccard, 0.999))))
            by = multipliers(bands)
            minima = np.array([[((own[i] * a) >> np.uint64(32)).min() for i in members] for a in by])
            order = minima.argsort(axis=1, kind="stable")
            seen = np.zeros((bands, 1 << 13), np.uint8)  # a bit for each beginning of a minimum
            for b in range(bands):
                np.bitwise_or.at(seen[b], minima[b] >> np.uint64(19), np.uint8(1) << (minima[b] >> np.uint64(16) & np.uint64(7)).astype(np.uint8))
            self.classes.append((k, size, by, np.take_along_axis(minima, order, 1), np.array(members)[order], seen))
        self.few = {}
        for k, parts in few.items():
            keys, of = np.concatenate([h for h, _ in parts]), np.repeat([i for _, i in parts], [len(h) for h, _ in parts])
            order = np.argsort(keys, kind="stable")
            self.few[k] = keys[order], of[order]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sets": {}}

    def needed(self, i: int) -> set[tuple[bytes, ...]]:
        """The distinct shingles of an item, remembered for as many words as all items of a group may have."""
        if i not in self.sets:
            if sum(map(len, self.sets.values())) > BYTES_AT_ONCE >> 5:
                self.sets.clear()
            self.sets[i] = shingles(words(self.texts[i]), self.width)
        return self.sets[i]

    def candidates(self, texts: pa.Array) -> set[tuple[int, int]]:
        """Pairs of a text's place and an item's place that share a minimum in a block."""
        flat = Words(texts)
        found: set[tuple[int, int]] = set()
        per_width = {}
        for k, size, by, minima, members, seen in self.classes:
            if k not in per_width:
                hashes, at = flat.shingles(k)
                per_width[k] = hashes, flat.doc()[at]
            hashes, doc = per_width[k]
            if not len(hashes):
                continue
            first = np.searchsorted(doc, np.arange(len(texts)))
            count = np.diff(np.append(first, len(doc)))
            cells = -(-count // size)
            of = np.repeat(np.arange(len(texts)), cells)
            begin = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)) * size
            pair = np.flatnonzero(of[1:] == of[:-1]) if size > 1 else np.zeros(0, np.int64)
            for b, a in enumerate(by):
                least = np.minimum.reduceat((hashes * a) >> np.uint64(32), begin)
                if len(pair):
                    next_ = least[pair + 1]
                    both = least.copy()
                    both[pair] = np.minimum(least[pair], next_)
                    least = both
                hit = np.flatnonzero(seen[b, least >> np.uint64(19)] >> (least >> np.uint64(16) & np.uint64(7)).astype(np.uint8) & 1)
                if len(hit):
                    low = np.searchsorted(minima[b], least[hit], "left")
                    high = np.searchsorted(minima[b], least[hit], "right")
                    for h, x, y in zip(hit.tolist(), low.tolist(), high.tolist()):
                        found.update((int(of[h]), int(i)) for i in members[b, x:y])
        for k, (keys, of) in self.few.items():
            hashes, at = flat.shingles(k)
            doc = flat.doc()[at]
            low = np.searchsorted(keys, hashes, "left")
            for h in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes).tolist():
                text, x = int(doc[h]), int(low[h])
                while x < len(keys) and keys[x] == hashes[h]:
                    found.add((text, int(of[x])))
                    x += 1
        return found

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """Text's place, item's place, shared distinct shingles, the item's distinct shingles."""
        out, last, held = [], -1, {}
        for t, i in sorted(self.candidates(texts)):
            if t != last:
                last, w, held = t, words(texts[t].as_py()), {}
            need = self.needed(i)
            k = len(next(iter(need)))
            if k not in held:
                held[k] = shingles(w, k) if len(w) >= k else set()
            shared = len(need & held[k])
            if shared >= self.containment * len(need) - 1e-9:
                out.append((t, i, shared, len(need)))
        return out


def groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items, row by row, in lists of bounded size."""
    group, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").toLocalIterator():
        if group and (len(group) >= ITEMS_AT_ONCE or size + len(r.text) > BYTES_AT_ONCE):
            yield group
            group, size = [], 0
        group.append((r.id, r.text))
        size += len(r.text)
    if group:
        yield group


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item_col, shared, n_shingles, containment)`` for each document and item it contains.

    Null and empty texts contain nothing, and items without a word are in no document. An item of
    fewer than five words is one shingle. Repeated rows and items each give their row. No items,
    or no documents, give no row. Other columns aren't read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    schema = f"id {kind}, item {item_kind.simpleString()}, shared bigint, n_shingles bigint, containment double"

    def against(group: list[tuple[object, str]]) -> DataFrame:
        index = Index(group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, 1, 1 << 20):
                    found = index.search(b.column(1))
                    place = pa.array([f[0] for f in found], pa.int64())
                    shared, need = (np.array([f[k] for f in found], np.int64) for k in (2, 3))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(place), pa.array([index.ids[f[1]] for f in found], kinds), pa.array(shared), pa.array(need), pa.array(shared / np.maximum(need, 1))], names=["id", "item", "shared", "n_shingles", "containment"])

        from pyspark.sql.pandas.types import to_arrow_type

        kinds = to_arrow_type(item_kind)
        return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

    parts = [against(g) for g in groups(items, item_col, item_text_col)]
    out = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that contain an item of the benchmark."""

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, 1, 1 << 20):
                    bad = {f[0] for f in index.search(b.column(1))}
                    yield b.select(["row"]).filter(pa.array([i not in bad for i in range(b.num_rows)]))

        return run

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    for group in groups(table(spark, sf_dir, "benchmark"), "item_id", "text"):
        kept = rows.mapInArrow(keep(Index(group)), f"row {rows.schema['row'].dataType.simpleString()}")
        rows = kept.select("row", F.col("row.text").alias("text"))
    return rows.select("row.*")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT row_number() OVER () AS item_row, item_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
si AS (
  SELECT item_row, item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda p: array_to_string(w[p + 1 : p + 5], ' ')))) AS s
  FROM i WHERE len(w) > 0),
sizes AS (SELECT item_row, count(*) AS n_shingles FROM si GROUP BY item_row),
ks AS (SELECT DISTINCT k FROM si),
sd AS (
  SELECT DISTINCT row_id, doc_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda p: array_to_string(w[p + 1 : p + k], ' '))) AS s
  FROM d, ks WHERE len(w) >= k)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(n_shingles)::BIGINT AS n_shingles, count(*)::DOUBLE / any_value(n_shingles) AS containment
FROM sd JOIN si USING (k, s) JOIN sizes USING (item_row)
GROUP BY row_id, doc_id, item_row, item_id
HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
"""
