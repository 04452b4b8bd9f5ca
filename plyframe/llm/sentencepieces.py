"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A word (its leading spaces and what follows up to the next space or line end) starts as single
characters. An agenda holds its adjacent pairs that the vocabulary can merge, best score first,
then leftmost. A popped candidate is skipped if a hash keyed by seed, stream, word and the places
of its two pieces falls below the dropout rate; a merge nearby may propose new candidates. So one
seed always gives one segmentation, other seeds and streams give others, and all decode to the
same text. Streams are dealt to a document's words in turn, from one that a keyed hash of its text
names: a word that recurs is cut in several ways, and partitioning has no part in it.

Many words are encoded at once: the agendas are rows of arrays, and each round pops the best
candidate of every row. Words of over WIDE characters have a heap instead; both follow one rule.
Characters that the vocabulary lacks, and a literal U+2581, become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from collections import ChainMap
from collections.abc import Iterator
from itertools import cycle
from operator import getitem

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import mix, powers, slices, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SEED, DROPOUT, STREAMS = 20240501, 0.1, 8
#: Words that a worker remembers, and the longest that is remembered and encoded in arrays.
REMEMBERED, WIDE = 300_000, 64
SPACE = "▁"
NONE = np.int32(2**31 - 1)


def mixed(x: int) -> int:
    """``mix`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 2**64 - 1
    return x ^ x >> 31


class Encoder:
    """Of a model's bytes; its tables are built where they are used."""

    def __init__(self, model: bytes, seed: int = SEED, dropout: float = DROPOUT, streams: int = STREAMS) -> None:
        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a rate from 0 to 1")
        self.model, self.seed, self.dropout = model, seed, dropout
        self.streams = max(1, streams) if dropout else 1
        self.slots = self.pairs = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("model", "seed", "dropout", "streams")} | {"slots": None, "pairs": None}

    def build(self) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = self.n = sp.vocab_size()
        plain, self.byte, raw = {}, np.zeros(256, np.int32), []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                plain[piece] = i
                raw.append(piece.replace(SPACE, " ").encode())
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw])
        self.at = np.cumsum(self.size) - self.size
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces with an inner space mark aren't supported")
        lines = not any("\n" in p and len(p) > 1 for p in plain)
        self.word = re.compile(r" *[^ \n]+|\n| +" if lines else r" *[^ ]+| +")
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(" " if p == SPACE else p)] = i
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        one = lambda s: plain.get(s, n + ord(s) if len(s) == 1 else -1)
        pairs = {(one(p[:k]) << 32 | one(p[k:])): i for p, i in plain.items() for k in range(1, len(p)) if one(p[:k]) >= 0 and one(p[k:]) >= 0}
        keys = np.array(list(pairs), np.uint64)
        into = np.array(list(pairs.values()), np.int32)
        self.bits = np.uint64(64 - max(10, (4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.bits)), np.uint64(2**64 - 1))
        self.merged = np.full(len(self.slots), -1, np.int32)
        spot, left, self.probes = self._spot(keys), np.arange(len(keys)), 1
        while len(left):
            free = left[self.slots[spot[left]] == np.uint64(2**64 - 1)]
            free = free[np.unique(spot[free], return_index=True)[1]]
            self.slots[spot[free]], self.merged[spot[free]] = keys[free], into[free]
            left = np.setdiff1d(left, free)
            spot[left] = (spot[left] + 1) % len(self.slots)
            self.probes += 1
        self.known: list[dict[str, bytes]] = [{} for _ in range(self.streams)]

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that pairs of symbols merge into, -1 where there is none, and their ranks."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        spot = self._spot(keys)
        found = np.where(self.slots[spot] == keys, self.merged[spot], -1)
        open_ = np.flatnonzero((found < 0) & (self.slots[spot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            spot[open_] = (spot[open_] + 1) % len(self.slots)
            there = self.slots[spot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.merged[spot[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64(2**64 - 1))]
        return found, np.where(found < 0, NONE, self.rank[found])

    def skipped(self, word: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether candidates are dropped, by the word's key and the pieces' places."""
        if not self.dropout:
            return np.zeros(len(word), bool)
        h = mix(mix(word ^ start.astype(np.uint64)) ^ (middle.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)))
        return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < self.dropout

    def encode_words(self, words: list[str], stream: np.ndarray) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        length = np.array([len(w) for w in words])
        point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(length) - length
        key = np.zeros(len(words), np.uint64)
        own = mix((stream.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) ^ np.uint64(self.seed & 2**64 - 1))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, WIDE), (WIDE, 1 << 40)):
            rows = np.flatnonzero((length > low) & (length <= high))
            if not len(rows):
                continue
            if low == WIDE:
                for i in rows:
                    own_points = point[begin[i] : begin[i] + length[i]]
                    key = mix((own_points.astype(np.uint64) + np.uint64(1)) @ powers(len(own_points)) ^ own[i : i + 1])
                    out[i] = self.ids_of(self.agenda(own_points, key[0]))
                continue
            for chunk in range(0, len(rows), 1 << 14):
                part = rows[chunk : chunk + (1 << 14)]
                at = np.arange(high)[None, :]
                inside = at < length[part][:, None]
                points = np.where(inside, point[np.minimum(begin[part][:, None] + at, len(point) - 1)], -1)
                key = mix(np.where(inside, points.astype(np.uint64) + np.uint64(1), np.uint64(0)) @ powers(high) ^ own[part])
                for i, ids in zip(part.tolist(), self.rows(points, inside, key)):
                    out[i] = ids
        return out

    def rows(self, points: np.ndarray, inside: np.ndarray, key: np.ndarray) -> Iterator[bytes]:
        n, width = points.shape
        sym = np.where(inside, self.symbol[points], -1)
        alive = inside.copy()
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        length = inside.sum(axis=1)
        rank = np.full((n, width), NONE)
        into = np.full((n, width), -1, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        into[r, c], rank[r, c] = self.join(sym[r, c], sym[r, c + 1])
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(axis=1)
            ok = rank[live, j] < NONE
            live, j = live[ok], j[ok]
            if not len(live):
                break
            middle = after[live, j]
            end = after[live, middle]
            drop = self.skipped(key[live], j, middle, end)
            rank[live[drop], j[drop]] = NONE
            i, j, middle, end = live[~drop], j[~drop], middle[~drop], end[~drop]
            sym[i, j] = into[i, j]
            after[i, j] = end
            before[i, end] = j
            alive[i, middle] = False
            rank[i, middle] = NONE
            rank[i, j] = NONE
            more = end < length[i]
            a, b, e = i[more], j[more], end[more]
            into[a, b], rank[a, b] = self.join(sym[a, b], sym[a, e])
            left = before[i, j]
            more = left >= 0
            a, b, e = i[more], j[more], left[more]
            into[a, e], rank[a, e] = self.join(sym[a, e], sym[a, b])
        ids = sym[alive]
        size = alive.sum(axis=1)
        odd = np.flatnonzero(((sym >= self.n) & alive).any(axis=1))
        raw = ids.astype("<i4").tobytes()
        end = (np.cumsum(size) * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *end[:-1]], end)]
        for i in odd.tolist():
            out[i] = self.ids_of(sym[i][alive[i]].tolist())
        return iter(out)

    def agenda(self, points: np.ndarray, key: np.uint64) -> list[int]:
        """Symbols of one word, by a heap of candidates; hashes are drawn in plain integers."""
        if self.pairs is None:
            full = np.flatnonzero(self.slots != np.uint64(2**64 - 1))
            pieces = self.merged[full]
            self.pairs = dict(zip(self.slots[full].tolist(), zip(pieces.tolist(), self.rank[pieces].tolist())))
        sym = self.symbol[points].tolist()
        n, word, limit = len(sym), int(key), self.dropout * 2.0**53
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[int, int, int, int, int]] = []

        def propose(left: int, middle: int, end: int) -> None:
            found = self.pairs.get(sym[left] << 32 | sym[middle])
            if found:
                heapq.heappush(heap, (found[1], left, middle, end, found[0]))

        for i in range(n - 1):
            propose(i, i + 1, i + 2)
        while heap:
            _, left, middle, end, piece = heapq.heappop(heap)
            if sym[left] < 0 or after[left] != middle or middle >= n or sym[middle] < 0 or after[middle] != end:
                continue
            if limit and mixed(mixed(word ^ left) ^ (middle << 32 | end)) >> 11 < limit:
                continue
            sym[left], sym[middle] = piece, -1
            after[left] = end
            before[end] = left
            if end < n:
                propose(left, end, after[end])
            if before[left] >= 0:
                propose(before[left], left, end)
        return [s for s in sym if s >= 0]

    def ids_of(self, symbols: list[int]) -> bytes:
        """Symbols outside the vocabulary become the bytes of their characters."""
        out: list[int] = []
        for s in symbols:
            out.extend([s] if s < self.n else self.byte[list(chr(s - self.n).encode())])
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null or empty text."""
        if self.slots is None:
            self.build()
        if sum(map(len, self.known)) > REMEMBERED:
            self.known = [{} for _ in range(self.streams)]
        split = [self.word.findall(" " + t) if t else [] for t in texts]
        of = [xxhash.xxh64_intdigest(t or "", self.seed & 2**64 - 1) % self.streams for t in texts]
        new: list[set[str]] = [set() for _ in range(self.streams)]
        for words, s in zip(split, of):
            for i in range(self.streams):
                new[(s + i) % self.streams].update(words[i :: self.streams])
        new = [a.difference(b) for a, b in zip(new, self.known)]
        words, long = [w for s in new for w in s], [{} for _ in range(self.streams)]
        for w, s, ids in zip(words, (streams := np.repeat(np.arange(self.streams), [len(s) for s in new])).tolist(), self.encode_words(words, streams) if words else []):
            (self.known if len(w) <= WIDE else long)[s][w] = ids
        known = [ChainMap(a, b) if b else a for a, b in zip(self.known, long)]
        return [b"".join(map(getitem, cycle(known[s:] + known[:s]), w)) for w, s in zip(split, of)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8, without the space put before it."""
        if self.slots is None:
            self.build()
        size = self.size[ids]
        total = int(size.sum())
        text = self.blob[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(total)].tobytes()
        return text[1:] if text[:1] == b" " else text


def load(path: str = MODEL_PATH) -> bytes:
    """A model's bytes, read on the driver and sent with the tasks (a vocabulary has a fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, encoder: Encoder, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col array<int>``, ``n_tokens`` and ``lossless`` added to each row.

    Null text has null ids, 0 tokens and is lossless; empty text has no ids. ``lossless`` says that
    the ids decode to the text. Equal texts get equal ids. Columns of ``docs`` keep their names and
    values; one called like a new column gives way to it.
    """
    kept = [c for c in docs.columns if c not in (ids_col, "n_tokens", "lossless")]
    clash = text_col not in kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                texts = b.column(1).to_pylist()
                found = encoder.encode(texts)
                size = np.array([len(x) // 4 for x in found])
                flat = np.frombuffer(b"".join(found), "<i4")
                end = np.cumsum(size)
                same = [t is None or encoder.decode(flat[e - n : e]) == t.encode() for t, n, e in zip(texts, size.tolist(), end.tolist())]
                offsets = pa.array(np.concatenate(([0], end)).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(size, pa.int64()), pa.array(same)], names=["row", ids_col, "n_tokens", "lossless"])

    row = F.struct(*(F.col(c) for c in kept)) if kept else F.struct(F.lit(0).alias("_none"))
    held = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, {ids_col} array<int>, n_tokens bigint, lossless boolean")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), ids_col, "n_tokens", "lossless") if not clash or kept else out.drop("row")


def decode(rows: DataFrame, encoder: Encoder, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids added; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", text_col])

    kept = [c for c in rows.columns if c != text_col]
    held = rows.select(F.struct(*kept).alias("row"), F.col(ids_col).alias("ids"))
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, {text_col} string")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), text_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Encoder(load())).select("doc_id", "n_tokens", "ids", "lossless")
