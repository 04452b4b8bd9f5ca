"""Fuzzy repeated passages, by chaining shared k-mer seeds.

Seeds are five-word shingles; of each four in a row the one with the least hash counts, so texts
that share eight words share a seed. An occurrence is matched with the seed's first one in the order
of document ids: a passage in m documents gives m - 1 matches, never all pairs. Where neighbouring seeds
of a document are first in different places, several seeds in a row are matched with their first common
occurrence too, so that a passage of lines that are first elsewhere meets its own first copy. Matches of two
documents are chained: a chain goes forward in both, earns the words of its seeds and pays for the
gaps, and the best one that ends in each match is found with a Fenwick tree of prefix maxima over
the places in the earlier document. Chains are aligned word by word: seeds stand as they are, the
gaps between them by edit distance, and both ends are extended, as are the ends at a gap that parts
two passages. Each stretch of a chain that is at least 50 words long and at least 0.8 alike is a repeat.

Seeds are shuffled once and stream through their task in order, so that it holds one first occurrence. Seeds
that are a large share of all have their first occurrence looked up beforehand and are dealt over all tasks.
Seeds that overlap become runs of equal words; only the words outside of runs are sent from one document
to the other. A document's matches are bounded by its own length.

A row is told by its id and, where an id has several texts, a hash of its text (``key``, else 0).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import Words, keyed, mix, powers, slices, table, written

K, WINDOW, MIN_WORDS, SIMILARITY = 5, 4, 50, 0.8
#: Words that a gap of may cost as much as a seed earns; words read beyond the outer seeds.
MAX_GAP, MARGIN = 25, 64
#: Words between two occurrences of a seed that belong to one run.
RUN = 256
#: Seeds that are one in so many, in one of so many documents, are dealt over all tasks. This decides where rows go, not which count.
HOT, LOOKED_AT = 2048, 32
#: A step of a chain that is shorter, in both documents together, pays whatever the chain has earned so far.
SURE = 2 * K + 2 * MAX_GAP
#: Extension: what a mismatch costs in matches, and how far a score may fall from its best.
MISMATCH, DROP = 3, 8


def minimizers(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose hash is least in some window of WINDOW places of one document; windows shrink at its ends."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    pad = WINDOW - 1
    place = np.arange(len(doc)) + (np.cumsum(np.concatenate(([1], (doc[1:] != doc[:-1]).astype(np.int64)))) * pad)
    line = np.full(int(place[-1]) + 1 + pad, np.uint64(2**64 - 1))
    line[place] = hashes

    def slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        done = 1
        while done < WINDOW:
            step = min(done, WINDOW - done)
            x = pick(x[: len(x) - step], x[step:])
            done += step
        return x

    least = slide(line, np.minimum)
    most = slide(least, np.maximum)
    return np.flatnonzero(most[place - pad] == hashes)


def numbered(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and their places in the input: all plain (even), and numbered ones (odd) where a seed recurs within RUN words.

    So runs of one word or line are matched in order, and every copy in one document meets the first source.
    """
    order = np.lexsort((pos, hashes, doc))
    h, d, p = hashes[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > RUN)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = nth > 0
    one = np.uint64(1)
    return np.concatenate([hashes & ~one, mix(h[again] ^ mix(nth[again].astype(np.uint64))) | one]), np.concatenate([np.arange(len(h)), order[again]])


def seeds(docs: DataFrame, only: list[int] | None = None) -> DataFrame:
    """``(seed, pos, doc, key)`` of ``(doc, key, text)``; pos counts words from 0. ``only``: the first ones of these seeds in each run of rows."""
    own = ids(docs)
    wanted = None if only is None else np.sort(np.array(only, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, len(own)):
                w = Words(b.column(len(own)))
                hashes, at = w.shingles(K)
                doc = w.doc()[at]
                keep = minimizers(hashes, doc)
                pos = (at[keep] - w.first[doc[keep]]).astype(np.int32)
                seed, place = numbered(hashes[keep], doc[keep], pos)
                seed = seed.view(np.int64)
                if wanted is not None:
                    near = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, seed), len(wanted) - 1)] == seed) if len(wanted) else np.zeros(0, np.int64)
                    seed, place = seed[near], place[near]
                row = pa.array(doc[keep][place])
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(pos[place]), *(b.column(k).take(row) for k in range(len(own)))], names=["seed", "pos", *own])

    return docs.select(*own, "text").mapInArrow(run, schema("seed bigint, pos int", docs, own))


def ids(df: DataFrame, prefix: str = "") -> list[str]:
    """The columns that tell a row: ``doc`` and, where ids repeat, ``key``."""
    return [c for c in ("doc", "key") if c in df.columns] if not prefix else [{"doc": "src", "key": "src_key"}[c] for c in ids(df)]


def schema(head: str, df: DataFrame, columns: list[str]) -> str:
    """A schema's text: ``head``, then columns with the types that ``df`` has for them (sources as their documents)."""
    kind = df.schema["doc"].dataType.simpleString()
    return ", ".join([*[head][: bool(head)], *(f"{c} {kind if c in ('doc', 'src') else 'bigint'}" for c in columns)])


def changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        if len(c) > 1:
            change[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return change


def frequent(some: DataFrame) -> list[int]:
    """Seeds that are one in HOT of ``some``: at most HOT."""
    counts = some.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= LOOKED_AT)
    counts, total = counts.collect(), some.count()
    return [r.seed for r in counts if r.n * HOT >= total]


def first_places(found: DataFrame, hot: DataFrame) -> DataFrame:
    """``found(seed, pos, doc, key)`` for seeds that recur, with ``(src_pos, src, src_key)``: where each one is first.

    First occurrences come too, as their own source. Other columns stay. ``hot`` has occurrences of very frequent seeds,
    the first one among them; they are dealt over all tasks.
    """
    own, src = ids(found), ids(found, "src")
    first = hot.groupBy("seed").agg(F.min(F.struct(*own, "pos")).alias("f")).select("seed", "f.*").toArrow().sort_by("seed").combine_chunks()
    seed = first.column("seed").to_numpy()
    target = F.when(F.col("seed").isin(seed.tolist()), F.xxhash64("seed", *own)).otherwise(F.col("seed")) if len(seed) else F.col("seed")
    dealt = found.repartition(target).sortWithinPartitions("seed", *own, "pos")
    names = [*found.columns, "src_pos", *src]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, False  # the first row of the seed that a batch ended with, and whether it has come out
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_batches([held, b]) if held is not None else b
            seeds_ = t.column("seed").to_numpy()
            new = np.flatnonzero(np.append(True, seeds_[1:] != seeds_[:-1]))
            size = np.diff(np.append(new, len(seeds_)))
            out = np.repeat(size > 1, size)
            among = None
            if len(seed):
                near = np.minimum(np.searchsorted(seed, seeds_), len(seed) - 1)
                among = seed[near] == seeds_
                out |= among
            last = int(new[-1])
            ended = bool(out[last])
            if told:
                out[0] = False
            told = ended or (told and last == 0)
            held = t.slice(last, 1)
            rows = np.flatnonzero(out)
            at = pa.array(rows)
            begin = pa.array(np.repeat(new, size)[rows])
            places = [t.column(c).take(begin) for c in ("pos", *own)]
            if among is not None and among[rows].any():
                near, among = pa.array(near[rows]), pa.array(among[rows])
                places = [pc.if_else(among, first.column(c).combine_chunks().take(near), p) for c, p in zip(("pos", *own), places)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in t.columns), *places], names=names)

    head = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in found.schema), "src_pos int"])
    return dealt.mapInArrow(run, schema(head, found, src))


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of two or more matches (x ascending), strictly forward in both, each match in one at most, best first."""
    n, cost = len(x), K / (2 * MAX_GAP)
    ranks = sorted(set(y))
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)
    score, back = [0.0] * n, [-1] * n
    done = 0
    for i in range(n):
        while x[done] < x[i]:  # of one place in x only what lies before it counts
            mine, q = (score[done] + cost * (x[done] + y[done]), done), bisect_left(ranks, y[done]) + 1
            while q <= len(ranks):
                if mine[0] > tree[q][0]:
                    tree[q] = mine
                q += q & -q
            done += 1
        best, at, far = -1e18, -1, cost * (x[i] + y[i])
        q = bisect_left(ranks, y[i])
        while q:
            if tree[q][0] > best:
                best, at = tree[q]
            q &= q - 1
        gain = best - far + 2 * cost * K
        score[i] = K
        if gain > 0:
            score[i], back[i] = K + gain, at
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = back[i]
        if len(own) > 1:
            out.append(own[::-1])
    return out


#: For hashes of rows of seeds: a multiplier and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def seams(group: np.ndarray, pos: np.ndarray, src: np.ndarray, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds in a row as one where neighbours are first in different places: its hash, first and last row.

    Rows are plain seeds that recur, in order, those of first occurrences too; ``src`` numbers the source of each and
    ``at`` is its place there. Pairs over each such seam are taken, and all seeds of about as many words as any
    passage of MIN_WORDS holds whatever is around it.
    """
    span = max(1, MIN_WORDS - K + 1 - 3 * (WINDOW - 1))
    n = len(pos)
    near, seam = np.zeros(n, bool), np.zeros(n, bool)  # of each row and the next one
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.diff(pos)
    near[:-1] = (group[1:] == group[:-1]) & (step <= WINDOW)
    seam[:-1] = near[:-1] & ((src[1:] != src[:-1]) | (np.diff(at - pos) != 0))
    row = np.arange(n)
    stop = np.append(np.flatnonzero(~near), n)
    last = stop[np.searchsorted(stop, row)]  # where the run of near rows ends
    line = pos + np.cumsum(np.append(0, (~near[:-1]).astype(np.int64))) * (1 << 32)
    end = np.searchsorted(line, line + span) - 1
    many = np.append(0, np.cumsum(seam))
    wide = (end - row > 1) & (pos[end] - pos >= span - WINDOW) & (many[end] > many[row]) & (end <= last)
    begin = np.concatenate([row[seam], row[wide]])
    end = np.concatenate([row[seam] + 1, end[wide]])
    # The sum of each seed and its distance from the one before, times a power of its number in the row.
    value = mix(seed ^ np.append(0, step).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.append(np.uint64(0), np.cumsum(value * powers(n), dtype=np.uint64))
    inverse = np.full(n + 1, BACK, np.uint64)
    inverse[0] = 1
    inner = (total[end + 1] - total[begin + 1]) * np.cumprod(inverse, dtype=np.uint64)[begin]
    return mix(mix(inner ^ (end - begin).astype(np.uint64)) ^ seed[begin]), begin, end


def chained(placed: DataFrame, with_seams: bool) -> DataFrame:
    """``(doc, key, src, src_key, x, y, n, seed, pos, reach, known)`` of ``first_places``.

    Chains have the starts and lengths of their runs of equal words in both documents. With seams, these follow with
    their hash, place and the distance of their last seed; known are those within a run that is surely a repeat.
    """
    ours, theirs = ids(placed), ids(placed, "src")
    names = [*ours, *theirs, "x", "y", "n", "seed", "pos", "reach", "known"]

    def lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values.astype(np.int32)))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: t.column(c).combine_chunks() for c in t.column_names}
        group = np.cumsum(changes(*(column[c] for c in ours)))
        source = np.zeros(len(group), np.int64)
        for c in theirs:
            codes = column[c].dictionary_encode()
            source = source * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
        px, py = (column[c].to_numpy().astype(np.int64) for c in ("pos", "src_pos"))
        row = np.lexsort((py, px, source, group))
        own = np.ones(len(row), bool)
        for a, b in zip(ours, theirs):
            own &= np.asarray(pc.equal(column[a], column[b]))
        new = lambda *v: np.append(True, np.any([np.diff(i[row]) != 0 for i in v], axis=0)) if len(row) else np.zeros(0, bool)
        row = row[~own[row] & new(group, source, px, py)]
        gx, gy = px[row], py[row]
        edge = np.flatnonzero(new(group, source))
        size = np.diff(np.append(edge, len(row)))
        dx, dy = np.diff(gx), np.diff(gy)
        bad = np.append(~((dx > 0) & (dy > 0) & (dx + dy < SURE)), False)[: len(row)]
        bad[edge[1:] - 1] = False
        wrong = np.add.reduceat(bad.astype(np.int64), edge) if len(edge) else size
        # Where each match goes on from the one before by a step that surely pays, all are one chain.
        plain = (size > 1) & (wrong == 0)
        parts = [np.flatnonzero(np.repeat(plain, size))]
        count = [size[plain]]
        for a, n in zip(edge[(size > 1) & ~plain].tolist(), size[(size > 1) & ~plain].tolist()):
            found = chains(gx[a : a + n].tolist(), gy[a : a + n].tolist())
            parts.extend(a + np.array(c) for c in found)
            count.append(np.array([len(c) for c in found], np.int64))
        at, count = np.concatenate(parts).astype(np.int64), np.concatenate(count)
        begins = np.cumsum(count) - count
        cx, cy = gx[at], gy[at]
        starts = np.append(True, (np.diff(cx) > K) | (np.diff(cx) != np.diff(cy)))[: len(cx)]
        starts[begins] = True
        first = np.flatnonzero(starts)
        final = np.append(first[1:], len(cx))[: len(first)] - 1
        runs = np.add.reduceat(starts.astype(np.int64), begins) if len(begins) else begins
        length = cx[final] + K - cx[first]
        who = pa.array(row[at[begins]])
        none = [pa.nulls(len(begins), kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(column[c].take(who) for c in (*ours, *theirs)), lists(cx[first], runs), lists(cy[first], runs), lists(length, runs), *none], names=names)
        if with_seams:
            long = length >= MIN_WORDS
            low = (group[row[at[first[long]]]] << 32) + cx[first[long]]
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.append(-1, np.maximum.accumulate((low + length[long])[order]))
            seed = column["seed"].to_numpy().view(np.uint64)
            order = np.lexsort((px, group))
            order = order[seed[order] & np.uint64(1) == 0]
            unit, begin, end = seams(group[order], px[order], source[order], py[order], seed[order])
            start, stop = px[order][begin], px[order][end]
            shift = group[order][begin] << 32
            known = high[np.searchsorted(low, shift + start, "right")] >= shift + stop + K
            who = pa.array(order[begin])
            empty = [pa.nulls(len(begin), column[c].type) for c in theirs] + [pa.nulls(len(begin), pa.list_(pa.int32()))] * 3
            yield pa.RecordBatch.from_arrays([*(column[c].take(who) for c in ours), *empty, pa.array(unit.view(np.int64)), pa.array(start.astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array(known)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of which all but the last have one document only
        for b in batches:
            if not b.num_rows:
                continue
            ends = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b]) if held else b
            edge = np.flatnonzero(changes(*(ends.column(c) for c in ours))) - bool(held)
            edge = edge[edge >= (0 if held else 1)]
            if len(edge):
                last = int(edge[-1])
                yield from solve(pa.Table.from_batches([*held, b.slice(0, last)]))
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield from solve(pa.Table.from_batches(held))

    columns = [*ours, *theirs, "pos", "src_pos", "seed"]
    dealt = placed.select(*columns).repartition(*ours).sortWithinPartitions(*ours)
    return dealt.mapInArrow(run, schema("", placed, [*ours, *theirs]) + ", x array<int>, y array<int>, n array<int>, seed bigint, pos int, reach int, known boolean")


def distance(a: list[bytes], b: list[bytes]) -> int:
    """Edit distance of two word sequences, by bit-parallel rows."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    mask, last, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = mask, 0
    for w in b:
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        out += bool(ph & last) - bool(mh & last)
        ph, mh = ph << 1 | 1, mh << 1
        up, down = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return out


def extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int) -> tuple[int, int]:
    """Words by which a match goes on from a[i] and b[j], and the mismatches among them."""
    score = best = length = wrong = n = miss = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score >= best - DROP:
        n += 1
        if a[i] == b[j]:
            score += 1
        else:
            score -= MISMATCH
            miss += 1
        if score > best:
            best, length, wrong = score, n, miss
        i, j = i + step, j + step
    return length, wrong


def align(a: list[bytes], b: list[bytes], x: list[int], y: list[int], sizes: list[int]) -> list[tuple[int, int, int, int, float]]:
    """The parts of a chain's alignment that are repeats: start and end in a and in b, similarity. No word of a run is looked at."""
    pieces: list[tuple[int, int, int, int, int]] = []  # start and end in a and b, edits
    n, wrong = extend(a, b, x[0] - 1, y[0] - 1, -1)
    end_a, end_b = x[-1] + sizes[-1], y[-1] + sizes[-1]
    more, wrong_more = extend(a, b, end_a, end_b, 1)
    if min(end_a - x[0], end_b - y[0]) + n + more < MIN_WORDS:
        return []
    pieces.append((x[0] - n, x[0], y[0] - n, y[0], wrong))
    i, j = x[0], y[0]
    for p, q, size in zip(x, y, sizes):
        if p < i or q < j:  # overlaps the run before
            shift = max(i - p, j - q)
            if shift >= size:
                continue
            p, q, size = p + shift, q + shift, size - shift
            pieces.append((i, p, j, q, max(p - i, q - j)))
        elif p > i or q > j:
            pieces.extend(gap(a, b, i, p, j, q))
        i, j = p + size, q + size
        pieces.append((p, i, q, j, 0))
    pieces.append((i, i + more, j, j + more, wrong_more))
    # The stretch that gains most where an edit costs what SIMILARITY allows for it, then those on both sides of it.
    out, todo = [], [(0, len(pieces))]
    while todo:
        low, high = todo.pop()
        best, at, gain, begin = 0.0, None, 0.0, low
        for k in range(low, high):
            p, i, q, j, edits = pieces[k]
            if gain <= 0:
                gain, begin = 0.0, k
            gain += (1 - SIMILARITY) * max(i - p, j - q) - edits
            if gain > best:
                best, at = gain, (begin, k)
        if at is None:
            continue
        if span(pieces, *at) < MIN_WORDS:
            at = widest(pieces, low, high, *at, best)
        todo += [(low, at[0]), (at[1] + 1, high)]
        taken = pieces[at[0] : at[1] + 1]
        length = sum(max(i - p, j - q) for p, i, q, j, _ in taken)
        alike = 1 - sum(e for *_, e in taken) / max(1, length)
        start, end, from_, to = taken[0][0], taken[-1][1], taken[0][2], taken[-1][3]
        if span(pieces, *at) >= MIN_WORDS and alike >= SIMILARITY:
            out.append((start, end, from_, to, alike))
    return sorted(out)


def span(pieces: list[tuple[int, int, int, int, int]], first: int, last: int) -> int:
    """Words from one piece to another, in the document where they are fewer."""
    return min(pieces[last][1] - pieces[first][0], pieces[last][3] - pieces[first][2])


def widest(pieces: list[tuple[int, int, int, int, int]], low: int, high: int, first: int, last: int, gain: float) -> tuple[int, int]:
    """The longest stretch around a short one of that gain that is still as alike as SIMILARITY, between equal words."""
    sides = []
    for places in (range(first - 1, low - 1, -1), range(last + 1, high)):
        own, lost = [(first if places.step < 0 else last, 0.0)], 0.0
        for k in places:
            p, i, q, j, edits = pieces[k]
            lost += edits - (1 - SIMILARITY) * max(i - p, j - q)
            if lost > 2 * gain + MIN_WORDS * (1 - SIMILARITY):
                break
            if not edits and i > p:
                own.append((k, lost))
        sides.append(own)
    fits = [(s, e) for s, a in sides[0] for e, b in sides[1] if a + b <= gain + 1e-9]
    return max(fits, key=lambda f: span(pieces, *f))


def gap(a: list[bytes], b: list[bytes], i: int, p: int, j: int, q: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a[i:p] and b[j:q] between two seeds: where a repeat can't go through, what goes on from each seed is apart."""
    edits = distance(a[i:p], b[j:q])
    if (1 - SIMILARITY) * max(p - i, q - j) >= edits:
        return [(i, p, j, q, edits)]
    n, wrong = extend(a[i:p], b[j:q], 0, 0, 1)
    m, other = extend(a[i + n : p], b[j + n : q], p - i - n - 1, q - j - n - 1, -1)
    inner = distance(a[i + n : p - m], b[j + n : q - m])
    return [(i, i + n, j, j + n, wrong), (i + n, p - m, j + n, q - m, inner), (p - m, p, q - m, q, other)]


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def outside(x: list[int], n: list[int], end: int) -> list[tuple[int, int]]:
    """The stretches of a chain that no run covers, and MARGIN words at both ends; ``end`` is the number of words."""
    out, at = [(max(0, x[0] - MARGIN), x[0])], x[0] + n[0]
    for p, size in zip(x[1:], n[1:]):
        if p > at:
            out.append((at, p))
        at = p + size
    return [*out, (at, min(end, at + MARGIN))]


def compared(own: list[bytes], held: list[bytes], x: list[int], y: list[int], n: list[int]) -> list[tuple]:
    """The repeats of a chain: ``own`` has the words of ``outside`` of one document, ``held`` all words of the other."""
    low_a, low_b, end = max(0, x[0] - MARGIN), max(0, y[0] - MARGIN), x[-1] + n[-1]
    inner = outside(x, n, end)[:-1]
    tail = len(own) - sum(q - p for p, q in inner)
    a, done = [None] * (end + tail - low_a), 0
    for p, q in [*inner, (end, end + tail)]:
        a[p - low_a : q - low_a] = own[done : done + q - p]
        done += q - p
    b = held[low_b : y[-1] + n[-1] + MARGIN]
    found = align(a, b, [p - low_a for p in x], [p - low_b for p in y], n)
    return [(r[0] + low_a, r[1] + low_a, r[2] + low_b, r[3] + low_b, r[1] - r[0], r[4]) for r in found]


#: Chains with one source that go on in one row: so many words between runs and places at most. Rows that are Python objects at once.
TOGETHER, ROWS = 1 << 13, 32


def objects(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, few of them as Python objects at once."""
    for at in range(0, batch.num_rows, ROWS):
        yield from batch.slice(at, ROWS).to_pylist()


def aligned(linked: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """The repeats of chains: first the words between runs are taken from the later document, then they meet the earlier one.

    A document's chains are one row; those with one source are grouped within a batch before they are shuffled.
    """
    ours, theirs = ids(linked), ids(linked, "src")
    kind = schema("", linked, ours)
    inner = pa.struct([(c, t) for c, t in zip(ours, (f.type for f in linked.select(*ours).limit(0).toArrow().schema))] + [(c, pa.list_(pa.int32())) for c in "xyn"] + [("a", pa.string())])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, b_text):
                groups: dict[tuple, tuple[list[dict], list[int]]] = {}
                done: list[tuple[tuple, list[dict]]] = []
                for row in objects(b):
                    held = words(row["text"])
                    for c in row["c"]:
                        parts = [w for p, q in outside(c["x"], c["n"], len(held)) for w in held[p:q]]
                        src = tuple(c[k] for k in theirs)
                        own, size = groups.setdefault(src, ([], [0]))
                        own.append({k: row[k] for k in ours} | {k: c[k] for k in "xyn"} | {"a": b" ".join(parts).decode()})
                        size[0] += len(parts) + 3 * len(c["x"])
                        if size[0] > TOGETHER:
                            done.append((src, groups.pop(src)[0]))
                done += [(src, own) for src, (own, _) in groups.items()]
                columns = [pa.array([src[k] for src, _ in done], inner.field(ours[k]).type) for k in range(len(ours))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([own for _, own in done], pa.list_(inner))], names=[*theirs, "c"])

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for whole in batches:
            for b in slices(whole, b_text):
                out = []
                for row in objects(b):
                    src = tuple(row[k] for k in theirs)
                    if src != last:
                        last, held = src, words(row["text"])
                    for c in row["c"]:
                        of = tuple(c[k] for k in ours)
                        out += [(of[0], src[0], *r, *of[1:], *src[1:]) for r in compared(c["a"].encode().split(), held, c["x"], c["y"], c["n"])]
                kinds = [inner.field("doc").type] * 2 + [pa.int32()] * 5 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in zip(range(len(names)), kinds)], names=names)

    b_text = len(ours) + 1
    chain = "x: array<int>, y: array<int>, n: array<int>"
    both = linked.groupBy(*ours).agg(F.collect_list(F.struct(*theirs, "x", "y", "n")).alias("c")).join(texts, ours).select(*ours, "c", "text")
    struct = ", ".join([f"{c}: {t}" for c, t in (x.split(" ", 1) for x in kind.split(", "))] + [chain, "a: string"])
    sent = both.mapInArrow(left, schema("", linked, theirs) + f", c array<struct<{struct}>>")
    renamed = texts.select(*(F.col(a).alias(b) for a, b in zip(ours, theirs)), "text")
    met = sent.join(renamed, theirs).select(*theirs, "c", "text")
    kinds = [linked.schema["doc"].dataType.simpleString()] * 2 + ["int"] * 5 + ["double"] + ["bigint"] * 2
    return met.mapInArrow(right, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, src_doc_id, start_word, end_word, src_start_word, src_end_word, n_words, similarity, doc_id_key, src_doc_id_key)``.

    A row says that words start to end of a document repeat words of an earlier document: one whose id is less, or
    of one id the one whose key is less. Words are runs without ASCII white space, A-Z lower-cased. Null ids and
    null texts are passed over, as are texts of under 50 words; rows that repeat id and text count once. Rows of
    one id with other texts are documents of their own, told apart by their key (a hash of the text; 0 where a row
    is alone with its id). Passages that recur within one document only aren't looked for. A table without repeats
    gives no row. Other columns aren't read.
    """
    texts = keyed(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null"))
    own = ids(texts)
    texts = texts.select(*own, "text")
    if len(own) > 1:
        several = texts.where("key <> 0").groupBy(*own).agg(F.any_value("text").alias("text"))
        texts = written(texts.where("key = 0").unionByName(several), "texts")
    looked = lambda df: df.where(F.pmod(F.xxhash64(*own), F.lit(LOOKED_AT)) == 0)
    hot = frequent(seeds(looked(texts)))
    found = seeds(texts)
    once = written(chained(first_places(found, seeds(texts, hot) if hot else found.limit(0)), True), "chains")
    units = once.where("seed is not null").select("seed", "pos", *own, "reach", "known")
    hot = frequent(looked(units))
    # What is a repeat already needs no other source, but may be one.
    src = ids(once, "src")
    other = " or ".join(f"{a} <> {b}" for a, b in zip(own, src))
    matches = first_places(units, units.where(F.col("seed").isin(hot))).where(f"not known and ({other})")
    ends = F.explode(F.array(F.lit(0), F.col("reach"))).alias("step")
    matches = matches.select(*own, *src, "pos", "src_pos", ends).select(*own, *src, (F.col("pos") + F.col("step")).alias("pos"), (F.col("src_pos") + F.col("step")).alias("src_pos"), F.lit(0).cast("bigint").alias("seed"))
    linked = once.where("seed is null").unionAll(chained(matches, False)).select(*own, *src, "x", "y", "n")
    names = [id_col, f"src_{id_col}", "start_word", "end_word", "src_start_word", "src_end_word", "n_words", "similarity", f"{id_col}_key", f"src_{id_col}_key"]
    found = aligned(linked, texts, names if len(own) > 1 else names[:8])
    if len(own) == 1:
        found = found.withColumns({c: F.lit(0).cast("bigint") for c in names[8:]})
    # Two chains of one pair may give one stretch, or a part of it that the margin ended.
    before = Window.partitionBy(*names[:2], *names[8:], F.col("src_end_word") - F.col("end_word")).orderBy("start_word", F.desc("end_word")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reached", F.max("end_word").over(before)).where("reached is null or reached < end_word").drop("reached")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the passages that repeat an earlier document; what is left empty so goes.

    The first document of a passage keeps it. n_chars is counted anew where a text was cut.
    """
    found = repeats(docs).groupBy("doc_id", "doc_id_key").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rows = keyed(docs.select(F.col("doc_id").alias("doc"), F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")))
    same = (F.col("doc") == F.col("doc_id")) & (F.col("key") == F.col("doc_id_key")) if "key" in rows.columns else F.col("doc") == F.col("doc_id")
    held = rows.join(found, same, "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                texts = b.column(1).to_pylist()
                own = b.column(2).to_pylist()
                for i, marks in enumerate(own):
                    if marks:
                        texts[i] = without(texts[i], [(m["start_word"], m["end_word"]) for m in marks])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([bool(m) for m in own])], names=["row", "text", "was_cut"])

    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, text string, was_cut boolean").where(~(F.col("was_cut") & (F.length(F.trim("text")) == 0)))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("was_cut"), F.length("text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*((new[c] if c in new else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def without(text: str, marks: list[tuple[int, int]]) -> str:
    """A text without the words of some spans; white space before a cut stays, what is within goes."""
    w = Words(pa.array([text], pa.string()))
    raw, out, at = text.encode(), [], 0
    for start, end in sorted(marks):
        if start >= len(w.start):
            continue
        low, high = int(w.start[start]), int(w.end[min(end, len(w.end)) - 1])
        out.append(raw[at : max(at, low)])
        at = max(at, high)
    return b"".join([*out, raw[at:]]).decode().strip()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
