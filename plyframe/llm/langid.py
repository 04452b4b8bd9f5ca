"""Language identification by cross-parsing with suffix automata.

Each language has a suffix automaton of labelled text. A text is cut greedily into the longest
phrases that occur in that labelled text; the fewer phrases it needs, the closer the language.
Phrase counts are normalised by the length of the labelled text, as in the Ziv-Merhav estimate
of cross-entropy: phrases * log2(labelled characters) / characters.

Texts are lower-cased; characters that aren't letters become one boundary. All languages' automata
form one dense table of transitions. A missing transition holds the state after a new phrase has
begun, so a step is one look-up. Texts are stepped together in blocks, as if a phrase began with each; then
each block is stepped from where the one before really ended, until both parses are in one state, and
what differs is put right. So the phrases are those of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import slices, table

#: The labelled sample: rows looked at for each language, characters kept in whole texts, and languages (the most frequent).
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_CHARS_IN_ALL, LANGUAGES = 96, 32768, 262144, 1024
#: Letters told apart; the others count as one.
ALPHABET = 62
#: Characters stepped one after the other before others are put beside them; it changes no result.
BLOCK = 1024


def normal(text: str) -> str:
    """Letters in lower case, other runs as one space; empty if there is no letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Model:
    """Automata of ``{language: labelled text}``, built where they are used; only the texts are sent."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = {k: normal(v) for k, v in sorted(texts.items())}
        self.langs = list(self.texts)
        self.table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def build(self) -> None:
        counts = Counter(c for t in self.texts.values() for c in t if c != " ")
        letters = sorted(counts, key=lambda c: (-counts[c], c))[:ALPHABET]
        self.code = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
        width = len(letters) + 2
        self.codes = np.zeros(1 << 16, np.int32)
        for i in range(1 << 16):
            if (c := chr(i)).isalpha():
                self.codes[i] = self.code.get(c, 1)
        self.start, rows = [], 0
        # An automaton has under two states a character; rows that aren't used are never touched.
        whole = np.empty((sum(2 * len(t) + 2 for t in self.texts.values()), width), np.int32)
        for t in self.texts.values():
            steps = automaton("".join(c if c in self.code else "\x01" for c in t))
            part = whole[rows : rows + len(steps)]
            part.fill(-1)
            for s, to in enumerate(steps):
                for c, n in to.items():
                    part[s, self.code.get(c, 1)] = n
            first = np.where(part[0] < 0, 0, part[0])
            for low in range(0, len(part), 4096):
                some = part[low : low + 4096]
                began = some < 0
                if not low:
                    began[0] = True
                np.copyto(some, first[None, :], where=some < 0)
                some += rows
                some *= 2 * width
                some |= began
            self.start.append(rows * width)
            rows += len(steps)
        self.table = whole[:rows].reshape(-1)
        self.cost = np.array([log2(max(2, len(t))) for t in self.texts.values()])

    def encoded(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(raw) and raw.max() >= 1 << 16:
            far = np.flatnonzero(raw >= 1 << 16)
            letter = [unicodedata.category(chr(c))[0] == "L" for c in raw[far]]
            raw = raw.copy()
            raw[far] = np.where(letter, 0x4E00, 0x20)
            out = self.codes[raw]
            out[far[letter]] = 1
        else:
            out = self.codes[raw]
        keep = out > 0
        keep[1:] |= out[:-1] > 0
        out = out[keep]
        return out[:-1] if len(out) and out[-1] == 0 else out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language (columns), and its characters."""
        if self.table is None:
            self.build()
        own = [self.encoded(t) for t in texts]
        length = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate(own) if own else np.zeros(0, np.int32)
        del own
        blocks = -(-length // BLOCK)
        doc = np.repeat(np.arange(len(length)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(length) - length, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, length[doc] - nth * BLOCK)
        n, langs = len(doc), len(self.langs)
        fresh = np.repeat(np.array(self.start, np.int32), n)
        begin, size, nth = np.tile(begin, langs), np.tile(size, langs), np.tile(nth, langs)
        count, plain = self.stepped(flat, begin, size, fresh)
        left = plain.copy()
        # Of each language and block: the state that it was entered with, and what that changes.
        entered, more = fresh.copy(), np.zeros(len(fresh), np.int64)
        todo = np.flatnonzero(nth > 0)
        while len(todo):
            todo = todo[left[todo - 1] != entered[todo]]
            entered[todo] = left[todo - 1]
            more[todo], now = self.put_right(flat, begin[todo], size[todo], fresh[todo], entered[todo], plain[todo])
            changed = todo[now != left[todo]]
            left[todo] = now
            todo = changed[changed + 1 < len(nth)] + 1
            todo = todo[nth[todo] > 0]
        total = np.zeros((len(length), langs), np.int64)
        np.add.at(total, doc, (count + more).reshape(langs, n).T)
        return total, length

    def stepped(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, and the state that it is left with."""
        order = np.argsort(-size, kind="stable")
        at, wide, now = begin[order], size[order], state[order]
        found = np.zeros(len(at), np.int64)
        alive = np.searchsorted(-wide, -np.arange(int(wide[0]) if len(wide) else 0), side="left")
        for t, n in enumerate(alive.tolist()):
            got = self.table.take(now[:n] + flat[at[:n] + t])
            found[:n] += got & 1
            now[:n] = got >> 1
        count, left = np.empty_like(found), np.empty_like(now)
        count[order], left[order] = found, now
        return count, left

    def put_right(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how many phrases blocks entered with states ``b`` differ from ``a``, and the states they are left with (``plain`` for ``a``)."""
        more, end = np.zeros(len(begin), np.int64), plain.copy()
        live, t = np.arange(len(begin)), 0
        while len(live):
            x, y = (self.table.take(v + flat[begin[live] + t]) for v in (a, b))
            more[live] += (y & 1) - (x & 1)
            a, b, t = x >> 1, y >> 1, t + 1
            done = size[live] == t
            end[live[done]] = b[done]
            on = ~done & (a != b)
            live, a, b = live[on], a[on], b[on]
        return more, end


def chosen(key: Column) -> Column:
    """Whether a row may be learnt from, by its key."""
    return F.crc32(key.cast("string")) % 3 != 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the non-null labels of ``docs``, from a bounded sample.

    Of the texts that have a letter and fit, about SAMPLE_ROWS for each language are taken by a hash of the id and kept
    whole up to SAMPLE_CHARS characters (fewer where there are many languages: SAMPLE_CHARS_IN_ALL for all together).
    Of a language without a text that fits, the shortest one is cut. Languages beyond the LANGUAGES most frequent ones
    aren't learnt. Rows with null id, label or text are passed over.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") <= SAMPLE_CHARS).alias("fit"))
    sizes = {r.lang: r for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return Model({})
    room = min(SAMPLE_CHARS, SAMPLE_CHARS_IN_ALL // len(sizes))
    share = F.create_map(*(F.lit(x) for lang, r in sizes.items() for x in (lang, min(1.0, SAMPLE_ROWS / max(1, r.fit)))))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    some = rows.withColumn("place", place).where(F.col("place") < share[F.col("lang")]).where(F.length("text") <= SAMPLE_CHARS)
    before = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1)
    found = some.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < 2 * room).select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in found:
        t, own = normal(r.text), texts.setdefault(r.lang, [])
        if t and t not in own and sum(map(len, own)) + len(t) <= room:
            own.append(t)
    if lacking := [lang for lang in sizes if not texts.get(lang)]:
        least = F.min_by(F.substring("text", 1, 2 * room), F.struct(F.length("text"), F.xxhash64("text")))
        for r in rows.where(F.col("lang").isin(lacking)).groupBy("lang").agg(least.alias("text")).collect():
            texts[r.lang] = [normal(r.text)[:room]]
    return Model({k: "\n".join(v) for k, v in texts.items() if any(v)})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``(id_col, lang_pred, score, phrases, chars)`` for each row, from the text alone.

    Null text, text without a letter and a model without languages give ``und``, score 0 and no
    phrases. Ties go to the language that sorts first. score is one less the share of phrases that
    the best language needs against the next (1 where there is one language). ``keep_text`` adds the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                count, length = model.phrases(b.column(1).to_pylist())
                known = length > 0 if model.langs else np.zeros(len(length), bool)
                cost = count * model.cost if model.langs else np.zeros((len(length), 1))
                best = cost.argmin(axis=1)
                low = np.sort(cost, axis=1)
                score = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-9) if cost.shape[1] > 1 else np.ones(len(length))
                langs = np.array([*model.langs, "und"], object)
                pred = langs[np.where(known, best, len(langs) - 1)]
                used = count[np.arange(len(length)), best] if model.langs else np.zeros(len(length), np.int64)
                kept = [b.column(1)] if keep_text else []
                yield pa.RecordBatch.from_arrays([b.column(0), *kept, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(used), pa.array(length)], names=names)

    names = ["id", *["kept"] * keep_text, "lang_pred", "score", "phrases", "chars"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {'kept string, ' * keep_text}lang_pred string, score double, phrases bigint, chars bigint"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({"id": id_col, "kept": text_col})


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (``und``); the others get the predicted language in ``lang``."""
    model = train(docs.where(chosen(F.col("doc_id"))))
    rest = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*rest).alias("_row"), F.col("text").cast("string").alias("_text"))
    known = predict(held, model, "_row", "_text", keep_text=True).where("lang_pred <> 'und'")
    own = {"lang": F.col("lang_pred"), "text": F.col("_text").cast(docs.schema["text"].dataType)}
    return known.select(*(own.get(c, F.col("_row")[c] if c in rest else None).alias(c) for c in docs.columns))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(chosen(F.col("doc_id"))))
    held = F.coalesce(~chosen(F.col("doc_id")), F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "phrases", "chars")
