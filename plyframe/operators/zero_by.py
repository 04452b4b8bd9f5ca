"""zero-by: players take turns to remove one of the allowed numbers of elements; who must move at zero wins."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.bits import field, let, signed
from plyframe.operators.base import Game
from plyframe.plans import variants


class ZeroBy(Game):
    name = "zero-by"

    def __init__(self, variant: str | None = None) -> None:
        self.variant = variants.zero_by(variant)
        self.variant_text, self.players = self.variant.text, self.variant.players
        self.start = self.packed(self.variant.start, 0)

    def packed(self, elements: int, turn: int) -> int:
        return signed(turn << self.variant.element_bits | elements)

    def pack(self, elements: Column, turn: Column) -> Column:
        return F.shiftleft(turn.cast("long"), self.variant.element_bits).bitwiseOR(elements.cast("long"))

    def elements(self, state: Column) -> Column:
        return field(state, 0, self.variant.element_bits)

    def turn(self, state: Column) -> Column:
        return field(state, self.variant.element_bits, self.variant.turn_bits)

    def is_sink(self, state: Column) -> Column:
        return self.elements(state) == 0

    def successors(self, state: Column) -> Column:
        left, next_ = self.elements(state), (self.turn(state) + 1) % self.players
        counts = F.array(*(F.lit(c).cast("long") for c in self.variant.choices))
        children = F.array_sort(F.array_distinct(F.transform(counts, lambda c: self.pack(left - F.least(c, left), next_))))
        return F.transform(children, lambda c: F.struct(c.alias("child"), c.alias("ord")))

    def utility(self, state: Column) -> Column:
        turn = self.turn(state)
        return F.transform(F.sequence(F.lit(0), F.lit(self.players - 1)), lambda i: F.when(i == turn, F.lit(1)).otherwise(F.lit(-1)).cast("long"))

    def encode(self, state: Column) -> Column:
        return F.concat_ws("-", self.elements(state).cast("string"), self.turn(state).cast("string"))

    def decode(self, text: Column) -> Column:
        digits = [F.regexp_extract(text, r"^0*(\d+)-0*(\d+)$", k).alias(n) for k, n in ((1, "e"), (2, "t"))]
        number = lambda d: F.when(F.length(d).between(1, 18), d.cast("long"))

        def judged(p: Column) -> Column:
            e, t = p["e"], p["t"]
            error = F.when(p["bad"], F.lit("malformed: not elements-turn")).when(e.isNull() | (e > self.variant.start), F.lit("too many elements")).when(t.isNull() | (t >= self.players), F.lit("no such player"))
            return let(error, lambda x: F.struct(F.when(x.isNull(), self.pack(e, t)).alias("state"), x.alias("error")))

        return let(F.struct(*digits), lambda d: let(F.struct(number(d["e"]).alias("e"), number(d["t"]).alias("t"), (d["e"].isNull() | (d["e"] == "")).alias("bad")), judged))


def values(variant: variants.ZeroByVariant, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """For 0 to ``upto`` elements: how many seats after the mover the winner sits, and the remoteness.

    Players are alike under rotation, so these two say it for every turn. A mover prefers to win,
    then the least remoteness, then the child with fewest elements.
    """
    p = variant.players
    ahead, remote = [0] * (upto + 1), [0] * (upto + 1)
    for e in range(1, upto + 1):
        options = ((((1 + ahead[c]) % p != 0), remote[c], c) for c in {max(e - n, 0) for n in variant.choices})
        _, near, child = min(options)
        ahead[e], remote[e] = (1 + ahead[child]) % p, near + 1
    return np.array(ahead, np.int64), np.array(remote, np.int64)


def reached(variant: variants.ZeroByVariant, start: int, turn: int) -> list[int]:
    """For each number of elements up to ``start`` the set of turns, as bits, in which play can meet it."""
    p = variant.players
    met = [0] * start + [1 << turn]
    for e in range(start, 0, -1):
        if met[e]:
            later = (met[e] << 1 | met[e] >> (p - 1)) & (1 << p) - 1
            for n in variant.choices:
                met[max(e - n, 0)] |= later
    return met


def fold(variant: variants.ZeroByVariant, start: int | None = None, turn: int = 0, everywhere: bool = False) -> pd.DataFrame:
    """All positions reachable from a start, solved; ``everywhere``: all positions up to it."""
    start = variant.start if start is None else start
    p = variant.players
    ahead, remote = values(variant, start)
    met = [(1 << p) - 1] * (start + 1) if everywhere else reached(variant, start, turn)
    rows = np.array([(e, t) for e, m in enumerate(met) for t in range(p) if m >> t & 1], np.int64)
    elements, turns = rows[:, 0], rows[:, 1]
    state = (turns.astype(np.uint64) << np.uint64(variant.element_bits) | elements.astype(np.uint64)).view(np.int64)
    winner = (turns + ahead[elements]) % p
    utility = np.where(winner[:, None] == np.arange(p)[None, :], 1, -1)
    return pd.DataFrame({"state": state, "remoteness": remote[elements], "player": turns, "utility": list(utility)})


def solve_all(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """``(variant, state, remoteness, player, utility)`` of many variants, folded side by side."""
    wanted = [(t,) for t in dict.fromkeys(texts)]
    for (t,) in wanted:
        variants.zero_by(t)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        text = group["variant"].iloc[0]
        found = fold(variants.zero_by(text))
        found.insert(0, "variant", text)
        return found

    schema = "variant string, state bigint, remoteness bigint, player bigint, utility array<bigint>"
    return spark.createDataFrame(wanted, "variant string").groupBy("variant").applyInPandas(one, schema)


def solve(spark: SparkSession, game: ZeroBy, start: int | None = None) -> DataFrame:
    """``(state, remoteness, player, utility)`` of the positions reachable from a packed start."""
    v = game.variant
    bits = (game.start if start is None else start) & (1 << 64) - 1
    elements, turn = bits & (1 << v.element_bits) - 1, bits >> v.element_bits
    schema = "state bigint, remoteness bigint, player bigint, utility array<bigint>"
    return spark.range(0, 1, 1, 1).mapInPandas(lambda parts: (fold(v, elements, turn) for _ in parts), schema)


def solve_everywhere(spark: SparkSession, game: ZeroBy) -> DataFrame:
    """Solutions of all well-formed positions, whether play from the start meets them or not."""
    v = game.variant
    schema = "state bigint, remoteness bigint, player bigint, utility array<bigint>"
    return spark.range(0, 1, 1, 1).mapInPandas(lambda parts: (fold(v, everywhere=True) for _ in parts), schema)
