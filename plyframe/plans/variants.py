"""Variant strings and table layouts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from plyframe.errors import SchemaError, VariantMalformed
from plyframe.functions.names import first_duplicate

#: Default variants, and the board limits of mnk.
ZERO_BY_DEFAULT, MNK_DEFAULT = "2-10-1-2", "3-3-3"
LARGEST_SIDE, CELL_BITS = 10, 63


@dataclass(frozen=True)
class ZeroByVariant:
    text: str
    players: int
    start: int
    choices: tuple[int, ...]

    @property
    def turn_bits(self) -> int:
        return self.players.bit_length()

    @property
    def element_bits(self) -> int:
        return 64 - self.turn_bits


@dataclass(frozen=True)
class MnkVariant:
    text: str
    m: int
    n: int
    k: int


def zero_by(text: str | None = None) -> ZeroByVariant:
    """``players-start-choice[-choice...]``, all positive."""
    text = ZERO_BY_DEFAULT if text is None else text
    if not re.fullmatch(r"[1-9]\d*(-[1-9]\d*){2,}", text, re.ASCII):
        raise VariantMalformed(f"zero-by: {text!r} isn't three or more positive numbers joined by hyphens: players, starting elements, and how many may be taken")
    players, start, *choices = map(int, text.split("-"))
    out = ZeroByVariant(text, players, start, tuple(sorted(set(choices))))
    if start.bit_length() > min(out.element_bits, 63):
        raise VariantMalformed(f"zero-by: {start} elements don't fit beside the turn of {players} players in 64 bits")
    return out


def mnk(text: str | None = None) -> MnkVariant:
    """``rows-columns-needed``, all positive; a board has at most 31 cells and ten a side."""
    text = MNK_DEFAULT if text is None else text
    if not re.fullmatch(r"[1-9]\d*(-[1-9]\d*){2}", text, re.ASCII):
        raise VariantMalformed(f"mnk: {text!r} isn't three positive numbers joined by hyphens: rows, columns, and how many in line win")
    m, n, k = map(int, text.split("-"))
    if max(m, n) > LARGEST_SIDE:
        raise VariantMalformed(f"mnk: a side of {max(m, n)} is more than {LARGEST_SIDE}")
    if 2 * m * n > CELL_BITS:
        raise VariantMalformed(f"mnk: {m * n} cells take {2 * m * n} bits and {CELL_BITS} are there")
    return MnkVariant(text, m, n, k)


@dataclass
class Layout:
    """Columns of a solution table: key, remoteness, player, features, then a utility for each player."""

    players: int | None = None
    key: str | None = None
    columns: list[tuple[str, str]] = field(default_factory=list)

    def build(self) -> T.StructType:
        if not self.players:
            raise SchemaError("a layout needs the number of players")
        if not self.key:
            raise SchemaError("a layout needs a key")
        names = [c for c, _ in self.columns] + [f"utility_{i}" for i in range(self.players)]
        if (twice := first_duplicate(names)) is not None:
            raise SchemaError(f"column {twice!r} is there twice")
        if self.key in names:
            raise SchemaError(f"column {self.key!r} is the key")
        kinds = dict(self.columns)
        return T.StructType([T.StructField(self.key, T.LongType(), False)] + [T.StructField(c, T._parse_datatype_string(kinds.get(c, "bigint")), False) for c in names])


def layout(players: int, features: tuple[str, ...] = ()) -> T.StructType:
    return Layout(players, "state", [(c, "bigint") for c in ("remoteness", "player", *features)]).build()
