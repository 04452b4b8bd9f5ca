"""Names and lines: identifier sanitising, first duplicates, trimmed input lines, utilities' conversions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.errors import InvalidConversion

T = TypeVar("T")


def identifier(name: str) -> str:
    """``name`` as an SQL identifier: other characters and a leading digit become underscores."""
    return re.sub(r"^[^A-Za-z_]", "_", re.sub(r"[^A-Za-z0-9_]", "_", name))


def identifiers(name: Column) -> Column:
    """The same for a column of names."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), r"^[^A-Za-z_]", "_")


def first_duplicate(values: Sequence[T]) -> T | None:
    """The first value that was there before, or None."""
    seen: set[T] = set()
    return next((v for v in values if v in seen or seen.add(v)), None)


def first_duplicates(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, value)``: for each key, the first value in order that its group had before; none, no row."""
    earlier = rows.select(key, order, value, F.row_number().over(Window.partitionBy(key, value).orderBy(order)).alias("_nth"))
    return earlier.where("_nth = 2").groupBy(key).agg(F.min_by(value, order).alias(value))


def clean_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines trimmed of white space and without empty ones; line numbers keep their gaps."""
    return lines.withColumn(text, F.regexp_replace(text, r"^\s+|\s+$", "")).where(F.col(text) != "")


def simple(value: Column) -> Column:
    """A utility that must be -1, 0 or 1; anything else stops the query."""
    return F.when(value.isin(-1, 0, 1) | value.isNull(), value.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a simple utility: "), value.cast("string"))).cast("long"))


def to_simple(value: int) -> int:
    if value not in (-1, 0, 1):
        raise InvalidConversion(f"{value} is none of -1, 0 and 1")
    return value


def classic(mover_value: Column, turn: Column) -> Column:
    """Both players' utilities of a zero-sum game, from the mover's."""
    return F.when(turn == 0, F.array(mover_value, -mover_value)).otherwise(F.array(-mover_value, mover_value))


def puzzle(value: Column) -> Column:
    """The utilities of a game with one player."""
    return F.array(value)
