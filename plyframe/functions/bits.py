"""Packed 64-bit states: plan-time integers and Column helpers. Keys are signed, as Spark's longs are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = -(1 << 63)


def signed(value: int) -> int:
    """The long that has the bit pattern of an unsigned 64-bit value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def mask(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def bit_width(value: int) -> int:
    """Bits that hold a non-negative value; 0 needs none."""
    if value < 0:
        raise ValueError("a bit width is of a non-negative value")
    return value.bit_length()


def field(state: Column, shift: int, width: int) -> Column:
    """``width`` bits of a state from ``shift`` on, as a non-negative long (width under 64)."""
    return F.shiftrightunsigned(state, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values) if values else F.lit(0).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
