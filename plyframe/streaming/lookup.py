"""Solved tables joined to streams of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.operators.base import Game


def decoded(stream: DataFrame, game: Game, text: str = "text") -> DataFrame:
    """A stream of state strings with ``state`` and ``error``; nothing is kept between batches."""
    found = stream.withColumn("_d", game.decode(F.col(text)))
    return found.withColumn("state", F.col("_d.state")).withColumn("error", F.col("_d.error")).drop("_d")


def solved(stream: DataFrame, table: DataFrame) -> DataFrame:
    """Each row of ``stream(state, ...)`` with its solution from a stored table, nulls where there is none."""
    return stream.join(table, "state", "left")
