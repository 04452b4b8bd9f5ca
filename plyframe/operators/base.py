"""What a game is: expressions over a column of packed states."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Game(ABC):
    """A finite sequential game as Column expressions; nothing here runs row by row in Python."""

    name: str
    players: int
    variant_text: str
    start: int
    features: tuple[str, ...] = ()

    @abstractmethod
    def turn(self, state: Column) -> Column: ...

    @abstractmethod
    def is_sink(self, state: Column) -> Column: ...

    @abstractmethod
    def successors(self, state: Column) -> Column:
        """``array<struct<child:bigint, ord:bigint>>``, ord telling equal children's order."""

    @abstractmethod
    def utility(self, state: Column) -> Column:
        """``array<bigint>``, a value for each player; of sinks only."""

    @abstractmethod
    def encode(self, state: Column) -> Column: ...

    @abstractmethod
    def decode(self, text: Column) -> Column:
        """``struct<state:bigint, error:string>``; error is null for a well-formed state."""

    def feature_columns(self, state: Column) -> dict[str, Column]:
        return {}

    def seed(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.lit(self.start).cast("long").alias("state"))

    def expanded(self, states: DataFrame) -> DataFrame:
        """``(state, child, ord)`` for each move from states that aren't sinks."""
        moves = states.where(~self.is_sink(F.col("state"))).select("state", F.explode(self.successors(F.col("state"))).alias("_m"))
        return moves.select("state", F.col("_m.child").alias("child"), F.col("_m.ord").alias("ord"))
