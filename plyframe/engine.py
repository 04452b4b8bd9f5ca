"""Building, storing and looking up solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe import info
from plyframe.operators.base import Game
from plyframe.operators.history import ends, forwarded
from plyframe.operators.mnk import Mnk
from plyframe.operators.solve import flat, solution, union
from plyframe.operators.zero_by import ZeroBy
from plyframe.sources.store import IOMode, Store, upserted

GAMES: dict[str, type[Game]] = {"zero-by": ZeroBy, "mnk": Mnk}


class Engine:
    """Games solved by Spark, kept in a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def game(self, name: str, variant: str | None = None) -> Game:
        if name not in GAMES:
            raise ValueError(f"no game {name!r}; there are {', '.join(GAMES)}")
        return GAMES[name](variant)

    def build(self, name: str, variant: str | None = None, mode: str = "constructive", history: DataFrame | None = None) -> DataFrame:
        """The table of a variant from its start, or from where ``history(line, text)`` leads; with a ``history_id``, from all of them.

        constructive returns the stored table if it has every start, else adds what is missing, taking what is stored as
        solved; overwrite begins anew; forgetful computes like constructive and stores nothing.
        """
        how, game = IOMode(mode), self.game(name, variant)
        if history is None:
            seeds = game.seed(self.spark)
        else:
            several = "history_id" in history.columns
            seeds = ends(history, game).select("state").distinct() if several else self.spark.createDataFrame([(forwarded(history.withColumn("history_id", F.lit(0)), game),)], "state bigint")
        stored = None if how is IOMode.OVERWRITE else self.store.read(name, game.variant_text)
        if stored is not None and seeds.join(stored.select("state"), "state", "left_anti").isEmpty():
            return stored
        known = None
        if stored is not None and isinstance(game, Mnk):
            known = stored.select("state", "remoteness", F.array(*(f"utility_{i}" for i in range(game.players))).alias("utility"))
        if isinstance(game, Mnk):
            new = solution(self.spark, game, seeds, known=known)
        else:  # one fold each, of a game that is cheap to solve
            new = union([solution(self.spark, game, start=r.state) for r in seeds.collect()]).dropDuplicates(["state"])
        new = flat(game, new)
        if stored is not None:
            new = upserted(stored, new)
        return new if how is IOMode.FORGETFUL else self.store.replace(name, game.variant_text, new)

    def lookup(self, name: str, variant: str, states: DataFrame) -> DataFrame:
        """``states(state)`` with their solutions, nulls where there is none."""
        return self.store.lookup(name, variant, states)

    def drop(self, name: str, variant: str | None = None) -> None:
        """Deletes the stored table of a variant; none is no error."""
        self.store.drop(name, self.game(name, variant).variant_text)

    def info(self, name: str, attributes: list[str] | None = None, output: str = "legible") -> str:
        return info.formatted(self.spark, name, attributes, output)
