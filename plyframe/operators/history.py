"""Histories of play: whether each is legal, where it goes wrong, and where it leads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.errors import InvalidHistory
from plyframe.operators.base import Game


def verified(lines: DataFrame, game: Game, over: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(history_id, valid, error_line, error, state)`` of ``lines(history_id, line, text)``.

    Lines are trimmed, empty ones passed over. The first fault counts: a string that is no state, a
    start that isn't the game's, play after the end, or a move that isn't legal. ``state`` is the last one
    of a valid history. A history of empty lines only is invalid; one without lines isn't there.
    ``over`` says after which states a line is play after the end, if not after all of the game's sinks.
    """
    trimmed = lines.select("history_id", "line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).repartition("history_id")
    rows = trimmed.select("history_id", "line", (F.coalesce("text", F.lit("")) == "").alias("blank"), game.decode(F.col("text")).alias("_d")).select("history_id", "line", "blank", "_d.state", "_d.error")
    order = Window.partitionBy("history_id", "blank").orderBy("line")
    steps = rows.select("history_id", "line", "blank", "state", F.col("error").alias("bad"), F.lag("state").over(order).alias("before"), F.row_number().over(order).alias("nth"))
    legal = F.exists(game.successors(F.col("before")), lambda s: s["child"] == F.col("state"))
    error = (
        F.when(F.col("blank"), F.lit(None))
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when((F.col("nth") == 1) & (F.col("state") != game.start), F.lit("wrong start"))
        .when((F.col("nth") > 1) & (over or game.is_sink)(F.col("before")), F.lit("play after the end"))
        .when((F.col("nth") > 1) & ~legal, F.lit("illegal move"))
    )
    marked = steps.select("history_id", "line", "blank", "state", error.alias("error"))
    fault = F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error")))
    found = marked.groupBy("history_id").agg(fault.alias("fault"), F.max(F.when(~F.col("blank"), F.struct("line", "state"))).alias("last"))
    empty = F.col("last").isNull()
    valid = ~empty & F.col("fault").isNull()
    return found.select("history_id", valid.alias("valid"), F.col("fault.line").cast("long").alias("error_line"), F.when(empty, F.lit("empty history")).otherwise(F.col("fault.error")).alias("error"), F.when(valid, F.col("last.state")).alias("state"))


def ends(lines: DataFrame, game: Game) -> DataFrame:
    """``(history_id, state)``: where each history leads; raises for the first that isn't legal."""
    rows = verified(lines, game)
    bad = rows.where("not valid").orderBy("history_id").limit(1).collect()
    if bad:
        at = "" if bad[0].error_line is None else f" at line {bad[0].error_line}"
        raise InvalidHistory(f"{game.name}: {bad[0].error}{at}")
    return rows.select("history_id", "state")


def forwarded(lines: DataFrame, game: Game) -> int:
    """The state that one history leads to; raises if it isn't legal."""
    rows = ends(lines, game).limit(2).collect()
    if len(rows) != 1:
        raise InvalidHistory(f"{game.name}: one history is needed, not {'none' if not rows else 'several'}")
    return rows[0].state
