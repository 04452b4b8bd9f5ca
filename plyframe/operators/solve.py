"""Reachable states and backward induction over DataFrames.

A graded game (mnk by ply) is solved level by level: each level is the distinct children of the
one before, and going back each state takes its best child's solution. Levels are cut from their
lineage by checkpoints. The best child has the mover's greatest utility, then the least
remoteness, then the least ord.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.errors import SolverViolation
from plyframe.operators.base import Game
from plyframe.operators.mnk import Mnk
from plyframe.operators.zero_by import ZeroBy
from plyframe.operators.zero_by import solve as solve_zero_by


#: Levels of a board game that are computed before their lineage is cut.
AT_ONCE = 3


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where there is one machine and none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``."""
    shared(df.sparkSession)
    return df.checkpoint()


def levels(game: Mnk, seeds: DataFrame, known: DataFrame | None = None) -> list[DataFrame]:
    """States at each distance from the seeds, for a board game: a state has one distance only. Known ones are left out.

    A move fills a cell, so there are as many levels as cells and one more; none is counted to tell the last.
    """
    new = lambda df: df if known is None else df.join(known.select("state"), "state", "left_anti")
    out = [cut(new(seeds.select("state").distinct()))]
    while len(out) <= game.cells:
        own = [out[-1]]
        for _ in range(min(AT_ONCE, game.cells + 1 - len(out))):
            own.append(new(game.expanded(own[-1]).select(F.col("child").alias("state")).distinct()))
        out += tagged(own[1:])[1]
    return out


def tagged(parts: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Several tables that follow from each other, computed and cut as one: their union, and each of them."""
    whole = cut(union([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]))
    return whole.drop("_part"), [whole.where(F.col("_part") == i).drop("_part") for i in range(len(parts))]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unseen(fresh: DataFrame, found: list[DataFrame], key: str) -> DataFrame:
    """The keys of ``fresh`` that none of ``found`` has."""
    marked = union([fresh.select(key, F.lit(True).alias("new")), *(f.select(key, F.lit(False).alias("new")) for f in found)])
    return marked.groupBy(key).agg(F.min("new").alias("new")).where("new").select(key)


def reachable(game: Game, seeds: DataFrame) -> DataFrame:
    """All states that play from the seeds can meet, each once; the game need not be graded."""
    found = [cut(seeds.select("state").distinct())]
    while not found[-1].isEmpty():
        fresh = game.expanded(found[-1]).select(F.col("child").alias("state")).distinct()
        found.append(cut(unseen(fresh, found, "state")))
    return cut(union(found))


def terminal(game: Game, states: DataFrame) -> DataFrame:
    """Solutions of the sinks among ``states``."""
    sinks = states.where(game.is_sink(F.col("state")))
    return sinks.select("state", F.lit(0).cast("long").alias("remoteness"), game.turn(F.col("state")).cast("long").alias("player"), game.utility(F.col("state")).alias("utility"))


def best_children(moves: DataFrame, solved: DataFrame, player) -> DataFrame:
    """Solutions of the states of ``moves(state, child, ord)`` from those of their children."""
    child = solved.select(F.col("state").alias("child"), "remoteness", "utility")
    found = moves.join(child, "child").withColumn("player", player)
    value = F.element_at("utility", (F.col("player") + 1).cast("int"))
    best = F.min_by(F.struct("remoteness", "utility"), F.struct((-value).alias("v"), F.col("remoteness").alias("r"), F.col("ord").alias("o")))
    return found.groupBy("state", "player").agg(best.alias("best")).select("state", (F.col("best.remoteness") + 1).alias("remoteness"), "player", F.col("best.utility").alias("utility"))


def by_levels(game: Mnk, seeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Solutions of all states that a board game reaches from the seeds; lineage is cut every few levels.

    Known solutions ``(state, remoteness, utility)`` aren't solved again and don't come out.
    """
    found = levels(game, seeds, known)[::-1]
    parts: list[DataFrame] = []
    wholes: list[DataFrame] = []
    for at in range(0, len(found), AT_ONCE):
        own: list[DataFrame] = []
        for level in found[at : at + AT_ONCE]:
            new = terminal(game, level)
            solved = (own or parts)[-1] if own or parts else None
            if solved is not None:
                below = solved if known is None else solved.select(*known.columns).unionByName(known)
                new = new.unionByName(best_children(game.expanded(level), below, game.turn(F.col("state")).cast("long")))
            own.append(new)
        whole, each = tagged(own)
        wholes.append(whole)
        parts += each
    return union(wholes)


def peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Solves an explicit graph of ``nodes(id, turn, utility)`` and ``edges(src, dst, ord)`` without cycles.

    In each round every node whose children are all solved is solved. ``utility`` is null but for
    terminal nodes. A round without progress is a cycle.
    """
    solved = cut(nodes.where("utility is not null").select(F.col("id").alias("state"), F.lit(0).cast("long").alias("remoteness"), F.col("turn").alias("player"), "utility"))
    left = cut(nodes.where("utility is null").select(F.col("id").alias("state"), "turn"))
    while not left.isEmpty():
        moves = edges.select(F.col("src").alias("state"), F.col("dst").alias("child"), "ord").join(left, "state")
        ready = moves.join(solved.select(F.col("state").alias("child"), F.lit(1).alias("ok")), "child", "left").groupBy("state").agg(F.count("*").alias("n"), F.count("ok").alias("k")).where("n = k")
        new = cut(best_children(moves.join(ready, "state", "left_semi"), solved, F.col("turn")))
        if new.isEmpty():
            raise SolverViolation("the graph has a cycle, or a node without a way on: some nodes wait for each other")
        solved = cut(solved.unionByName(new))
        left = cut(left.join(new, "state", "left_anti"))
    return solved


def solution(spark: SparkSession, game: Game, seeds: DataFrame | None = None, start: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(state, remoteness, player, utility)`` of all states reachable from the game's start, another, or many.

    ``known(state, remoteness, utility)`` are solutions that a board game doesn't solve again; they don't come out.
    """
    if isinstance(game, ZeroBy) and seeds is None:
        return solve_zero_by(spark, game, start)
    if seeds is None:
        seeds = game.seed(spark) if start is None else spark.range(1).select(F.lit(start).cast("long").alias("state"))
    if isinstance(game, Mnk):
        return by_levels(game, seeds, known=known)
    found = cut(reachable(game, seeds))
    nodes = found.select(F.col("state").alias("id"), game.turn(F.col("state")).cast("long").alias("turn"), F.when(game.is_sink(F.col("state")), game.utility(F.col("state"))).alias("utility"))
    edges = game.expanded(found).select(F.col("state").alias("src"), F.col("child").alias("dst"), "ord")
    return peel(nodes, edges)


def flat(game: Game, solved: DataFrame) -> DataFrame:
    """The table as stored: key, remoteness, player, the game's features, then a utility for each player."""
    features = [c.alias(n) for n, c in game.feature_columns(F.col("state")).items()]
    return solved.select("state", "remoteness", "player", *features, *(F.col("utility")[i].alias(f"utility_{i}") for i in range(game.players)))
