"""Solutions as Parquet: a folder for each game and variant, replaced as a whole."""

from __future__ import annotations

import uuid
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IOMode(Enum):
    """constructive: keep what is stored and add; overwrite: begin anew; forgetful: store nothing."""

    CONSTRUCTIVE = "constructive"
    OVERWRITE = "overwrite"
    FORGETFUL = "forgetful"


def upserted(old: DataFrame, new: DataFrame, key: str = "state") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Store:
    """Tables under ``root/game=<name>/variant=<text>``; variants are told apart by their raw text."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, game: str, variant: str) -> str:
        return f"{self.root}/game={game}/variant={variant}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, game: str, variant: str) -> bool:
        """Whether there is a table; one whose replacement broke off between its two renames is put back first."""
        fs, p = self._fs(self.path(game, variant))
        _, old = self._fs(self.replaced(game, variant))
        if not fs.exists(p) and fs.exists(old):
            fs.rename(old, p)
        return fs.exists(p)

    def replaced(self, game: str, variant: str) -> str:
        return f"{self.root}/_replaced/game={game}/variant={variant}"

    def read(self, game: str, variant: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(game, variant)) if self.exists(game, variant) else None

    def drop(self, game: str, variant: str) -> None:
        """Deletes a table, and what a replacement that broke off has left of it."""
        for path in (self.replaced(game, variant), self.path(game, variant)):
            fs, p = self._fs(path)
            fs.delete(p, True)

    def replace(self, game: str, variant: str, rows: DataFrame) -> DataFrame:
        """Writes beside the table and swaps by renaming: a failed write leaves the old one, and so does a crash at any point."""
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        target = self.path(game, variant)
        fs, s = self._fs(staged)
        _, t = self._fs(target)
        _, old = self._fs(self.replaced(game, variant))
        fs.mkdirs(t.getParent())
        fs.mkdirs(old.getParent())
        if self.exists(game, variant):
            fs.delete(old, True)  # left by a crash after both renames
            fs.rename(t, old)
        if not fs.rename(s, t):
            raise OSError(f"{staged} can't be renamed to {target}")
        fs.delete(old, True)
        return self.spark.read.parquet(target)

    def upsert(self, game: str, variant: str, rows: DataFrame, key: str = "state") -> DataFrame:
        old = self.read(game, variant)
        return self.replace(game, variant, rows if old is None else upserted(old, rows, key))

    def lookup(self, game: str, variant: str, keys: DataFrame, key: str = "state") -> DataFrame:
        """Each key with its row, nulls where there is none."""
        return keys.join(self.read(game, variant), key, "left")


def point(table: DataFrame, state: int) -> DataFrame:
    """The row of one state, by a filter that reaches the Parquet scan."""
    return table.where(F.col("state") == F.lit(state).cast("long"))
