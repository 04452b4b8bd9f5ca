"""What is known about the games themselves."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.names import first_duplicate


class Attribute(Enum):
    NAME = "name"
    AUTHORS = "authors"
    ABOUT = "about"
    VARIANT_PROTOCOL = "variant-protocol"
    VARIANT_PATTERN = "variant-pattern"
    VARIANT_DEFAULT = "variant-default"
    STATE_PROTOCOL = "state-protocol"
    STATE_PATTERN = "state-pattern"
    STATE_DEFAULT = "state-default"


class Format(Enum):
    LEGIBLE = "legible"
    JSON = "json"


GAMES: dict[str, dict[str, str]] = {
    "zero-by": {
        "name": "zero-by",
        "authors": "The plyframe contributors",
        "about": "Players in turn take one of the allowed numbers from a heap of elements; a larger number than is left empties the heap. Whoever has the turn at an empty heap wins.",
        "variant-protocol": "Three or more positive numbers joined by hyphens: how many players, how many elements at the start, and each number that may be taken.",
        "variant-pattern": r"^[1-9]\d*(-[1-9]\d*){2,}$",
        "variant-default": "2-10-1-2",
        "state-protocol": "How many elements are left, a hyphen, and whose turn it is, counted from 0.",
        "state-pattern": r"^\d+-\d+$",
        "state-default": "10-0",
    },
    "mnk": {
        "name": "mnk",
        "authors": "The plyframe contributors",
        "about": "Two players in turn put X and O on a board; X begins. Whoever first has enough of their own in a row, column or diagonal wins, and a full board is a tie.",
        "variant-protocol": "Three positive numbers joined by hyphens: rows, columns, and how many in line win.",
        "variant-pattern": r"^[1-9]\d*(-[1-9]\d*){2}$",
        "variant-default": "3-3-3",
        "state-protocol": "The rows from the top, each in brackets with its cells X, O or _ between commas, all in brackets. X has the turn unless there are more of X than of O.",
        "state-pattern": r"^\s*\[\s*\[\s*[XO_](\s*,\s*[XO_])*\s*\](\s*,\s*\[\s*[XO_](\s*,\s*[XO_])*\s*\])*\s*\]\s*$",
        "state-default": "[[_, _, _], [_, _, _], [_, _, _]]",
    },
}


def rows(spark: SparkSession, game: str, attributes: list[str] | None = None) -> DataFrame:
    """``(attribute, value)`` in the order asked for; all nine by default."""
    wanted = [Attribute(a).value for a in attributes] if attributes else [a.value for a in Attribute]
    if (twice := first_duplicate(wanted)) is not None:
        raise ValueError(f"attribute {twice} is asked for twice")
    return spark.createDataFrame([(a, GAMES[game][a]) for a in wanted], "attribute string, value string")


def formatted(spark: SparkSession, game: str, attributes: list[str] | None = None, output: str = "legible") -> str:
    found = rows(spark, game, attributes)
    if Format(output) is Format.JSON:
        return found.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))))).first()[0]
    return "".join(f"\t{r.attribute}:\n{r.value}\n\n" for r in found.collect())
