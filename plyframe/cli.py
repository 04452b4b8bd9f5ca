"""``python -m plyframe.cli build|info``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from plyframe.engine import GAMES, Engine
from plyframe.errors import PlyframeError
from plyframe.info import Attribute, Format
from plyframe.sources.store import IOMode


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plyframe")
    out.add_argument("--quiet", action="store_true", help="say nothing when something fails")
    out.add_argument("--root", default="plyframe-data", help="folder of the solutions")
    todo = out.add_subparsers(dest="command", required=True)
    build = todo.add_parser("build", help="solve a game")
    build.add_argument("target", choices=list(GAMES))
    build.add_argument("--variant")
    build.add_argument("--mode", choices=[m.value for m in IOMode], default="constructive")
    build.add_argument("--forward", action="store_true", help="start where the history on standard input leads")
    about = todo.add_parser("info", help="describe a game")
    about.add_argument("target", choices=list(GAMES))
    about.add_argument("--attributes", type=lambda s: [Attribute(a).value for a in s.split(",")])
    about.add_argument("--output", choices=[f.value for f in Format], default="legible")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, lines=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plyframe").getOrCreate()
    engine = Engine(spark, args.root)
    try:
        if args.command == "info":
            print(engine.info(args.target, args.attributes, args.output))
        else:
            history = None
            if args.forward:
                said = [(i, t.rstrip("\n")) for i, t in enumerate(sys.stdin if lines is None else lines)]
                history = spark.createDataFrame(said or [(0, "")], "line bigint, text string")
            print(engine.build(args.target, args.variant, args.mode, history).count(), "states")
    except PlyframeError as e:
        if not args.quiet:
            print(f"error: {e}", file=sys.stderr)
        return 64
    return 0


if __name__ == "__main__":
    sys.exit(main())
