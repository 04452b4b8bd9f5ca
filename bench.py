"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and three times more, fully materialised; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plyframe.operators import solve
from plyframe.operators.mnk import Mnk
from plyframe.operators.zero_by import ZeroBy, solve_all
from plyframe.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ZERO_BY = ("2-10000-1-2", "2-10000-3-5-7-11", "4-10000-1-2", "4-10000-3-5-7-11", "2-100000-1-2")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {f"zero_by_{v}": lambda v=v: solve.flat(ZeroBy(v), solve.solution(spark, ZeroBy(v))) for v in ZERO_BY}
    todo["zero_by_all"] = lambda: solve_all(spark, ZERO_BY)
    todo["mnk_3-3-3"] = lambda: solve.flat(Mnk("3-3-3"), solve.solution(spark, Mnk("3-3-3")))
    for name in ("zero_by_lookup_outcomes", "zero_by_history_valid", "zero_by_decode", "mnk_fork", "mnk_orbit_rep", "mnk_history_valid", "store_upsert"):
        todo[name] = lambda f=catalogue.QUERIES[name]: f(spark, SF_DIR)
    seconds = {}
    for name, query in todo.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            query().agg(F.count("*"), F.bit_xor(F.xxhash64("*"))).collect()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "wall seconds, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
