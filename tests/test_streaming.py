from plyframe.operators import solve
from plyframe.operators.zero_by import ZeroBy
from plyframe.streaming import lookup


def test_positions_are_looked_up_as_they_come(spark, tmp_path):
    g = ZeroBy()
    table = solve.flat(g, solve.solution(spark, g))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("10-0\nnonsense\n3-1\n10-1\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    query = lookup.solved(lookup.decoded(stream, g), table).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.text: (r.error is None, r.remoteness) for r in spark.table("found").collect()}
    assert got == {"10-0": (True, 7), "nonsense": (False, None), "3-1": (True, 2), "10-1": (True, None)}
