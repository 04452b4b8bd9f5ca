"""Variants, codecs, features and solutions against fixed tables and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plyframe import info
from plyframe.cli import main
from plyframe.engine import Engine
from plyframe.errors import InvalidConversion, InvalidGraph, InvalidHistory, SchemaError, SolverViolation, VariantMalformed
from plyframe.functions.bits import bit_width
from plyframe.functions.names import first_duplicate, identifier, to_simple
from plyframe.operators import graph, history, solve
from plyframe.operators.mnk import Mnk
from plyframe.operators.zero_by import ZeroBy, solve_all
from plyframe.plans import variants
from plyframe.plans.variants import Layout


def test_variants():
    rng = random.Random(41)
    for _ in range(20):
        t = "-".join(str(rng.randrange(1, 300)) for _ in range(rng.randrange(3, 7)))
        assert variants.zero_by(t).text == t
        for bad in (t + "-", "-" + t, t.replace("-", "--", 1), t + "-0", "0-" + t, t.replace("-", "+", 1), t + "-x", " ".join(t.split("-")), "-".join(t.split("-")[:2]), "", t.replace(t[0], "٣", 1)):
            with pytest.raises(VariantMalformed):
                variants.zero_by(bad)
    with pytest.raises(VariantMalformed):
        variants.zero_by(f"3-{2**63}-1")
    for m, n, k in itertools.product(range(1, 6), range(1, 6), range(1, 4)):
        assert (variants.mnk(f"{m}-{n}-{k}").m, variants.mnk(f"{m}-{n}-{k}").n) == (m, n)
    for t in ("3-3", "3-3-3-3", "0-3-3", "3-0-3", "3-3-0", "a-b-c", "3-3-", "6-6-3", "31-1-1", "1-32-1", ""):
        with pytest.raises(VariantMalformed):
            variants.mnk(t)
    assert variants.zero_by().text == "2-10-1-2" and variants.mnk().text == "3-3-3"


def test_small_functions(spark):
    assert [bit_width(v) for v in (0, 1, 6, 0x29, 255, 0xFDE0)] == [0, 1, 3, 6, 8, 16]
    assert identifier("zero-by 2-10") == "zero_by_2_10" and identifier("2x") == "_x"
    assert first_duplicate([3, 1, 3, 1]) == 3 and first_duplicate([1, 2]) is None
    assert to_simple(-1) == -1
    with pytest.raises(InvalidConversion):
        to_simple(2)
    assert Layout(2, "state", [("remoteness", "bigint")]).build().names == ["state", "remoteness", "utility_0", "utility_1"]
    for bad in (Layout(None, "k"), Layout(2, None), Layout(2, "k", [("a", "bigint"), ("a", "bigint")]), Layout(2, "k", [("k", "bigint")])):
        with pytest.raises(SchemaError):
            bad.build()


def decoded(spark, game, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.d for r in df.select("i", game.decode(F.col("t")).alias("d")).orderBy("i").collect()]


def test_zero_by_codec(spark):
    g = ZeroBy()
    good = [f"{e}-{t}" for e in (0, 4, 7, 10) for t in (0, 1)] + ["0004-001"]
    assert all(d.error is None for d in decoded(spark, g, good))
    assert all(d.error and d.state is None for d in decoded(spark, g, ["11-0", "4-2", "-4-0", "4-", "-1", "4", "4-0-0", "4 - 0", "x-0", None, "", "8" * 30 + "-0", "1-" + "8" * 30]))
    for v, top, players in (("6-90-2-7", 90, 6), ("11-40-1", 40, 11), ("1-255-3", 255, 1)):
        rows = decoded(spark, ZeroBy(v), [f"{top}-{players - 1}", f"{top + 1}-0", f"{top}-{players}"])
        assert [d.error for d in rows] == [None, "too many elements", "no such player"]
    back = spark.createDataFrame([(d.state,) for d in decoded(spark, g, good[:8])], "s bigint").select(g.encode(F.col("s"))).collect()
    assert [r[0] for r in back] == good[:8]
    assert ZeroBy("3-10-1-2").packed(8, 2) == -9223372036854775800 and ZeroBy("3-10-1-2").packed(9, 1) == 4611686018427387913


def test_mnk_codec(spark):
    g = Mnk()
    good = [info.GAMES["mnk"]["state-default"], " [[X,O ,\tX],[_, _, _],\n[O, O, X]] ", "[[X, X, X], [X, X, X], [X, X, X]]"]
    assert all(d.error is None for d in decoded(spark, g, good))
    full = "[[X, O, _], [_, X, O], [O, _, X]]"
    bad = [full.replace("O", "", 1), full.replace("O", "0", 1), full.replace(", O]", "]", 1), full.replace("_]", "_, _]", 1), full[:-1] + ", [_, _, _]]", full[:-1], full[1:], full.replace("], [", " ", 1), "[[X], [O, _, _, X, O], [O, _, X]]", None, ""]
    assert all(d.error and d.state is None for d in decoded(spark, g, bad))
    wide = Mnk("2-3-2")
    d = decoded(spark, wide, ["[[X, O, _], [_, X, O]]"])[0]
    assert spark.createDataFrame([(d.state,)], "s bigint").select(wide.encode(F.col("s"))).first()[0] == "[[X, O, _], [_, X, O]]"


def solved(spark, g):
    return solve.flat(g, solve.solution(spark, g)).toPandas()


def test_zero_by_two_players_complete(spark):
    g = ZeroBy()
    r = {(x.state & (1 << 62) - 1, x.player): x for x in solved(spark, g).itertuples()}
    remote, value = [0, 1, 2, 2, 3, 4, 4, 5, 6, 6, 7], [1, -1, 1, 1, -1, 1, 1, -1, 1, 1, -1]
    assert set(r) == {(e, t) for e in range(11) for t in (0, 1)} - {(9, 0), (10, 1)}
    for (e, t), x in r.items():
        assert x.remoteness == remote[e] and (x.utility_0, x.utility_1)[t] == value[e] == -(x.utility_0, x.utility_1)[1 - t]


@pytest.mark.parametrize("variant,rows,most,total,wins", [("3-10-1-2", 27, 6, 72, [10, 10, 7]), ("1-10-1-2", 11, 5, 30, [11]), ("2-11-3-5-7-11", 10, 2, 12, [3, 7]), ("2-50-1-2", 100, 34, 1667, [51, 49]), ("4-100-1-2", 392, 57, 10925, [95, 99, 100, 98]), ("8-200-30-70-15-1", 1308, 3, 2235, [164, 163, 162, 162, 163, 164, 166, 164])])
def test_zero_by_fixed_tables(spark, variant, rows, most, total, wins):
    r = solved(spark, ZeroBy(variant))
    assert (len(r), r.remoteness.max(), r.remoteness.sum()) == (rows, most, total)
    assert [(r[f"utility_{i}"] == 1).sum() for i in range(len(wins))] == wins


def test_fold_equals_peeling(spark):
    g = ZeroBy("3-12-1-2-5")
    found = solve.reachable(g, g.seed(spark))
    nodes = found.select(F.col("state").alias("id"), g.turn(F.col("state")).cast("long").alias("turn"), F.when(g.is_sink(F.col("state")), g.utility(F.col("state"))).alias("utility"))
    edges = g.expanded(found).select(F.col("state").alias("src"), F.col("child").alias("dst"), "ord")
    rows = lambda df: sorted((r.state, r.remoteness, r.player, tuple(r.utility)) for r in df.collect())
    assert rows(solve.peel(nodes, edges)) == rows(solve.solution(spark, g))
    assert solve_all(spark, ["2-10-1-2", "3-10-1-2", "2-10-1-2"]).groupBy("variant").count().collect().__len__() == 2
    assert ZeroBy("12-30-1-2").players == 12 and solve.solution(spark, ZeroBy("12-30-1-2")).count() > 0


GOLD = {
    "3-3-3": dict(rows=5478, sinks=958, root=(9, 0, 0), u1=(2544, 1460, 1474), orbits=765, fork=(2014, 3464), centre=(1492, 2043, 1943), corner=-1364, edge=-924, ply=[1, 9, 72, 252, 756, 1260, 1520, 1140, 390, 78], rem=[958, 2438, 808, 654, 288, 160, 138, 24, 9, 1]),
    "2-2-2": dict(rows=29, sinks=12, root=(3, -1, 1), u1=(29, 0, 0), orbits=6, fork=(5, 24), centre=(0, 29, 0), corner=-16, edge=0, ply=[1, 4, 12, 12], rem=[12, 12, 4, 1]),
    "3-2-2": dict(rows=129, sinks=72, root=(3, -1, 1), u1=(93, 0, 36), orbits=65, fork=(97, 32), centre=(0, 129, 0), corner=-20, edge=-54, ply=[1, 6, 30, 60, 24, 8], rem=[72, 50, 6, 1]),
}


@pytest.mark.parametrize("variant", GOLD)
def test_mnk_fixed_tables(spark, variant):
    want, r = GOLD[variant], solved(spark, Mnk(variant))
    root = r[r.state == -(1 << 63)].iloc[0]
    assert (len(r), (r.remoteness == 0).sum(), r.orbit_rep.nunique()) == (want["rows"], want["sinks"], want["orbits"])
    assert (root.remoteness, root.utility_0, root.utility_1) == want["root"]
    count = lambda c, vs: tuple((r[c] == v).sum() for v in vs)
    assert count("utility_1", (1, 0, -1)) == want["u1"] and count("fork_exists", (1, -1)) == want["fork"] and count("center_control", (1, 0, -1)) == want["centre"]
    assert (r.corner_count.sum(), r.edge_count.sum()) == (want["corner"], want["edge"])
    assert r.groupby("ply").size().tolist() == want["ply"] and r.groupby("remoteness").size().tolist() == want["rem"]
    assert r.state.is_unique and (r.utility_0 == -r.utility_1).all()
    if variant == "3-3-3":
        first = r.sort_values("state").head(3).values.tolist()
        assert first == [[-9223372036854775808, 9, 1, -9223372036854775808, -1, 0, 0, 0, 0, 0, 0], [-9223160930622242816, 7, 1, -9223160930622242816, -1, 2, 0, -1, 1, 0, 0], [-9223055377505976320, 3, 1, -9223055377505976320, -1, 2, 0, 1, -1, -1, 1]]


def brute_fork(m, n, k, cells, mover):
    def line(held):
        return {tuple(run) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)) for i in range(m) for j in range(n) for run in [[(i + a * s, j + b * s) for s in range(k)]] if all(p in held for p in run)}

    mine = {(c // n, c % n) for c in range(m * n) if cells[c] == mover}
    blank = [(c // n, c % n) for c in range(m * n) if cells[c] == 0]
    for a in blank:
        held = mine | {a}
        if sum(any(c in run for run in line(held | {c})) for c in blank if c != a) >= 2:
            return 1
    return -1


def test_features_on_other_boards(spark):
    rng = random.Random(3)
    for variant in ("3-4-3", "4-3-2", "1-5-2", "2-3-4"):
        g = Mnk(variant)
        boards = [[rng.choice([0, 0, 1, 2]) for _ in range(g.cells)] for _ in range(40)]
        rows = [(i, bool(i % 2), *b) for i, b in enumerate(boards)]
        names = [f"c{i}" for i in range(g.cells)]
        df = spark.createDataFrame(rows, ["i", "x", *names]).select("i", g.pack([F.col(c) for c in names], F.col("x")).alias("state"))
        got = {r.i: r for r in df.select("i", "state", g.fork_exists(F.col("state")).alias("fork"), g.orbit(F.col("state")).alias("orbit"), g.encode(F.col("state")).alias("text")).collect()}
        for i, b in enumerate(boards):
            assert got[i].fork == brute_fork(g.m, g.n, g.k, b, 1 if i % 2 else 2), (variant, b)
            grid = [b[r * g.n : (r + 1) * g.n] for r in range(g.m)]
            assert len(got[i].orbit) == len({str(grid), str([r[::-1] for r in grid])})
    assert len(Mnk("3-4-3", full_group=True).images()) == 4


def test_full_board_flag(spark):
    line = decoded(spark, Mnk(), ["[[X, X, X], [O, O, X], [X, O, O]]"])[0].state
    df = spark.createDataFrame([(line,)], "s bigint")
    value = lambda g: df.select(g.utility(F.col("s"))).first()[0]
    assert value(Mnk()) == [0, 0] and value(Mnk(full_board_is_tie=False)) == [-1, 1]


def verify(spark, game, histories):
    rows = [(i, k, t) for i, h in enumerate(histories) for k, t in enumerate(h)]
    return {r.history_id: r for r in history.verified(spark.createDataFrame(rows, "history_id int, line bigint, text string"), game).collect()}


def test_histories(spark):
    def play(rng, variant, upto):
        g = variants.zero_by(variant)
        e, out = g.start, []
        for k in range(upto):
            out.append(f"{e}-{k % g.players}")
            if not e:
                break
            e = max(0, e - rng.choice(list(g.choices)))
        return out

    rng = random.Random(43)
    good = [play(rng, "2-10-1-2", 30), ["", "10-0", " "], play(rng, "2-10-1-2", 3)]
    whole = good[0]
    bad = [["10-0", "7-1"], ["10-0", "8-0"], ["9-1", "8-0"], ["0-1"], ["10-0", "?"], [""], [*whole, whole[-1]], [whole[0], "", whole[2]]]
    r = verify(spark, ZeroBy(), good + bad)
    assert [r[i].valid for i in range(11)] == [True] * 3 + [False] * 8
    assert (r[0].state & (1 << 62) - 1, r[3].error, r[3].error_line, r[5].error, r[7].error, r[8].error, r[9].error) == (0, "illegal move", 1, "wrong start", "malformed: not elements-turn", "empty history", "play after the end")
    assert (r[10].error, r[10].error_line) == ("illegal move", 2)
    v = "5-60-13-4-1"
    good = [play(rng, v, n) for n in (1, 4, 99, 99)]
    bad = [good[2][:2] + good[2][3:], good[2][1:], [*good[3], "0-0"]]
    r = verify(spark, ZeroBy(v), good + bad)
    assert [r[i].valid for i in range(7)] == [True] * 4 + [False] * 3
    m = ["[[_, _, _], [_, _, _], [_, _, _]]", "[[X, _, _], [_, _, _], [_, _, _]]", "[[X, _, _], [_, O, _], [_, _, _]]"]
    r = verify(spark, Mnk(), [m, [m[0], m[2]], m[1:]])
    assert [r[i].valid for i in range(3)] == [True, False, False]


def test_engine_modes_and_forwarding(spark, tmp_path, capsys):
    e = Engine(spark, str(tmp_path / "store"))
    lines = lambda *t: spark.createDataFrame(list(enumerate(t)), "line bigint, text string")
    part = e.build("zero-by", history=lines("10-0", "8-1")).count()
    assert part < 20 and e.build("zero-by", mode="forgetful").count() == 20 and e.store.read("zero-by", "2-10-1-2").count() == part
    assert e.build("zero-by").count() == 20 and e.build("zero-by", mode="overwrite", history=lines("10-0", "8-1")).count() == part
    with pytest.raises(InvalidHistory):
        e.build("zero-by", history=lines("10-0", "5-1"))
    full = e.build("mnk", "2-2-2", mode="forgetful")
    assert full.count() == 29 and not e.store.exists("mnk", "2-2-2")
    later = e.build("mnk", "2-2-2", history=lines("[[_, _], [_, _]]", "[[X, _], [_, _]]"))
    assert later.count() == 1 + 3 + 6 and later.where("ply = 0").count() == 0
    many = spark.createDataFrame([(7, 0, "10-0"), (7, 1, "9-1"), (8, 0, "10-0"), (8, 1, "8-1")], "history_id int, line int, text string")
    assert e.build("zero-by", mode="forgetful", history=many).count() >= part
    keys = spark.createDataFrame([(e.game("zero-by").start,), (12345,)], "state bigint")
    e.build("zero-by", mode="overwrite")
    assert sorted((r.remoteness is None, r.remoteness or 0) for r in e.lookup("zero-by", "2-10-1-2", keys).collect()) == [(False, 7), (True, 0)]
    with pytest.raises(ValueError):
        e.build("chess")
    assert e.info("mnk", ["name", "variant-default"], "json") == '{"name":"mnk","variant-default":"3-3-3"}'
    assert e.info("mnk", ["name"]) == "\tname:\nmnk\n\n"
    with pytest.raises(ValueError):
        e.info("mnk", ["name", "name"])
    root = ["--root", str(tmp_path / "cli")]
    assert main([*root, "build", "zero-by", "--forward"], spark, ["10-0\n", "9-1\n"]) == 0 and main([*root, "info", "mnk", "--output", "json"], spark) == 0
    capsys.readouterr()
    assert main([*root, "--quiet", "build", "zero-by", "--variant", "x"], spark) == 64 and capsys.readouterr().err == ""


def test_graph_builder(spark):
    t, m = graph.node(1, 1, 2, 3), graph.node(0)
    g = graph.GraphBuilder("g").edge(m, t).edge(m, t).source(m).build()
    assert g.players == 3 and len(g.edge_rows) == 1 and "0 -> 1" in g.dot()
    assert (g.state(m), g.state(t), g.state(graph.node(0))) == (0, 1, None)
    assert [tuple(r) for r in g.incoming(spark, spark.createDataFrame([(0,), (1,)], "state bigint")).collect()] == [(1, 0)]
    B = graph.GraphBuilder
    faults = [
        lambda: B("no source").edge(m, t).build(),
        lambda: B("other size").edge(m, t).edge(m, graph.node(0, 1, 2)).source(m).build(),
        lambda: B("empty").edge(m, graph.Node(0, ())).source(m).build(),
        lambda: B("turn").edge(m, graph.node(3, 1, 2, 3)).source(m).build(),
        lambda: B("medial turn").edge(m, t).edge(graph.node(5), t).source(m).build(),
        lambda: B("from terminal").edge(t, m),
        lambda: B("trap").edge(m, t).edge(m, graph.node(1)).source(m).build(),
        lambda: B("unknown").source(m),
    ]
    a, b = graph.node(0), graph.node(1)
    faults.append(lambda: B("no end").edge(a, b).edge(b, a).source(a).build())
    for f in faults:
        with pytest.raises(InvalidGraph):
            f()
    cyclic = B("cycle").edge(a, b).edge(b, a).edge(b, graph.node(0, 1, -1)).source(a).build()
    with pytest.raises(SolverViolation):
        cyclic.solve(spark)


def test_invariants_of_a_wider_board(spark):
    g = Mnk("2-4-3")
    r = {x.state: x for x in solved(spark, g).itertuples()}
    edges = g.expanded(spark.createDataFrame([(s,) for s in r], "state bigint")).collect()
    for state, group in itertools.groupby(sorted(edges, key=lambda e: e.state), key=lambda e: e.state):
        x, kids = r[state], [(r[e.child], e.ord) for e in group]
        value = lambda c: (c.utility_0, c.utility_1)[x.player]  # noqa: B023, E731
        best = min(kids, key=lambda c: (-value(c[0]), c[0].remoteness, c[1]))[0]
        assert x.remoteness == best.remoteness + 1 and x.utility_0 == best.utility_0


def test_what_is_stored_is_not_solved_again(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    g = e.game("mnk", "2-3-2")
    whole = solve.flat(g, solve.solution(spark, g))
    later = whole.where("ply >= 2")
    # Stored values that nobody would compute show that they are taken as they are.
    e.store.replace("mnk", "2-3-2", later.withColumn("remoteness", F.col("remoteness") + 100))
    known = e.store.read("mnk", "2-3-2").select("state", "remoteness", F.array("utility_0", "utility_1").alias("utility"))
    new = solve.solution(spark, g, known=known)
    assert new.count() == 1 + 6
    built = e.build("mnk", "2-3-2")
    assert built.count() == whole.count() and built.where("ply = 0").first().remoteness > 100 and e.build("mnk", "2-3-2", mode="overwrite").where("ply = 0").first().remoteness < 10


def test_a_replacement_that_breaks_off_loses_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.build("zero-by")
    fs, target = e.store._fs(e.store.path("zero-by", "2-10-1-2"))
    old = e.store._fs(e.store.replaced("zero-by", "2-10-1-2"))[1]
    fs.mkdirs(old.getParent())
    assert fs.rename(target, old)  # a crash between the two renames
    assert e.store.read("zero-by", "2-10-1-2").count() == 20
    assert e.build("zero-by", mode="overwrite").count() == 20 and not fs.exists(old)


def test_a_dropped_table_stays_away(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.drop("zero-by")
    e.build("zero-by")
    fs, target = e.store._fs(e.store.path("zero-by", "2-10-1-2"))
    old = e.store._fs(e.store.replaced("zero-by", "2-10-1-2"))[1]
    fs.mkdirs(old.getParent())
    assert fs.rename(target, old)  # a crash between the two renames of a replacement
    e.drop("zero-by")
    assert e.store.read("zero-by", "2-10-1-2") is None and e.build("zero-by").count() == 20
