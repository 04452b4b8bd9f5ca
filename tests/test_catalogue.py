"""Every game query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from plyframe.operators import history
from plyframe.operators.mnk import Mnk
from plyframe.plans import catalogue

SF = os.environ.get("PLYFRAME_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    want_columns, want_rows = [d[0] for d in result.description], result.fetchall()
    columns = sorted(df.columns)
    assert sorted(want_columns) == columns
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r[want_columns.index(c)] for c in columns) for r in want_rows), key=key)
    assert len(got) == len(want) and got == want


def test_moves_on_a_full_board(spark, duck, tmp_path):
    drawn, won_last = [0, 1, 2, 4, 3, 5, 7, 6, 8], [0, 3, 1, 4, 5, 7, 6, 8, 2]
    games = [drawn, [*drawn, 4], [*drawn, 0, 1, 2], won_last, [*won_last, 4], [0, 3, 1, 4, 2, 5], [0, 3, 1, 4, 2, 0], [0, 0], [8]]
    moves = ", ".join(f"({u}, {9 * u + c}, {k})" for u, game in enumerate(games) for k, c in enumerate(game))
    duck.execute(f"""COPY (SELECT (1000 * u + nth)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(nth // 2) AS ts, u::BIGINT AS user_id, '{{"k": ' || k || '}}' AS props FROM (VALUES {moves}) AS t(u, k, nth)) TO '{tmp_path}/events.parquet'""")
    sql = catalogue.ORACLES["mnk_history_valid"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    want = sorted(duck.execute(f"SELECT history_id, valid, error_line, error FROM ({sql})").fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["mnk_history_valid"](spark, str(tmp_path)).select("history_id", "valid", "error_line", "error").collect()) == want
    assert [(r[2], r[3]) for r in want] == [(None, None), (10, "illegal move"), (10, "illegal move"), (None, None), (10, "play after the end"), (6, "play after the end"), (6, "play after the end"), (2, "illegal move"), (None, None)]
    board = lambda moved: "[[" + "], [".join(", ".join("XO"[moved.index(c) % 2] if c in moved else "_" for c in range(r, r + 3)) for r in (0, 3, 6)) + "]]"
    lines = spark.createDataFrame([(1, k, board(drawn[:k])) for k in range(10)] + [(1, 10, board(drawn))], "history_id int, line bigint, text string")
    assert [(r.error_line, r.error) for r in history.verified(lines, Mnk()).collect()] == [(10, "play after the end")]
