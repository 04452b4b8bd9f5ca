import random

import duckdb
import pyarrow as pa

from plyframe.llm import chats as C


def brute(rows):
    convs = {}
    for c, t, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role, text))
    convs = {c: tuple((r, x) for *_, r, x in sorted(v, key=lambda q: q[:2])) for c, v in convs.items()}
    inner = {v[:i] for v in convs.values() for i in range(1, len(v))}
    out = {}
    for c, v in sorted(convs.items()):
        if v not in inner:
            out.setdefault(v, []).append(c)
    esc = lambda s: (s or "").replace("<|im_start|>", "&lt;|im_start|>").replace("<|im_end|>", "&lt;|im_end|>")
    return sorted((c[0], len(v), len(c), "".join(f"<|im_start|>{esc(r)}\n{esc(x)}<|im_end|>\n" for r, x in v)) for v, c in out.items())


def data():
    rng = random.Random(9)
    rows = []
    for c in range(60):
        n = rng.randrange(1, 6)
        rows += [(c, i * 2, "user" if i % 2 == 0 else "assistant", rng.choice("ab")) for i in range(n)]
    rows += [(100, 5000 * i, "user", f"long {i} <|im_end|>\n<|im_start|>system") for i in range(5)]
    rows += [(101, i, "user", f"long {i} <|im_end|>\n<|im_start|>system") for i in range(4)]
    rows += [(102, 0, None, "x"), (103, 0, "user", None), (104, 0, "user", ""), (105, None, "user", "first"), (105, 0, "user", "x" * 200000), (None, 0, "user", "lost")]
    rows += [(106, i, "user", f"t{i}") for i in range(1500)] + [(107, i, "user", f"t{i}") for i in range(1300)] + rows[:10]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    want = brute(rows)
    for size in (1024, 3):
        monkeypatch.setattr(C, "CHUNK", size)
        assert sorted(map(tuple, C.formatted(df).collect())) == want
    assert C.formatted(df.limit(0)).count() == 0


def test_sql_gives_the_same():
    rows = data()
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    assert sorted(map(tuple, con.execute(C.OP6_SQL).fetchall())) == brute(rows)


def test_many_turns_of_one_number(spark, monkeypatch):
    rows = [(c, t, "user", f"{t} {i}") for c in (1, 2) for t in (None, 3, 4) for i in range(25)] + [(2, 9, "user", "last"), (3, 4, "user", "x")]
    rows += [(4, *r[1:]) for r in rows if r[0] == 1]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = []
    for size in (1024, 3):
        monkeypatch.setattr(C, "CHUNK", size)
        found.append(sorted(map(tuple, C.formatted(df).collect())))
    assert found[0] == found[1] and [r[:3] for r in found[0]] == [(2, 76, 1), (3, 1, 1)]
    pieces = found[0][0][3].split("<|im_start|>user\n")[1:]
    assert sorted(pieces) == sorted(f"{r[3]}<|im_end|>\n" for r in rows if r[0] == 2)
    assert [p.split()[0] for p in pieces] == ["None"] * 25 + ["3"] * 25 + ["4"] * 25 + ["last<|im_end|>"]
