"""mnk: two players fill a board of m rows and n columns; k in line win. Player 1 (X) begins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyframe.functions.bits import TOP, any_of, field, let, mask, total
from plyframe.operators.base import Game
from plyframe.plans import variants

BLANK, X, O = 0, 1, 2  # noqa: E741


class Mnk(Game):
    """A cell's two bits are 0 (blank), 1 (X) or 2 (O), row by row from the bit below the turn's.

    ``full_board_is_tie``: a full board is a tie even if its last move made a line.
    ``full_group``: orbits of boards that aren't square also use the half turn and the vertical mirror.
    """

    name = "mnk"
    players = 2
    features = ("orbit_rep", "fork_exists", "ply", "center_control", "corner_count", "edge_count")
    start = TOP

    def __init__(self, variant: str | None = None, full_board_is_tie: bool = True, full_group: bool = False) -> None:
        self.variant = variants.mnk(variant)
        self.variant_text = self.variant.text
        self.m, self.n, self.k = self.variant.m, self.variant.n, self.variant.k
        self.cells = self.m * self.n
        self.full_board_is_tie, self.full_group = full_board_is_tie, full_group

    # Cells.

    def shift(self, cell: int) -> int:
        return 61 - 2 * cell

    def bits(self, cells: list[int], symbol: int) -> int:
        return sum(symbol << self.shift(c) for c in cells)

    def cell(self, state: Column, c: int) -> Column:
        return field(state, self.shift(c), 2)

    def pack(self, codes: list[Column], x_to_move: Column) -> Column:
        """A board of cell codes, row by row, and whose turn it is."""
        cells = total([F.shiftleft(c.cast("long"), self.shift(i)) for i, c in enumerate(codes)])
        return F.when(x_to_move, cells.bitwiseOR(mask(1 << 63))).otherwise(cells)

    def blank(self, state: Column, c: int) -> Column:
        return state.bitwiseAND(mask(3 << self.shift(c))) == 0

    def lines(self) -> list[list[int]]:
        """Cells of each run of k in a row, column or diagonal; none where k exceeds the side."""
        out = []
        for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
            for i in range(self.m):
                for j in range(self.n):
                    run = [(i + di * s, j + dj * s) for s in range(self.k)]
                    if all(0 <= a < self.m and 0 <= b < self.n for a, b in run):
                        out.append([a * self.n + b for a, b in run])
        return [list(r) for r in dict.fromkeys(tuple(sorted(r)) for r in out)]

    # Rules.

    def turn(self, state: Column) -> Column:
        return F.shiftrightunsigned(state, 63)

    def wins(self, state: Column, symbol: int) -> Column:
        return any_of([state.bitwiseAND(mask(b)) == mask(b) for b in (self.bits(r, symbol) for r in self.lines())])

    def ply(self, state: Column) -> Column:
        return F.bit_count(state.bitwiseAND(mask((1 << 63) - 1))).cast("long")

    def is_full(self, state: Column) -> Column:
        return self.ply(state) == self.cells

    def is_won(self, state: Column) -> Column:
        return self.wins(state, X) | self.wins(state, O)

    def is_sink(self, state: Column) -> Column:
        return self.is_won(state) | self.is_full(state)

    def successors(self, state: Column) -> Column:
        code = F.when(state < 0, F.lit(X)).otherwise(F.lit(O)).cast("long")
        other = state.bitwiseXOR(mask(1 << 63))
        moves = [F.when(self.blank(state, c), F.struct(other.bitwiseOR(F.shiftleft(code, self.shift(c))).alias("child"), F.lit(c).cast("long").alias("ord"))) for c in range(self.cells)]
        return F.array_compact(F.array(*moves))

    def utility(self, state: Column) -> Column:
        x = F.when(self.wins(state, X), 1).when(self.wins(state, O), -1).otherwise(0).cast("long")
        if self.full_board_is_tie:
            x = F.when(self.is_full(state), F.lit(0).cast("long")).otherwise(x)
        return F.array(-x, x)

    # Strings.

    def encode(self, state: Column) -> Column:
        sign = lambda c: F.when(self.cell(state, c) == X, "X").when(self.cell(state, c) == O, "O").otherwise("_")
        rows = [F.concat(F.lit("["), F.concat_ws(", ", *(sign(i * self.n + j) for j in range(self.n))), F.lit("]")) for i in range(self.m)]
        return F.concat(F.lit("["), F.concat_ws(", ", *rows), F.lit("]"))

    def decode(self, text: Column) -> Column:
        row = r"\[\s*[XO_](\s*,\s*[XO_])*\s*\]"
        well = rf"^\s*\[\s*{row}(\s*,\s*{row})*\s*\]\s*$"

        def judged(p: Column) -> Column:
            flat, symbols = p["flat"], p["symbols"]
            error = F.when(p["bad"], F.lit("malformed: not rows of X, O and _")).when(~F.rlike(flat, F.lit(f"^([XO_]{{{self.n}}}\\]){{{self.m}}}\\]$")), F.lit("wrong number of symbols"))
            count = lambda s: F.length(F.regexp_replace(symbols, f"[^{s}]", ""))
            sign = lambda c: F.substring(symbols, c + 1, 1)
            code = lambda c: F.when(sign(c) == "X", mask(X << self.shift(c))).when(sign(c) == "O", mask(O << self.shift(c))).otherwise(mask(0))
            turn = F.when(count("X") <= count("O"), mask(1 << 63)).otherwise(mask(0))
            return let(error, lambda x: F.struct(F.when(x.isNull(), total([code(c) for c in range(self.cells)]).bitwiseOR(turn)).alias("state"), x.alias("error")))

        bad = F.coalesce(~F.rlike(text, F.lit(well)), F.lit(True))
        signs = F.struct(F.regexp_replace(text, r"[^XO_\]]", "").alias("flat"), F.regexp_replace(text, r"[^XO_]", "").alias("symbols"), bad.alias("bad"))
        return let(signs, judged)

    # Features.

    def images(self) -> list[list[int]]:
        """For each symmetry in use, the cell that goes to each cell."""
        at = lambda i, j: i * self.n + j
        m, n = self.m, self.n
        same = [lambda i, j: (i, j), lambda i, j: (i, n - 1 - j)]
        if m == n or self.full_group:
            same += [lambda i, j: (m - 1 - i, j), lambda i, j: (m - 1 - i, n - 1 - j)]
        if m == n:
            same += [lambda i, j: (j, i), lambda i, j: (n - 1 - j, i), lambda i, j: (j, n - 1 - i), lambda i, j: (n - 1 - j, n - 1 - i)]
        found = [tuple(at(*f(i, j)) for i in range(m) for j in range(n)) for f in same]
        return [list(p) for p in dict.fromkeys(found)]

    def orbit(self, state: Column) -> Column:
        """The board's images under symmetry, ascending and distinct."""
        turn = state.bitwiseAND(mask(1 << 63))

        def image(source: list[int]) -> Column:
            out = turn
            for c, s in enumerate(source):
                out = out.bitwiseOR(F.shiftleft(self.cell(state, s), self.shift(c)))
            return out

        return F.array_sort(F.array_distinct(F.array(*(state if p == list(range(self.cells)) else image(p) for p in self.images()))))

    def orbit_rep(self, state: Column) -> Column:
        return F.array_min(self.orbit(state))

    def own(self, state: Column, c: int) -> Column:
        """1 where the mover holds a cell, -1 where the opponent does, else 0."""
        code = self.cell(state, c)
        mover = F.when(state < 0, F.lit(X)).otherwise(F.lit(O))
        return F.when(code == 0, 0).when(code == mover, 1).otherwise(-1).cast("long")

    def fork_exists(self, state: Column) -> Column:
        """1 if some move leaves the mover two or more other blank cells that each complete a line, else -1.

        A cell c is such a threat after move a if some line through c has all its other cells
        held by the mover or equal to a. Tests are on bits in X's places: the mover's cells, the blank
        ones and the threats that stand already.
        """
        lines, every = self.lines(), self.bits(list(range(self.cells)), X)
        bit = lambda c: self.bits([c], X)
        has = lambda held, cells: held.bitwiseAND(mask(self.bits(cells, X))) == mask(self.bits(cells, X))

        def threats(p: Column, ways: list[tuple[int, list[int]]]) -> Column:
            """Blank cells for which the mover holds all cells of one of their ways."""
            by = {c: [w for d, w in ways if d == c] for c in sorted({c for c, _ in ways})}
            return total([F.when((p["blank"].bitwiseAND(mask(bit(c))) != 0) & any_of([has(p["mine"], w) for w in by[c]]), mask(bit(c))).otherwise(mask(0)) for c in by])

        def after(p: Column, a: int) -> Column:
            gained = threats(p, [(c, [x for x in r if x not in (a, c)]) for r in lines if a in r for c in r if c != a])
            left = p["standing"].bitwiseAND(mask(every & ~bit(a)))
            return (p["blank"].bitwiseAND(mask(bit(a))) != 0) & (F.bit_count(left.bitwiseOR(gained)) >= 2)

        x, o = state.bitwiseAND(mask(every)), F.shiftrightunsigned(state, 1).bitwiseAND(mask(every))
        held = F.struct(F.when(state < 0, x).otherwise(o).alias("mine"), x.bitwiseOR(o).bitwiseXOR(mask(every)).alias("blank"))
        standing = lambda p: F.struct(p["mine"].alias("mine"), p["blank"].alias("blank"), threats(p, [(c, [x for x in r if x != c]) for r in lines for c in r]).alias("standing"))
        found = lambda p: F.when(any_of([after(p, a) for a in range(self.cells)]), F.lit(1)).otherwise(F.lit(-1)).cast("long")
        return let(held, lambda p: let(standing(p), found))

    def center_control(self, state: Column) -> Column:
        if self.m % 2 == 0 or self.n % 2 == 0:
            return F.lit(0).cast("long")
        return self.own(state, (self.m // 2) * self.n + self.n // 2)

    def corner_count(self, state: Column) -> Column:
        corners = [0, self.n - 1, (self.m - 1) * self.n, self.cells - 1]
        return total([self.own(state, c) for c in corners])

    def edge_count(self, state: Column) -> Column:
        """Border cells but corners; on a board one cell wide or high each is counted twice."""
        m, n = self.m, self.n
        border = [i * n + j for i in (0, m - 1) for j in range(1, n - 1)] + [i * n + j for j in (0, n - 1) for i in range(1, m - 1)]
        return total([self.own(state, c) for c in border])

    def feature_columns(self, state: Column) -> dict[str, Column]:
        return {
            "orbit_rep": self.orbit_rep(state),
            "fork_exists": self.fork_exists(state),
            "ply": self.ply(state),
            "center_control": self.center_control(state),
            "corner_count": self.corner_count(state),
            "edge_count": self.edge_count(state),
        }
