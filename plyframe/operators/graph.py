"""Games given as explicit graphs: built node by node, or checked and solved as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.errors import InvalidGraph
from plyframe.operators.solve import cut, peel, union, unseen

NODES, EDGES = "id bigint, turn bigint, utility array<bigint>", "src bigint, dst bigint, ord bigint"


@dataclass(eq=False)
class Node:
    """A node by identity: with utilities it is terminal."""

    turn: int
    utility: tuple[int, ...] | None = None


def node(turn: int, *utility: int) -> Node:
    return Node(turn, utility or None)


@dataclass
class GraphBuilder:
    """Collects nodes and edges; ``build`` gives a game or says what is wrong."""

    name: str
    nodes: list[Node] = field(default_factory=list)
    edges: dict[tuple[int, int], None] = field(default_factory=dict)
    start: int | None = None
    numbers: dict[int, int] = field(default_factory=dict)

    def _index(self, n: Node) -> int:
        """The number of a node, by identity; the node is kept, so identities stay apart."""
        if id(n) not in self.numbers:
            self.numbers[id(n)] = len(self.nodes)
            self.nodes.append(n)
        return self.numbers[id(n)]

    def edge(self, a: Node, b: Node) -> GraphBuilder:
        if a.utility is not None:
            raise InvalidGraph(f"{self.name}: an edge leaves a terminal node")
        self.edges[self._index(a), self._index(b)] = None
        return self

    def source(self, n: Node) -> GraphBuilder:
        if id(n) not in self.numbers:
            raise InvalidGraph(f"{self.name}: the source is no node of any edge")
        self.start = self._index(n)
        return self

    def build(self) -> GraphGame:
        if self.start is None:
            raise InvalidGraph(f"{self.name}: no source")
        sizes = {len(n.utility) for n in self.nodes if n.utility is not None}
        if len(sizes) > 1:
            raise InvalidGraph(f"{self.name}: terminal nodes with {' and '.join(map(str, sorted(sizes)))} utilities")
        players = max(sizes, default=0)
        for n in self.nodes if sizes else ():
            if not 0 <= n.turn < players:
                raise InvalidGraph(f"{self.name}: turn {n.turn} among {players} players")
        onward: dict[int, list[int]] = {}
        for a, b in self.edges:
            onward.setdefault(a, []).append(b)
        if any(n.utility is None and i not in onward for i, n in enumerate(self.nodes)):
            raise InvalidGraph(f"{self.name}: a node that isn't terminal has no way on")
        seen, todo = {self.start}, [self.start]
        while todo:
            for b in onward.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if not any(self.nodes[i].utility for i in seen):
            raise InvalidGraph(f"{self.name}: no terminal node can be reached")
        return GraphGame(self.name, players, self.start, [(i, n.turn, list(n.utility) if n.utility else None) for i, n in enumerate(self.nodes)], [(a, b, k) for k, (a, b) in enumerate(self.edges)], dict(self.numbers), list(self.nodes))


@dataclass
class GraphGame:
    name: str
    players: int
    start: int
    node_rows: list[tuple[int, int, list[int] | None]]
    edge_rows: list[tuple[int, int, int]]
    numbers: dict[int, int] = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)

    def state(self, n: Node) -> int | None:
        """The state of a node, or None if it is none of this game's."""
        return self.numbers.get(id(n))

    def incoming(self, spark: SparkSession, states: DataFrame) -> DataFrame:
        """``(state, before)``: where play can come from, for each of ``states(state)``."""
        edges = self.frames(spark)[1]
        return states.join(edges, F.col("state") == F.col("dst")).select("state", F.col("src").alias("before"))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.node_rows, NODES), spark.createDataFrame(self.edge_rows, EDGES)

    def solve(self, spark: SparkSession) -> DataFrame:
        """``(state, remoteness, player, utility)`` of the nodes reachable from the source."""
        nodes, edges = self.frames(spark)
        own = reachable(nodes.where(F.col("id") == self.start), edges)
        return peel(nodes.join(own, "id", "left_semi"), edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi"))

    def dot(self) -> str:
        """The graph in Graphviz's language."""
        shape = [f'  {i} [label="{i}: player {t}{"" if u is None else " " + str(u)}"{", shape=box" if u else ""}{", penwidth=2" if i == self.start else ""}];' for i, t, u in self.node_rows]
        return "\n".join([f'digraph "{self.name}" {{', *shape, *(f"  {a} -> {b};" for a, b, _ in self.edge_rows), "}"])


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of every node that can be reached from the seeds, themselves included."""
    found = [cut(seeds.select("id").distinct())]
    while not found[-1].isEmpty():
        fresh = found[-1].join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        found.append(cut(unseen(fresh, found, "id")))
    return cut(union(found))


def problems(nodes: DataFrame, edges: DataFrame, source: DataFrame) -> DataFrame:
    """``(problem, id)``: what keeps ``nodes`` and ``edges`` from being a game that starts at ``source(id)``."""
    terminal, medial = nodes.where("utility is not null"), nodes.where("utility is null")
    size = terminal.agg(F.max(F.size("utility")).alias("players"))
    with_size = nodes.crossJoin(F.broadcast(size))  # one row
    tell = lambda rows, text: rows.select(F.lit(text).alias("problem"), "id")
    reach = reachable(source.join(nodes, "id", "left_semi"), edges)
    parts = [
        tell(terminal.where("size(utility) = 0 or turn >= size(utility)"), "turn without utility"),
        tell(with_size.where("utility is not null and size(utility) <> players"), "other number of utilities"),
        tell(with_size.where("utility is null and turn >= players"), "turn beyond players"),
        tell(edges.join(terminal, F.col("src") == F.col("id")).select("id").distinct(), "edge from terminal"),
        tell(medial.join(edges, F.col("src") == F.col("id"), "left_anti"), "no way on"),
        tell(source.join(nodes, "id", "left_anti"), "source is no node"),
        tell(source.join(nodes, "id", "left_semi").where(F.lit(reach.join(terminal, "id", "left_semi").isEmpty())), "no terminal reachable"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
