"""Causal graphs: a small adjacency on the driver, edges as a DataFrame."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .factors import factor, graph_score

EDGES = "parent string, child string"


class CausalGraph:
    """Names and the set of parents of each node; always acyclic."""

    def __init__(self, names: Sequence[str] = (), matrix=None):
        self.names = list(names) if len(names) or matrix is None else [f"x{i}" for i in range(len(matrix))]
        self.parents: dict[str, set[str]] = {n: set() for n in self.names}
        self.factors: dict[str, DataFrame] = {}
        self.excluded: set[str] = set()
        if matrix is not None:
            for i, a in enumerate(self.names):
                for j, b in enumerate(self.names):
                    if matrix[i][j] != 0:
                        self.add_edge(a, b)

    def copy(self) -> CausalGraph:
        out = CausalGraph(self.names)
        out.parents = {k: set(v) for k, v in self.parents.items()}
        return out

    def name(self, node: str | int) -> str:
        found = self.names[node] if isinstance(node, int) and 0 <= node < len(self.names) else node
        if found not in self.parents:
            raise ValueError(f"no node {node}")
        return found

    def ancestors(self, node: str) -> set[str]:
        seen, todo = set(), list(self.parents[node])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += self.parents[p]
        return seen

    def is_cyclic(self) -> bool:
        return any(n in self.ancestors(n) for n in self.names)

    def add_edge(self, parent: str | int, child: str | int, max_parents: int | None = None) -> bool:
        """False, and no change, if the child has enough parents or a cycle would arise."""
        parent, child = self.name(parent), self.name(child)
        if parent == child:
            raise ValueError("an edge needs two nodes")
        if max_parents is not None and len(self.parents[child]) >= max_parents or child in self.ancestors(parent):
            return False
        self.parents[child].add(parent)
        return True

    def remove_edge(self, parent: str | int, child: str | int, strict: bool = False) -> None:
        parent, child = self.name(parent), self.name(child)
        if strict and parent not in self.parents[child]:
            raise ValueError(f"no edge {parent} - {child}")
        self.parents[child].discard(parent)

    def parents_exclude(self, names: Iterable[str]) -> None:
        self.excluded = {self.name(n) for n in names}

    def random_init(self, max_parents: int | None = None, seed: int = 0) -> CausalGraph:
        rnd = random.Random(seed)
        limit = max_parents if max_parents is not None else max(1, len(self.names) // 2)
        for child in self.names:
            for parent in rnd.sample([n for n in self.names if n != child], rnd.randint(0, min(limit, len(self.names) - 1))):
                self.add_edge(parent, child, limit)
        return self

    def merge(self, other: CausalGraph, p1: float = 1.0, p2: float = 1.0, mutation: float = 0.0, max_parents: int | None = None, seed: int = 0) -> CausalGraph:
        """Edges of both, each side's kept with its probability, without those that close a cycle; then mutate and prune."""
        rnd, out = random.Random(seed), CausalGraph(self.names)
        for graph, p in ((self, p1), (other, p2)):
            for parent, child in graph.edges():
                if rnd.random() < p:
                    out.add_edge(parent, child)
        return out.mutate(mutation, seed).remove_extra_parents(max_parents, seed)

    def mutate(self, rate: float, seed: int = 0) -> CausalGraph:
        """Each ordered pair of nodes draws once: below half the rate its edge is added (unless that closes a cycle), below the rate it is removed."""
        rnd = random.Random(seed)
        for parent in self.names:
            for child in self.names:
                drawn = rnd.random()
                if parent == child or drawn >= rate:
                    continue
                if drawn < rate / 2:
                    self.add_edge(parent, child)
                else:
                    self.remove_edge(parent, child)
        return self

    def remove_extra_parents(self, max_parents: int | None, seed: int = 0) -> CausalGraph:
        rnd = random.Random(seed)
        for n in self.names:
            if max_parents is not None and len(self.parents[n]) > max_parents:
                self.parents[n] = set(rnd.sample(sorted(self.parents[n]), max_parents))
        return self

    def edges(self) -> list[tuple[str, str]]:
        return [(p, c) for c in self.names for p in sorted(self.parents[c])]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges(), EDGES)

    def save(self, spark: SparkSession, path: str, by_index: bool = False) -> None:
        rows = [(str(self.names.index(p)), str(self.names.index(c))) for p, c in self.edges()] if by_index else self.edges()
        spark.createDataFrame(rows, EDGES).coalesce(1).write.mode("overwrite").csv(path, header=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: Sequence[str] = ()) -> CausalGraph:
        """Edges from a CSV of parent and child, quotes stripped; new names are added as they come."""
        rows = [tuple(x.strip().strip("'\"") for x in r) for r in spark.read.csv(path, header=True, schema=EDGES).collect()]
        out = cls(list(names) or list(dict.fromkeys(x for r in rows for x in r)))
        for p, c in rows:
            out.add_edge(p, c)
        return out

    def score(self, df: DataFrame) -> float:
        return graph_score(df, {n: sorted(p) for n, p in self.parents.items()}).first()[0]

    def fit(self, df: DataFrame) -> CausalGraph:
        """Factor tables of all nodes."""
        self.factors = {n: factor(df, n, sorted(self.parents[n])) for n in self.names}
        return self


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor) of an edge table, by squaring the reachable pairs until none is new."""
    now = checkpointed(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    n = now.count()
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor")
        now = checkpointed(now.union(step).distinct())
        new = now.count()
        if new == n:
            return now
        n = new


def is_cyclic(edges: DataFrame) -> DataFrame:
    return ancestors(edges).agg(F.coalesce(F.max(F.col("node") == F.col("ancestor")), F.lit(False)).alias("is_cyclic"))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("parent", "child").unionByName(b.select("parent", "child")).distinct()


def top_parents(edges: DataFrame, k: int) -> DataFrame:
    """Of weighted edges, the k heaviest of each child; ties by name."""
    from pyspark.sql import Window as W

    order = W.partitionBy("child").orderBy(F.desc("weight"), "parent")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("parent", "child", "weight", "place")
