"""Causal discovery by greedy search over parents with the Bayesian score."""

from __future__ import annotations

import random
from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..logs import log
from ..sources.frames import intake
from .factors import compress, family_scores, subset_scores
from .graph import CausalGraph


def node_order(names: Sequence[str], seed: int | None, target: str | None = None) -> list[str]:
    """The order in which nodes look for parents."""
    order = list(names)
    if seed is not None:
        random.Random(seed).shuffle(order)
    return order if target is None else [target, *(n for n in order if n != target)]


class CausalSearchDiscovery:
    """K2 search. Nodes come in a seeded random order (in column order if seed is None), the target first; each takes the parent with the largest gain
    until none gains more than edge_gain, has enough parents, or would close a cycle. Scores are compared to six decimals,
    and ties go to the lowest name.

    One pass over the rows gives their distinct ones, one over these the scores of all families of at most ``counted`` parents
    (fewer, where there would be over ``most_sets`` sets of nodes to count); each step beyond these is a job of its own.
    ``jobs`` tells how many there were.

    moving_margin: candidates come in a random order, and one takes over only if it gains edge_gain more than the best so
    far, which need not find the largest gain. legacy_gain measures a second parent against the score without parents, as the first one.
    """

    def __init__(self, edge_gain: float = 20.0, max_parents: int | None = None, seed: int | None = 0, legacy_gain: bool = False, moving_margin: bool = False, counted: int = 2, most_sets: int = 2_000):
        self.edge_gain, self.max_parents, self.seed, self.legacy_gain = edge_gain, max_parents, seed, legacy_gain
        self.moving_margin, self.counted, self.most_sets, self.jobs = moving_margin, counted, most_sets, 0
        self.result: tuple[CausalGraph, float] | None = None

    def fit(self, source, target_name: str | None = None, node_names: Sequence[str] | None = None, spark=None) -> CausalSearchDiscovery:
        df = source if isinstance(source, DataFrame) and node_names is None else intake(spark or source.sparkSession, source, node_names)
        names = df.columns
        rows = compress(df, names).cache()  # bounded by the number of distinct rows; every step reads only this
        try:
            self.result = self._search(rows, names, target_name)
        finally:
            rows.unpersist()
        return self

    def _search(self, rows: DataFrame, names: list[str], target: str | None) -> tuple[CausalGraph, float]:
        graph, limit = CausalGraph(names), self.max_parents if self.max_parents is not None else max(1, len(names) // 2)
        order = node_order(names, self.seed, target)
        ahead = min(limit, self.counted, len(names) - 1)
        while ahead > 0 and sum(comb(len(names), k) for k in range(1, ahead + 2)) > self.most_sets:
            ahead -= 1
        self.jobs, rnd = 1, random.Random(self.seed)
        known = {(r.node, tuple(r.parents)): r.score for r in subset_scores(rows, names, ahead).collect()}  # a row for each family
        scores = {n: known[n, ()] for n in names}
        alone = dict(scores)
        for node in order:
            while len(graph.parents[node]) < limit:
                options = [p for p in names if p not in (node, target) and p not in graph.parents[node] and node not in graph.ancestors(p)]
                if not options:
                    break
                families = [(node, tuple(sorted({*graph.parents[node], p}))) for p in options]
                if lacking := [f for f in families if f not in known]:
                    known |= self._scores(rows, lacking)  # one job for all candidates of a step
                    self.jobs += 1
                log.info("%s: %d candidates", node, len(options))
                base = alone[node] if self.legacy_gain else scores[node]
                best, score = self._best(dict(zip(options, (known[f] for f in families), strict=True)), base, rnd)
                if best is None:
                    break
                graph.add_edge(best, node)
                scores[node] = score
        return graph, sum(scores.values())

    def _best(self, found: dict[str, float], base: float, rnd: random.Random) -> tuple[str | None, float]:
        """The parent that is taken, and its family's score; none if none gains enough."""
        if not self.moving_margin:
            best = min(found, key=lambda p: (-round(found[p], 6), p))
            return (best, found[best]) if found[best] - base > self.edge_gain else (None, base)
        best, order = None, sorted(found)
        rnd.shuffle(order)
        for p in order:
            if found[p] > base + self.edge_gain:
                best, base = p, found[p]
        return best, base

    @staticmethod
    def _scores(rows: DataFrame, families: list[tuple[str, tuple]]) -> dict:
        found = family_scores(rows, [(n, list(p)) for n, p in families]).select("family", F.col("score")).collect()
        return {families[r.family]: r.score for r in found}

    def get_result(self) -> tuple[CausalGraph, float]:
        return self.result
