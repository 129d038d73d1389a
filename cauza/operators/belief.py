"""Interventions on a causal graph by loopy belief propagation, and attribution by rules over it.

Factors of all nodes are counted by one grouped job. Up to ``most_cells`` combinations are collected, and messages are
arrays over the values of one node; beyond that factors stay tables and messages become joins, see propagation.py. Both
ways give the same beliefs.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from . import propagation
from .factors import COUNT, compress
from .graph import CausalGraph

TOLERANCE, FLOOR = 1e-5, 1e-8


class Factor:
    """Codes [rows, nodes] of observed combinations and their scores."""

    def __init__(self, nodes: Sequence[str], codes: np.ndarray, scores: np.ndarray):
        self.nodes, self.codes, self.scores = list(nodes), codes, scores

    def restricted(self, allowed: Mapping[str, np.ndarray]) -> Factor:
        """Scores 0 outside the allowed codes, then normalised."""
        scores = self.scores.copy()
        for i, n in enumerate(self.nodes):
            if n in allowed:
                scores[~np.isin(self.codes[:, i], allowed[n])] = 0
        return Factor(self.nodes, self.codes, scores / (scores.sum() + FLOOR))

    def to(self, node: str, size: int, messages: Mapping[str, np.ndarray]) -> np.ndarray:
        """The message to a node: the product with the others' messages, summed over all but the node."""
        scores = self.scores
        for i, n in enumerate(self.nodes):
            if n in messages:
                scores = scores * messages[n][self.codes[:, i]]
        return np.bincount(self.codes[:, self.nodes.index(node)], scores, size)


class GraphInferModel:
    """P(node | conditions, do(treatment)) for every node of a graph."""

    def __init__(self, graph: CausalGraph | None = None, column_names: Sequence[str] | None = None, treatment_name: str | None = None, label_name: str | None = None, num_iteration: int = 20, discovery=None, most_cells: int = 5_000_000):
        self.graph, self.treatment_name, self.label_name, self.num_iteration, self.discovery = graph, treatment_name, label_name, num_iteration, discovery
        self.most_cells = most_cells
        self.column_names = list(column_names) if column_names else (graph.names if graph else None)
        self.values: dict[str, np.ndarray] = {}
        self.tables: tuple[DataFrame, list[list[str]], DataFrame] | None = None  # cells, families and domains, where these are not collected
        self.result: dict | None = None

    def fit(self, df: DataFrame) -> GraphInferModel:
        """Counts the factors of all nodes; finds the graph first if there is none."""
        if self.graph is None:
            if self.discovery is None:
                raise ValueError("a graph or a discovery method is needed")
            self.graph, _ = self.discovery.fit(df).get_result()
        names = self.graph.names
        if self.column_names and self.column_names != df.columns and len(self.column_names) == len(df.columns):
            df = df.toDF(*self.column_names)
        family = lambda i, n: F.struct(F.lit(i).alias("family"), F.array(*(F.col(f"`{c}`").cast("int") for c in [n, *sorted(self.graph.parents[n])])).alias("codes"))
        stacked = compress(df, names).select(COUNT, F.explode(F.array(*(family(i, n) for i, n in enumerate(names)))).alias("f"))
        cells, self.tables = checkpointed(stacked.groupBy("f.family", "f.codes").agg(F.sum(COUNT).alias("n"))), None
        if cells.count() > self.most_cells:
            families = [[n, *sorted(self.graph.parents[n])] for n in names]
            domains = propagation.domains(cells, families)
            self.tables = propagation.scored(cells, families), families, domains
            self.values = {r.node: np.sort(np.array(r.v, int)) for r in domains.groupBy("node").agg(F.collect_list("value").alias("v")).collect()}  # one node's values
            return self
        cells, tables = cells.toPandas(), {}
        for i, n in enumerate(names):
            own = cells[cells["family"] == i]
            tables[n] = np.column_stack([np.array(own["codes"].tolist(), float).reshape(len(own), -1), own["n"].to_numpy(float)])
        self.values = {n: np.unique(tables[n][:, 0]).astype(int) for n in names}
        self.factors, self.freq = {}, {}
        for n in names:
            nodes = [n, *sorted(self.graph.parents[n])]
            codes = np.stack([np.searchsorted(self.values[m], tables[n][:, i].astype(int)) for i, m in enumerate(nodes)], 1)
            counts = tables[n][:, -1].astype(float)
            self.factors[n] = Factor(nodes, codes, (1 + counts) / (np.prod([len(self.values[m]) for m in nodes]) + counts.sum()))
            self.freq[n] = np.bincount(codes[:, 0], counts, len(self.values[n])) / counts.sum()
        return self

    def estimate(self, condition: Mapping, treatment_value, label_value: int | None = None):
        """{node: (values, beliefs)} under do(treatment = value), given the condition; with label_value that belief."""
        listed = {k: [v] if np.isscalar(v) else list(v) for k, v in condition.items()}
        do = {self.treatment_name: [treatment_value] if np.isscalar(treatment_value) else list(treatment_value)}
        if self.tables:
            found = propagation.propagate(*self.tables, do, {k: v for k, v in listed.items() if k in self.values}, self.num_iteration, TOLERANCE).toPandas()
            by = {n: x.sort_values("value") for n, x in found.groupby("node")}
            beliefs = {n: by[n]["belief"].to_numpy() for n in self.values}
        else:
            beliefs = self._propagate(do, listed)
        self.result = {n: (self.values[n], b) for n, b in beliefs.items()}
        return self.result if label_value is None else self.value(self.label_name, label_value)

    def value(self, node: str, value: int) -> float:
        at = np.flatnonzero(self.values[node] == value)
        if not len(at):
            raise ValueError(f"{node} has no value {value}")
        return float(self.result[node][1][at[0]])

    def get_result(self, label_value: int | None = None):
        return self.result if label_value is None else self.value(self.label_name, label_value)

    def _propagate(self, do: Mapping, condition: Mapping) -> dict[str, np.ndarray]:
        allowed = {n: np.flatnonzero(np.isin(self.values[n], v)) for n, v in {**condition, **do}.items() if n in self.values}
        (target,) = do
        norm = lambda x: x / (x.sum() + FLOOR)

        def strict(n: str, x: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(x))
            keep[allowed.get(n, slice(None))] = 1
            return norm(x * keep)

        factors = {}
        for n, f in self.factors.items():
            f = f.restricted(allowed)
            if n == target:  # incoming edges are cut
                size = len(self.values[n])
                f = Factor([n], np.arange(size)[:, None], f.to(n, size, {}))
            factors[n] = f
        prior = {n: strict(n, np.full(len(v), 1 / len(v))) for n, v in self.values.items()}
        to_factor = {f: {n: strict(n, self.freq[n]) for n in x.nodes} for f, x in factors.items()}
        to_node = {n: {f: strict(n, self.freq[n]) for f, x in factors.items() if n in x.nodes} for n in self.values}
        beliefs = prior
        for _ in range(self.num_iteration):
            to_node = {n: {f: norm(factors[f].to(n, len(self.values[n]), {m: x for m, x in to_factor[f].items() if m != n})) for f in at} for n, at in to_node.items()}
            to_factor = {f: {n: norm(prior[n] * np.prod([x for g, x in to_node[n].items() if g != f], axis=0)) for n in at} for f, at in to_factor.items()}
            new = {n: norm(prior[n] * np.prod(list(at.values()), axis=0)) for n, at in to_node.items()}
            change = sum(np.abs(new[n] - beliefs[n]).sum() for n in new)
            beliefs = new
            if change < TOLERANCE:
                break
        return beliefs


class Attribution:
    """Rules {feature: value} under which the label's belief reaches a threshold."""

    def __init__(self, threshold: float, max_step: int = 2, top_num: int | None = None, inferencer=None, random_pairs: bool = False, seed: int = 0):
        self.threshold, self.max_step, self.top_num, self.inferencer, self.random_pairs, self.seed = threshold, max_step, top_num, inferencer, random_pairs, seed
        self.rules: list[tuple[dict, float]] = []

    def attribute(self, df: DataFrame, treatment_value: int, label_value: int) -> list[tuple[dict, float]]:
        """Scores all single conditions as one distributed job; those below the threshold grow by the best other one."""
        model = self.inferencer if self.inferencer.values else self.inferencer.fit(df)
        spark = df.sparkSession
        features = [n for n in model.graph.names if n not in (model.treatment_name, model.label_name)]
        todo = [{n: int(v)} for n in features for v in model.values[n]]
        rnd, self.rules, singles, seen = random.Random(self.seed), [], [], set()
        for step in range(self.max_step):
            # rounded, so that rules of equal belief stand by name and not by the last bits
            scored = sorted(self._scores(spark, model, todo, treatment_value, label_value), key=lambda r: (-round(r[1], 9), str(r[0])))
            if step == 0:
                singles = [pair for rule, _ in scored for pair in rule.items()]
            self.rules += [r for r in scored if r[1] >= self.threshold]
            rest = [r for r in scored if r[1] < self.threshold][: self.top_num]
            todo = []
            for rule, _ in rest:
                options = [p for p in singles if p[0] not in rule]
                if options:
                    grown = rule | dict([rnd.choice(options) if self.random_pairs else options[0]])
                    if (k := tuple(sorted(grown.items()))) not in seen:
                        seen.add(k)
                        todo.append(grown)
            if not todo:
                break
        self.rules.sort(key=lambda r: (-round(r[1], 9), str(r[0])))
        return self.rules

    @staticmethod
    def _scores(spark, model, rules: list[dict], treatment_value: int, label_value: int) -> list[tuple[dict, float]]:
        """Rules as rows: each task propagates beliefs for its share, with the factors as a broadcast of bounded size."""
        if model.tables:  # each rule's propagation is distributed itself
            return [(r, model.estimate(r, treatment_value, label_value)) for r in rules]
        bare = GraphInferModel(None, None, model.treatment_name, model.label_name, model.num_iteration)
        bare.values, bare.factors, bare.freq = model.values, model.factors, model.freq
        shared = spark.sparkContext.broadcast(bare)

        def run(parts):
            for pdf in parts:
                own = shared.value
                yield pdf.assign(score=[own.estimate(dict(zip(k, v)), treatment_value, label_value) for k, v in zip(pdf.keys_, pdf.values_)])[["i", "score"]]

        rows = [(i, list(r), list(r.values())) for i, r in enumerate(rules)]
        found = spark.createDataFrame(rows, "i int, keys_ array<string>, values_ array<int>").repartition(min(len(rows), 64)).mapInPandas(run, "i int, score double").collect()
        return [(rules[r.i], float(r.score)) for r in found]

    def get_result(self) -> list[tuple[dict, float]]:
        return self.rules


def enumerate_belief(model: GraphInferModel, do: dict, condition: dict, node: str) -> np.ndarray:
    """The product of all factors, summed over everything but the node: exact on small graphs, for tests."""
    names = list(model.values)
    allowed = {**condition, **do}
    out = np.zeros(len(model.values[node]))
    lookup = {n: {tuple(c): s for c, s in zip(f.codes.tolist(), f.scores)} for n, f in model.factors.items()}
    for codes in itertools.product(*(range(len(model.values[n])) for n in names)):
        at = dict(zip(names, codes))
        if any(model.values[n][at[n]] not in v for n, v in allowed.items()):
            continue
        p = 1.0
        for n, f in model.factors.items():
            p *= 1.0 if n in do else lookup[n].get(tuple(at[m] for m in f.nodes), 0.0)
        out[at[node]] += p
    return out / out.sum()
