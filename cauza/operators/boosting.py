"""Gradient-boosted causal trees over panels.

Each level of a tree is one job: tasks replay the trees since the last checkpoint on their rows' bins, take gradients at
the factual and the opposite arm's predictions, and sum them by (leaf, feature, bin, arm); partial sums meet in one
aggregation, whose size depends on leaves, features and bins alone. The split search runs on that table on the driver.
Predictions are written to a checkpoint every few trees, so that neither lineage nor replay grows.

Trees see rows by their bins and arm alone. Without draws, rows that agree in both are one cell of the state, with their number, the
sums of their outcomes and the squares about the means, from which gradients and losses are the same sums; so that levels cost
what the cells do.

With ``subsample`` below 1 each tree draws its own rows, by a hash of key and tree, and its validation loss is that of the
rows it did not draw. Features of which no bound leaves min_points rows on both sides are flagged trivial, and no tree
looks at them. Columns that bring bounds in their metadata are not binned again. Categorical features become codes by a dictionary (places in order of frequency, one for the rest, missing
ones as NaN), which the model keeps.

Fitted trees score as Columns on raw values (x <= bound; NaN and null to the right, as their bin is the last), so that
neither bins nor Python are needed there.

pred follows theta of the own arm, cpred theta of the opposite one. Before treatment cost is taken at cpred, after it
at pred.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logs import log, trace
from ..sources.frames import CausalFrame
from ..sources.shared import checkpointed
from .bins import category_bounds, category_code, fit_bins, fit_categories, found_bounds, transform, trivial
from .losses import Logistic, Square


@dataclass(frozen=True)
class Config:
    learning_rate: float = 0.1
    n_estimators: int = 100
    subsample: float = 1.0
    subfeature: float = 1.0
    min_points: int = 10
    max_depth: int = 3
    lambd: float = 5.0
    coeff: float = 1.0
    init: float = 0.0
    n_iter_no_change: int | None = 10
    tol: float = 1e-4
    max_bin: int = 64
    min_points_per_bin: int = 10
    min_var_rate: float = 0.1
    parallel_l2: float = 0.0
    true_variance: bool = False  # right child's treatment variance as p(1 - p) instead of as published
    own_divisor: bool = False  # control curvature of eta over the control count instead of as published
    monotone: int = 0
    anchor: int = 10  # trees between checkpoints
    seed: int = 0


#: Cells of a fit: bins, arm, sums of outcomes, predictions of the own and the opposite arm, shift, hash of the key (of cells of one row), rows, squares of outcomes about their means before and after treatment.
STATE = "x array<int>, w int, y array<double>, pred array<double>, cpred array<double>, eta double, unit bigint, n double, pre double, post double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows; null values as NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _double(x: float) -> str:
    """A double as SQL."""
    return f"{float(x)!r}D" if np.isfinite(x) else f"double('{float(x)}')"


@dataclass
class Node:
    level: int
    theta: np.ndarray  # [arms, periods]
    eta: float = 0.0
    feature: int | None = None
    bin: int = -1
    bound: float = float("nan")
    children: list = field(default_factory=list)

    @property
    def is_leaf(self) -> bool:
        return self.feature is None


@dataclass
class Tree:
    nodes: dict[int, Node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Level id of each row's leaf."""
        at = np.zeros(len(bins), np.int64)
        for level in sorted(self.nodes):
            node = self.nodes[level]
            if not node.is_leaf:
                here = at == level
                at[here] = np.where(bins[here, node.feature] <= node.bin, 2 * level + 1, 2 * level + 2)
        return at

    def values(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """theta [rows, arms, periods] and eta [rows]."""
        ids = sorted(k for k, n in self.nodes.items() if n.is_leaf)
        place = np.searchsorted(ids, self.leaves(bins))
        return np.stack([self.nodes[i].theta for i in ids])[place], np.array([self.nodes[i].eta for i in ids])[place]


def _costs(g, h, cg, ch, n, t0: int, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """Cost and theta of nodes; arrays [..., arms, periods], n [..., arms]."""
    theta = -g / (h + c.lambd)
    other = -(g.sum(-2, keepdims=True) - g) / (h.sum(-2, keepdims=True) - h + c.lambd)
    quad = lambda v, a, b: a * v + 0.5 * v * v * (b + c.lambd)
    periods = g.shape[-1]
    loss = c.coeff * quad(theta, g, h)[..., t0:].sum(-1) / (n * (periods - t0))
    if t0:
        loss = loss + quad(other, cg, ch)[..., :t0].sum(-1) / (n * t0)
    total = loss.sum(-1)
    if c.monotone:
        total = total + np.where((c.monotone * (theta[..., 1, t0:] - theta[..., 0, t0:]) < 0).any(-1), np.inf, 0)
    return total * n.sum(-1) / 2, theta


def _did_costs(g, h, cg, ch, n, e, t0: int, c: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _costs, with the shift eta of the arms; e [..., arms] sums of eta so far."""
    theta = -g / (h + c.lambd)
    other = -(g.sum(-2, keepdims=True) - g) / (h.sum(-2, keepdims=True) - h + c.lambd)
    n0, n1 = n[..., 0, None], n[..., 1, None]
    mean = (e / n).mean(-1)
    pre = slice(0, t0)
    divisor = n0 if c.own_divisor else n1
    up = (cg[..., 1, pre] / n1 - cg[..., 0, pre] / n0 + ch[..., 1, pre] * other[..., 1, pre] / n1 - ch[..., 0, pre] * other[..., 0, pre] / divisor).sum(-1) + t0 * c.parallel_l2 * mean
    down = (ch[..., 1, pre] / n1 + ch[..., 0, pre] / n0).sum(-1) + t0 * c.parallel_l2
    eta = np.where(down != 0, -up / np.where(down != 0, down, 1), 0.0)
    quad = lambda v, a, b: a * v + 0.5 * v * v * (b + c.lambd)
    loss = c.coeff * quad(theta, g, h)[..., t0:].sum(-1) / (n * (g.shape[-1] - t0))
    if t0:
        shifted = other + np.array([-1.0, 1.0])[:, None] * eta[..., None, None]
        loss = loss + quad(shifted, cg, ch)[..., pre].sum(-1) / (n * t0)
    total = loss.sum(-1) + c.parallel_l2 * (0.5 * eta * eta + eta * mean)
    return total * n.sum(-1) / 2, theta, eta


def search(stats: dict[str, np.ndarray], t0: int, c: Config, did: bool = False):
    """Best split of one leaf from sums [features, bins, arms(, periods)]; None if none is admissible. Ties: lowest feature, bin."""
    left = {k: np.cumsum(v, axis=1) for k, v in stats.items()}
    right = {k: left[k][:, -1:] - left[k] for k in left}
    nl, nr = left["n"], right["n"]
    total = nl[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        size_l, size_r = nl.sum(-1), nr.sum(-1)
        p = (total[:, 1] / total.sum(-1))[:, None]
        var_l = (nl[..., 1] - nl[..., 1] ** 2 / size_l) / size_l
        square = nr[..., 1] ** 2
        var_r = ((nr[..., 1] if c.true_variance else square) - square / (size_r + 1e-9)) / (size_r + 1e-9)
        ok = (np.minimum(nl.min(-1), nr.min(-1)) >= max(1, c.min_points)) & ((c.min_var_rate <= 0) | (np.minimum(var_l, var_r) >= c.min_var_rate * (p - p * p)))
        if did:
            (cl, tl, el), (cr, tr, er) = (_did_costs(s["g"], s["h"], s["cg"], s["ch"], s["n"], s["e"], t0, c) for s in (left, right))
        else:
            (cl, tl), (cr, tr) = (_costs(s["g"], s["h"], s["cg"], s["ch"], s["n"], t0, c) for s in (left, right))
            el = er = np.zeros_like(cl)
        cost = np.where(ok, cl + cr, np.inf)
    cost = np.where(np.isnan(cost), np.inf, cost)
    f, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
    if not np.isfinite(cost[f, b]):
        return None
    return int(f), int(b), float(cost[f, b]), (tl[f, b], tr[f, b]), (float(el[f, b]), float(er[f, b]))


def drawn(units: np.ndarray, tree: int, seed: int = 0) -> np.ndarray:
    """A number from 0 up to 1 for each row (units: hashes of keys, of 32 bits) and a tree."""
    mask = np.uint64(0xFFFFFFFF)
    x = units.astype(np.uint64) ^ np.uint64((tree * 0x9E3779B1 + seed * 0x7FEB352D) & 0xFFFFFFFF)
    for factor, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        x = x * np.uint64(factor) & mask
        x ^= x >> np.uint64(shift)
    return x / 4294967296.0


def unit(key: Column) -> Column:
    """The first 32 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


class Boosting:
    """Shared loop; subclasses choose the loss and whether arms have a shift."""

    did = False
    loss = Square()

    def __init__(self, config: Config | None = None, bounds: dict[str, list[float]] | None = None, dictionaries: dict[str, list[str]] | None = None):
        self.config, self.bounds, self.dictionaries = config or Config(), bounds, dict(dictionaries or {})
        self.trees: list[Tree] = []
        self.valid_losses: list[float] = []
        self.trivial: list[str] = []

    def _values(self, df: DataFrame) -> list[Column]:
        """The features as numbers."""
        return [category_code(df, f, self.dictionaries[f]) if f in self.dictionaries else F.col(f).cast("double") for f in self.features]

    def fit(self, frame: CausalFrame) -> Boosting:
        c = self.config
        self.features, self.t0, self.periods = frame.features, frame.treat_dt, frame.n_period
        frame.check()
        for f in frame.categorical:
            self.dictionaries.setdefault(f, fit_categories(frame.df, f, c.max_bin))
        known = {f: category_bounds(d) for f, d in self.dictionaries.items()} | found_bounds(frame.df, [f for f in frame.features if f not in self.dictionaries]) | (self.bounds or {})
        if rest := [f for f in self.features if f not in known]:
            known |= fit_bins(frame.df, rest, c.max_bin, c.min_points_per_bin)
        self.bounds = {f: known[f] for f in self.features}
        self.width = max(len(b) for b in self.bounds.values()) + 1
        zeros = F.array(*[F.lit(float(c.init))] * self.periods)
        units = unit(F.col(frame.key)) if c.subsample < 1 else F.lit(0).cast("bigint")
        state = frame.df.select(F.array(*self._values(frame.df)).alias("x"), F.col(frame.treatment).cast("int").alias("w"), F.col(frame.outcomes).cast("array<double>").alias("y"), zeros.alias("pred"), zeros.alias("cpred"), F.lit(0.0).alias("eta"), units.alias("unit"), F.lit(1.0).alias("n"), F.lit(0.0).alias("pre"), F.lit(0.0).alias("post"))
        state = checkpointed(self._cells(self._bin(state)))
        since: list[Tree] = []
        rnd = np.random.default_rng(c.seed)
        self._turn = 0  # the tree that is to be grown
        root, _ = self._level(state, since, None, [0])
        useful = self._useful(root[0]["n"].sum(-1))
        for k in range(c.n_estimators):
            chosen = np.sort(rnd.permutation(useful)[: max(1, round(c.subfeature * len(useful)))])
            tree = self._grow(state, since, chosen, root)
            self.trees.append(tree)
            since.append(tree)
            if len(since) >= c.anchor:
                state, since = checkpointed(self._replay(state, since)), []
            # one pass: how good the ensemble is by now, and the root of the next tree
            self._turn = k + 1
            root, loss = self._level(state, since, None, [0])
            self.valid_losses.append(loss)
            log.debug("tree %d: %d nodes, validation loss %g", k, len(tree.nodes), loss)
            if self._stop():
                break
        best = int(np.argmin(self.valid_losses))
        self.trees = self.trees[: best + 1]
        return self

    def _useful(self, counts: np.ndarray) -> np.ndarray:
        """Features that a bound could split, by the rows [features, bins] of the first root; the others are named in trivial."""
        none = [trivial(self.bounds[f], counts[i], self.config.min_points) for i, f in enumerate(self.features)]
        self.trivial = [f for f, t in zip(self.features, none, strict=True) if t]
        return np.flatnonzero(~np.array(none)) if not all(none) else np.arange(len(none))

    def _stop(self) -> bool:
        c, best = self.config, int(np.argmin(self.valid_losses))
        worse = self.valid_losses[-1] > self.valid_losses[best] * (1 + c.tol)
        late = c.n_iter_no_change is not None and len(self.valid_losses) - best - 1 >= c.n_iter_no_change
        return worse and late or len(self.trees[-1].nodes) == 1

    def _bin(self, df: DataFrame) -> DataFrame:
        bounds = [self.bounds[f] for f in self.features]

        def run(batches):
            for batch in batches:
                values = _matrix(batch.column(0), len(bounds))
                bins = np.stack([transform(values[:, i], b) for i, b in enumerate(bounds)], 1)
                yield pa.RecordBatch.from_arrays([_lists(bins), *batch.columns[1:]], batch.schema.names)

        return df.mapInArrow(run, STATE)

    def _cells(self, state: DataFrame) -> DataFrame:
        """Rows of the same bins and arm as one, as far as trees do not draw rows and the loss has sums over cells."""
        if self.config.subsample < 1 or not hasattr(self.loss, "cells"):
            return state
        ys = [F.coalesce(F.get("y", F.lit(t)), F.lit(float("nan"))) for t in range(self.periods)]
        squares = lambda some: sum((F.var_pop(y) * F.sum("n") for y in some), F.lit(0.0))
        first = [F.first(c).alias(c) for c in ("pred", "cpred", "eta", "unit")]  # all alike before the first tree
        cells = state.groupBy("x", "w").agg(F.array(*map(F.sum, ys)).alias("y"), *first, F.sum("n").alias("n"), squares(ys[: self.t0]).alias("pre"), squares(ys[self.t0 :]).alias("post"))
        return cells.select(*state.columns)

    def _sums(self, y: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature of cells [cells, periods], without the spread of their outcomes."""
        return self.loss.cells(y, p, n[:, None]) if hasattr(self.loss, "cells") else self.loss.arrays(y, p)

    def _apply(self, batch: pa.RecordBatch, trees: list[Tree]):
        """(bins, w, y, pred, cpred, eta) with the trees' steps added."""
        bins, w = _matrix(batch.column(0), len(self.features)).astype(np.int64), batch.column(1).to_numpy()
        y, pred, cpred = (_matrix(batch.column(i), self.periods) for i in (2, 3, 4))
        eta = batch.column(5).to_numpy()
        rows, rate = np.arange(len(w)), self.config.learning_rate
        for tree in trees:
            theta, e = tree.values(bins)
            pred = pred + rate * theta[rows, w]
            cpred = cpred + rate * (theta[rows, 1 - w] - np.where(w == 0, e, -e)[:, None])
            eta = eta + rate * e
        return bins, w, y, pred, cpred, eta

    def _replay(self, state: DataFrame, trees: list[Tree]) -> DataFrame:
        def run(batches):
            for batch in batches:
                _, _, _, pred, cpred, eta = self._apply(batch, trees)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(pred), _lists(cpred), pa.array(eta), *batch.columns[6:]], batch.schema.names)

        return state.mapInArrow(run, STATE)

    def _grow(self, state: DataFrame, since: list[Tree], chosen: np.ndarray, root: dict) -> Tree:
        """A tree from the sums of its root; one job for each level below."""
        c = self.config
        tree, level, held = None, [0], {}
        for depth in range(c.max_depth + 1):
            # left children are summed, right ones are what the parent has besides
            stats = root if tree is None else self._level(state, since, tree, [n for n in level if n % 2])[0]
            stats |= {n: {k: v - stats[n - 1][k] for k, v in held[(n - 1) // 2].items()} for n in level if n and n % 2 == 0}
            held = stats
            if tree is None:
                s = stats[0]
                g, h = s["g"][0].sum(0), s["h"][0].sum(0)
                tree = Tree({0: Node(0, -g / (h + c.lambd))})
            if depth == c.max_depth:
                break
            new = []
            for leaf in level:
                found = search({k: v[chosen] for k, v in stats[leaf].items()}, self.t0, c, self.did)
                if found is None:
                    continue
                f, b, cost, theta, eta = found
                trace("leaf %d: feature %d, bin %d, cost %g", leaf, chosen[f], b, cost)
                node, feature = tree.nodes[leaf], int(chosen[f])
                node.feature, node.bin = feature, b
                node.bound = self.bounds[self.features[feature]][b] if b < len(self.bounds[self.features[feature]]) else float("inf")
                for side in (0, 1):
                    child = 2 * leaf + 1 + side
                    tree.nodes[child] = Node(child, theta[side], eta[side])
                    node.children.append(child)
                    new.append(child)
            level = new
            if not level or depth == c.max_depth - 1:
                break
        return tree

    def _level(self, state: DataFrame, since: list[Tree], tree: Tree | None, level: list[int]) -> tuple[dict[int, dict[str, np.ndarray]], float]:
        """Sums of each leaf of a level, and the validation loss of the trees so far (mean pre-period loss at cpred plus coeff times the mean post-period loss at pred): one job."""
        c, m, width, periods, arrays, spread = self.config, len(self.features), self.width, self.periods, self._sums, getattr(self.loss, "spread", 0.0)
        columns = [f"s{i}" for i in range(4 * periods + 2)]
        size, t0, turn = len(level) * width * 2, self.t0, self._turn

        def run(batches):
            total, pre, post = np.zeros((4 * periods + 2, m, size)), 0.0, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, w, y, pred, cpred, eta = self._apply(batch, since)
                units, n, before, after = (batch.column(i).to_numpy() for i in range(6, 10))
                inside = drawn(units, turn, c.seed) < c.subsample if c.subsample < 1 else np.ones(len(w), bool)
                if tree is None:
                    held = drawn(units, turn - 1, c.seed) >= c.subsample if c.subsample < 1 else inside
                    pre += float(arrays(y[held, :t0], cpred[held, :t0], n[held])[0].sum() + spread * before[held].sum())
                    post += float(arrays(y[held, t0:], pred[held, t0:], n[held])[0].sum() + spread * after[held].sum())
                leaf = tree.leaves(bins) if tree is not None else np.zeros(len(bins), np.int64)
                here = np.isin(leaf, level) & inside
                place = np.searchsorted(level, leaf[here]) * width
                _, g, h = arrays(y[here], pred[here], n[here])
                _, cg, ch = arrays(y[here], cpred[here], n[here])
                sums = [*g.T, *h.T, *cg.T, *ch.T, eta[here] * n[here], n[here]]
                for f in range(m):
                    key = (place + bins[here, f]) * 2 + w[here]
                    for i, v in enumerate(sums):
                        total[i, f] += np.bincount(key, v, size)
            total = total.reshape(4 * periods + 2, -1)
            cells = np.flatnonzero(total[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), *(pa.array(np.append(total[i, cells], (pre, post)[i] if i < 2 else 0.0)) for i in range(len(columns)))], ["cell", *columns])

        rows = state.mapInArrow(run, "cell bigint, " + ", ".join(f"{k} double" for k in columns)).groupBy("cell").agg(*(F.sum(k).alias(k) for k in columns)).toPandas()
        losses, rows = rows[rows["cell"] < 0], rows[rows["cell"] >= 0]
        loss = float(losses["s0"].sum() / max(1, t0) + c.coeff * losses["s1"].sum() / (periods - t0))
        full = np.zeros((4 * periods + 2, m * size))
        full[:, rows["cell"].to_numpy()] = rows[columns].to_numpy().T
        full = full.reshape(-1, m, len(level), width, 2).swapaxes(1, 2)
        parts = {k: np.moveaxis(full[i * periods : (i + 1) * periods], 0, -1) for i, k in enumerate(("g", "h", "cg", "ch"))}
        parts |= {"e": full[-2], "n": full[-1]}
        return {leaf: {k: v[i] for k, v in parts.items()} for i, leaf in enumerate(level)}, loss

    def _theta(self, bins: np.ndarray) -> np.ndarray:
        """theta [rows, arms, periods] of all trees, from bins."""
        return self.config.learning_rate * sum((t.values(bins)[0] for t in self.trees), np.zeros((len(bins), 2, self.periods)))

    def _leaf_sql(self, tree: Tree, level: int, place: dict[int, int]) -> str:
        """The place of a row's leaf, on features __x0, __x1, ..."""
        node = tree.nodes[level]
        if node.is_leaf:
            return str(place[level])
        left, right = (self._leaf_sql(tree, k, place) for k in (2 * level + 1, 2 * level + 2))
        return f"CASE WHEN __x{node.feature} <= {_double(node.bound)} THEN {left} ELSE {right} END"

    def compiled(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The columns keep of df with __leaf (ids of each tree's leaf), __theta (the trees' steps summed, arm by arm and period by period) and __eta (the shift of each tree): Columns on raw values, for tables and streams."""
        places = [{k: i for i, k in enumerate(sorted(n for n, x in t.nodes.items() if x.is_leaf))} for t in self.trees]
        most = max((len(p) for p in places), default=1)
        at = F.expr("array(" + ", ".join(self._leaf_sql(t, 0, p) for t, p in zip(self.trees, places, strict=True)) + ")")
        table = lambda value: [value(t.nodes[k]) for t, p in zip(self.trees, places, strict=True) for k in [*p, *[next(iter(p))] * (most - len(p))]]
        look = lambda values: f"transform(__at, (p, i) -> get(array({', '.join(values)}), i * {most} + p))"
        sums = [f"aggregate({look(table(lambda n, d=d, t=t: _double(n.theta[d, t])))}, 0D, (a, v) -> a + v)" for d in (0, 1) for t in range(self.periods)]
        out = df.select(*keep, *(v.alias(f"__x{i}") for i, v in enumerate(self._values(df)))).select(*keep, at.alias("__at"))
        return out.select(*keep, F.expr(look(table(lambda n: f"{n.level}L"))).alias("__leaf"), F.expr(f"array({', '.join(sums)})").alias("__theta"), F.expr(look(table(lambda n: _double(n.eta)))).alias("__eta"))

    def predict(self, frame: CausalFrame | DataFrame, what: str = "effect", key: str = "id") -> DataFrame:
        """effect (debiased, after treatment), effect-ND, leaf_id or outcome as array columns of that name."""
        df, key = (frame.df, frame.key) if isinstance(frame, CausalFrame) else (frame, key)
        makers = {"effect": self._effect, "effect-ND": lambda: F.array(self._gap(self.t0)), "leaf_id": lambda: F.col("__leaf"), "outcome": lambda: F.transform("__theta", lambda x: self.config.learning_rate * x)} | self._more()
        if what not in makers:
            raise ValueError(f"{what} is none of {sorted(makers)}")
        return self.compiled(df, [key]).select(key, makers[what]().alias(what))

    def _gap(self, t: int) -> Column:
        """The arms' difference in a period."""
        rate = self.config.learning_rate
        return rate * F.get("__theta", F.lit(self.periods + t)) - rate * F.get("__theta", F.lit(t))

    def _effect(self) -> Column:
        before = [self._gap(t) for t in range(self.t0)]
        bias = sum(before[1:], before[0]) / self.t0 if before else F.lit(0.0)
        return F.array(*(self._gap(t) - bias for t in range(self.t0, self.periods)))

    def _more(self) -> dict:
        return {}

    def split_counts(self) -> dict[str, int]:
        """Splits on each feature; leaves count nowhere."""
        out = dict.fromkeys(self.features, 0)
        for t in self.trees:
            for n in t.nodes.values():
                if not n.is_leaf:
                    out[self.features[n.feature]] += 1
        return out

    def export(self) -> list[list[dict]]:
        """Nodes of each tree as plain values; leaves have no feature."""
        out = []
        for t in self.trees:
            nodes = []
            for k, n in sorted(t.nodes.items()):
                effect = n.theta[1] - n.theta[0]
                bias = float(effect[: self.t0].mean()) if self.t0 else 0.0
                nodes.append({"level_id": k, "is_leaf": n.is_leaf, "split_feature": None if n.is_leaf else self.features[n.feature], "bin": n.bin, "bound": n.bound, "children": n.children, "outcomes": n.theta.tolist(), "eta": [n.eta, -n.eta], "bias": bias, "effect": effect.tolist(), "debiased_effect": (effect - n.eta if self.did else effect[self.t0 :] - bias).tolist()})
            out.append(nodes)
        return out

    def save(self, spark, path: str) -> None:
        """Bounds and nodes as rows of JSON."""
        rows = [(-1, json.dumps({"bounds": self.bounds, "features": self.features, "t0": self.t0, "periods": self.periods, "width": self.width, "dictionaries": self.dictionaries, "trivial": self.trivial}))] + [(i, json.dumps(t)) for i, t in enumerate(self.export())]
        spark.createDataFrame(rows, "tree int, json string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, config: Config | None = None) -> Boosting:
        out = cls(config)
        for r in spark.read.parquet(path).orderBy("tree").collect():
            x = json.loads(r.json)
            if r.tree < 0:
                out.bounds, out.features, out.t0, out.periods, out.width = x["bounds"], x["features"], x["t0"], x["periods"], x["width"]
                out.dictionaries, out.trivial = x.get("dictionaries", {}), x.get("trivial", [])
            else:
                out.trees.append(Tree({n["level_id"]: Node(n["level_id"], np.array(n["outcomes"]), n["eta"][0], None if n["is_leaf"] else out.features.index(n["split_feature"]), n["bin"], n["bound"], n["children"]) for n in x}))
        return out


class GradientBoostingCausalRegressionTree(Boosting):
    """Debiased by the mean gap of the arms before treatment."""


class GradientBoostingUpliftTree(Boosting):
    """For outcomes of 0 and 1: effects are differences of logits."""

    loss = Logistic()


class DifferenceInDifferencesRegressionTree(Boosting):
    """Arms keep a parallel distance eta before treatment, estimated in each node."""

    did = True

    def _more(self) -> dict:
        return {"eta": lambda: F.col("__eta")}

    def _effect(self) -> Column:
        shift = self.config.learning_rate * F.aggregate("__eta", F.lit(0.0), lambda a, v: a + v)
        return F.array(*(self._gap(t) - shift for t in range(self.t0, self.periods)))
