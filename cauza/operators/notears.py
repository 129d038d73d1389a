"""Continuous discovery: a network of any depth for each node, acyclic by a penalty on the trace of a matrix exponential.

The squared error and its gradient are sums over rows: tasks add up their share, the driver takes projected L-BFGS steps
on the parameters, about 2 d^2 hidden + d hidden for one hidden layer, and d times the weights between any further ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import intake
from .graph import CausalGraph


#: Rows of a block: their units' values stay in the cache.
BLOCK = 2048


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor series."""
    norm = np.abs(a).sum(axis=1).max(initial=0.0)
    squarings = max(0, int(np.ceil(np.log2(max(norm, 1e-16)))) + 1)
    a = a / 2**squarings
    out, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 19):
        term = term @ a / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def projected_lbfgs(value, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 50, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """Minimises value(x) -> (f, gradient) inside a box: quasi-Newton directions on free coordinates, projected line search."""
    x = np.clip(x, low, high)
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        stuck = (x <= low) & (g > 0) | (x >= high) & (g < 0)
        free = np.where(stuck, 0.0, g)
        if np.abs(free).max(initial=0.0) < tol:
            break
        q, back = free.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(back)):
            q += (a - (y @ q) / (s @ y)) * s
        direction = -np.where(stuck, 0.0, q)
        if direction @ g >= 0:
            direction, pairs = -free, []
        rate = 1.0 if pairs else min(1.0, 1 / (np.abs(free).sum() + 1e-12))
        for _ in range(25):
            new = np.clip(x + rate * direction, low, high)
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * (g @ (new - x)):
                break
            rate *= 0.5
        else:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - f_new) <= tol * max(1.0, abs(f)) * 1e-3
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


class CausalRegressionDiscovery:
    """Augmented Lagrangian over ½/n of the squared error, ½λ2 of squared weights and λ1 of absolute first-layer weights.

    hidden: the units of the hidden layer, or of each of several; behind the first one a layer connects only units of the same
    node. Subproblems run until they converge (``inner_steps`` is their limit). max_iteration: outer rounds at most; math.inf leaves
    the end to h_tol and rho_max, one of which is met, as each round behind the first quarters h or brings rho to rho_max.
    """

    def __init__(self, max_iteration: float = 3, lambda1: float = 0.1, lambda2: float = 0.1, h_tol: float = 1e-8, rho_max: float = 1e16, w_threshold: float = 0.3, hidden: int | Sequence[int] = 10, inner_steps: int = 15_000, seed: int = 0):
        self.max_iteration, self.lambda1, self.lambda2, self.h_tol, self.rho_max, self.w_threshold, self.hidden, self.inner_steps, self.seed = max_iteration, lambda1, lambda2, h_tol, rho_max, w_threshold, hidden, inner_steps, seed
        self.widths = [hidden] if isinstance(hidden, int) else list(hidden)
        if not self.widths or min(self.widths) < 1:
            raise ValueError("a network needs a hidden layer")
        self.weights: np.ndarray | None = None
        self.result = None

    def shapes(self, d: int) -> list[tuple[int, ...]]:
        """Of the parameters in their order: first layer's positive and negative parts, its offsets, then weights and offsets of each further layer."""
        m = self.widths[0]
        out = [(d, m, d), (d, m, d), (d, m)]
        for a, b in zip(self.widths, [*self.widths[1:], 1], strict=True):
            out += [(d, a, b), (d, b)]
        return out

    def _unpack(self, flat: np.ndarray, d: int) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes(d):
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    def partial(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """½ squared error of rows and its gradient."""
        pos, neg, b1, *deeper = self._unpack(flat, x.shape[1])
        layers = list(zip(deeper[::2], deeper[1::2], strict=True))
        turned = lambda v: v.transpose(0, 2, 1)
        z, inputs = x @ turned(pos - neg) + b1[:, None, :], []  # node, row, unit
        for w, b in layers:
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            inputs.append(np.reciprocal(z, out=z))
            z = inputs[-1] @ w + b[:, None, :]
        error = z[:, :, 0] - x.T
        back, grads = error[:, :, None], []
        for (w, _), a in zip(reversed(layers), reversed(inputs), strict=True):
            grads = [turned(a) @ back, back.sum(1), *grads]
            back = back @ turned(w)
            back *= a
            back *= 1 - a
        g1 = turned(back) @ x
        return 0.5 * float((error**2).sum()), np.concatenate([g.ravel() for g in (g1, -g1, back.sum(1), *grads)])

    @staticmethod
    def packed(rows: DataFrame) -> DataFrame:
        """(d, x): blocks of up to BLOCK rows of d numbers, as bytes, so that a pass turns no rows into others."""
        d = len(rows.columns)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(at, BLOCK)
                    x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in some.columns], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["d", "x"])

        return rows.select(*(F.col(f"`{c}`").cast("double") for c in rows.columns)).mapInArrow(run, "d int, x binary")

    def squared(self, rows: DataFrame, flat: np.ndarray) -> DataFrame:
        """(i, g): ½ squared error of all rows at i = -1, its derivative by each parameter behind it."""
        return self._squared(self.packed(rows), flat)

    def _squared(self, blocks: DataFrame, flat: np.ndarray) -> DataFrame:
        def run(batches):
            loss, g = 0.0, np.zeros(len(flat))
            for batch in batches:
                for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    a, b = self.partial(flat, np.frombuffer(x.as_buffer()).reshape(-1, d))
                    loss, g = loss + a, g + b
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.concatenate([[loss], g]))], ["i", "g"])

        return blocks.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))

    def fit(self, source, names: list[str] | None = None, spark=None) -> CausalRegressionDiscovery:
        """source: a DataFrame (names choose columns), or what intake() takes."""
        df = source if isinstance(source, DataFrame) else intake(spark, source, names)
        names = names or df.columns
        d, m = len(names), self.widths[0]
        n_w, shapes = d * m * d, self.shapes(len(names))
        behind = sum(int(np.prod(s)) for s in shapes[2:])
        means = df.agg(*(F.avg(c).alias(c) for c in names), F.count(F.lit(1)).alias("n")).first()
        rows, n = self.packed(df.select(*((F.col(c).cast("double") - means[c]).alias(c) for c in names))).cache(), means["n"]

        def squared(flat: np.ndarray) -> tuple[float, np.ndarray]:
            found = self._squared(rows, flat).toPandas().sort_values("i")["g"].to_numpy()  # a sort by Spark is another job
            return found[0] / n, found[1:] / n

        def penalty(flat: np.ndarray) -> tuple[float, np.ndarray]:
            pos, neg, *_ = self._unpack(flat, d)
            w = pos - neg
            a = (w**2).sum(1).T  # a[i, j]: i drives j
            e = expm(a)
            return float(np.trace(e)) - d, 2 * w * e[:, None, :]  # the derivative by a[i, j] is e[j, i]

        low = np.concatenate([np.zeros(2 * n_w), np.full(behind, -np.inf)])
        own = np.zeros((d, m, d), bool)
        own[np.arange(d), :, np.arange(d)] = True
        high = np.concatenate([np.where(own, 0.0, np.inf).ravel()] * 2 + [np.full(behind, np.inf)])
        rnd = np.random.default_rng(self.seed)
        started = [rnd.normal(0, 0.3, s) if len(s) == 3 else np.zeros(s) for s in shapes[3:]]
        flat = np.concatenate([np.abs(rnd.normal(0, 0.1, 2 * n_w)), np.zeros(d * m), *(s.ravel() for s in started)])
        rho, alpha, h = 1.0, 0.0, np.inf
        try:
            rounds = 0
            while rounds < self.max_iteration:
                while rho < self.rho_max:

                    def value(x):
                        f, g = squared(x)
                        hx, gh = penalty(x)
                        pos, neg, _, *deeper = self._unpack(x, d)
                        w = pos - neg
                        f += 0.5 * rho * hx * hx + alpha * hx + 0.5 * self.lambda2 * ((w**2).sum() + sum((v**2).sum() for v in deeper[::2])) + self.lambda1 * x[: 2 * n_w].sum()
                        side = (rho * hx + alpha) * gh + self.lambda2 * w
                        shrunk = [(self.lambda2 * v if k % 2 == 0 else np.zeros_like(v)).ravel() for k, v in enumerate(deeper)]  # offsets are free
                        g = g + np.concatenate([side.ravel() + self.lambda1, -side.ravel() + self.lambda1, np.zeros(d * m), *shrunk])
                        return f, g

                    new = projected_lbfgs(value, flat, low, high, self.inner_steps)
                    h_new = penalty(new)[0]
                    if h_new > 0.25 * h:
                        rho *= 10
                    else:
                        break
                flat, h = new, h_new
                alpha += rho * h
                rounds += 1
                if not h > self.h_tol or rho >= self.rho_max:
                    break
        finally:
            rows.unpersist()
        pos, neg, *_ = self._unpack(flat, d)
        self.weights = np.sqrt(((pos - neg) ** 2).sum(1).T)
        self.weights[np.abs(self.weights) < self.w_threshold] = 0
        graph = CausalGraph(names)
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if self.weights[i, j]:
                    graph.add_edge(a, b)
        self.result = graph
        return self

    def get_result(self) -> tuple[CausalGraph, None]:
        return self.result, None
