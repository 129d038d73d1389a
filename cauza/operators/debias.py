"""Networks that correct selection, popularity and exposure bias, and the two-tower effect model.

A model is a forward pass and a loss over a batch of named columns. Training takes one Adam step for each mini-batch:
rows are dealt by their hash to ``workers`` partitions, each of which goes through its batches from the same start, and
after an epoch parameters and moments are averaged by rows on the cluster (with one worker this is the plain loop). With
``batch_size=None`` an epoch is one step on the gradient of all rows instead. What is collected is one vector of
parameters. Batch statistics (kernel distances, group means, the confounder mean in training) are those of a mini-batch.
Scoring is a pass over Arrow batches that does not depend on how rows are batched, and works on streaming frames, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .autodiff import Tensor, bce, concat, softmax_ce

P = dict[str, Tensor]


def dense(p: P, name: str, x: Tensor, layers: int, last: bool = False, batch_norm: bool = False, drop: float = 0.0, rnd=None) -> Tensor:
    """A stack of layers with ReLU between them, and after the last one if asked for."""
    for i in range(layers):
        x = x @ p[f"{name}.w{i}"] + p[f"{name}.b{i}"]
        if i < layers - 1 or last:
            if batch_norm:
                x = normed(p, name, i, x, rnd is not None)
            x = x.relu()
            if drop and rnd is not None:
                x = x * ((rnd.random(x.shape) >= drop) / (1 - drop))
    return x


def normed(p: P, name: str, i: int, x: Tensor, training: bool) -> Tensor:
    """A layer's values less their mean, over their deviation: of the batch in training, where these are noted for the moving ones, which count in scoring."""
    mean, var = p.get(f"{name}.mean{i}"), p.get(f"{name}.var{i}")
    if not training and mean is not None:
        return (x - Tensor(mean.value)) / Tensor(np.sqrt(var.value + 1e-3))
    if len(x.value) < 2:
        return x
    center = x.mean(0, keepdims=True)
    x = x - center
    spread = (x * x).mean(0, keepdims=True)
    if training and mean is not None:
        mean.grad, var.grad = center.value.reshape(mean.shape), spread.value.reshape(var.shape)
    return x / (spread + 1e-3).power(0.5)


def is_moving(key: str) -> bool:
    return ".mean" in key or ".var" in key


def moving(params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moving means and variances for each layer that has an offset."""
    layers = [k.rpartition(".b") for k in params if k.rpartition(".b")[1] and k.rpartition(".b")[2].isdigit()]
    return {f"{name}.{what}{i}": np.full(params[f"{name}.b{i}"].shape, start) for name, _, i in layers for what, start in (("mean", 0.0), ("var", 1.0))}


def stack(sizes: list[int], name: str, rnd) -> dict[str, np.ndarray]:
    """He-normal weights."""
    out = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out |= {f"{name}.w{i}": rnd.normal(0, np.sqrt(2 / a), (a, b)), f"{name}.b{i}": np.zeros(b)}
    return out


def fm(fields: list[Tensor]) -> Tensor:
    """Second-order interactions of fields of one width, [rows, width]."""
    total = sum(fields[1:], fields[0])
    squares = sum((f * f for f in fields[1:]), fields[0] * fields[0])
    return (total * total - squares) * 0.5


def rbf_sum(a: Tensor, b: Tensor, sigma: float, block: int = 512) -> Tensor:
    """Sum of exp(-|x - y|^2 / sigma^2) over the rows x of a and y of b; kernels are formed in blocks and not kept."""
    x, y, scale = a.value, b.value, -2 / sigma**2
    ga, gb, total, square = np.zeros_like(x), np.zeros_like(y), 0.0, (y * y).sum(1)
    for at in range(0, len(x), block):
        part = x[at : at + block]
        k = (2 * part) @ y.T  # one array, worked in place
        k -= (part * part).sum(1)[:, None]
        k -= square
        k /= sigma**2
        np.exp(k, out=k)
        rows = k.sum(1)
        total += rows.sum()
        ga[at : at + block] = part * rows[:, None] - k @ y
        if a is b and block >= len(x):  # a kernel of rows with themselves is the same both ways
            gb = ga
        else:
            gb += y * k.sum(0)[:, None] - k.T @ part
    return Tensor(total, ((a, lambda g: g * scale * ga), (b, lambda g: g * scale * gb)))


def mmd(emb: Tensor, t: np.ndarray, sigma: float) -> Tensor | float:
    """Kernel distance of treated and control rows; 0 where an arm has a single row."""
    tr, co = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    n, m = len(tr), len(co)
    if n < 2 or m < 2:
        return 0.0
    p, et, ec = n / (n + m), emb[tr], emb[co]
    return (4 * (1 - p) ** 2 / (m * (m - 1))) * (rbf_sum(ec, ec, sigma) - m) + (4 * p * p / (n * (n - 1))) * (rbf_sum(et, et, sigma) - n) - (8 * p * (1 - p) / (m * n)) * rbf_sum(et, ec, sigma)


def multi_stack(inputs: int, hidden: tuple, tasks: int, task_hidden: tuple, name: str, rnd) -> dict[str, np.ndarray]:
    """Weights of a multi-task network: a trunk, and a stack for each task on top of it."""
    out = stack([inputs, *hidden], f"{name}.trunk", rnd)
    for k in range(tasks):
        out |= stack([hidden[-1], *task_hidden], f"{name}.task{k}", rnd)
    return out


def multi_task(p: P, name: str, x: Tensor, layers: int, tasks: int, task_layers: int, **options) -> list[Tensor]:
    """Outputs of all tasks over one shared trunk (ReLU after its last layer, too)."""
    trunk = dense(p, f"{name}.trunk", x, layers, True, **options)
    return [dense(p, f"{name}.task{k}", trunk, task_layers, False, **options) for k in range(tasks)]


class DebiasModel:
    """fit(df, epochs), predict(df). Columns: features (doubles), label, and what a model names in ``side``."""

    side: tuple = ()

    def __init__(self, features: Iterable[str], label: str = "y", hidden: tuple = (16, 8), rate: float = 0.02, l2: float = 0.0, batch_norm: bool = False, dropout: float = 0.0, seed: int = 1024, batch_size: int | None = 256, workers: int = 8, **options):
        self.batch_size, self.workers = batch_size, workers
        self.features, self.label, self.hidden, self.rate, self.l2, self.batch_norm, self.dropout, self.seed = list(features), label, tuple(hidden), rate, l2, batch_norm, dropout, seed
        self.options = self.defaults() | options
        if unknown := self.options.keys() - self.defaults().keys():
            raise ValueError(f"unknown options: {sorted(unknown)}")
        self.params: dict[str, np.ndarray] | None = None
        self.extra: dict[str, np.ndarray] = {}  # of the fitted model, beside its parameters
        self.losses: list[float] = []
        self._result: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_result": None}  # tasks get the model without the last result, which only the driver can hold

    def defaults(self) -> dict:
        return {}

    def init(self, rnd) -> dict[str, np.ndarray]:
        return stack([len(self.features), *self.hidden, 1], "dnn", rnd)

    def net(self, p: P, name: str, x: Tensor, layers: int | None = None, rnd=None, last: bool = False) -> Tensor:
        return dense(p, name, x, layers or len(self.hidden) + 1, last, self.batch_norm, self.dropout, rnd)

    def loss(self, p: P, x: Tensor, y: np.ndarray, side: dict[str, np.ndarray], rnd) -> Tensor:
        """Sum of losses over the batch."""
        raise NotImplementedError

    def score(self, p: P, x: Tensor, side: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def _side(self, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: pdf[self.options.get(c, c)].to_numpy() for c in self.side if self.options.get(c, c) in pdf}

    def fit(self, df: DataFrame, num_epochs: int = 10) -> DebiasModel:
        names = [self.options.get(c, c) for c in self.side]
        if missing := {*self.features, self.label, *names} - set(df.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        rows = df.select(*(F.col(c).cast("double") for c in [*self.features, self.label]), *(F.col(c) for c in dict.fromkeys(names) if c not in self.features and c != self.label)).cache()
        try:
            self.params = self.init(np.random.default_rng(self.seed))
            if self.batch_norm:
                self.params |= moving(self.params)
            if self.batch_size is None:
                self._descend(rows, num_epochs)
            else:
                self._descend_batches(rows, num_epochs)
            self.finish(rows)
        finally:
            rows.unpersist()
        return self

    def finish(self, rows: DataFrame) -> None:
        """What the fitted model needs beside its parameters."""

    def gradient(self, params: dict[str, np.ndarray], pdf: pd.DataFrame, epoch: int = 0, worker: int = 0, step: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient, summed over the rows; for moving means and variances those of the batch, times the rows."""
        return self._gradient(params, *self._arrays(pdf), epoch, worker, step)

    def _arrays(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Features, label and side columns."""
        return pdf[self.features].to_numpy(float), pdf[self.label].to_numpy(float), self._side(pdf)

    def _gradient(self, params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, side: dict[str, np.ndarray], epoch: int, worker: int, step: int) -> tuple[float, dict[str, np.ndarray]]:
        p, n = {k: Tensor(v) for k, v in params.items()}, len(y)
        rnd = np.random.default_rng([self.seed, epoch, worker, step, n])
        total = self.loss(p, Tensor(x, constant=True), y, side, rnd)
        if self.l2:
            total = total + sum((v * v).sum() for k, v in p.items() if ".w" in k) * (self.l2 * n)
        total.backward()
        held = lambda k, v: n * (params[k] if v.grad is None else v.grad) if is_moving(k) else np.zeros(v.shape) if v.grad is None else v.grad
        return float(total.value), {k: held(k, v) for k, v in p.items()}

    def _descend(self, rows: DataFrame, epochs: int) -> None:
        keys = sorted(self.params)
        m, v = ({k: np.zeros_like(x) for k, x in self.params.items()} for _ in range(2))
        for step in range(1, epochs + 1):
            params = self.params

            def run(parts):
                loss, n, total = 0.0, 0, None
                from pyspark import TaskContext

                for k, pdf in enumerate(parts):
                    if len(pdf):
                        one, g = self.gradient(params, pdf, step, TaskContext.get().partitionId(), k)
                        flat = np.concatenate([g[k].ravel() for k in keys])
                        loss, n, total = loss + one, n + len(pdf), flat if total is None else total + flat
                if n:
                    yield pd.DataFrame({"i": np.arange(-2, len(total)), "g": np.concatenate([[loss, n], total])})

            found = rows.mapInPandas(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").toPandas()["g"].to_numpy()
            loss, n, flat = found[0], found[1], found[2:] / found[1]
            self.losses.append(float(loss / n))
            ends = np.cumsum([self.params[k].size for k in keys])
            self._adam(self.params, m, v, {k: flat[e - self.params[k].size : e].reshape(self.params[k].shape) for k, e in zip(keys, ends)}, step)

    def _adam(self, params: dict, m: dict, v: dict, g: dict, step: float) -> None:
        """One step, in place."""
        for k, x in g.items():
            if is_moving(k):
                params[k] = 0.9 * params[k] + 0.1 * x
                continue
            m[k] += (x - m[k]) * 0.1
            v[k] += (x * x - v[k]) * 0.001
            params[k] = params[k] - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)

    def _descend_batches(self, rows: DataFrame, epochs: int) -> None:
        """An Adam step for each mini-batch in each of the workers; their results are averaged after an epoch."""
        keys, size = sorted(self.params), self.batch_size
        shapes = [self.params[k].shape for k in keys]
        own = [F.col(f"`{c}`") for c in rows.columns]
        dealt = rows.withColumn("__h", F.xxhash64(*own)).repartition(self.workers, "__h").sortWithinPartitions("__h", *own).drop("__h").cache()
        flatten = lambda d: np.concatenate([d[k].ravel() for k in keys])

        def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
            ends = np.cumsum([int(np.prod(x)) for x in shapes])
            return {k: flat[e - int(np.prod(x)) : e].reshape(x).copy() for k, x, e in zip(keys, shapes, ends)}

        state = np.concatenate([flatten(self.params), np.zeros(2 * sum(int(np.prod(x)) for x in shapes))])
        step = 0.0
        try:
            for epoch in range(1, epochs + 1):
                start = state, step

                def run(batches):
                    from pyspark import TaskContext

                    params, m, v = map(parts, np.split(start[0], 3))
                    at, loss, n, worker, step = start[1], 0.0, 0, TaskContext.get().partitionId(), 0
                    for pdf in batches:
                        x, y, side = self._arrays(pdf)
                        for i in range(0, len(pdf), size):
                            part = slice(i, i + size)
                            rows = len(y[part])
                            step += 1
                            one, g = self._gradient(params, x[part], y[part], {k: c[part] for k, c in side.items()}, epoch, worker, step)
                            at += 1
                            self._adam(params, m, v, {k: x / rows for k, x in g.items()}, at)
                            loss, n = loss + one, n + rows
                    if n:
                        flat = np.concatenate([[loss, n, at * n], np.concatenate([flatten(params), flatten(m), flatten(v)]) * n])
                        yield pd.DataFrame({"i": np.arange(-3, len(flat) - 3), "g": flat})

                found = dealt.mapInPandas(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").toPandas()["g"].to_numpy()
                if len(found):
                    state, step = found[3:] / found[1], found[2] / found[1]
                    self.losses.append(float(found[0] / found[1]))
        finally:
            dealt.unpersist()
        self.params = parts(np.split(state, 3)[0])

    def batch_losses(self, df: DataFrame, batch: str) -> DataFrame:
        """(batch, n, loss, score): sums over each batch under the present parameters."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            p = {k: Tensor(v) for k, v in self.params.items()}
            x, side = Tensor(pdf[self.features].to_numpy(float)), self._side(pdf)
            loss = self.loss(p, x, pdf[self.label].to_numpy(float), side, None)
            return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n": [len(pdf)], "loss": [float(loss.value)], "score": [float(np.sum(self.score(p, x, side)))]})

        return df.groupBy(batch).applyInPandas(run, f"`{batch}` {dict(df.dtypes)[batch]}, n bigint, loss double, score double")

    def predict(self, df: DataFrame, key: str = "event_id", name: str = "score") -> DataFrame:
        """(key, score): batch or streaming."""
        params, extra = self.params, [c for c in dict.fromkeys(self.options.get(c, c) for c in self.side) if c in df.columns and c not in self.features]

        def run(parts):
            for pdf in parts:
                p = {k: Tensor(v) for k, v in params.items()}
                values = self.score(p, Tensor(pdf[self.features].to_numpy(float)), self._side(pdf)) if len(pdf) else np.zeros(0)
                yield pd.DataFrame({key: pdf[key], name: np.asarray(values, float).reshape(-1)})

        self._result = df.select(key, *(F.col(c).cast("double") for c in self.features), *extra).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {name} double")
        return self._result

    def get_result(self) -> DataFrame:
        return self._result


def _flat(x: Tensor) -> Tensor:
    return x.sum(-1)


class _OneTower(DebiasModel):
    def score(self, p, x, side):
        return _flat(self.net(p, "dnn", x)).sigmoid().value


class IPW(_OneTower):
    """Cross entropy weighted by the clipped inverse of a given weight."""

    side = ("weight",)

    def defaults(self):
        return {"weight": "W", "a_min": 0.01, "a_max": 1.0}

    def loss(self, p, x, y, side, rnd):
        w = np.clip(1 / np.maximum(side["weight"].astype(float), 1e-12), self.options["a_min"], self.options["a_max"])
        return (bce(_flat(self.net(p, "dnn", x, rnd=rnd)), y) * w).sum()


class IPS(_OneTower):
    """Cross entropy over the propensity of the given treatment class, learned beside it."""

    side = ("treatment",)

    def defaults(self):
        return {"treatment": "T", "classes": 2, "min_propensity": 0.01, "alpha": 0.1}

    def init(self, rnd):
        return super().init(rnd) | stack([len(self.features), *self.hidden, self.options["classes"]], "prop", rnd)

    def loss(self, p, x, y, side, rnd):
        ce = softmax_ce(self.net(p, "prop", x, rnd=rnd), side["treatment"].astype(int))
        weight = np.minimum(np.exp(ce.value), 1 / self.options["min_propensity"])
        return (bce(_flat(self.net(p, "dnn", x, rnd=rnd)), y) * weight).sum() + ce.sum() * self.options["alpha"]


class DR(DebiasModel):
    """Doubly robust: on a shared embedding, towers for the propensity, the imputed outcome and the debiased outcome.

    The error of the last is taken against the label where the row was treated, over its propensity, and against the
    imputed outcome everywhere. With ``classes`` above 2 the propensity is a softmax over treatment classes and class 0 is
    untreated; with ``encode`` the treatment joins the embedding of both outcome towers through a layer of its own.
    """

    side = ("treatment",)

    def defaults(self):
        return {"treatment": "T", "min_propensity": 0.01, "classes": 2, "encode": False, "encode_width": 4}

    def init(self, rnd):
        h, o = self.hidden[-1], self.options
        wide = h + (o["encode_width"] if o["encode"] else 0)
        out = stack([len(self.features), *self.hidden], "emb", rnd) | stack([h, 1 if o["classes"] == 2 else o["classes"]], "prop", rnd) | stack([wide, 1], "impute", rnd) | stack([wide, 1], "dr", rnd)
        return out | (stack([1, o["encode_width"]], "enc", rnd) if o["encode"] else {})

    def _towers(self, p, x, t, rnd=None):
        emb = self.net(p, "emb", x, len(self.hidden), rnd, last=True)
        prop = self.net(p, "prop", emb, 1)
        if self.options["encode"]:
            emb = concat([emb, self.net(p, "enc", Tensor(t[:, None].astype(float)), 1, last=True)])
        return prop, _flat(self.net(p, "impute", emb, 1)), _flat(self.net(p, "dr", emb, 1))

    def loss(self, p, x, y, side, rnd):
        t, floor = side["treatment"], self.options["min_propensity"]
        prop, impute, dr = self._towers(p, x, t, rnd)
        if self.options["classes"] == 2:
            own = bce(_flat(prop), t.astype(float))
            share = np.maximum(_flat(prop).sigmoid().value, floor)
        else:
            own = softmax_ce(prop, t.astype(int))
            share = np.maximum(np.exp(-own.value), floor)
        guess = bce(dr, impute.sigmoid().value)
        return own.sum() + (bce(impute, y) * (1 / share)).sum() + ((bce(dr, y) - guess) * ((t > 0) / share) + guess).sum()

    def score(self, p, x, side):
        return self._towers(p, x, side["treatment"])[2].sigmoid().value


class CFR(DebiasModel):
    """Two outcome heads on an embedding whose arms are drawn together; the score is the effect."""

    side = ("treatment",)

    def defaults(self):
        return {"treatment": "T", "weight": 0.1, "sigma": 2.0}

    def init(self, rnd):
        return stack([len(self.features), *self.hidden], "emb", rnd) | stack([self.hidden[-1], 1], "tr", rnd) | stack([self.hidden[-1], 1], "co", rnd)

    def _heads(self, p, x, rnd=None):
        emb = self.net(p, "emb", x, len(self.hidden), rnd, last=True)
        return emb, _flat(self.net(p, "tr", emb, 1)), _flat(self.net(p, "co", emb, 1))

    def loss(self, p, x, y, side, rnd):
        t = side["treatment"].astype(float)
        emb, tr, co = self._heads(p, x, rnd)
        return (bce(tr, y) * t).sum() + (bce(co, y) * (1 - t)).sum() + mmd(emb, t, self.options["sigma"]) * (self.options["weight"] * len(y))

    def score(self, p, x, side):
        _, tr, co = self._heads(p, x)
        return (tr - co).value


class DICE(DebiasModel):
    """Interest and conformity embeddings kept apart, with a click head on both."""

    side = ("mask",)

    def defaults(self):
        return {"mask": "T", "alpha": 0.1, "beta": 0.01}

    def init(self, rnd):
        h = self.hidden[-1]
        return stack([len(self.features), *self.hidden], "int", rnd) | stack([len(self.features), *self.hidden], "con", rnd) | stack([h, 1], "hi", rnd) | stack([h, 1], "hc", rnd) | stack([2 * h, 1], "click", rnd)

    def _parts(self, p, x, rnd=None):
        a, b = (self.net(p, n, x, len(self.hidden), rnd, last=True) for n in ("int", "con"))
        return a, b, _flat(self.net(p, "click", concat([a, b]), 1))

    def loss(self, p, x, y, side, rnd):
        mask = side["mask"].astype(float)
        a, b, click = self._parts(p, x, rnd)
        own = (bce(_flat(self.net(p, "hi", a, 1)), y) * mask).sum() + (bce(_flat(self.net(p, "hc", b, 1)), y) * (1 - mask)).sum()
        return bce(click, y).sum() + own * self.options["alpha"] - (a - b).power(2).mean(-1).sum() * self.options["beta"]

    def score(self, p, x, side):
        return self._parts(p, x)[2].sigmoid().value


class DMBR(DebiasModel):
    """Interaction of the mean confounder embedding with the feature embedding, beside the features, into a network.

    In training the mean is the mini-batch's; the fitted model holds the mean over all rows that it was fitted on.
    """

    side = ("confounder",)

    def defaults(self):
        return {"confounder": "W"}

    def init(self, rnd):
        h = self.hidden[-1]
        return stack([len(self.features), *self.hidden], "emb", rnd) | stack([1, h], "conf", rnd) | stack([len(self.features) + h, *self.hidden, 1], "out", rnd)

    def _confounders(self, p, side):
        return self.net(p, "conf", Tensor(side["confounder"].astype(float)[:, None]), 1, last=True)

    def _logit(self, p, x, mean, rnd=None):
        emb = self.net(p, "emb", x, len(self.hidden), rnd, last=True)
        return _flat(self.net(p, "out", concat([x, fm([emb, emb * 0.0 + mean])]), rnd=rnd))

    def loss(self, p, x, y, side, rnd):
        return bce(self._logit(p, x, self._confounders(p, side).mean(0, keepdims=True), rnd), y).sum()

    def finish(self, rows):
        params, name, width = self.params, self.options["confounder"], self.hidden[-1]

        def run(parts):
            for pdf in parts:
                total = self._confounders({k: Tensor(v) for k, v in params.items()}, {"confounder": pdf[name].to_numpy()}).value.sum(0)
                yield pd.DataFrame({"i": np.arange(-1, width), "g": np.concatenate([[float(len(pdf))], total])})

        found = rows.select(name).mapInPandas(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").toPandas()["g"].to_numpy()
        self.extra["mean"] = found[1:] / max(1.0, found[0]) if len(found) else np.zeros(width)

    def score(self, p, x, side):
        return self._logit(p, x, Tensor(self.extra["mean"][None, :])).sigmoid().value


class FAIRCO(_OneTower):
    """Cross entropy plus the gap of merit per exposure between groups, numbered from 1."""

    side = ("weight", "group")

    def defaults(self):
        return {"weight": "W", "group": "G", "group_count": 2, "gamma": 0.01, "w": 0.01}

    def loss(self, p, x, y, side, rnd):
        logit = _flat(self.net(p, "dnn", x, rnd=rnd))
        merit, ratios = logit.sigmoid(), []
        for k in range(1, self.options["group_count"] + 1):
            own = np.flatnonzero(side["group"] == k)
            exposure = side["weight"][own].astype(float).mean() if len(own) else 0.0
            ratios.append(merit[own].mean() * (1 / exposure) if exposure > 0 else Tensor(1.0, constant=True))
        gap = sum(((a - b).abs() for i, a in enumerate(ratios) for b in ratios[:i]), Tensor(0.0, constant=True)) * 2.0  # either way round
        return bce(logit, y).sum() + gap * (self.options["w"] * self.options["gamma"] / 2 * len(y))


class MACR(DebiasModel):
    """User and item networks of two tasks: a head for each one's direct effect, and embeddings whose product is the match.

    ``user`` and ``item`` are lists of columns (by default the first half of the features and the rest). The match is
    trained by the label, the heads beside it with small weights; scores take the match above ``sigma`` times both heads.
    """

    def defaults(self):
        return {"user": None, "item": None, "sigma": 0.001, "alpha": 1e-4, "beta": 1e-4, "task_hidden": (8,)}

    def __init__(self, features, *args, **options):
        super().__init__(features, *args, **options)
        half = max(1, len(self.features) // 2)
        self.columns = {"user": list(self.options["user"] or self.features[:half]), "item": list(self.options["item"] or self.features[half:] or self.features[:1])}
        self.features = list(dict.fromkeys([*self.features, *self.columns["user"], *self.columns["item"]]))

    def init(self, rnd):
        task, out = tuple(self.options["task_hidden"]), {}
        for name, columns in self.columns.items():
            out |= multi_stack(len(columns), self.hidden, 2, task, name, rnd) | stack([task[-1], 1], f"{name}.head", rnd)
        return out

    def _heads(self, p, x, rnd=None):
        heads, parts = [], []
        for name, columns in self.columns.items():
            direct, part = multi_task(p, name, x[:, [self.features.index(c) for c in columns]], len(self.hidden), 2, len(self.options["task_hidden"]), batch_norm=self.batch_norm, drop=self.dropout, rnd=rnd)
            heads.append(_flat(self.net(p, f"{name}.head", direct, 1)))
            parts.append(part)
        return _flat(parts[0] * parts[1]), *heads

    def loss(self, p, x, y, side, rnd):
        match, user, item = self._heads(p, x, rnd)
        return bce(match, y).sum() + bce(user, y).sum() * self.options["alpha"] + bce(item, y).sum() * self.options["beta"]

    def score(self, p, x, side):
        match, user, item = self._heads(p, x)
        return ((match - self.options["sigma"]) * user.sigmoid() * item.sigmoid()).value


class PDA(DebiasModel):
    """Trained without popularity; scores take it in with a power."""

    side = ("mit",)

    def defaults(self):
        return {"mit": "W", "gamma": 0.1}

    def loss(self, p, x, y, side, rnd):
        return bce(_flat(self.net(p, "dnn", x, rnd=rnd)), y).sum()

    def score(self, p, x, side):
        return _flat(self.net(p, "dnn", x)).value * np.power(side["mit"].astype(float), self.options["gamma"])


class TModel(DebiasModel):
    """A shared base with a tower for each arm; the factual arm's logit is trained, the score is the effect."""

    side = ("treatment",)

    def defaults(self):
        return {"treatment": "T", "activate_last_test": False}

    def init(self, rnd):
        h = self.hidden[-1]
        return stack([len(self.features), *self.hidden], "base", rnd) | stack([h, 8, 1], "test", rnd) | stack([h, 8, 1], "control", rnd)

    def _towers(self, p, x, rnd=None):
        base = self.net(p, "base", x, len(self.hidden), rnd, last=True)
        return _flat(self.net(p, "test", base, 2, last=self.options["activate_last_test"])), _flat(self.net(p, "control", base, 2))

    def loss(self, p, x, y, side, rnd):
        t = side["treatment"].astype(float)
        test, control = self._towers(p, x, rnd)
        return bce(test * t + control * (1 - t), y).sum()

    def score(self, p, x, side):
        test, control = self._towers(p, x)
        return test.sigmoid().value - control.sigmoid().value


MODELS: dict[str, Callable] = {"ipw": IPW, "ips": IPS, "dr": DR, "cfr": CFR, "dice": DICE, "dmbr": DMBR, "fairco": FAIRCO, "macr": MACR, "pda": PDA, "tmodel": TModel}
