"""One step of each debiasing network under fixed weights: the classes' own losses and scores over batches of events, and the same networks spelled out in SQL."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ..operators.debias import MODELS
from .effects import EVT, evt

BATCH, HIDDEN, FEATURES = 64, (3, 2), ["f1", "f2"]
#: Model and options of each query.
CASES = {
    "ipw": ("ipw", {}), "ips": ("ips", {}), "dr": ("dr", {}), "dr_classes": ("dr", {"treatment": "K", "classes": 3, "encode": True, "encode_width": 2}), "cfr": ("cfr", {}), "dice": ("dice", {}),
    "dmbr": ("dmbr", {}), "fairco": ("fairco", {"group_count": 5}), "macr": ("macr", {"user": ["f1"], "item": ["f2", "W"], "task_hidden": (2,)}), "pda": ("pda", {}), "tmodel": ("tmodel", {}),
}


def model(case: str):
    """The network with weights that depend on nothing but its shape."""
    name, options = CASES[case]
    out = MODELS[name](FEATURES, hidden=HIDDEN, **options)
    rnd = np.random.default_rng(11)
    out.params = {k: np.round(v + rnd.normal(0, 0.2, v.shape), 3) for k, v in out.init(rnd).items()}
    return out


def _frame(spark, sf_dir):
    return evt(spark, sf_dir).select("event_id", "f1", "f2", "y", "T", "W", "G", (F.col("G") % 3).alias("K"), F.expr(f"event_id div {BATCH}").alias("batch"))


def _query(case: str, spark, sf_dir):
    df, own = _frame(spark, sf_dir), model(case)
    own.finish(df)
    return own.batch_losses(df, "batch").select("batch", "n", F.round("loss", 5).alias("loss"), F.round("score", 6).alias("score"))


class Steps:
    """A chain of CTEs, each of which adds columns to the one before it."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params, self.ctes, self.last = params, [EVT, f"s0 AS (SELECT *, g % 3 AS k, event_id // {BATCH} AS batch FROM evt)"], "s0"

    def add(self, **columns: str) -> None:
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.last})")
        self.last = name

    def dense(self, name: str, inputs: list[str], layers: int, last: bool = False) -> list[str]:
        for i in range(layers):
            w, b = self.params[f"{name}.w{i}"], self.params[f"{name}.b{i}"]
            rows = {}
            for j in range(w.shape[1]):
                z = f"({float(b[j])!r}" + "".join(f" + ({float(w[k, j])!r}) * {c}" for k, c in enumerate(inputs)) + ")"
                rows[f"{name.replace('.', '_')}_{i}_{j}"] = f"greatest({z}, 0)" if i < layers - 1 or last else z
            self.add(**rows)
            inputs = list(rows)
        return inputs

    def sql(self, loss: str, score: str, batch: str = "0") -> str:
        """loss and score of a row, batch: what is added for each batch."""
        return f"WITH {', '.join(self.ctes)} SELECT batch, count(*) AS n, round(sum({loss}) + any_value({batch}), 5) AS loss, round(sum({score}), 6) AS score FROM {self.last} GROUP BY batch"


def _bce(z: str, y: str = "y") -> str:
    return f"(greatest({z}, 0) - ({z}) * ({y}) + ln(1 + exp(-abs({z}))))"


def _sig(z: str) -> str:
    return f"(1 / (1 + exp(-({z}))))"


def _sql(case: str) -> str:
    name, _ = CASES[case]
    own = model(case)
    s, o = Steps(own.params), own.options
    if name in ("ipw", "ips", "fairco", "pda"):
        (z,) = s.dense("dnn", FEATURES, 3)
        if name == "ipw":
            return s.sql(f"{_bce(z)} * least(greatest(1 / w, 0.01), 1)", _sig(z))
        if name == "ips":
            u, v = s.dense("prop", FEATURES, 3)
            s.add(ce=f"ln(exp({u}) + exp({v})) - CASE WHEN t = 0 THEN {u} ELSE {v} END")
            return s.sql(f"{_bce(z)} * least(exp(ce), 100) + 0.1 * ce", _sig(z))
        if name == "pda":
            return s.sql(_bce(z), f"{z} * w ** 0.1")
        groups = range(1, 6)
        s.add(**{f"r{g}": f"coalesce(avg({_sig(z)}) FILTER (g = {g}) OVER q / avg(w) FILTER (g = {g}) OVER q, 1)" for g in groups})
        s.ctes[-1] = s.ctes[-1][:-1] + " WINDOW q AS (PARTITION BY batch))"
        s.add(size="count(*) OVER (PARTITION BY batch)")
        gap = " + ".join(f"abs(r{a} - r{b})" for a in groups for b in groups)
        return s.sql(_bce(z), _sig(z), f"({gap}) * 0.01 * 0.01 / 2 * size")
    if name == "dr":
        t = o["treatment"].lower()
        emb = s.dense("emb", FEATURES, 2, True)
        prop = s.dense("prop", emb, 1)
        if o["encode"]:
            emb = [*emb, *s.dense("enc", [t], 1, True)]
        (impute,), (dr,) = s.dense("impute", emb, 1), s.dense("dr", emb, 1)
        if len(prop) == 1:
            s.add(own=_bce(prop[0], t), share=f"greatest({_sig(prop[0])}, 0.01)")
        else:
            s.add(own=f"ln({' + '.join(f'exp({c})' for c in prop)}) - CASE {t} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(prop)) + " END")
            s.add(share="greatest(exp(-own), 0.01)")
        s.add(guess=_bce(dr, _sig(impute)))
        return s.sql(f"own + {_bce(impute)} / share + ({_bce(dr)} - guess) * ({t} > 0)::INT / share + guess", _sig(dr))
    if name == "cfr":
        emb = s.dense("emb", FEATURES, 2, True)
        (tr,), (co,) = s.dense("tr", emb, 1), s.dense("co", emb, 1)
        d = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in emb)
        s.ctes.append(f"pairs AS (SELECT a.batch, a.event_id = b.event_id AS same, a.t AS ta, b.t AS tb, exp(-({d}) / 4.0) AS e FROM {s.last} a JOIN {s.last} b USING (batch))")
        s.ctes.append("sizes AS (SELECT batch, count(*) FILTER (same AND ta = 0)::DOUBLE AS m, count(*) FILTER (same AND ta = 1)::DOUBLE AS n1, sum(e) FILTER (ta = 0 AND tb = 0) AS cc, sum(e) FILTER (ta = 1 AND tb = 1) AS tt, sum(e) FILTER (ta = 1 AND tb = 0) AS ct FROM pairs GROUP BY batch)")
        s.ctes.append("kernel AS (SELECT batch, (m + n1) * CASE WHEN m > 1 AND n1 > 1 THEN 4 * ((m / (m + n1)) ** 2 * (cc - m) / (m * (m - 1)) + (n1 / (m + n1)) ** 2 * (tt - n1) / (n1 * (n1 - 1)) - 2 * (n1 / (m + n1)) * (m / (m + n1)) * ct / (m * n1)) ELSE 0 END AS mmd FROM sizes)")
        s.ctes.append(f"joined AS (SELECT * FROM {s.last} JOIN kernel USING (batch))")
        s.last = "joined"
        return s.sql(f"CASE WHEN t = 1 THEN {_bce(tr)} ELSE {_bce(co)} END", f"{tr} - {co}", "0.1 * mmd")
    if name == "dice":
        a, b = s.dense("int", FEATURES, 2, True), s.dense("con", FEATURES, 2, True)
        (click,), (hi,), (hc,) = s.dense("click", a + b, 1), s.dense("hi", a, 1), s.dense("hc", b, 1)
        far = " + ".join(f"({x} - {y}) ** 2" for x, y in zip(a, b))
        return s.sql(f"{_bce(click)} + 0.1 * CASE WHEN t = 1 THEN {_bce(hi)} ELSE {_bce(hc)} END - 0.01 * ({far}) / {len(a)}", _sig(click))
    if name == "dmbr":
        emb, conf = s.dense("emb", FEATURES, 2, True), s.dense("conf", ["w"], 1, True)
        found = []
        for over, tag in (("PARTITION BY batch", "b"), ("", "a")):
            s.add(**{f"m{tag}{i}": f"avg({c}) OVER ({over})" for i, c in enumerate(conf)})
            # half of (e + m)^2 - e^2 - m^2
            s.add(**{f"x{tag}{i}": f"{c} * m{tag}{i}" for i, c in enumerate(emb)})
            w = {k: v for k, v in own.params.items() if k.startswith("out.")}
            part = Steps(w | {k.replace("out.", f"out{tag}."): v for k, v in w.items()})
            part.ctes, part.last = s.ctes, s.last
            found += part.dense(f"out{tag}", [*FEATURES, *(f"x{tag}{i}" for i in range(len(emb)))], 3)
            s.last = part.last
        return s.sql(_bce(found[0]), _sig(found[1]))
    if name == "macr":
        heads, parts = [], []
        for side, columns in (("user", ["f1"]), ("item", ["f2", "w"])):
            trunk = s.dense(f"{side}.trunk", columns, 2, True)
            direct, part = s.dense(f"{side}.task0", trunk, 1), s.dense(f"{side}.task1", trunk, 1)
            heads += s.dense(f"{side}.head", direct, 1)
            parts.append(part)
        s.add(hit=" + ".join(f"{a} * {b}" for a, b in zip(*parts)))
        return s.sql(f"{_bce('hit')} + 1e-4 * {_bce(heads[0])} + 1e-4 * {_bce(heads[1])}", f"(hit - 0.001) * {_sig(heads[0])} * {_sig(heads[1])}")
    base = s.dense("base", FEATURES, 2, True)
    (test,), (control,) = s.dense("test", base, 2), s.dense("control", base, 2)
    return s.sql(f"CASE WHEN t = 1 THEN {_bce(test)} ELSE {_bce(control)} END", f"{_sig(test)} - {_sig(control)}")


QUERIES = {f"{case}_batch": (partial(_query, case), _sql(case)) for case in CASES}
