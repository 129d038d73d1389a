"""Loopy belief propagation over tables, for factors that the driver should not hold.

A factor's observed combinations are rows (f, cell, score) with their nodes and values beside them, (f, cell, node, value).
They are dealt by (f, cell) and written once for each intervention; an iteration then reads them in place. Messages are
tables (f, node, value, m), as large as the nodes' domains. An iteration is one pass over the rows (each takes the
messages of its nodes, and the product of the others goes to each node by partial sums) and one over the messages, which
are written at its end. Products without one of the terms come from sums of logarithms and counts of zeros.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

FLOOR = 1e-8


def scored(cells: DataFrame, nodes: Sequence[Sequence[str]]) -> DataFrame:
    """(family, codes, score, n) from counts (family, codes, n): smoothed joint frequencies. nodes: each family's node and its parents, as their codes lie."""
    names = [f[0] for f in nodes]
    sizes = cells.groupBy("family").agg(F.countDistinct(F.get("codes", F.lit(0))).cast("double").alias("r"), F.sum("n").alias("total")).collect()  # a row for each node
    r = {names[x.family]: x.r for x in sizes}
    product, total = {}, {x.family: float(x.total) for x in sizes}
    for i, f in enumerate(nodes):
        product[i] = 1.0
        for m in f:
            product[i] *= r.get(m, 1.0)
    below = F.get(F.array(*(F.lit(product[i] + total.get(i, 0.0)) for i in range(len(nodes)))), F.col("family"))
    return checkpointed(cells.select("family", "codes", ((1 + F.col("n")) / below).alias("score"), "n"))


def domains(cells: DataFrame, nodes: Sequence[Sequence[str]]) -> DataFrame:
    """(node, value, freq) of each node, from its own family."""
    own = cells.groupBy(F.get(F.array(*(F.lit(f[0]) for f in nodes)), F.col("family")).alias("node"), F.get("codes", F.lit(0)).alias("value")).agg(F.sum("n").alias("n"))
    return checkpointed(own.select("node", "value", (F.col("n") / F.sum("n").over(W.partitionBy("node"))).alias("freq")))


def _shared(x: Column, *keys: str) -> Column:
    return x / (F.sum(x).over(W.partitionBy(*keys)) + FLOOR)


def _others(x: Column, *keys: str) -> Column:
    """The product of x over the rows of equal keys, without the own one."""
    by = W.partitionBy(*keys)
    log, zero = F.when(x > 0, F.ln(x)).otherwise(0.0), (x <= 0).cast("int")
    return F.when(F.sum(zero).over(by) > zero, 0.0).otherwise(F.exp(F.sum(log).over(by) - log))


def _allowed(node: Column, value: Column, allowed: Mapping[str, Sequence[int]]) -> Column:
    keep = F.lit(True)
    for n, values in allowed.items():
        keep = keep & ((node != n) | (value.isin(*values) if len(values) else F.lit(False)))
    return keep


def _evidence(cells: DataFrame, nodes: Sequence[Sequence[str]], allowed: Mapping[str, Sequence[int]], target: str) -> DataFrame:
    """(f, cell, node, value, score) of all factors under the evidence; that of the target is its marginal."""
    out = F.lit(False)
    for i, f in enumerate(nodes):
        for at, n in enumerate(f):
            if n in allowed:
                value = F.get("codes", F.lit(at))
                out = out | ((F.col("family") == i) & ~(value.isin(*allowed[n]) if len(allowed[n]) else F.lit(False)))
    score = F.when(out, 0.0).otherwise(F.col("score"))
    sums = cells.groupBy("family").agg(F.sum(score).alias("whole"))
    rows = cells.join(F.broadcast(sums), "family").select("family", "codes", (score / (F.col("whole") + FLOOR)).alias("score"))  # a row for each node
    own = next(i for i, f in enumerate(nodes) if f[0] == target)
    cut = rows.filter(F.col("family") == own).groupBy("family", F.array(F.get("codes", F.lit(0))).alias("codes")).agg(F.sum("score").alias("score"))
    rows = rows.filter(F.col("family") != own).unionByName(cut).withColumn("cell", F.xxhash64("codes"))
    names = F.get(F.array(*(F.array(*map(F.lit, f)) for f in nodes)), F.col("family"))
    long = rows.select(F.col("family").alias("f"), "cell", "codes", "score", F.posexplode(F.arrays_zip(F.slice(names, F.lit(1), F.size("codes")).alias("node"), F.col("codes").alias("value"))).alias("at", "x"))
    # codes stay in the key, as hashes alone may collide
    return checkpointed(long.select("f", "cell", "codes", F.col("x.node").alias("node"), F.col("x.value").alias("value"), "score").repartition("f", "cell"))


def propagate(cells: DataFrame, nodes: Sequence[Sequence[str]], values: DataFrame, do: Mapping[str, Sequence[int]], condition: Mapping[str, Sequence[int]], iterations: int, tolerance: float) -> DataFrame:
    """(node, value, belief) under do, given the condition; cells from scored(), values from domains()."""
    allowed, (target,) = {**condition, **do}, do
    rows = _evidence(cells, nodes, allowed, target)
    keep = _allowed(F.col("node"), F.col("value"), allowed).cast("double")
    uniform = 1.0 / F.count(F.lit(1)).over(W.partitionBy("node"))
    prior = values.select("node", "value", (keep * uniform).alias("p"), (keep * F.col("freq")).alias("q"))
    prior = checkpointed(prior.select("node", "value", _shared(F.col("p"), "node").alias("prior"), _shared(F.col("q"), "node").alias("start")))
    edges = [(i, n) for i, f in enumerate(nodes) for n in (f if f[0] != target else [target])]
    grid = prior.sparkSession.createDataFrame(edges, "f int, node string").join(prior, "node")
    messages = grid.select("f", "node", "value", F.col("start").alias("m"))
    beliefs = prior.select("node", "value", F.col("prior").alias("belief"))
    for _ in range(iterations):
        sent = rows.join(messages, ["f", "node", "value"])
        sent = sent.withColumn("x", F.col("score") * _others(F.col("m"), "f", "cell", "codes"))
        sums = sent.groupBy("f", "node", "value").agg(F.sum("x").alias("x"))
        to_node = grid.join(sums, ["f", "node", "value"], "left").withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("x", _shared(F.col("x"), "f", "node"))
        rest = _others(F.col("x"), "node", "value")
        state = checkpointed(to_node.select("f", "node", "value", "prior", "x", (F.col("prior") * rest).alias("m")))
        messages = state.select("f", "node", "value", _shared(F.col("m"), "f", "node").alias("m"))
        product = F.when(F.min("x") <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(F.col("x") > 0, F.col("x"))))))
        new = state.groupBy("node", "value").agg((F.first("prior") * product).alias("b")).select("node", "value", _shared(F.col("b"), "node").alias("belief"))
        new = checkpointed(new)
        change = new.join(beliefs.withColumnRenamed("belief", "old"), ["node", "value"]).agg(F.sum(F.abs(F.col("belief") - F.col("old")))).first()[0]
        beliefs = new
        if (change or 0.0) < tolerance:
            break
    return beliefs
