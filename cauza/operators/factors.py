"""Contingency counts, Bayesian family scores and factor tables over discrete nodes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import lgamma

COUNT = "n_rows"


def compress(df: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Distinct rows of the nodes with their number; every later count is a weighted sum over these."""
    return df.groupBy(*nodes).agg(F.count(F.lit(1)).alias(COUNT))


def counted(df: DataFrame) -> DataFrame:
    return df if COUNT in df.columns else df.withColumn(COUNT, F.lit(1).cast("long"))


def domains(df: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """(node, n_values): exact distinct counts of all nodes in one pass."""
    wide = df.agg(*(F.countDistinct(n).alias(n) for n in nodes))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(n).alias("n_values")) for n in nodes))).alias("d")).select("d.node", "d.n_values")


def frequencies(df: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """(node, value, n, freq) of all nodes in one pass."""
    rows = counted(df).select(COUNT, F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(n).cast("int").alias("value")) for n in nodes))).alias("d"))
    n = rows.groupBy("d.node", "d.value").agg(F.sum(COUNT).alias("n"))
    return n.select("node", "value", "n", (F.col("n") / F.sum("n").over(W.partitionBy("node"))).alias("freq"))


def family_scores(df: DataFrame, families: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(family, node, score) by the K2 metric: for each observed parent row lnG(r) - lnG(r + N_pa), for each cell lnG(1 + N).

    All families are counted in one job: rows are stacked, keyed by family, and counted on values of node and parents.
    Input rows may carry weights in COUNT.
    """
    df = counted(df)
    nodes = sorted({n for f in families for n in (f[0], *f[1])})
    r = df.agg(*(F.countDistinct(n).alias(n) for n in nodes))
    stacked = F.array(*(F.struct(F.lit(i).alias("family"), F.col(node).cast("int").alias("x"), F.array(*(F.col(p).cast("int") for p in parents)).cast("array<int>").alias("pa")) for i, (node, parents) in enumerate(families)))
    cells = df.select(COUNT, F.explode(stacked).alias("f")).groupBy("f.family", "f.pa", "f.x").agg(F.sum(COUNT).alias("n"))
    rows = cells.groupBy("family", "pa").agg(F.sum("n").alias("n_pa"), F.sum(lgamma((F.col("n") + 1).cast("double"))).alias("cell"))
    sizes = r.select(F.explode(F.array(*(F.struct(F.lit(i).alias("family"), F.lit(node).alias("node"), F.col(node).cast("double").alias("r")) for i, (node, _) in enumerate(families)))).alias("s")).select("s.*")
    scored = rows.join(F.broadcast(sizes), "family")  # a row for each family
    return scored.groupBy("family", "node").agg(F.sum(lgamma(F.col("r")) - lgamma(F.col("r") + F.col("n_pa")) + F.col("cell")).alias("score"))


def subset_scores(df: DataFrame, nodes: Sequence[str], parents: int) -> DataFrame:
    """(node, parents, score) of every family of at most ``parents`` parents, from one pass over the rows.

    The cells of each set of up to parents + 1 nodes are counted once; a set's cells then serve every family that it holds,
    each of its nodes in turn with the others as parents. Parents are in the order of names.
    """
    names = sorted(nodes)
    sets = [c for k in range(1, parents + 2) for c in combinations(names, k)]
    df = counted(df)
    every = F.array(*(F.struct(F.lit(i).alias("subset"), F.array(*(F.col(f"`{n}`").cast("int") for n in c)).alias("codes")) for i, c in enumerate(sets)))
    cells = df.select(COUNT, F.explode(every).alias("c")).groupBy("c.subset", "c.codes").agg(F.sum(COUNT).alias("n"))
    turns = cells.select("subset", "codes", "n", F.explode(F.sequence(F.lit(1), F.size("codes"))).alias("at"))
    others = F.concat(F.slice("codes", F.lit(1), F.col("at") - 1), F.slice("codes", F.col("at") + 1, F.size("codes")))
    rows = turns.groupBy("subset", "at", others.alias("pa")).agg(F.sum("n").alias("n_pa"), F.sum(lgamma((F.col("n") + 1).cast("double"))).alias("cell"))
    r = df.agg(*(F.countDistinct(n).alias(n) for n in names))
    families = [(i, at, c[at - 1], [m for m in c if m != c[at - 1]]) for i, c in enumerate(sets) for at in range(1, len(c) + 1)]
    sizes = r.select(F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(n).cast("double").alias("r")) for n in names))).alias("s")).select("s.*")
    listed = df.sparkSession.createDataFrame(families, "subset int, at int, node string, parents array<string>").join(F.broadcast(sizes), "node")  # a row for each node
    scored = rows.join(F.broadcast(listed), ["subset", "at"])  # a row for each family
    return scored.groupBy("node", "parents").agg(F.sum(lgamma(F.col("r")) - lgamma(F.col("r") + F.col("n_pa")) + F.col("cell")).alias("score"))


def graph_score(df: DataFrame, parents: dict[str, Sequence[str]]) -> DataFrame:
    """(score): sum of the family scores of a graph."""
    return family_scores(df, [(n, list(p)) for n, p in parents.items()]).agg(F.sum("score").alias("score"))


def factor(df: DataFrame, node: str, parents: Sequence[str]) -> DataFrame:
    """(node, parents..., score): smoothed joint frequencies (1 + n) / (product of domain sizes + N) of observed rows."""
    names = [node, *parents]
    df = counted(df)
    cells = df.groupBy(*names).agg(F.sum(COUNT).alias("n"))
    sizes = cells.agg(F.sum("n").alias("total"), *(F.countDistinct(n).alias(f"r_{n}") for n in names))
    product = F.lit(1)
    for n in names:
        product = product * F.col(f"r_{n}")
    return cells.crossJoin(F.broadcast(sizes)).select(*names, ((1 + F.col("n")) / (product + F.col("total"))).alias("score"))


def sort_factor(f: DataFrame, by: str) -> DataFrame:
    """Rows of a factor in the order of one column, then of the others."""
    return f.orderBy(by, *(c for c in f.columns if c not in (by, "score")))


def row_names(nodes: Sequence[str]) -> Column:
    """What a row of a factor stands for, as text: ``x = 1 y = 2``."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{n} = "), F.col(n).cast("string")) for n in nodes))


def evidence(f: DataFrame, allowed: dict[str, Sequence[int]]) -> DataFrame:
    """Scores 0 where a column that allowed names has another value; columns that f lacks are passed over."""
    keep = F.lit(True)
    for name, values in allowed.items():
        if name in f.columns:
            keep = keep & F.col(name).isin(*values)
    return f.withColumn("score", F.when(keep, F.col("score")).otherwise(0.0))


def normalise(f: DataFrame) -> DataFrame:
    """Scores over their sum plus 1e-8."""
    return f.withColumn("score", F.col("score") / (F.sum("score").over(W.partitionBy(F.lit(0))) + 1e-8))


def multiply(f: DataFrame, message: DataFrame, key: str) -> DataFrame:
    """Scores times the message's score for the same key; without one they stay."""
    m = message.select(F.col(key), F.col("score").alias("__m"))
    return f.join(F.broadcast(m), key, "left").withColumn("score", F.col("score") * F.coalesce("__m", F.lit(1.0))).drop("__m").select(*f.columns)


def marginal(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    return f.groupBy(*keys).agg(F.sum("score").alias("score"))


def message(f: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """multiply() by a message, then the sum over its key (kept where f has no other column)."""
    rest = [c for c in f.columns if c not in (key, "score")] or [key]
    return marginal(multiply(f, incoming, key), rest)


def deviation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(deviation): sum of absolute differences, matched by value."""
    both = a.select(F.col(key), F.col("score").alias("a")).join(b.select(F.col(key), F.col("score").alias("b")), key, "full")
    return both.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("deviation"))


def code(value: Column, codes: Sequence[str]) -> Column:
    """Place of a value in codes."""
    out = F.lit(None).cast("int")
    for i, c in enumerate(codes):
        out = F.when(value == c, i).otherwise(out)
    return out
