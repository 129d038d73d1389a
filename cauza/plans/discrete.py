"""Queries over discrete nodes of lineitem: counts, scores, factors, graphs, beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors as X
from ..session import table

NODES = ["x0", "x1", "x2", "x3", "x4", "x5"]
FAMILIES = [("x0", []), ("x0", ["x1"]), ("x0", ["x1", "x2"]), ("x3", ["x4"]), ("x5", ["x0", "x1"])]
GRAPH = {"x0": ["x1"], "x1": [], "x2": [], "x3": ["x2"], "x4": ["x3"], "x5": ["x0"]}
EDGE_GAIN = 20.0


def disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discrete sample frame."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        X.code(F.col("l_returnflag"), ["A", "N", "R"]).alias("x0"), X.code(F.col("l_linestatus"), ["F", "O"]).alias("x1"), F.col("l_linenumber").cast("int").alias("x2"),
        F.round(F.col("l_discount") * 100).cast("int").alias("x3"), F.round(F.col("l_tax") * 100).cast("int").alias("x4"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("x5"),
    )


DISC = """disc AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::INT AS x0, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INT AS x1, l_linenumber::INT AS x2,
  round(l_discount * 100)::INT AS x3, round(l_tax * 100)::INT AS x4, ceil(l_quantity / 10)::INT AS x5 FROM lineitem)"""


def _score_sql(node: str, parents: list[str]) -> str:
    pa = ", ".join(parents)
    group = f"GROUP BY {pa}" if parents else ""
    cells = f"SELECT {', '.join([*parents, node])}, count(*) AS n FROM disc GROUP BY ALL"
    return f"(SELECT sum(lgamma(r) - lgamma(r + n_pa) + cell) FROM (SELECT sum(n) AS n_pa, sum(lgamma((n + 1)::DOUBLE)) AS cell FROM ({cells}) {group}), (SELECT count(DISTINCT {node})::DOUBLE AS r FROM disc))"


def label(node: str, parents: list[str]) -> str:
    return f"{node}|{','.join(parents)}"


def k2_family_score(spark, sf_dir):
    names = F.array(*(F.lit(label(*f)) for f in FAMILIES))
    out = X.family_scores(X.compress(disc(spark, sf_dir), NODES), FAMILIES)
    return out.select(F.get(names, F.col("family")).alias("family"), F.round("score", 5).alias("score"))


K2_FAMILY = f"WITH {DISC} " + " UNION ALL ".join(f"SELECT '{label(*f)}' AS family, round({_score_sql(*f)}, 5) AS score" for f in FAMILIES)


def k2_graph_score(spark, sf_dir):
    return X.graph_score(X.compress(disc(spark, sf_dir), NODES), GRAPH).select(F.round("score", 4).alias("score"))


K2_GRAPH = f"WITH {DISC} SELECT round({' + '.join(_score_sql(n, p) for n, p in GRAPH.items())}, 4) AS score"


def _gains(spark, sf_dir) -> DataFrame:
    others = NODES[1:]
    scored = X.family_scores(X.compress(disc(spark, sf_dir), NODES), [("x0", []), *(("x0", [p]) for p in others)])
    base = scored.filter("family = 0").select(F.col("score").alias("base"))
    return scored.filter("family > 0").crossJoin(F.broadcast(base)).select(F.get(F.array(*map(F.lit, others)), F.col("family") - 1).alias("candidate"), (F.col("score") - F.col("base")).alias("gain"))


def k2_candidate_gain(spark, sf_dir):
    return _gains(spark, sf_dir).select("candidate", F.round("gain", 5).alias("gain"))


K2_GAIN = f"WITH {DISC}, base AS (SELECT {_score_sql('x0', [])} AS base) " + " UNION ALL ".join(f"SELECT '{p}' AS candidate, round({_score_sql('x0', [p])} - base, 5) AS gain FROM base" for p in NODES[1:])


def k2_best_parent(spark, sf_dir):
    best = _gains(spark, sf_dir).agg(F.max(F.struct("gain", "candidate")).alias("b"))
    return best.select(F.col("b.candidate").alias("candidate"), F.round("b.gain", 5).alias("gain"), (F.col("b.gain") > EDGE_GAIN).alias("accepted"))


K2_BEST = f"SELECT candidate, gain, gain > {EDGE_GAIN} AS accepted FROM ({K2_GAIN}) ORDER BY gain DESC, candidate DESC LIMIT 1"


def node_domains(spark, sf_dir):
    return X.domains(disc(spark, sf_dir), NODES)


def node_frequencies(spark, sf_dir):
    return X.frequencies(X.compress(disc(spark, sf_dir), NODES), NODES).select("node", "value", "n", F.round("freq", 9).alias("freq"))


DOMAINS = f"WITH {DISC} " + " UNION ALL ".join(f"SELECT '{n}' AS node, count(DISTINCT {n}) AS n_values FROM disc" for n in NODES)
FREQUENCIES = f"WITH {DISC} " + " UNION ALL ".join(f"SELECT '{n}' AS node, {n} AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM disc), 9) AS freq FROM disc GROUP BY {n}" for n in NODES)


def _factor(spark, sf_dir) -> DataFrame:
    return X.factor(disc(spark, sf_dir), "x0", ["x1", "x5"])


FACTOR = f"""{DISC}, cells AS (SELECT x0, x1, x5, count(*) AS n FROM disc GROUP BY ALL),
factor AS (SELECT x0, x1, x5, (1 + n) / ((SELECT count(DISTINCT x0) * count(DISTINCT x1) * count(DISTINCT x5) FROM cells) + (SELECT sum(n) FROM cells))::DOUBLE AS score FROM cells)"""


def factor_parameters(spark, sf_dir):
    return _factor(spark, sf_dir).withColumn("score", F.round("score", 10))


def factor_evidence(spark, sf_dir):
    return X.normalise(X.evidence(_factor(spark, sf_dir), {"x1": [1], "x5": [1, 2, 3], "x9": [0]})).withColumn("score", F.round("score", 9))


def factor_normalise(spark, sf_dir):
    return X.normalise(_factor(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _x1(spark, sf_dir) -> DataFrame:
    return X.frequencies(disc(spark, sf_dir), ["x1"]).select(F.col("value").alias("x1"), F.col("freq").alias("score"))


def factor_message(spark, sf_dir):
    incoming = X.evidence(_x1(spark, sf_dir), {"x1": [1]})
    return X.normalise(X.marginal(X.message(_factor(spark, sf_dir), incoming, "x1"), ["x0"])).withColumn("score", F.round("score", 9))


def factor_do_marginal(spark, sf_dir):
    return X.marginal(_factor(spark, sf_dir), ["x0"]).withColumn("score", F.round("score", 9))


def belief_deviation(spark, sf_dir):
    a = X.normalise(X.marginal(_factor(spark, sf_dir), ["x1"]))
    return X.deviation(a, X.evidence(_x1(spark, sf_dir), {"x1": [1]}), "x1").select(F.round("deviation", 9).alias("deviation"))


EVIDENCE = f"WITH {FACTOR}, e AS (SELECT x0, x1, x5, CASE WHEN x1 = 1 AND x5 IN (1, 2, 3) THEN score ELSE 0 END AS score FROM factor) SELECT x0, x1, x5, round(score / ((SELECT sum(score) FROM e) + 1e-8), 9) AS score FROM e"
NORMALISE = f"WITH {FACTOR} SELECT x0, x1, x5, round(score / ((SELECT sum(score) FROM factor) + 1e-8), 9) AS score FROM factor"
MESSAGE = f"""WITH {FACTOR}, m AS (SELECT x1, CASE WHEN x1 = 1 THEN count(*) / (SELECT count(*) FROM disc) ELSE 0 END AS score FROM disc GROUP BY x1),
s AS (SELECT x0, sum(f.score * coalesce(m.score, 1)) AS score FROM factor f LEFT JOIN m USING (x1) GROUP BY x0) SELECT x0, round(score / ((SELECT sum(score) FROM s) + 1e-8), 9) AS score FROM s"""
DO_MARGINAL = f"WITH {FACTOR} SELECT x0, round(sum(score), 9) AS score FROM factor GROUP BY x0"
DEVIATION = f"""WITH {FACTOR}, a AS (SELECT x1, sum(score) / ((SELECT sum(score) FROM factor) + 1e-8) AS score FROM factor GROUP BY x1),
b AS (SELECT x1, CASE WHEN x1 = 1 THEN count(*) / (SELECT count(*) FROM disc) ELSE 0 END AS score FROM disc GROUP BY x1) SELECT round(sum(abs(coalesce(a.score, 0) - coalesce(b.score, 0))), 9) AS deviation FROM a FULL JOIN b USING (x1)"""


def attribution_step1(spark, sf_dir):
    """P(x1 = 1 | feature = value) of each single condition, best first."""
    rows = X.compress(disc(spark, sf_dir), NODES)
    singles = rows.select("x1", X.COUNT, F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(n).alias("value")) for n in NODES if n != "x1"))).alias("c"))
    scored = singles.groupBy("c.node", "c.value").agg((F.sum(F.when(F.col("x1") == 1, F.col(X.COUNT)).otherwise(0)) / F.sum(X.COUNT)).alias("score"))
    return scored.select("node", "value", F.round("score", 9).alias("score")).filter("score >= 0.5").orderBy(F.desc("score"), "node", "value").limit(10)


ATTRIBUTION = f"WITH {DISC}, s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS node, {n} AS value, round(count(*) FILTER (x1 = 1) / count(*), 9) AS score FROM disc GROUP BY {n}" for n in NODES if n != "x1") + ") SELECT * FROM s WHERE score >= 0.5 ORDER BY score DESC, node, value LIMIT 10"


QUERIES = {
    "k2_family_score": (k2_family_score, K2_FAMILY), "k2_graph_score": (k2_graph_score, K2_GRAPH), "k2_candidate_gain": (k2_candidate_gain, K2_GAIN), "k2_best_parent": (k2_best_parent, K2_BEST),
    "node_domains": (node_domains, DOMAINS), "node_frequencies": (node_frequencies, FREQUENCIES), "factor_parameters": (factor_parameters, f"WITH {FACTOR} SELECT x0, x1, x5, round(score, 10) AS score FROM factor"),
    "factor_evidence": (factor_evidence, EVIDENCE), "factor_normalise": (factor_normalise, NORMALISE), "factor_message": (factor_message, MESSAGE), "factor_do_marginal": (factor_do_marginal, DO_MARGINAL), "belief_deviation": (belief_deviation, DEVIATION),
    "attribution_step1": (attribution_step1, ATTRIBUTION),
}
