"""Queries of effect estimators and of debiasing losses.

evt: events with two features, label purchase, treatment click or view, exposure weight of the user (events over the
largest number of any user), group by event type. Logits are fixed linear forms of the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import learners as L
from ..session import table
from .trees import PANEL, panel_frame

TYPES = ["click", "error", "purchase", "signup", "view"]
SIGMA, BATCH, GAMMA = 8.0, 64, 0.1


def _panel(spark, sf_dir) -> DataFrame:
    p = panel_frame(spark, sf_dir)
    return p.select("id", "w", F.col("c_nationkey").cast("double").alias("x"), F.get("y", F.lit(6)).alias("y"), (F.col("c_nationkey") % 5).alias("strata"), (F.col("id") % 2).alias("fold"))


P = PANEL.split(",\nbinned")[0] + ", p AS (SELECT id, w, c_nationkey::DOUBLE AS x, y[7] AS y, c_nationkey % 5 AS strata, id % 2 AS fold FROM panel)"
LINES = P + ", l AS (SELECT regr_intercept(y, x) FILTER (w = 0) AS a0, regr_slope(y, x) FILTER (w = 0) AS b0, regr_intercept(y, x) FILTER (w = 1) AS a1, regr_slope(y, x) FILTER (w = 1) AS b1 FROM p)"


def tlearner_ols(spark, sf_dir):
    return L.t_learner_line(_panel(spark, sf_dir), "x", "y").groupBy("x").agg(F.round(F.avg("effect"), 8).alias("effect"), F.count(F.lit(1)).alias("n"))


def slearner_ols(spark, sf_dir):
    return L.s_learner_line(_panel(spark, sf_dir), "x", "y").select(F.round("effect", 9).alias("effect"))


def xlearner_ols(spark, sf_dir):
    return L.x_learner_line(_panel(spark, sf_dir), "x", "y").groupBy("x").agg(F.round(F.avg("effect"), 8).alias("effect"), F.count(F.lit(1)).alias("n"))


def dr_aipw_strata(spark, sf_dir):
    return L.aipw_strata(_panel(spark, sf_dir), "strata", "fold", "y").groupBy("strata").agg(F.round(F.avg("psi"), 8).alias("effect"), F.count(F.lit(1)).alias("n"))


def dml_residual_slope(spark, sf_dir):
    return L.dml_strata(_panel(spark, sf_dir), "strata", "fold", "y").select(F.round("effect", 8).alias("effect"))


X_SQL = f"""WITH {LINES}, d AS (SELECT w, x, CASE WHEN w = 0 THEN a1 + b1 * x - y ELSE y - a0 - b0 * x END AS d FROM p, l),
t AS (SELECT regr_intercept(d, x) FILTER (w = 0) AS c0, regr_slope(d, x) FILTER (w = 0) AS d0, regr_intercept(d, x) FILTER (w = 1) AS c1, regr_slope(d, x) FILTER (w = 1) AS d1, avg(w) AS g FROM d)
SELECT x, round(avg(g * (c0 + d0 * x) + (1 - g) * (c1 + d1 * x)), 8) AS effect, count(*) AS n FROM p, t GROUP BY x"""
FOLDS = f"{P}, o AS (SELECT strata, 1 - fold AS fold, avg(w) AS pw, avg(y) AS m, avg(y) FILTER (w = 0) AS m0, avg(y) FILTER (w = 1) AS m1 FROM p GROUP BY ALL)"
S_SQL = f"WITH {P} SELECT round((var_pop(x) * covar_pop(w, y) - covar_pop(x, w) * covar_pop(x, y)) / (var_pop(x) * var_pop(w) - covar_pop(x, w) ** 2), 9) AS effect FROM p"
DR_SQL = f"WITH {FOLDS} SELECT strata, round(avg(m1 - m0 + w * (y - m1) / pw - (1 - w) * (y - m0) / (1 - pw)), 8) AS effect, count(*) AS n FROM p JOIN o USING (strata, fold) GROUP BY strata"
DML_SQL = f"WITH {FOLDS} SELECT round(sum((w - pw) * (y - m)) / sum((w - pw) ** 2), 8) AS effect FROM p JOIN o USING (strata, fold)"


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    users = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = users.agg(F.max("n").alias("top"))
    weight = users.crossJoin(F.broadcast(top)).select("user_id", (F.col("n") / F.col("top")).alias("W"))
    rows = e.join(weight, "user_id").select(
        "event_id", "user_id", (F.col("value") / 100).alias("f1"), (F.hour("ts") / 24).alias("f2"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.col("event_type").isin("click", "view").cast("int").alias("T"), "W",
        F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int").alias("G"),
    )
    return rows.withColumns({"z": 0.3 * F.col("f1") - 0.5 * F.col("f2") + 0.1, "u": 0.2 * F.col("f1"), "v": 0.4 * F.col("f2") - 0.1 * F.col("f1")})


EVT = f"""evt AS (SELECT *, 0.3 * f1 - 0.5 * f2 + 0.1 AS z, 0.2 * f1 AS u, 0.4 * f2 - 0.1 * f1 AS v FROM (
  SELECT event_id, user_id, value / 100 AS f1, hour(ts) / 24 AS f2, (event_type = 'purchase')::INT AS y, (event_type IN ('click', 'view'))::INT AS t, n / max(n) OVER () AS w, list_position({TYPES}, event_type)::INT AS g
  FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)))"""


def _bce(z: str, y: str) -> str:
    return f"(greatest({z}, 0) - ({z}) * {y} + ln(1 + exp(-abs({z}))))"


def _soft(label: str) -> str:
    """Cross entropy of a class under the softmax of u, v."""
    return f"(ln(exp(u) + exp(v)) - CASE WHEN {label} = 0 THEN u ELSE v END)"


def ipw_weighted_bce(spark, sf_dir):
    loss = C.bce_with_logits(F.col("z"), F.col("y")) * C.clipped_inverse(F.col("W"))
    return evt(spark, sf_dir).groupBy("G").agg(F.round(F.avg(loss), 9).alias("loss"), F.count(F.lit(1)).alias("n"))


def ips_outcome_loss(spark, sf_dir):
    ce = C.softmax_ce([F.col("u"), F.col("v")], F.col("T"))
    outcome = C.bce_with_logits(F.col("z"), F.col("y")) * C.capped_inverse(F.exp(-ce))
    return evt(spark, sf_dir).groupBy("T").agg(F.round(F.avg(outcome) + 0.1 * F.avg(ce), 9).alias("loss"))


def dr_loss(spark, sf_dir):
    p = C.floored(C.sigmoid(F.col("v")))
    e, guess = C.bce_with_logits(F.col("z"), F.col("y")), F.pow(F.col("u"), 2)
    prop = C.bce_with_logits(F.col("v"), F.col("T"))
    return evt(spark, sf_dir).groupBy("G").agg(F.round(F.avg(prop) + F.avg(e * F.col("T") / p) + F.avg((e - guess) * F.col("T") / p + guess), 8).alias("loss"))


def cfr_factual_loss(spark, sf_dir):
    part = lambda d, z: F.sum(F.when(F.col("T") == d, C.bce_with_logits(F.col(z), F.col("y")))) / F.sum((F.col("T") == d).cast("int"))
    return evt(spark, sf_dir).agg(F.round(part(1, "u") + part(0, "v"), 9).alias("loss"), F.round(F.avg(F.col("u") - F.col("v")), 9).alias("effect"))


def dice_loss(spark, sf_dir):
    y, mask = F.col("y"), F.col("T")
    click, interest, conformity = (C.bce_with_logits(F.col(c), y) for c in ("z", "u", "v"))
    return evt(spark, sf_dir).agg(F.round(F.avg(click) + 0.1 * (F.avg(interest * mask) + F.avg(conformity * (1 - mask))) - 0.01 * F.avg(F.pow(F.col("f1") - F.col("f2"), 2)), 9).alias("loss"))


def macr_score(spark, sf_dir):
    score = (F.col("z") - 0.001) * C.sigmoid(F.col("u")) * C.sigmoid(F.col("v"))
    loss = C.bce_with_logits(F.col("z"), F.col("y")) + 1e-4 * C.bce_with_logits(F.col("u"), F.col("y")) + 1e-4 * C.bce_with_logits(F.col("v"), F.col("y"))
    return evt(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg(score), 9).alias("score"), F.round(F.avg(loss), 9).alias("loss"))


def pda_score(spark, sf_dir):
    return evt(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg(F.col("z") * C.popularity(F.col("W"), GAMMA)), 9).alias("score"))


def fairco_merit_gap(spark, sf_dir):
    """Sum over pairs of groups of the difference of merit per exposure; groups are few."""
    from pyspark.sql import Window as W

    by = evt(spark, sf_dir).groupBy("G").agg(F.avg(C.sigmoid(F.col("z"))).alias("merit"), F.avg("W").alias("exposure"))
    ratio = by.select(C.merit_ratio(F.col("merit"), F.col("exposure")).alias("r"))
    all_r = ratio.withColumn("all", F.collect_list("r").over(W.partitionBy(F.lit(0))))
    gap = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("r")))
    return all_r.agg(F.round(0.01 / 2 * F.sum(gap), 9).alias("gap"))


def emb(spark, sf_dir) -> DataFrame:
    """(vec_id, v, w, batch): vectors in batches of neighbouring identifiers; pairs are formed inside a batch only."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") % 2).alias("w"), F.expr(f"vec_id div {BATCH}").alias("batch"))


EMB = f"emb AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 2 AS w, vec_id // {BATCH} AS batch FROM embeddings), pairs AS (SELECT a.batch, a.vec_id AS a, b.vec_id AS b, a.w AS wa, b.w AS wb, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d FROM emb a JOIN emb b USING (batch))"


def _pairs(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir)
    a, b = (e.select("batch", F.col("vec_id").alias(n), F.col("v").alias(f"v{n}"), F.col("w").alias(f"w{n}")) for n in "ab")
    return a.join(b, "batch").withColumn("d", C.sqdist(F.col("va"), F.col("vb")))


def pairwise_sqdist(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("a < b").select("a", "b", F.round("d", 7).alias("d"))


def mmd_rbf(spark, sf_dir):
    """Kernel distance of the arms in each batch; null where an arm has a single row."""
    k = F.exp(-F.col("d") / (SIGMA * SIGMA))
    part = lambda x, y: F.sum(F.when((F.col("wa") == x) & (F.col("wb") == y), k))
    size = lambda x: F.sum(((F.col("a") == F.col("b")) & (F.col("wa") == x)).cast("double"))
    s = _pairs(spark, sf_dir).groupBy("batch").agg(size(0).alias("m"), size(1).alias("n"), part(0, 0).alias("cc"), part(1, 1).alias("tt"), part(0, 1).alias("ct"))
    p = F.col("n") / (F.col("m") + F.col("n"))
    value = 4 * (F.pow(1 - p, 2) * (F.col("cc") - F.col("m")) / (F.col("m") * (F.col("m") - 1)) + p * p * (F.col("tt") - F.col("n")) / (F.col("n") * (F.col("n") - 1)) - 2 * p * (1 - p) * F.col("ct") / (F.col("m") * F.col("n")))
    return s.select("batch", F.round(F.when((F.col("m") > 1) & (F.col("n") > 1), value), 9).alias("mmd"))


MMD_SQL = f"""WITH {EMB}, s AS (SELECT batch, count(*) FILTER (a = b AND wa = 0)::DOUBLE AS m, count(*) FILTER (a = b AND wa = 1)::DOUBLE AS n, sum(exp(-d / {SIGMA * SIGMA})) FILTER (wa = 0 AND wb = 0) AS cc, sum(exp(-d / {SIGMA * SIGMA})) FILTER (wa = 1 AND wb = 1) AS tt, sum(exp(-d / {SIGMA * SIGMA})) FILTER (wa = 0 AND wb = 1) AS ct FROM pairs GROUP BY batch)
SELECT batch, round(CASE WHEN m > 1 AND n > 1 THEN 4 * ((m / (m + n)) ** 2 * (cc - m) / (m * (m - 1)) + (n / (m + n)) ** 2 * (tt - n) / (n * (n - 1)) - 2 * (n / (m + n)) * (m / (m + n)) * ct / (m * n)) END, 9) AS mmd FROM s"""


def fm_interaction(spark, sf_dir):
    """Second-order interaction of each vector, taken as 8 fields of width 8."""
    rows = F.array(*(F.slice("v", 8 * i + 1, 8) for i in range(8)))
    return emb(spark, sf_dir).select("vec_id", F.round(C.fm2(rows, 8), 8).alias("fm"))


def dmbr_confounder_mean(spark, sf_dir):
    """Inner product of each batch's mean vector with the mean of each arm in it."""
    e = emb(spark, sf_dir)
    mean = lambda c: F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(64))).alias(c)
    both = e.groupBy("batch", "w").agg(mean("own")).join(e.groupBy("batch").agg(mean("all")), "batch")
    return both.select("batch", "w", F.round(C.dot(F.col("own"), F.col("all")), 9).alias("score"))


FM_SQL = f"WITH {EMB} SELECT vec_id, round(list_sum(list_transform(range(8), lambda j: 0.5 * (list_sum(list_transform(range(8), lambda i: v[8 * i + j + 1])) ** 2 - list_sum(list_transform(range(8), lambda i: v[8 * i + j + 1] ** 2))))), 8) AS fm FROM emb"
DMBR_SQL = f"""WITH {EMB}, x AS (SELECT batch, w, unnest(v) AS c, unnest(range(64)) AS i FROM emb), own AS (SELECT batch, w, i, avg(c) AS o FROM x GROUP BY ALL), tot AS (SELECT batch, i, avg(c) AS a FROM x GROUP BY ALL)
SELECT batch, w, round(sum(o * a), 9) AS score FROM own JOIN tot USING (batch, i) GROUP BY ALL"""


QUERIES = {
    "tlearner_ols": (tlearner_ols, f"WITH {LINES} SELECT x, round(avg(a1 - a0 + (b1 - b0) * x), 8) AS effect, count(*) AS n FROM p, l GROUP BY x"), "slearner_ols": (slearner_ols, S_SQL), "xlearner_ols": (xlearner_ols, X_SQL),
    "dr_aipw_strata": (dr_aipw_strata, DR_SQL), "dml_residual_slope": (dml_residual_slope, DML_SQL),
    "ipw_weighted_bce": (ipw_weighted_bce, f"WITH {EVT} SELECT g AS \"G\", round(avg({_bce('z', 'y')} * least(greatest(1 / w, 0.01), 1)), 9) AS loss, count(*) AS n FROM evt GROUP BY g"),
    "ips_outcome_loss": (ips_outcome_loss, f"WITH {EVT} SELECT t AS \"T\", round(avg({_bce('z', 'y')} * least(exp({_soft('t')}), 100)) + 0.1 * avg({_soft('t')}), 9) AS loss FROM evt GROUP BY t"),
    "dr_loss": (dr_loss, f"WITH {EVT}, q AS (SELECT *, greatest(1 / (1 + exp(-v)), 0.01) AS p, {_bce('z', 'y')} AS e FROM evt) SELECT g AS \"G\", round(avg({_bce('v', 't')}) + avg(e * t / p) + avg((e - u * u) * t / p + u * u), 8) AS loss FROM q GROUP BY g"),
    "cfr_factual_loss": (cfr_factual_loss, f"WITH {EVT} SELECT round(avg({_bce('u', 'y')}) FILTER (t = 1) + avg({_bce('v', 'y')}) FILTER (t = 0), 9) AS loss, round(avg(u - v), 9) AS effect FROM evt"),
    "dice_loss": (dice_loss, f"WITH {EVT} SELECT round(avg({_bce('z', 'y')}) + 0.1 * (avg({_bce('u', 'y')} * t) + avg({_bce('v', 'y')} * (1 - t))) - 0.01 * avg((f1 - f2) ** 2), 9) AS loss FROM evt"),
    "macr_score": (macr_score, f"WITH {EVT} SELECT user_id, round(avg((z - 0.001) / (1 + exp(-u)) / (1 + exp(-v))), 9) AS score, round(avg({_bce('z', 'y')} + 1e-4 * {_bce('u', 'y')} + 1e-4 * {_bce('v', 'y')}), 9) AS loss FROM evt GROUP BY user_id"),
    "pda_score": (pda_score, f"WITH {EVT} SELECT user_id, round(avg(z * w ** {GAMMA}), 9) AS score FROM evt GROUP BY user_id"),
    "fairco_merit_gap": (fairco_merit_gap, f"WITH {EVT}, r AS (SELECT g, avg(1 / (1 + exp(-z))) / avg(w) AS r FROM evt GROUP BY g) SELECT round(0.01 / 2 * sum(abs(a.r - b.r)), 9) AS gap FROM r a, r b"),
    "mmd_rbf": (mmd_rbf, MMD_SQL), "pairwise_sqdist": (pairwise_sqdist, f"WITH {EMB} SELECT a, b, round(d, 7) AS d FROM pairs WHERE a < b"),
    "fm_interaction": (fm_interaction, FM_SQL), "dmbr_confounder_mean": (dmbr_confounder_mean, DMBR_SQL),
}
