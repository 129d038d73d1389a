"""Queries of causal trees: bins, histograms, split scans, leaves, effects of one split, fitted ensembles.

The panel: customers with yearly order counts from 1995 to 2001, treated if their segment is AUTOMOBILE or BUILDING,
treatment before the last period. Gradients are those of the first round, where all predictions are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bin_of
from ..operators import histograms as H
from ..session import table
from ..sources.frames import CausalFrame, panel

YEARS = list(range(1995, 2002))
T, T0, LAMBD, COEFF = 7, 6, 5.0, 1.0
BINS = ["b0", "b1"]


def panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, c_acctbal, c_nationkey, w, y)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    y = panel(orders, "o_custkey", "year", YEARS, F.count(F.lit(1)))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey", F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("w"))
    zeros = F.array(*[F.lit(0.0)] * T)
    return c.join(y, c["id"] == y["o_custkey"], "left").select("id", "c_acctbal", "c_nationkey", "w", F.coalesce("y", zeros).alias("y"))


def binned(spark, sf_dir) -> DataFrame:
    """panel_frame() with bins: b0 the nation, b1 the balance in steps of 1,000."""
    p = panel_frame(spark, sf_dir)
    return p.withColumns({"b0": F.col("c_nationkey"), "b1": F.floor(F.col("c_acctbal") / 1000).cast("int") + 1, "leaf": F.lit(0)})


def gradients(df: DataFrame) -> DataFrame:
    g, h = F.transform("y", lambda y: -2.0 * y), F.transform("y", lambda y: F.lit(2.0))
    return df.withColumns({"g": g, "h": h, "cg": g, "ch": h})


def hist(spark, sf_dir) -> DataFrame:
    return H.histogram(gradients(binned(spark, sf_dir)), BINS, T)


PANEL = """panel AS (SELECT c_custkey AS id, c_acctbal, c_nationkey, (c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))::INT AS w, [""" + ", ".join(f"coalesce(y{y}, 0)::DOUBLE" for y in YEARS) + """] AS y
  FROM customer LEFT JOIN (SELECT o_custkey, """ + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS y{y}" for y in YEARS) + """ FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
binned AS (SELECT *, c_nationkey::INT AS b0, floor(c_acctbal / 1000)::INT + 1 AS b1 FROM panel),
long AS (SELECT id, w, f.feature, CASE f.feature WHEN 0 THEN b0 ELSE b1 END AS bin, p.t::INT AS t, -2 * y[p.t + 1] AS g, 2.0::DOUBLE AS h FROM binned, (VALUES (0), (1)) f(feature), (SELECT unnest(range(7)) AS t) p),
hist AS (SELECT 0 AS leaf, feature, bin, w, t, sum(g) AS g, sum(h) AS h, sum(g) AS cg, sum(h) AS ch, count(*) AS n FROM long GROUP BY ALL)"""
SIDES = PANEL + """,
cells AS (SELECT DISTINCT feature, bin FROM hist),
dense AS (SELECT c.feature, c.bin, a.w, p.t::INT AS t, coalesce(g, 0) AS g, coalesce(h, 0) AS h, coalesce(n, 0) AS n FROM cells c CROSS JOIN (VALUES (0), (1)) a(w) CROSS JOIN (SELECT unnest(range(7)) AS t) p LEFT JOIN hist i ON i.feature = c.feature AND i.bin = c.bin AND i.w = a.w AND i.t = p.t),
runs AS (SELECT *, sum(g) OVER u AS lg, sum(h) OVER u AS lh, sum(n) OVER u AS ln, sum(g) OVER a AS ag, sum(h) OVER a AS ah, sum(n) OVER a AS an FROM dense
  WINDOW u AS (PARTITION BY feature, w, t ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature, w, t)),
sides AS (SELECT feature, bin, w, t, 0 AS side, lg AS g, lh AS h, ln::BIGINT AS n FROM runs UNION ALL SELECT feature, bin, w, t, 1, ag - lg, ah - lh, (an - ln)::BIGINT FROM runs),
est AS (SELECT *, -g / (h + 5.0) AS theta, -(sum(g) OVER k - g) / (sum(h) OVER k - h + 5.0) AS other FROM sides WINDOW k AS (PARTITION BY feature, bin, side, t))"""
GBCT = SIDES + """,
child AS (SELECT feature, bin, side, min(n) AS least, sum(n) FILTER (t = 0) AS n, sum(CASE WHEN n > 0 THEN CASE WHEN t < 6 THEN (g * other + 0.5 * other * other * (h + 5)) / (n * 6) ELSE (g * theta + 0.5 * theta * theta * (h + 5)) / n END END) AS s FROM est GROUP BY ALL),
gbct AS (SELECT feature, bin, sum(s * n / 2) AS loss FROM child GROUP BY ALL HAVING min(least) > 0)"""
DID = SIDES + """,
wide AS (SELECT feature, bin, side, t, max(g) FILTER (w = 0) AS g0, max(g) FILTER (w = 1) AS g1, max(h) FILTER (w = 0) AS h0, max(h) FILTER (w = 1) AS h1, max(n) FILTER (w = 0) AS n0, max(n) FILTER (w = 1) AS n1,
  max(theta) FILTER (w = 0) AS th0, max(theta) FILTER (w = 1) AS th1, max(other) FILTER (w = 0) AS o0, max(other) FILTER (w = 1) AS o1 FROM est GROUP BY ALL),
shift AS (SELECT feature, bin, side, -sum(g1 / n1 - g0 / n0 + h1 * o1 / n1 - h0 * o0 / n1) FILTER (t < 6) / sum(h1 / n1 + h0 / n0) FILTER (t < 6) AS eta FROM wide WHERE n0 > 0 AND n1 > 0 GROUP BY ALL),
cost AS (SELECT w.*, eta, CASE WHEN t < 6 THEN (g0 * (o0 - eta) + 0.5 * (o0 - eta) ** 2 * (h0 + 5)) / (n0 * 6) + (g1 * (o1 + eta) + 0.5 * (o1 + eta) ** 2 * (h1 + 5)) / (n1 * 6)
  ELSE (g0 * th0 + 0.5 * th0 * th0 * (h0 + 5)) / n0 + (g1 * th1 + 0.5 * th1 * th1 * (h1 + 5)) / n1 END AS c FROM wide w JOIN shift USING (feature, bin, side)),
sums AS (SELECT feature, bin, side, any_value(eta) AS eta, sum(c) * (max(n0) + max(n1)) / 2 AS s FROM cost GROUP BY ALL),
did AS (SELECT feature, bin, sum(s) AS loss, max(eta) FILTER (side = 0) AS eta_l, max(eta) FILTER (side = 1) AS eta_r FROM sums GROUP BY ALL HAVING count(*) = 2)"""
ALLOWED = """allowed AS (SELECT feature, bin FROM (SELECT feature, bin, min(n) AS least, sum(n) FILTER (side = 0 AND w = 1)::DOUBLE AS sl, sum(n) FILTER (side = 0)::DOUBLE AS nl, sum(n) FILTER (side = 1 AND w = 1)::DOUBLE AS sr, sum(n) FILTER (side = 1)::DOUBLE AS nr FROM sides WHERE t = 0 GROUP BY ALL)
  WHERE least >= 10 AND least((sl - sl * sl / nl) / nl, (sr * sr - sr * sr / (nr + 1e-9)) / (nr + 1e-9)) >= 0.1 * ((sl + sr) / (nl + nr) - ((sl + sr) / (nl + nr)) ** 2))"""


def hist_grad(spark, sf_dir):
    return hist(spark, sf_dir).select("feature", "bin", "w", "t", "g", "h")


def hist_count(spark, sf_dir):
    return hist(spark, sf_dir).filter("t = 0").select("feature", "bin", "w", "n")


def hist_subtract(spark, sf_dir):
    df = gradients(binned(spark, sf_dir))
    left = H.histogram(df.filter("b0 <= 12"), BINS, T)
    return H.subtract(H.histogram(df, BINS, T), left, ["g", "h", "n"])


def sumby_square(spark, sf_dir):
    df = binned(spark, sf_dir).select("w", F.col("b1").alias("bin"), *(F.get("y", F.lit(t)).alias(f"y{t}") for t in (0, 6)))
    return H.sumby(df, ["w", "bin"], ["y0", "y6"], lambda c: c * c)


def _gaps(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    return li.select("l_returnflag", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(nan).alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_tax")).otherwise(nan).alias("b"))


def countby_dropna(spark, sf_dir):
    return H.countby(_gaps(spark, sf_dir), ["l_returnflag", "l_linenumber"], ["a", "b"])


def groupby_nan_mean(spark, sf_dir):
    return H.groupby(_gaps(spark, sf_dir), ["l_linenumber"], "a").select("l_linenumber", "n", F.round("mean", 9).alias("mean"))


def groupby_minmax(spark, sf_dir):
    return H.groupby(_gaps(spark, sf_dir), ["l_returnflag"], "a").select("l_returnflag", "low", "high")


GAPS = "gaps AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity END AS a, CASE WHEN l_discount > 0.05 THEN l_tax END AS b FROM lineitem)"


def bin_bounds_small(spark, sf_dir):
    """Upper bounds of features with few values: midpoints between neighbours, the last infinite."""
    from ..operators.bins import small_bounds

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("line"))
    return small_bounds(rows, ["quantity", "line"])


BOUNDS = [0.015, 0.035, 0.055, 0.075]


def _assigned(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", bin_of(F.col("l_discount"), BOUNDS + [float("inf")]).alias("bin"))


def bin_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("bin", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


def bin_counts(spark, sf_dir):
    w = W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return _assigned(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("cumulative", F.sum("n").over(w))


ASSIGNED = "assigned AS (SELECT *, CASE " + " ".join(f"WHEN l_discount <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END::INT AS bin FROM lineitem)"
BOUNDS_SQL = """WITH v AS (SELECT 'quantity' AS feature, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'line', l_linenumber::DOUBLE, count(*) FROM lineitem GROUP BY ALL),
p AS (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS next, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS bin FROM v)
SELECT feature, bin::INT AS bin, coalesce((value + next) / 2, 'inf'::DOUBLE) AS bound FROM p"""


def _costs(spark, sf_dir, kind: str) -> DataFrame:
    sides = H.scan(hist(spark, sf_dir), periods=T)
    return H.gbct_costs(sides, T, T0, LAMBD, COEFF) if kind == "gbct" else H.did_costs(sides, T, T0, LAMBD, COEFF)


def split_scan_gbct(spark, sf_dir):
    return _costs(spark, sf_dir, "gbct").select("feature", "bin", F.round("loss", 5).alias("loss"))


def split_scan_did(spark, sf_dir):
    return _costs(spark, sf_dir, "did").select("feature", "bin", F.round("loss", 5).alias("loss"), F.round("eta_l", 7).alias("eta_l"), F.round("eta_r", 7).alias("eta_r"))


def split_scan_vanilla(spark, sf_dir):
    return H.vanilla_gains(H.scan(hist(spark, sf_dir), periods=T), T, T0, COEFF, 3.0).select("feature", "bin", F.round("gain", 5).alias("gain"))


def split_scan_vanilla2(spark, sf_dir):
    return H.vanilla_gains(H.scan(hist(spark, sf_dir), periods=T), T, T0, COEFF, 3.0, by_theta=True).select("feature", "bin", F.round("gain", 7).alias("gain"))


_SIDE = "side AS (SELECT feature, bin, t, sum(g) FILTER (side = 0) AS g0, sum(g) FILTER (side = 1) AS g1, sum(h) FILTER (side = 0) AS h0, sum(h) FILTER (side = 1) AS h1, sum(n) FILTER (side = 0)::DOUBLE AS n0, sum(n) FILTER (side = 1)::DOUBLE AS n1 FROM sides GROUP BY ALL)"
VANILLA = f"WITH {SIDES}, {_SIDE} SELECT feature, bin, round(sum(CASE WHEN t < 6 THEN -1.0 / 6 ELSE 1 END * (g0 * g0 / n0 + g1 * g1 / n1)) - max(3.0 * (1 / n0 + 1 / n1)), 5) AS gain FROM side WHERE n0 > 0 AND n1 > 0 GROUP BY ALL"
VANILLA2 = f"WITH {SIDES}, {_SIDE} SELECT feature, bin, round(sum(CASE WHEN t < 6 THEN -1 ELSE 1 END * (-g0 / h0 + g1 / h1) ** 2) - max(3.0 * (1 / n0 + 1 / n1)), 7) AS gain FROM side WHERE n0 > 0 AND n1 > 0 GROUP BY ALL"


def _best(spark, sf_dir, kind: str) -> DataFrame:
    sides = H.scan(hist(spark, sf_dir), periods=T)
    costs = H.gbct_costs(sides, T, T0, LAMBD, COEFF) if kind == "gbct" else H.did_costs(sides, T, T0, LAMBD, COEFF)
    return H.best_split(costs, H.admissible(sides))


def best_split_gbct(spark, sf_dir):
    return _best(spark, sf_dir, "gbct").select("feature", "bin", F.round("loss", 5).alias("loss"))


def best_split_did(spark, sf_dir):
    return _best(spark, sf_dir, "did").select("feature", "bin", F.round("loss", 5).alias("loss"))


def _best_sql(kind: str, ctes: str) -> str:
    return f"WITH {ctes}, {ALLOWED} SELECT feature, bin, round(loss, 5) AS loss FROM {kind} JOIN allowed USING (feature, bin) ORDER BY {kind}.loss, feature, bin LIMIT 1"


def _leaves(spark, sf_dir) -> DataFrame:
    split = spark.createDataFrame([(0, 0, 12)], "leaf int, feature int, bin int")
    return H.next_leaf(gradients(binned(spark, sf_dir)), split, BINS)


def leaf_partition(spark, sf_dir):
    return _leaves(spark, sf_dir).groupBy("leaf", "w").agg(F.count(F.lit(1)).alias("n"), F.min("b0").alias("low"), F.max("b0").alias("high"))


def leaf_theta(spark, sf_dir):
    return H.leaf_theta(_leaves(spark, sf_dir), T, LAMBD).withColumn("theta", F.round("theta", 9))


LEAVES = PANEL + """, leaves AS (SELECT *, CASE WHEN b0 <= 12 THEN 1 ELSE 2 END::INT AS leaf FROM binned),
theta AS (SELECT leaf, w, p.t::INT AS t, 2 * sum(y[p.t + 1]) / (2 * count(*) + 5.0) AS theta, count(*) AS n FROM leaves, (SELECT unnest(range(7)) AS t) p GROUP BY ALL)"""


def _arms(spark, sf_dir) -> DataFrame:
    """Rows with theta of their leaf by period and arm."""
    th = H.leaf_theta(_leaves(spark, sf_dir), T, LAMBD)
    by = th.groupBy("leaf").agg(*(F.array(*(F.max(F.when((F.col("t") == t) & (F.col("w") == w), F.col("theta"))) for w in (0, 1))).alias(f"th{t}") for t in range(T)))
    return _leaves(spark, sf_dir).join(F.broadcast(by), "leaf")  # a row for each leaf


def arm_gather(spark, sf_dir):
    own, other = H.arm_gather(F.col("th6"), F.col("w"))
    return _arms(spark, sf_dir).groupBy("leaf", "w").agg(F.round(F.min(own), 9).alias("factual"), F.round(F.max(other), 9).alias("opposite"), F.count(F.lit(1)).alias("n"))


def boost_gradients(spark, sf_dir):
    """Gradients of both losses after one step of 0.1, summed."""
    from ..operators.losses import Logistic, Square

    own, _ = H.arm_gather(F.col("th6"), F.col("w"))
    y = F.get("y", F.lit(6))
    rows = _arms(spark, sf_dir).select("leaf", y.alias("y"), (0.1 * own).alias("p"), (y > 0).cast("double").alias("z"))
    sq, lo = Square(), Logistic()
    return rows.groupBy("leaf").agg(F.round(F.sum(sq.grad(F.col("y"), F.col("p"))), 5).alias("g"), F.round(F.sum(sq.hess(F.col("y"), F.col("p"))), 5).alias("h"), F.round(F.sum(lo.grad(F.col("z"), F.col("p"))), 5).alias("g_logit"), F.round(F.sum(lo.hess(F.col("z"), F.col("p"))), 5).alias("h_logit"), F.round(F.sum(lo.loss(F.col("z"), F.col("p"))), 5).alias("loss_logit"))


def boost_valid_loss(spark, sf_dir):
    """Mean over pre-periods of squared errors at the opposite arm, plus that of the post-period at the own arm."""
    from ..operators.losses import Square

    rows = _arms(spark, sf_dir)
    parts = []
    for t in range(T):
        own, other = H.arm_gather(F.col(f"th{t}"), F.col("w"))
        parts.append(F.sum(Square().loss(F.get("y", F.lit(t)), 0.1 * (other if t < T0 else own))) / (T0 if t < T0 else T - T0))
    return rows.agg(F.round(sum(parts[1:], parts[0]), 5).alias("loss"))


GATHER = LEAVES + ", own AS (SELECT l.id, l.leaf, l.w, l.y, f.t, f.theta AS factual, c.theta AS opposite FROM leaves l JOIN theta f ON f.leaf = l.leaf AND f.w = l.w JOIN theta c ON c.leaf = l.leaf AND c.w = 1 - l.w AND c.t = f.t)"
GRADIENTS = f"""WITH {GATHER}, p AS (SELECT leaf, y[7] AS y, 0.1 * factual AS p, (y[7] > 0)::INT AS z FROM own WHERE t = 6)
SELECT leaf, round(sum(2 * (p - y)), 5) AS g, round(sum(2.0::DOUBLE), 5) AS h, round(sum(1 / (1 + exp(-p)) - z), 5) AS g_logit, round(sum(1 / (1 + exp(-p)) * (1 - 1 / (1 + exp(-p)))), 5) AS h_logit, round(sum(greatest(p, 0) - p * z + ln(1 + exp(-abs(p)))), 5) AS loss_logit FROM p GROUP BY leaf"""


def gbct_effect_stump(spark, sf_dir):
    """Debiased effect in each leaf of one split: difference of arms after treatment, less its mean before."""
    th = H.leaf_theta(_leaves(spark, sf_dir), T, LAMBD)
    gap = th.groupBy("leaf", "t").agg((F.max(F.when(F.col("w") == 1, F.col("theta"))) - F.max(F.when(F.col("w") == 0, F.col("theta")))).alias("d"))
    out = gap.groupBy("leaf").agg(F.avg(F.when(F.col("t") < T0, F.col("d"))).alias("bias"), F.avg(F.when(F.col("t") >= T0, F.col("d"))).alias("effect"))
    return out.select("leaf", F.round("bias", 9).alias("bias"), F.round("effect", 9).alias("effect"), F.round(F.col("effect") - F.col("bias"), 9).alias("debiased"))


def effect_nd(spark, sf_dir):
    return gbct_effect_stump(spark, sf_dir).select("leaf", "effect")


def did_effect_stump(spark, sf_dir):
    """theta_1 - theta_0 after treatment less the shift eta of the leaf (arms are shifted by eta and -eta)."""
    best = H.did_costs(H.scan(hist(spark, sf_dir), periods=T), T, T0, LAMBD, COEFF).filter("feature = 0 and bin = 12")
    eta = best.select(F.explode(F.array(F.struct(F.lit(1).alias("leaf"), F.col("eta_l").alias("eta")), F.struct(F.lit(2).alias("leaf"), F.col("eta_r").alias("eta")))).alias("e")).select("e.*")
    out = gbct_effect_stump(spark, sf_dir).select("leaf", "effect").join(F.broadcast(eta), "leaf")
    return out.select("leaf", F.round("eta", 7).alias("eta"), F.round(F.col("effect") - F.col("eta"), 7).alias("debiased"))


STUMP = LEAVES + """, gap AS (SELECT leaf, t, max(theta) FILTER (w = 1) - max(theta) FILTER (w = 0) AS d FROM theta GROUP BY ALL),
stump AS (SELECT leaf, avg(d) FILTER (t < 6) AS bias, avg(d) FILTER (t >= 6) AS effect FROM gap GROUP BY leaf)"""
DID_STUMP = f"WITH {DID}, {STUMP.removeprefix(PANEL + ', ')} SELECT leaf, round(eta, 7) AS eta, round(effect - eta, 7) AS debiased FROM stump JOIN (SELECT 1 AS leaf, eta_l AS eta FROM did WHERE feature = 0 AND bin = 12 UNION ALL SELECT 2, eta_r FROM did WHERE feature = 0 AND bin = 12) USING (leaf)"


def _fit(spark, sf_dir, kind: str) -> DataFrame:
    from ..operators import boosting as B

    df = panel_frame(spark, sf_dir).withColumn("nation", F.col("c_nationkey").cast("double"))
    frame = CausalFrame(df, ["c_acctbal", "nation"], n_period=T, treat_dt=T0)
    if kind == "uplift":
        df = df.withColumn("y", F.array((F.get("y", F.lit(6)) > 0).cast("double")))
        frame = CausalFrame(df, ["c_acctbal", "nation"], n_period=1, treat_dt=0)
    cls = {"gbct": B.GradientBoostingCausalRegressionTree, "did": B.DifferenceInDifferencesRegressionTree, "uplift": B.GradientBoostingUpliftTree}[kind]
    model = cls(B.Config()).fit(frame)
    return model.predict(frame, "effect").select("id", F.round(F.get("effect", F.lit(0)), 6).alias("effect"))


def gbct_fit_effect(spark, sf_dir):
    return _fit(spark, sf_dir, "gbct")


def did_fit_effect(spark, sf_dir):
    return _fit(spark, sf_dir, "did")


def uplift_fit_effect(spark, sf_dir):
    return _fit(spark, sf_dir, "uplift")


QUERIES = {
    "hist_grad": (hist_grad, f"WITH {PANEL} SELECT feature, bin, w, t, g, h FROM hist"),
    "hist_count": (hist_count, f"WITH {PANEL} SELECT feature, bin, w, n FROM hist WHERE t = 0"),
    "hist_subtract": (hist_subtract, f"WITH {PANEL} SELECT feature, bin, w, t, coalesce(sum(g) FILTER (nation > 12), 0) AS g, coalesce(sum(h) FILTER (nation > 12), 0) AS h, count(*) FILTER (nation > 12) AS n FROM (SELECT l.*, b.b0 AS nation FROM long l JOIN binned b USING (id)) GROUP BY ALL"),
    "sumby_square": (sumby_square, f"WITH {PANEL} SELECT w, b1 AS bin, sum(y[1] * y[1]) AS y0, sum(y[7] * y[7]) AS y6 FROM binned GROUP BY ALL"),
    "countby_dropna": (countby_dropna, f"WITH {GAPS} SELECT l_returnflag, l_linenumber, count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS n FROM gaps GROUP BY ALL"),
    "groupby_nan_mean": (groupby_nan_mean, f"WITH {GAPS} SELECT l_linenumber, count(a) AS n, round(coalesce(avg(a), 'nan'::DOUBLE), 9) AS mean FROM gaps GROUP BY ALL"),
    "groupby_minmax": (groupby_minmax, f"WITH {GAPS} SELECT l_returnflag, min(a) AS low, max(a) AS high FROM gaps GROUP BY ALL"),
    "bin_bounds_small": (bin_bounds_small, BOUNDS_SQL),
    "bin_assign": (bin_assign, f"WITH {ASSIGNED} SELECT bin, l_linenumber, count(*) AS n, min(l_discount) AS low, max(l_discount) AS high FROM assigned GROUP BY ALL"),
    "bin_counts": (bin_counts, f"WITH {ASSIGNED} SELECT bin, n, (sum(n) OVER (ORDER BY bin))::BIGINT AS cumulative FROM (SELECT bin, count(*) AS n FROM assigned GROUP BY bin)"),
    "split_scan_gbct": (split_scan_gbct, f"WITH {GBCT} SELECT feature, bin, round(loss, 5) AS loss FROM gbct"),
    "split_scan_did": (split_scan_did, f"WITH {DID} SELECT feature, bin, round(loss, 5) AS loss, round(eta_l, 7) AS eta_l, round(eta_r, 7) AS eta_r FROM did"),
    "split_scan_vanilla": (split_scan_vanilla, VANILLA), "split_scan_vanilla2": (split_scan_vanilla2, VANILLA2),
    "best_split_gbct": (best_split_gbct, _best_sql("gbct", GBCT)), "best_split_did": (best_split_did, _best_sql("did", DID)),
    "leaf_partition": (leaf_partition, f"WITH {LEAVES} SELECT leaf, w, count(*) AS n, min(b0) AS low, max(b0) AS high FROM leaves GROUP BY ALL"),
    "leaf_theta": (leaf_theta, f"WITH {LEAVES} SELECT leaf, w, t, round(theta, 9) AS theta, n FROM theta"),
    "arm_gather": (arm_gather, f"WITH {GATHER} SELECT leaf, w, round(min(factual), 9) AS factual, round(max(opposite), 9) AS opposite, count(*) AS n FROM own WHERE t = 6 GROUP BY ALL"),
    "boost_gradients": (boost_gradients, GRADIENTS),
    "boost_valid_loss": (boost_valid_loss, f"WITH {GATHER} SELECT round(sum(CASE WHEN t < 6 THEN (y[t + 1] - 0.1 * opposite) ** 2 / 6 ELSE (y[t + 1] - 0.1 * factual) ** 2 END), 5) AS loss FROM own"),
    "gbct_effect_stump": (gbct_effect_stump, f"WITH {STUMP} SELECT leaf, round(bias, 9) AS bias, round(effect, 9) AS effect, round(effect - bias, 9) AS debiased FROM stump"),
    "effect_nd": (effect_nd, f"WITH {STUMP} SELECT leaf, round(effect, 9) AS effect FROM stump"),
    "did_effect_stump": (did_effect_stump, DID_STUMP),
    "gbct_fit_effect": (gbct_fit_effect, None), "did_fit_effect": (did_fit_effect, None), "uplift_fit_effect": (uplift_fit_effect, None),
}
