"""Grouped sums over binned features, split scans over bins, and the choice of the best split, as DataFrame plans.

A histogram is long: (leaf, feature, bin, w, t) with sums of g, h, cg, ch and a row count n (and eta). Scans make it
dense over treatment arms and periods, so that running sums exist at every bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUMS = ("g", "h", "cg", "ch")
CELL = ("leaf", "feature", "bin", "w", "t")


def stack(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each feature: (keep..., feature, bin)."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("int").alias("bin")) for i, f in enumerate(features)))
    return df.select(*keep, F.explode(pairs).alias("__f")).select(*keep, "__f.feature", "__f.bin")


def histogram(df: DataFrame, features: Sequence[str], periods: int, arrays: Sequence[str] = SUMS, leaf: str = "leaf", arm: str = "w") -> DataFrame:
    """Sums of array columns by leaf, feature, bin, arm and period, with counts; one shuffle of one row for each cell and task.

    Arrays are summed by period in place, so that rows are multiplied by the features only.
    """
    rows = stack(df, features, [F.col(leaf).alias("leaf"), F.col(arm).alias("w"), *arrays])
    sums = [F.sum(F.get(a, F.lit(t))).alias(f"{a}{t}") for a in arrays for t in range(periods)]
    wide = rows.groupBy("leaf", "feature", "bin", "w").agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = F.array(*(F.struct(F.lit(t).alias("t"), *(F.col(f"{a}{t}").alias(a) for a in arrays)) for t in range(periods)))
    return wide.select("leaf", "feature", "bin", "w", "n", F.explode(cells).alias("c")).select("leaf", "feature", "bin", "w", "c.*", "n")


def subtract(parent: DataFrame, left: DataFrame, values: Sequence[str]) -> DataFrame:
    """The right child's histogram: parent minus left, cells that the left lacks as they are."""
    keys = [c for c in CELL if c != "leaf" and c in parent.columns]
    lefts = left.select(*keys, *(F.col(v).alias(f"__{v}") for v in values))
    return parent.join(lefts, keys, "left").select(*keys, *((F.col(v) - F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values))


def sumby(df: DataFrame, keys: Sequence[str], values: Sequence[str], transform=lambda c: c) -> DataFrame:
    """Sums of transformed values (identity, square, logarithm)."""
    return df.groupBy(*keys).agg(*(F.sum(transform(F.col(v))).alias(v) for v in values))


def countby(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with a value, other than null and NaN, in any of the columns."""
    any_value = F.lit(False)
    for v in values:
        any_value = any_value | (F.col(v).isNotNull() & ~F.isnan(v))
    return df.groupBy(*keys).agg(F.sum(any_value.cast("long")).alias("n"))


def sumby_stacked(df: DataFrame, features: Sequence[str], arm: str, values: Sequence[str], transform=lambda c: c) -> DataFrame:
    """sumby() by arm and bin for all features in one pass: (feature, bin, w, sums)."""
    return sumby(stack(df, features, [F.col(arm).alias("w"), *values]), ["feature", "bin", "w"], values, transform)


def countby_stacked(df: DataFrame, features: Sequence[str], arm: str, values: Sequence[str]) -> DataFrame:
    """countby() by arm and bin for all features in one pass: (feature, bin, w, n)."""
    return countby(stack(df, features, [F.col(arm).alias("w"), *values]), ["feature", "bin", "w"], values)


def groupby(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, min, max and variance of the values that are numbers; NaN mean for groups without one."""
    x = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(float("nan"))).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.var_pop(x).alias("variance"))


def scan(hist: DataFrame, arms: int = 2, extra: Sequence[str] = (), periods: int | None = None) -> DataFrame:
    """Left (side 0) and right (side 1) sums of each split `bin <= b`, for every arm and period: long, dense.

    Arms and periods become columns of one row for each bin, so that one window over bins makes all running sums; what
    follows stays partitioned by leaf and feature. Without periods, one job asks for them.
    """
    values = [*(c for c in (*SUMS, *extra) if c in hist.columns), "n"]
    periods = periods if periods is not None else (hist.agg(F.max("t")).first()[0] or 0) + 1
    cells = [(w, t) for w in range(arms) for t in range(periods)]
    here = lambda v, w, t: F.coalesce(F.sum(F.when((F.col("w") == w) & (F.col("t") == t), F.col(v))), F.lit(0))
    wide = hist.groupBy("leaf", "feature", "bin").agg(*(here(v, w, t).alias(f"{v}_{w}_{t}") for v in values for w, t in cells))
    by = W.partitionBy("leaf", "feature").orderBy("bin")
    until, every = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    names = [f"{v}_{w}_{t}" for v in values for w, t in cells]
    sums = wide.select("leaf", "feature", "bin", *(F.sum(n).over(until).alias(f"l_{n}") for n in names), *(F.sum(n).over(every).alias(f"a_{n}") for n in names))
    side = lambda s, n: F.col(f"l_{n}") if s == 0 else F.col(f"a_{n}") - F.col(f"l_{n}")
    rows = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(s).alias("side"), *(side(s, f"{v}_{w}_{t}").alias(v) for v in values)) for w, t in cells for s in (0, 1)))
    return sums.select("leaf", "feature", "bin", F.explode(rows).alias("s")).select("leaf", "feature", "bin", "s.*")


def _quadratic(v: Column, g: Column, h: Column, lambd: float) -> Column:
    return g * v + 0.5 * v * v * (h + lambd)


def estimates(sides: DataFrame, lambd: float) -> DataFrame:
    """Adds theta of the arm and other, of the opposite arm, in each node (leaf, feature, bin, side, t)."""
    node = W.partitionBy("leaf", "feature", "bin", "side", "t")
    both_g, both_h = F.sum("g").over(node), F.sum("h").over(node)
    return sides.withColumns({"theta": -F.col("g") / (F.col("h") + lambd), "other": -(both_g - F.col("g")) / (both_h - F.col("h") + lambd)})


def gbct_costs(sides: DataFrame, periods: int, t0: int, lambd: float = 5.0, coeff: float = 1.0) -> DataFrame:
    """(leaf, feature, bin, loss): cost of both children under the debiased loss. Splits with an empty arm have none."""
    rows = estimates(sides, lambd)
    pre = _quadratic(F.col("other"), F.col("cg"), F.col("ch"), lambd) / (F.col("n") * t0) if t0 else F.lit(0.0)
    post = coeff * _quadratic(F.col("theta"), F.col("g"), F.col("h"), lambd) / (F.col("n") * (periods - t0))
    part = F.when(F.col("n") > 0, F.when(F.col("t") < t0, pre).otherwise(post))
    child = rows.groupBy("leaf", "feature", "bin", "side").agg(F.sum(part).alias("sum"), F.min("n").alias("least"), F.sum(F.when(F.col("t") == 0, F.col("n"))).alias("n"))
    return child.groupBy("leaf", "feature", "bin").agg(F.sum(F.col("sum") * F.col("n") / 2).alias("loss"), F.min("least").alias("least")).filter("least > 0").drop("least")


def did_costs(sides: DataFrame, periods: int, t0: int, lambd: float = 5.0, coeff: float = 1.0, parallel_l2: float = 0.0, own_divisor: bool = False) -> DataFrame:
    """(leaf, feature, bin, loss, eta_l, eta_r): costs with a parallel shift eta of the arms before treatment.

    The published form divides the control arm's curvature term by the treated count; own_divisor uses its own.
    """
    rows = estimates(sides, lambd)
    node = ["leaf", "feature", "bin", "side", "t"]
    arm = lambda c, d: F.max(F.when(F.col("w") == d, F.col(c)))
    wide = rows.groupBy(*node).agg(*(arm(c, d).alias(f"{c}_{d}") for c in ("g", "h", "cg", "ch", "n", "theta", "other", *(["eta"] if "eta" in rows.columns else [])) for d in (0, 1)))
    wide = wide.filter("n_0 > 0 and n_1 > 0")
    before = F.col("t") < t0
    divisor = F.col("n_0") if own_divisor else F.col("n_1")
    mean = (F.col("eta_0") / F.col("n_0") + F.col("eta_1") / F.col("n_1")) / 2 if "eta" in rows.columns else F.lit(0.0)
    side = W.partitionBy("leaf", "feature", "bin", "side")
    up = F.sum(F.when(before, F.col("cg_1") / F.col("n_1") - F.col("cg_0") / F.col("n_0") + F.col("ch_1") * F.col("other_1") / F.col("n_1") - F.col("ch_0") * F.col("other_0") / divisor + parallel_l2 * mean).otherwise(0.0))
    down = F.sum(F.when(before, F.col("ch_1") / F.col("n_1") + F.col("ch_0") / F.col("n_0")).otherwise(0.0))
    wide = wide.withColumns({"up": up.over(side), "down": down.over(side), "n0": F.max("n_0").over(side), "n1": F.max("n_1").over(side), "mean_eta": F.max(mean).over(side)})
    wide = wide.withColumn("shift", F.coalesce(F.try_divide(-F.col("up"), F.col("down") + t0 * parallel_l2), F.lit(0.0)))

    def cost(d: int) -> Column:
        pre = _quadratic(F.col(f"other_{d}") + (2 * d - 1) * F.col("shift"), F.col(f"cg_{d}"), F.col(f"ch_{d}"), lambd) / (F.col(f"n_{d}") * t0) if t0 else F.lit(0.0)
        post = coeff * _quadratic(F.col(f"theta_{d}"), F.col(f"g_{d}"), F.col(f"h_{d}"), lambd) / (F.col(f"n_{d}") * (periods - t0))
        return F.when(before, pre).otherwise(post)

    sums = wide.groupBy("leaf", "feature", "bin", "side").agg(F.sum(cost(0) + cost(1)).alias("sum"), *(F.first(c).alias(c) for c in ("n0", "n1", "mean_eta", "shift")))
    penalty = parallel_l2 * (0.5 * F.col("shift") * F.col("shift") + F.col("shift") * F.col("mean_eta"))
    total = (F.col("sum") + penalty) * (F.col("n0") + F.col("n1")) / 2
    out = sums.groupBy("leaf", "feature", "bin").agg(F.sum(total).alias("loss"), *(F.max(F.when(F.col("side") == s, F.col("shift"))).alias(n) for s, n in ((0, "eta_l"), (1, "eta_r"))), F.count(F.lit(1)).alias("sides"))
    return out.filter("sides = 2").drop("sides")


def vanilla_gains(sides: DataFrame, periods: int, t0: int, coeff: float = 1.0, imbalance: float = 0.0, by_theta: bool = False) -> DataFrame:
    """(leaf, feature, bin, gain) of the plain causal tree: squared sums over sizes, or squared differences of theta."""
    side = sides.groupBy("leaf", "feature", "bin", "side", "t").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = side.groupBy("leaf", "feature", "bin", "t").agg(*(pick(c, s).alias(f"{c}{s}") for c in ("g", "h", "n") for s in (0, 1))).filter("n0 > 0 and n1 > 0")
    if by_theta:
        term = F.pow(-F.col("g0") / F.col("h0") + F.col("g1") / F.col("h1"), F.lit(2.0))
        weight = F.when(F.col("t") < t0, F.lit(-1.0)).otherwise(F.lit(float(coeff)))
    else:
        term = F.col("g0") * F.col("g0") / F.col("n0") + F.col("g1") * F.col("g1") / F.col("n1")
        weight = F.when(F.col("t") < t0, F.lit(-1.0 / t0 if t0 else 0.0)).otherwise(F.lit(coeff / (periods - t0)))
    return wide.groupBy("leaf", "feature", "bin").agg((F.sum(weight * term) - F.max(imbalance * (1 / F.col("n0") + 1 / F.col("n1")))).alias("gain"))


def admissible(sides: DataFrame, min_points: int = 10, min_var_rate: float = 0.1, true_variance: bool = False) -> DataFrame:
    """(leaf, feature, bin) of splits that leave enough rows in each arm and enough variance of the treatment in each child.

    The right child's measure is, as published, (S^2 - S^2 / n) / n of the treated count S; true_variance uses p(1 - p).
    """
    rows = sides.filter("t = 0")
    node = rows.groupBy("leaf", "feature", "bin").agg(
        F.min("n").alias("least"), F.sum(F.when((F.col("side") == 0) & (F.col("w") == 1), F.col("n"))).cast("double").alias("s_l"), F.sum(F.when(F.col("side") == 0, F.col("n"))).cast("double").alias("n_l"),
        F.sum(F.when((F.col("side") == 1) & (F.col("w") == 1), F.col("n"))).cast("double").alias("s_r"), F.sum(F.when(F.col("side") == 1, F.col("n"))).cast("double").alias("n_r"),
    )
    p = (F.col("s_l") + F.col("s_r")) / (F.col("n_l") + F.col("n_r"))
    left = (F.col("s_l") - F.col("s_l") * F.col("s_l") / F.col("n_l")) / F.col("n_l")
    n_r = F.col("n_r") + 1e-9
    square = F.col("s_r") if true_variance else F.col("s_r") * F.col("s_r")
    right = (square - F.col("s_r") * F.col("s_r") / n_r) / n_r
    return node.filter((F.col("least") >= min_points) & (F.least(left, right) >= min_var_rate * (p - p * p))).select("leaf", "feature", "bin")


def best_split(costs: DataFrame, allowed: DataFrame) -> DataFrame:
    """(leaf, feature, bin, loss) with the least loss of each leaf; ties go to the lowest feature, then bin."""
    best = costs.join(allowed, ["leaf", "feature", "bin"], "left_semi").groupBy("leaf").agg(F.min(F.struct("loss", "feature", "bin")).alias("b"))
    return best.select("leaf", F.col("b.feature").alias("feature"), F.col("b.bin").alias("bin"), F.col("b.loss").alias("loss"))


def next_leaf(df: DataFrame, splits: DataFrame, features: Sequence[str]) -> DataFrame:
    """leaf becomes 2 leaf + 1 for rows with bin <= the split's, 2 leaf + 2 for others; leaves without a split stay."""
    some = splits.select("leaf", F.col("feature").alias("__f"), F.col("bin").alias("__b"))
    value = F.element_at(F.array(*(F.col(f).cast("int") for f in features)), F.col("__f") + 1)
    moved = df.join(F.broadcast(some), "leaf", "left")  # at most a row for each leaf of a level
    return moved.withColumn("leaf", F.when(F.col("__f").isNull(), F.col("leaf")).when(value <= F.col("__b"), 2 * F.col("leaf") + 1).otherwise(2 * F.col("leaf") + 2)).drop("__f", "__b")


def leaf_theta(df: DataFrame, periods: int, lambd: float) -> DataFrame:
    """(leaf, w, t, theta, n) from columns leaf, w, g, h (arrays)."""
    sums = df.groupBy("leaf", "w").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get(a, F.lit(t))).alias(f"{a}{t}") for a in ("g", "h") for t in range(periods)))
    cells = F.array(*(F.struct(F.lit(t).alias("t"), (-F.col(f"g{t}") / (F.col(f"h{t}") + lambd)).alias("theta")) for t in range(periods)))
    return sums.select("leaf", "w", "n", F.explode(cells).alias("c")).select("leaf", "w", "c.t", "c.theta", "n")


def arm_gather(theta: Column, w: Column) -> tuple[Column, Column]:
    """Of an array by arm: the factual one's element and the opposite one's."""
    return F.element_at(theta, w + 1), F.element_at(theta, F.lit(2) - w)
