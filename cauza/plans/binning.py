"""Queries of bin bounds: the greedy scan, zero and negatives apart, categories, trivial features, inverse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import bins as N
from ..operators import histograms as H
from ..session import table
from ..sources.frames import CausalFrame
from ..sources.shared import new_path
from .trees import ASSIGNED, BOUNDS, PANEL, binned

MOST, LEAST, COVER, RARE = 16, 10, 0.6, 1000


def _features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), (F.col("l_linenumber") - 3).cast("double").alias("signed"), F.lit(1.0).alias("constant"), ((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7)).cast("double").alias("rare"))


def bin_bounds_greedy(spark, sf_dir):
    """Bounds of a feature with more values than bins, of one with zeros, and of one with both signs."""
    found = N.fit_bins(_features(spark, sf_dir), ["quantity", "discount", "signed"], MOST, LEAST)
    return spark.createDataFrame(_round(found), "feature string, bin int, bound double")


GREEDY = f"""WITH RECURSIVE v AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL),
total AS (SELECT greatest(1, least({MOST - 1}, sum(n)::BIGINT // {LEAST})) AS most, sum(n)::DOUBLE AS n FROM v),
w AS (SELECT v.*, row_number() OVER (ORDER BY value) AS i, lead(value) OVER (ORDER BY value) AS next, v.n >= t.n / t.most AS big, t.most, t.n AS whole FROM v, total t),
x AS (SELECT *, coalesce(lead(big) OVER (ORDER BY value), FALSE) AS next_big, sum(CASE WHEN big THEN 0 ELSE n END) OVER () AS rest, count(*) FILTER (big) OVER () AS n_big FROM w),
run AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS held, rest::DOUBLE AS left_, (most - n_big)::BIGINT AS bins, rest / greatest(1, most - n_big) AS mean, 0::BIGINT AS ends, FALSE AS cut, most::BIGINT AS most FROM x WHERE i = 1
  UNION ALL SELECT s.i, CASE WHEN s.cut THEN 0 ELSE s.held END, s.left_, CASE WHEN s.cut AND NOT s.big AND s.ends < s.most - 1 THEN s.bins - 1 ELSE s.bins END,
    CASE WHEN s.cut AND NOT s.big AND s.ends < s.most - 1 THEN s.left_ / greatest(1, s.bins - 1) ELSE s.mean END, s.ends, s.cut, s.most
  FROM (SELECT x.i, x.big, r.held + x.n AS held, r.left_ - CASE WHEN x.big THEN 0 ELSE x.n END AS left_, r.bins, r.mean, r.most,
      x.big OR r.held + x.n >= r.mean OR (x.next_big AND r.held + x.n >= greatest(1.0, r.mean * 0.5)) AS cut,
      r.ends + (x.big OR r.held + x.n >= r.mean OR (x.next_big AND r.held + x.n >= greatest(1.0, r.mean * 0.5)))::INT AS ends
    FROM run r JOIN x ON x.i = r.i + 1 WHERE x.next IS NOT NULL AND r.ends < r.most - 1) s),
q AS (SELECT 'quantity' AS feature, (x.value + x.next) / 2 AS bound FROM run r JOIN x USING (i) WHERE r.cut),
m AS (SELECT feature, (value + lead(value) OVER (PARTITION BY feature, sign(value) ORDER BY value)) / 2 AS bound FROM (SELECT DISTINCT 'discount' AS feature, l_discount AS value FROM lineitem WHERE l_discount > 0 UNION SELECT 'signed', l_linenumber - 3 FROM lineitem WHERE l_linenumber != 3)),
b AS (SELECT * FROM q UNION ALL SELECT * FROM m WHERE bound IS NOT NULL UNION ALL VALUES ('discount', 1e-35), ('signed', 1e-35), ('signed', -1e-35), ('quantity', 'inf'::DOUBLE), ('discount', 'inf'::DOUBLE), ('signed', 'inf'::DOUBLE))
SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY bound) - 1)::INT AS bin, round(bound, 9) AS bound FROM b"""


def _round(found: dict):
    return [(f, i, round(b, 9)) for f, bounds in found.items() for i, b in enumerate(bounds)]


def bin_bounds_exact(spark, sf_dir):
    """Bounds of a price, almost every value of which is another one."""
    found = N.fit_bins(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price")), ["price"], MOST, LEAST)
    return spark.createDataFrame(_round(found), "feature string, bin int, bound double")


def bin_bounds_forced(spark, sf_dir):
    """Eight bins of quantities and of prices around two forced bounds each."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    found = N.fit_bins(df, list(FORCED), 8, LEAST, FORCED)
    return spark.createDataFrame(_round(found), "feature string, bin int, bound double")


def bins_travel(spark, sf_dir):
    """Bounds in column metadata after a round trip through Parquet and a subset, and out of a file of their own: rows by bin."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.lit(0).alias("w"), F.array(F.lit(0.0)).alias("y"))
    names, table_path, own = ["l_discount", "l_tax"], new_path(spark, "binned"), new_path(spark, "bounds")
    bounds = N.fit_bins(li, names, MOST, LEAST)
    N.write_bounds(spark, own, bounds)
    N.attached(li, bounds).write.parquet(table_path)
    frame = CausalFrame(spark.read.parquet(table_path), names, key="l_orderkey").subset(F.col("l_linenumber") > 2, ["l_discount"])
    held, filed = N.found_bounds(frame.df, frame.features), N.read_bounds(spark, own)
    if held["l_discount"] != filed["l_discount"]:
        raise RuntimeError("the two ways give unlike bounds")
    return frame.df.groupBy(N.assigned(frame.df, "l_discount", held["l_discount"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


FORCED = {"quantity": [10.0, 25.5], "price": [40000.25, 1500.0]}


def _steps(gaps: str, values: str, most: int) -> str:
    """Cuts of positive values without frequent ones. gaps: (gap, bins, n); values: (gap, value, n). A bin ends at the first value that fills it, and what is left is dealt anew to the bins that are left."""
    steps = [f"gaps AS ({gaps}), vals AS ({values}), v AS (SELECT *, sum(n) OVER u AS cum, lead(value) OVER u AS next FROM vals WINDOW u AS (PARTITION BY gap ORDER BY value)), s0 AS (SELECT gap, bins, n, 0::DOUBLE AS cum, NULL::DOUBLE AS bound FROM gaps)"]
    for k in range(most - 1):
        steps.append(f"s{k + 1} AS (SELECT s.gap, any_value(s.bins) AS bins, any_value(s.n) AS n, min(v.cum)::DOUBLE AS cum, arg_min((v.value + v.next) / 2, v.value) AS bound FROM s{k} s JOIN v ON v.gap = s.gap WHERE s.bins > {k + 1} AND v.next IS NOT NULL AND v.cum >= s.cum + (s.n - s.cum) / (s.bins - {k}) GROUP BY s.gap)")
    return ", ".join(steps) + ", cuts AS (" + " UNION ALL ".join(f"SELECT gap, bound FROM s{k + 1}" for k in range(most - 1)) + ")"


EXACT = f"WITH {_steps(f'SELECT 0 AS gap, least({MOST - 1}, count(*) // {LEAST}) AS bins, count(*)::DOUBLE AS n FROM lineitem', 'SELECT 0 AS gap, l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY ALL', MOST - 1)}, b AS (SELECT bound FROM cuts UNION ALL SELECT 'inf'::DOUBLE) SELECT 'price' AS feature, (row_number() OVER (ORDER BY bound) - 1)::INT AS bin, round(bound, 9) AS bound FROM b"


def _forced_sql(feature: str, column: str) -> str:
    low, high = sorted(FORCED[feature])
    gap = f"CASE WHEN {column} < {low} THEN 0 WHEN {column} < {high} THEN 1 ELSE 2 END"
    # four free bins: rounded shares of the rows to the first two gaps, the rest to the last
    shares = f"SELECT gap, n, CASE WHEN gap < 2 THEN least(floor(n * 4 / whole + 0.5), 4) END AS share FROM (SELECT {gap} AS gap, count(*)::DOUBLE AS n, (SELECT count(*) FROM lineitem)::DOUBLE AS whole FROM lineitem GROUP BY 1)"
    gaps = f"SELECT gap, n, 1 + CASE gap WHEN 0 THEN share WHEN 1 THEN least(share, 4 - sum(share) FILTER (gap = 0) OVER ()) ELSE 4 - sum(share) FILTER (gap < 2) OVER () END AS bins FROM ({shares})"
    sql = _steps(gaps, f"SELECT {gap} AS gap, {column} AS value, count(*) AS n FROM lineitem GROUP BY ALL", 5)
    return f"SELECT '{feature}' AS feature, bound FROM (WITH {sql} SELECT bound FROM cuts) UNION ALL SELECT '{feature}', unnest([1e-35, {low}, {high}, 'inf'::DOUBLE])"


FORCED_SQL = f"SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY bound) - 1)::INT AS bin, round(bound, 9) AS bound FROM ({_forced_sql('quantity', 'l_quantity')} UNION ALL {_forced_sql('price', 'l_extendedprice')})"


def bin_categories(spark, sf_dir):
    """Nations of customers from the most frequent on, until the share is covered."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for each nation
    codes = N.categories(counts["c_nationkey"].to_numpy(), counts["n"].to_numpy(), COVER)
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "bin int, nation int")


CATEGORIES = f"WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, nation) AS i, sum(n) OVER (ORDER BY n DESC, nation ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS whole FROM c) SELECT (i - 1)::INT AS bin, nation::INT AS nation FROM o WHERE before < {COVER} * whole"


def bin_trivial(spark, sf_dir):
    """Features of which no bound leaves enough rows on both sides."""
    df, names = _features(spark, sf_dir), ["quantity", "constant", "rare"]
    bounds = N.fit_bins(df, names, MOST, LEAST)

    def count(parts):
        total = {f: np.zeros(len(bounds[f]) + 1, np.int64) for f in names}
        for pdf in parts:
            for f in names:
                total[f] += np.bincount(N.transform(pdf[f].to_numpy(), bounds[f]), minlength=len(bounds[f]) + 1)
        yield pd.DataFrame([(f, i, int(n)) for f in names for i, n in enumerate(total[f])], columns=["feature", "bin", "n"])

    counts = df.select(*names).mapInPandas(count, "feature string, bin int, n bigint").groupBy("feature", "bin").agg(F.sum("n").alias("n")).toPandas()  # bins of three features
    rows = [(f, bool(N.trivial(bounds[f], counts[counts["feature"] == f].sort_values("bin")["n"].to_numpy(), RARE))) for f in names]
    return spark.createDataFrame(rows, "feature string, trivial boolean")


TRIVIAL = f"SELECT 'quantity' AS feature, FALSE AS trivial UNION ALL SELECT 'constant', TRUE UNION ALL SELECT 'rare', least(count(*) FILTER (l_quantity = 50 AND l_linenumber = 7), count(*) FILTER (NOT (l_quantity = 50 AND l_linenumber = 7))) < {RARE} FROM lineitem"


def bin_inverse(spark, sf_dir):
    """Rows by the upper bound of their bin."""
    bounds = [*BOUNDS, float("inf")]

    @F.pandas_udf("double")
    def upper(x: pd.Series) -> pd.Series:
        return pd.Series(N.inverse(N.transform(x.to_numpy(), bounds), bounds))

    return table(spark, sf_dir, "lineitem").select(upper("l_discount").alias("upper")).groupBy("upper").agg(F.count(F.lit(1)).alias("n"))


INVERSE = f"WITH {ASSIGNED} SELECT CASE bin {' '.join(f'WHEN {i} THEN {b}' for i, b in enumerate(BOUNDS))} ELSE 'inf'::DOUBLE END AS upper, count(*) AS n FROM assigned GROUP BY 1"


def sumby_log(spark, sf_dir):
    df = binned(spark, sf_dir).select("w", "b0", "b1", *((F.get("y", F.lit(t)) + 1).alias(f"y{t}") for t in (0, 6)))
    out = H.sumby_stacked(df, ["b0", "b1"], "w", ["y0", "y6"], F.ln)
    return out.select("feature", "bin", "w", F.round("y0", 8).alias("y0"), F.round("y6", 8).alias("y6"))


def sumby_identity(spark, sf_dir):
    df = binned(spark, sf_dir).select("w", "b0", "b1", *(F.get("y", F.lit(t)).alias(f"y{t}") for t in (0, 6)))
    return H.sumby_stacked(df, ["b0", "b1"], "w", ["y0", "y6"])


def countby_stacked(spark, sf_dir):
    """Customers with an order in the first or the last period, by arm and bin of both features."""
    some = lambda t: F.when(F.get("y", F.lit(t)) > 0, F.get("y", F.lit(t))).otherwise(F.lit(float("nan")))
    return H.countby_stacked(binned(spark, sf_dir).select("w", "b0", "b1", some(0).alias("y0"), some(6).alias("y6")), ["b0", "b1"], "w", ["y0", "y6"])


_BOTH = f"WITH {PANEL}, f AS (SELECT 0 AS feature, b0 AS bin, w, y FROM binned UNION ALL SELECT 1, b1, w, y FROM binned)"
QUERIES = {
    "bin_bounds_greedy": (bin_bounds_greedy, GREEDY), "bins_travel": (bins_travel, "SELECT bin, count(*) FILTER (l_linenumber > 2) AS n, min(l_discount) AS low, max(l_discount) AS high FROM (SELECT l_linenumber, l_discount, (dense_rank() OVER (ORDER BY l_discount) - 1)::INT AS bin FROM lineitem) GROUP BY bin HAVING count(*) FILTER (l_linenumber > 2) > 0"), "bin_bounds_exact": (bin_bounds_exact, EXACT), "bin_bounds_forced": (bin_bounds_forced, FORCED_SQL), "bin_categories": (bin_categories, CATEGORIES), "bin_trivial": (bin_trivial, TRIVIAL), "bin_inverse": (bin_inverse, INVERSE),
    "sumby_log": (sumby_log, f"{_BOTH} SELECT feature, bin, w, round(sum(ln(y[1] + 1)), 8) AS y0, round(sum(ln(y[7] + 1)), 8) AS y6 FROM f GROUP BY ALL"),
    "sumby_identity": (sumby_identity, f"{_BOTH} SELECT feature, bin, w, sum(y[1]) AS y0, sum(y[7]) AS y6 FROM f GROUP BY ALL"),
    "countby_stacked": (countby_stacked, f"{_BOTH} SELECT feature, bin, w, count(*) FILTER (y[1] > 0 OR y[7] > 0) AS n FROM f GROUP BY ALL"),
}
