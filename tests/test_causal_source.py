import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cauza.operators.bins import attached, found_bounds
from cauza.sources.causal_source import NAME, read_causal, register, slices


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('causal')}/rows"
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    pdf = pd.DataFrame({"id": range(500), "w": r.integers(0, 2, 500), "x": x, "n": r.integers(0, 9, 500), "kind": r.choice(["a", "b", "ü"], 500), "y0": r.normal(size=500), "y1": r.normal(size=500), "more": "not read"})
    df = spark.createDataFrame(pdf).withColumns({"x": F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).when(F.col("id") % 50 != 1, F.col("x")), "kind": F.when(F.col("id") % 40 != 3, F.col("kind"))})
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(out)
    return out


FILTERS = ["x > 0.5", "x >= 0.5", "x < 0", "x <= 0 AND w = 1", "NOT (x > 0.5)", "x = 0.5", "x IS NULL", "x IS NOT NULL", "n IN (1, 3)", "n NOT IN (1, 3)", "kind = 'ü'", "kind <> 'a'", "kind IN ('a', 'b')", "NOT kind IN ('a', 'b')", "kind LIKE 'a%'", "x = double('NaN')", "id > 100 AND id <= 400", "n > 2.5 OR w = 0", "kind <=> NULL"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_are_those_of_spark(spark, path, condition):
    frame = read_causal(spark, path, ["x", "n", "kind"], ["y0", "y1"], treat_dt=1)
    plain = spark.read.parquet(path).select("id", "w", "x", F.col("n").cast("double").alias("n"), "kind", F.array("y0", "y1").alias("y"))
    rows = lambda df: sorted(map(str, df.filter(condition).select(frame.df.columns).collect()))
    assert frame.df.columns == ["id", "w", "x", "n", "kind", "y"] and rows(frame.df) == rows(plain)


def test_filters_reach_the_files(spark, path):
    df = read_causal(spark, path, ["x", "n"], ["y0", "y1"]).df.filter("id > 100 AND w = 1 AND n < 4")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "more" not in plan


def test_ranges_hold_every_row_group_once(spark, path):
    register(spark)
    read = lambda most: spark.read.format(NAME).options(features="x", outcomes="y0,y1", max_partition_bytes=most).load(path)
    few, many = read(1 << 27), read(1000)
    assert few.rdd.getNumPartitions() == 1 < many.rdd.getNumPartitions()
    assert few.select("id").distinct().count() == few.count() == many.count() == 500
    assert [p.ranges for p in slices([("a", 5), ("b", 25), ("c", 1)], 10)] == [[("a", 0, 5)], [("b", 0, 8)], [("b", 8, 16)], [("b", 16, 25), ("c", 0, 1)]]


def test_roles_are_checked(spark, path, tmp_path):
    for wrong in ({"features": ["zz"]}, {"features": ["x"], "treatment": "x"}, {"features": []}):
        with pytest.raises(Exception, match="missing|two roles|needed"):
            read_causal(spark, path, **({"outcomes": ["y0", "y1"]} | wrong)).df.count()
    spark.createDataFrame([(1, 0, 1.0, [1.0, 2.0]), (2, 3, 1.0, [1.0, 2.0]), (3, 1, 1.0, [1.0])], "id int, w int, x double, y array<double>").write.parquet(f"{tmp_path}/odd")
    assert read_causal(spark, f"{tmp_path}/odd", ["x"], n_period=2, check=False).df.count() == 3
    assert read_causal(spark, f"{tmp_path}/odd", ["x"], n_period=2).df.filter("id = 1").count() == 1  # rows that are read are checked
    for bad in ("id = 2", "id = 3"):
        with pytest.raises(Exception, match="1 rows with a treatment|1 with other numbers"):
            read_causal(spark, f"{tmp_path}/odd", ["x"], n_period=2).df.filter(bad).collect()


def test_bounds_travel_with_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2, float(k), [1.0]) for k in range(50)], "id int, w int, x double, y array<double>")
    bounds = [10.5, 30.5, float("inf")]
    attached(df, {"x": bounds}).write.parquet(f"{tmp_path}/binned")
    assert found_bounds(read_causal(spark, f"{tmp_path}/binned", ["x"]).df, ["x"]) == {"x": bounds}
