import math

import numpy as np
from pyspark.sql import functions as F

from cauza.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_lgamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.3, 8.0, 100.0, 60000.0, 600000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(C.lgamma(F.col("x"))).collect()
    for x, r in zip(xs, got):
        assert abs(r[0] - math.lgamma(x)) <= 1e-12 * max(1, abs(math.lgamma(x)))


def test_losses(spark):
    rows = [(-800.0, 0.0), (800.0, 0.0), (0.0, 1.0), (2.5, 1.0)]
    df = spark.createDataFrame(rows, "z double, y double")
    for (z, y), r in zip(rows, df.select(C.bce_with_logits(F.col("z"), F.col("y"))).collect()):
        assert abs(r[0] - (np.logaddexp(0, z) - z * y)) < 1e-9
    assert abs(one(spark, C.softmax_ce([F.lit(1.0), F.lit(2.0), F.lit(0.5)], F.lit(2))) - (np.log(np.exp([1, 2, 0.5]).sum()) - 0.5)) < 1e-12
    assert one(spark, C.clipped_inverse(F.lit(0.5))) == 1.0 and one(spark, C.capped_inverse(F.lit(0.0001))) == 100.0 and one(spark, C.floored(F.lit(0.001))) == 0.01
    assert one(spark, C.merit_ratio(F.lit(1.0), F.lit(0.0))) == 1.0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, C.sqdist(a, b)) == 25 and one(spark, C.dot(a, b)) == 16 and abs(one(spark, C.rbf(a, b, 5.0)) - math.exp(-1)) < 1e-15
    assert one(spark, C.fm2(F.array(a, b), 2)) == 1 * 4 + 2 * 6


def test_bin_of(spark):
    bounds = [-1.0, 0.0, 2.5, float("inf")]
    xs = [-5.0, -1.0, -0.5, 0.0, 0.1, 2.5, 9.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.bin_of(F.col("x"), bounds, 4)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 4, 4]
