"""Buckets of values by sorted cuts."""
import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators import windows as W


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 200, 255])
def test_cuts_below(spark, n):
    cuts = [k / 2 for k in range(n)]
    values = [-math.inf, -1.0, 0.0, 0.25, 0.5, 1.0, 3.0, 63.7, 99.5, 127.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(W.cuts_below(F.col("v"), cuts)).collect()]
    assert got == [n if math.isnan(v) else sum(c < v for c in cuts) for v in values]


def test_a_cut_at_infinity(spark):
    df = spark.createDataFrame([(math.inf,), (math.nan,), (2.0,)], "v double")
    assert [r[0] for r in df.select(W.cuts_below(F.col("v"), [1.0, math.inf])).collect()] == [1, 2, 1]


def test_bucketing_compares_with_few_cuts(spark):
    plan = spark.range(1).select(W.cuts_below(F.col("id").cast("double"), [float(k) for k in range(255)]))._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan.lower()
