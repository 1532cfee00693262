"""The HAC test writes its series between the steps: no task holds the sorts of all of them."""
import math

import pytest

from panelspark import catalog
from panelspark.operators import inference as I


@pytest.mark.parametrize("kind", ["sharpe", "variance"])
def test_last_job_of_hac_difference_sorts_no_series(spark, kind):
    rows = [("a", "b", i, math.sin(i * i), math.cos(3.0 * i)) for i in range(30)]
    got = I.hac_difference(spark.createDataFrame(rows, "a string, b string, t int, x double, y double"), ["a", "b"], "t", kind)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1


@pytest.mark.parametrize("name", ["g08_hac_sharpe_test", "g09_hac_variance_test"])
def test_no_step_of_the_query_holds_many_sorts(spark, sf, monkeypatch, name):
    """A task may hold the first page of every sort of its step (64 MB each): 61 sorts in one plan were the fault."""
    sorts, stage = [], I.stage

    def count(df):
        sorts.append(df._jdf.queryExecution().executedPlan().toString().count("Sort ["))
        return df
    monkeypatch.setattr(I, "stage", lambda df: stage(count(df)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables: no join without sorts
    try:
        count(catalog.queries()[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(sorts) > 1 and max(sorts) <= 12, sorts
