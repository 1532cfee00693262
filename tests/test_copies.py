"""A supplier whose lines are another's in a different order has the same returns to the last bit."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import catalog
from panelspark.plans.views import Views


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Suppliers 1 (the benchmark) and 2: the same lines of 24 months, in two orders."""
    rng, lines = random.Random(5), []
    for month in pd.date_range("1995-01-01", periods=24, freq="MS"):
        lines += [(float(rng.randint(1, 50)), rng.randint(90_000, 10_499_999) / 100, month) for _ in range(60)]
    df = pd.DataFrame(lines + lines[::-1], columns=["l_quantity", "l_extendedprice", "l_shipdate"])
    df["l_suppkey"] = [1] * len(lines) + [2] * len(lines)
    last = pd.DataFrame([(1.0, 1.0, pd.Timestamp("1997-01-01"), 1)], columns=df.columns)
    path = tmp_path_factory.mktemp("copies")
    pd.concat([df, last]).astype({"l_shipdate": "datetime64[us]"}).to_parquet(path / "lineitem.parquet")
    pd.DataFrame({"s_suppkey": [1, 2], "s_name": ["a", "b"]}).to_parquet(path / "supplier.parquet")
    return str(path)


def test_excess_over_a_copy_of_the_benchmark_is_zero(spark, copies):
    rows = catalog.queries()["a05_quality_ir"](spark, copies).where("key = 'S2'").collect()
    assert len(rows) == 24 and all(r.quality is None for r in rows)  # 0 / 0, not noise / noise


def test_a_copy_of_the_benchmark_is_never_above_it(spark, copies):
    rows = catalog.queries()["f12_raw_on_rules"](spark, copies).where("key = 'S2'").collect()
    assert len(rows) == 24 and not any(r.plain for r in rows)


@pytest.fixture
def shaky_prices(monkeypatch):
    """Prices that come out differently whenever they are read: a cluster may add them up in another order."""
    prices = Views._prices
    noise = F.crc32(F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID"))) * 1e-15
    monkeypatch.setattr(Views, "_prices", staticmethod(lambda *a: prices(*a).withColumn("price", F.col("price") * (1.0 + noise))))


def test_the_benchmark_is_compared_with_the_numbers_it_was_read_as(spark, copies, shaky_prices):
    rows = catalog.queries()["f12_raw_on_rules"](spark, copies).where("key = 'S1'").collect()
    assert len(rows) == 24 and not any(r.plain for r in rows)


def test_the_benchmark_has_no_excess_over_itself(spark, copies, shaky_prices):
    rows = catalog.queries()["a05_quality_ir"](spark, copies).where("key = 'S1'").collect()
    assert len(rows) == 24 and all(r.quality is None for r in rows)
