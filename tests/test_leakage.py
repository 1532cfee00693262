"""No look-ahead: changing the future must not change the past."""
from functools import cached_property

import pytest
from pyspark.sql import functions as F

from panelspark.catalog import q_alloc as QA, q_portfolio as QW, q_scores as QS
from panelspark.plans.views import Views

CUT = 1998 * 12 + 6


class Mutated(Views):
    """The same views with every price and return after the cut replaced."""

    def _m(self, df, col):
        return df.withColumn(col, F.when(F.col("midx") > CUT, F.col(col) * 1.7 + 0.3).otherwise(F.col(col)))

    px_s = cached_property(lambda self: self._m(Views.px_s.func(self), "price"))
    px_b = cached_property(lambda self: self._m(Views.px_b.func(self), "price"))
    ret_s = cached_property(lambda self: self._m(Views.ret_s.func(self), "ret"))
    ret_b = cached_property(lambda self: self._m(Views.ret_b.func(self), "ret"))


CASES = {
    "scores": (lambda v: QS.monthly_scores(v).select("key", "midx", "s"), 0),
    "rotation": (lambda v: QW.rotation_signals(v).select("key", "midx", "z", "vol_ok", "is_on"), 0),
    "shrinkage": (lambda v: QA.g14i(v), 0),
    "regimes": (lambda v: QA.regime_features(v), 0),
    "min_variance": (lambda v: QA.A.allocate(QA.lw_cov(v), ["midx"], QA.K.min_variance), 0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_future_does_not_move_the_past(spark, sf, name):
    fn, lag = CASES[name]
    def past(v):
        d = fn(v).where(F.col("midx") <= CUT - lag)
        return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    a, b = past(Views(spark, sf)), past(Mutated(spark, sf))
    assert a and a == b
