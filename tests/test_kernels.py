"""Matrix helpers against optimality conditions, limits and brute force."""
import numpy as np
from pyspark.sql import functions as F
import pytest

from panelspark.operators import kernels as K


def cov(n=8, t=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((t, n)) @ (np.eye(n) + 0.4 * rng.standard_normal((n, n)) / np.sqrt(n)) * rng.uniform(0.5, 3, n)
    return np.cov(x, rowvar=False, ddof=0)


@pytest.mark.parametrize("seed", range(6))
def test_min_variance_is_optimal(seed):
    c = cov(10, 40, seed)
    w = K.min_variance(c)
    g = c @ w
    v = w @ g
    assert w.sum() == pytest.approx(1) and w.min() >= 0
    assert (g >= v - 1e-9 * abs(v)).all() and np.allclose(g[w > 0], v, rtol=1e-8)
    rng = np.random.default_rng(seed)
    for p in rng.dirichlet(np.ones(10), 500):
        assert p @ c @ p >= v - 1e-12


def test_equal_risk_shares():
    w = K.equal_risk(cov(12, 50, 3))
    share = w * (cov(12, 50, 3) @ w)
    assert np.allclose(share, share.mean(), rtol=1e-9)


def test_many_names():
    w = K.min_variance(np.eye(1100))
    assert np.allclose(w, 1 / 1100)


def test_a_wrong_weight_fails_its_certificate(spark):
    """The certificates can fail: equal weights are neither minimum variance nor equal risk on this matrix."""
    from panelspark.operators import covariance as V
    c = cov(6, 60, 4)
    rows = [(1, f"k{i}", f"k{j}", float(c[i, j])) for i in range(6) for j in range(i, 6)]
    e = spark.createDataFrame(rows, "midx int, k1 string, k2 string, cov double")
    for w, right in ((K.min_variance(c), "kkt_ok"), (K.equal_risk(c), "parity_ok"), (np.full(6, 1 / 6), None)):
        d = spark.createDataFrame([(1, f"k{i}", float(x)) for i, x in enumerate(w)], "midx int, key string, weight double")
        got = {"kkt_ok": V.min_variance_certificate(d, e, ["midx"]).first()["kkt_ok"], "parity_ok": V.equal_risk_certificate(d, e, ["midx"]).first()["parity_ok"]}
        assert got == {k: k == right for k in got}


def test_two_states_separates_volatility_without_looking_ahead(spark):
    from panelspark.operators import allocate as A
    rng = np.random.default_rng(0)
    vol = np.r_[rng.normal(1, .1, 40), rng.normal(3, .1, 20), rng.normal(1, .1, 10)]
    rows = [(i, float(v), float(v + rng.normal(0, .1))) for i, v in enumerate(vol)]
    df = spark.createDataFrame(rows, "midx int, vol double, corr double")
    got = {r["midx"]: r for r in A.regime_labels(df, "midx", ["vol", "corr"], "vol", 5).collect()}
    assert all(got[i]["stress"] == 1 and got[i]["settled"] for i in range(40, 60)) and all(got[i]["stress"] == 0 for i in range(60, 70)) and min(got) == 4
    cut = {r["midx"]: r for r in A.regime_labels(df.where("midx < 50"), "midx", ["vol", "corr"], "vol", 5).collect()}
    assert all(cut[i] == got[i] for i in cut)
    flat = A.regime_labels(df.withColumns({"vol": F.lit(1.0), "corr": F.lit(2.0)}), "midx", ["vol", "corr"], "vol", 5).collect()
    assert {r["stress"] for r in flat} == {0}


def test_var_forecast_equals_least_squares(spark):
    from panelspark.operators import allocate as A
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(50, 3)), axis=0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "midx int, a double, b double, c double")
    for r in A.var1_forecast(df, [], "midx", ["a", "b", "c"], 30).collect():
        i = r["midx"]
        h = x[max(0, i - 30):i]
        want = h[-1] if len(h) < 13 else np.array([1.0, *h[-1]]) @ np.linalg.lstsq(np.column_stack([np.ones(len(h) - 1), h[:-1]]), h[1:], rcond=None)[0]
        np.testing.assert_allclose([r["a_hat"], r["b_hat"], r["c_hat"]], want, atol=1e-8)
        assert r["rows"] == len(h)


def test_wide_systems_equal_numpy(spark):
    from panelspark.operators import covariance as V
    c = cov(5, 60, 4)
    names = [f"k{i}" for i in range(5)]
    e = spark.createDataFrame([(1, names[i], names[j], float(c[i, j])) for i in range(5) for j in range(i, 5)] + [(2, "k0", "k0", 1.0)], "midx int, k1 string, k2 string, cov double")
    wide = V.wide_matrix(e, ["midx"], names)
    w = {r["key"]: r["weight"] for r in V.wide_equal_risk(wide, ["midx"], names, 0.0).collect()}
    np.testing.assert_allclose([w[k] for k in names], K.equal_risk(c), atol=1e-10)
    m = np.arange(5) / 10
    means = spark.createDataFrame([(1, k, float(x)) for k, x in zip(names, m)], "midx int, key string, mean double")
    f = V.wide_frontier(wide, means, ["midx"], names).collect()
    assert len(f) == 1
    inv = np.linalg.inv(c)
    np.testing.assert_allclose([f[0]["a"], f[0]["b"], f[0]["c"]], [inv.sum(), m @ inv.sum(1), m @ inv @ m], rtol=1e-9)
