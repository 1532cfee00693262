"""Covariance of every decision window as rows, with linear shrinkage in aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.scalar import ratio
from panelspark.operators.panel import paired


def window_entries(live: DataFrame, ret: DataFrame, lookback: int, key: str = "key", idx: str = "midx", value: str = "ret",
                   group: list[str] = ()) -> DataFrame:
    """Upper-triangle population covariances of the trailing window at each decision.

    ``live``: (group, key, idx) rows of complete windows.  Pair products exist once per period;
    the trailing window is a RANGE frame on each pair, so windows are not copied per decision.
    """
    g = list(group)
    p = paired(ret, [*g, idx], key, value, own=True)
    w = Window.partitionBy(*g, "k1", "k2").orderBy(idx).rangeBetween(-lookback + 1, 0)
    c = p.select(*g, idx, "k1", "k2", F.covar_pop("x", "y").over(w).alias("cov"), F.count("*").over(w).alias("n"))
    ok = live.select(*g, idx, key)
    c = c.where(F.col("n") == lookback)
    c = c.join(ok.withColumnRenamed(key, "k1"), [*g, idx, "k1"], "left_semi")
    return c.join(ok.withColumnRenamed(key, "k2"), [*g, idx, "k2"], "left_semi")


def shrinkage_intensity(live: DataFrame, ret: DataFrame, entries: DataFrame, lookback: int, key: str = "key", idx: str = "midx",
                        value: str = "ret", group: list[str] = ()) -> DataFrame:
    """Ledoit-Wolf intensity per decision from sums only: |S|^2, trace and sum_t (sum_i x_ti^2)^2."""
    g = list(group)
    w = Window.partitionBy(*g, key).orderBy(idx).rangeBetween(-lookback + 1, 0)
    means = ret.select(*g, key, idx, F.avg(value).over(w).alias("_m")).join(live.select(*g, key, idx), [*g, key, idx], "left_semi")
    seen = ret.where(F.col(value).isNotNull()).select(*g, key, F.col(idx).alias("_t"), F.col(value).alias("_x"),
                                                      F.explode(F.sequence(F.col(idx), F.col(idx) + lookback - 1)).alias(idx))
    sq = seen.join(means, [*g, key, idx]).groupBy(*g, idx, "_t").agg(F.sum(F.pow(F.col("_x") - F.col("_m"), 2)).alias("_q"))
    beta = sq.groupBy(*g, idx).agg(F.sum(F.col("_q") * F.col("_q")).alias("_b4"))
    two = F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(2.0)
    s = entries.groupBy(*g, idx).agg(F.sum(two * F.col("cov") * F.col("cov")).alias("_s2"),
                                     F.sum(F.when(F.col("k1") == F.col("k2"), F.col("cov"))).alias("_tr"),
                                     F.count_if(F.col("k1") == F.col("k2")).cast("double").alias("names"))
    t = float(lookback)
    d = s.join(beta, [*g, idx]).withColumn("mu", F.col("_tr") / F.col("names"))
    d = d.withColumn("_beta", (F.col("_b4") / t - F.col("_s2")) / (F.col("names") * t))
    d = d.withColumn("_delta", (F.col("_s2") - 2.0 * F.col("mu") * F.col("_tr") + F.col("names") * F.col("mu") * F.col("mu")) / F.col("names"))
    delta = F.coalesce(ratio(F.least("_beta", "_delta"), "_delta"), F.lit(0.0))
    return d.select(*g, idx, "names", "mu", F.greatest(F.lit(0.0), delta).alias("shrinkage"))


def shrunk(entries: DataFrame, intensity: DataFrame, idx: str = "midx", group: list[str] = ()) -> DataFrame:
    """(1 - d) S + d mu I, entry by entry."""
    d = entries.join(intensity, [*group, idx])
    diag = F.when(F.col("k1") == F.col("k2"), F.col("mu")).otherwise(0.0)
    return d.withColumn("cov", (1.0 - F.col("shrinkage")) * F.col("cov") + F.col("shrinkage") * diag)


def linear_shrinkage(live: DataFrame, ret: DataFrame, lookback: int, **kw) -> DataFrame:
    e = window_entries(live, ret, lookback, **kw)
    return shrunk(e, shrinkage_intensity(live, ret, e, lookback, **kw), kw.get("idx", "midx"), kw.get("group", []))


def shrunk_or_ridge(live: DataFrame, ret: DataFrame, lookback: int, ridge: float = 1e-6, **kw) -> DataFrame:
    """Linear shrinkage where the window has 12 rows and two more than names at least; a shorter one gives the sample covariance
    with a small ridge.  A single name keeps its own variance."""
    e = window_entries(live, ret, lookback, **kw)
    keys = [*kw.get("group", []), kw.get("idx", "midx")]
    d = e.join(shrinkage_intensity(live, ret, e, lookback, **kw), keys)
    own = F.col("k1") == F.col("k2")
    linear = (1.0 - F.col("shrinkage")) * F.col("cov") + F.when(own, F.col("shrinkage") * F.col("mu")).otherwise(0.0)
    sample = F.col("cov") * lookback / (lookback - 1.0) + F.when(own, ridge).otherwise(0.0)
    enough = F.lit(float(lookback)) >= F.greatest(F.lit(12.0), F.col("names") + 2)
    return d.withColumn("method", F.when(enough, "shrunk").otherwise("ridge")).withColumn("cov", F.when(enough, linear).otherwise(sample))


def blend(a: DataFrame, b: DataFrame, lam: float, keys: list[str]) -> DataFrame:
    """(1 - lam) a + lam b; decisions without a b keep a."""
    d = a.join(b.select(*keys, "k1", "k2", F.col("cov").alias("_c2")), [*keys, "k1", "k2"], "left")
    return d.withColumn("cov", F.when(F.col("_c2").isNull(), F.col("cov")).otherwise((1.0 - lam) * F.col("cov") + lam * F.col("_c2"))).drop("_c2")


def both_triangles(entries: DataFrame) -> DataFrame:
    """Full matrix rows (i, j, cov) from the stored triangle."""
    sides = F.when(F.col("k1") == F.col("k2"), F.array(F.struct(F.col("k1").alias("i"), F.col("k2").alias("j")))).otherwise(
        F.array(F.struct(F.col("k1").alias("i"), F.col("k2").alias("j")), F.struct(F.col("k2").alias("i"), F.col("k1").alias("j"))))
    others = [c for c in entries.columns if c not in ("k1", "k2", "cov")]
    return entries.select(*others, F.inline(sides), "cov")


def marginal_risk(weights: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Adds g = (C w)_i, the book variance and the risk share of each name."""
    full = both_triangles(entries).select(*keys, "i", "j", "cov")
    w = weights.select(*keys, F.col("key").alias("j"), "weight")
    g = full.join(w, [*keys, "j"]).groupBy(*keys, F.col("i").alias("key")).agg(F.sum(F.col("cov") * F.col("weight")).alias("g"))
    d = weights.join(g, [*keys, "key"])
    var = d.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("g")).alias("variance"))
    return d.join(var, keys).withColumn("risk_share", ratio(F.col("weight") * F.col("g"), "variance"))


def min_variance_certificate(weights: DataFrame, entries: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """KKT conditions of the long-only minimum variance per decision: a proof of optimality as rows."""
    d = marginal_risk(weights, entries, keys)
    gap = F.col("g") / F.col("variance") - 1.0
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (F.abs(F.sum("weight") - 1.0) < 1e-9).alias("sum_ok"), (F.min("weight") >= 0).alias("sign_ok"),
                                ((F.min(gap) > -tol) & (F.coalesce(F.max(F.when(F.col("weight") > 1e-9, F.abs(gap))), F.lit(0.0)) < tol)).alias("kkt_ok"))


def equal_risk_certificate(weights: DataFrame, entries: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Spread of risk shares per decision."""
    d = marginal_risk(weights, entries, keys)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (F.abs(F.sum("weight") - 1.0) < 1e-9).alias("sum_ok"), (F.min("weight") > 0).alias("sign_ok"),
                                (F.max("risk_share") - F.min("risk_share") < tol).alias("parity_ok"))


def wide_matrix(entries: DataFrame, keys: list[str], names: list[str], cov: str = "cov") -> DataFrame:
    """Columns a_i_j (i <= j) of every decision that has all entries of a short literal list of names, in that order."""
    cells = {f"a_{i}_{j}": F.max(F.when((F.least("k1", "k2") == min(x, y)) & (F.greatest("k1", "k2") == max(x, y)), F.col(cov))) for i, x in enumerate(names) for j, y in enumerate(names) if i <= j}
    return entries.groupBy(*keys).agg(*[c.alias(n) for n, c in cells.items()]).dropna(subset=list(cells))


def solve(matrix: Column, n: int) -> Column:
    """Rows of an augmented n x (n + m) system after Gauss-Jordan steps: entry n + k of row i is x_i for right side k.

    For symmetric positive matrices, so without exchanging rows; a zero pivot gives NULL.  One compact expression: unrolled
    columns would be copied into each other by the optimizer.
    """
    def step(rows, k):
        head = F.get(rows, k)
        pivot = F.get(head, k)
        return F.transform(rows, lambda row, i: F.when(i == k, F.transform(head, lambda v: F.try_divide(v, pivot))).otherwise(
            F.zip_with(row, head, lambda v, h: v - F.try_divide(F.get(row, k) * h, pivot))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)


def augmented(n: int, rhs: list, cell: str = "a") -> Column:
    """Columns <cell>_i_j (i <= j) and right sides, each a list of n columns, as rows of a system."""
    at = lambda i, j: F.col(f"{cell}_{min(i, j)}_{max(i, j)}")
    return F.array(*[F.array(*[at(i, j) for j in range(n)], *[r[i] for r in rhs]) for i in range(n)])


def wide_frontier(wide: DataFrame, means: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A = 1'C^-1 1, B = m'C^-1 1, C = m'C^-1 m per decision of a short literal list of names."""
    n = len(names)
    m = means.groupBy(*keys).agg(*[F.max(F.when(F.col("key") == x, F.col("mean"))).alias(f"m_{i}") for i, x in enumerate(names)])
    d = wide.join(m, keys).withColumn("_s", solve(augmented(n, [[F.lit(1.0)] * n, [F.col(f"m_{i}") for i in range(n)]]), n))
    total = lambda f: sum((f(i) for i in range(1, n)), f(0))
    x = lambda i, k: F.col("_s")[i][n + k]
    return d.select(*keys, total(lambda i: x(i, 0)).alias("a"), total(lambda i: x(i, 0) * F.col(f"m_{i}")).alias("b"), total(lambda i: x(i, 1) * F.col(f"m_{i}")).alias("c"))


def wide_equal_risk(wide: DataFrame, keys: list[str], names: list[str], ridge: float = 1e-8, sweeps: int = 100) -> DataFrame:
    """(keys, key, weight): equal risk contributions by coordinate descent on x'Cx/2 - mean(log x), one coordinate a step.

    For a short literal list of names; the matrix is one row and the steps run inside an expression.
    """
    n = len(names)
    cell = lambda i, j: F.col(f"a_{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    size = sum((cell(i, i) for i in range(1, n)), cell(0, 0)) / n
    d = wide.withColumn("_c", F.array(*[F.array(*[cell(i, j) / size for j in range(n)]) for i in range(n)]))
    start = F.array(*[1.0 / F.sqrt(F.col("_c")[i][i]) / n for i in range(n)])

    def step(x, s):
        i = F.pmod(s, F.lit(n))
        row = F.get(F.col("_c"), i)
        own = F.get(row, i)
        off = F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - own * F.get(x, i)
        return F.transform(x, lambda v, j: F.when(j == i, (F.sqrt(off * off + 4.0 * own / n) - off) / (2.0 * own)).otherwise(v))
    d = d.withColumn("_x", F.aggregate(F.sequence(F.lit(0), F.lit(n * sweeps - 1)), start, step))
    total = F.aggregate("_x", F.lit(0.0), lambda a, b: a + b)
    cells = F.array(*[F.struct(F.lit(x).alias("key"), (F.col("_x")[i] / total).alias("weight")) for i, x in enumerate(names)])
    return d.select(*keys, F.inline(cells))


def frontier(entries_with_mu: DataFrame, keys: list[str]) -> DataFrame:
    """r_mvp, sigma_mvp and curvature u from A, B, C; NULL on a flat or singular frontier."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    u = F.try_divide(a * c - b * b, a)
    return entries_with_mu.where((a > 0) & (u > 0)).select(*keys, (b / a).alias("r_mvp"), (1.0 / F.sqrt(a)).alias("sigma_mvp"), u.alias("u"))


def tangency(r, sigma, u, rf=0.0) -> dict:
    """Tangency return and volatility on the frontier (r, sigma, u); NULL when r equals rf."""
    r, sigma, u = (F.col(x) for x in (r, sigma, u))
    ret = F.when(F.abs(r - rf) >= 1e-12, F.try_divide(r * r + u * sigma * sigma - r * rf, r - rf))
    return {"r_tp": ret, "sigma_tp": F.sqrt(sigma * sigma + F.pow(ret - r, 2) / u)}
