"""Significance tests: Newey-West, block bootstraps as rows, deflated Sharpe, hurdles."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import SQRT12, col, ratio
from panelspark.functions.stats import deflated_sharpe_full, norm_cdf, norm_ppf
from panelspark.sources.stage import stage


def newey_west(df: DataFrame, keys: list[str], order: str, value: str, lags: int = 3) -> DataFrame:
    """t statistic of the mean with Bartlett weights; all lags in one window pass and one aggregate."""
    d = df.where(F.col(value).isNotNull())
    mean = d.groupBy(*keys).agg(F.avg(value).alias("_m"))
    d = d.join(mean, keys).withColumn("_d", F.col(value) - F.col("_m"))
    w = Window.partitionBy(*keys).orderBy(order)
    d = d.select(*keys, "_m", "_d", *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)])
    n = F.count("*").cast("double")
    var = F.sum(F.col("_d") * F.col("_d")) / n
    for k in range(1, lags + 1):
        # the weight uses min(lags, n - 1) terms but always the nominal L; a lag beyond n - 1 has no products
        var = var + 2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    se = F.sqrt(F.greatest(var, F.lit(0.0)) / n)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), se.alias("se"),
                                F.when((n >= 3) & (se > 0), F.try_divide(F.first("_m"), se)).alias("nw_t"))


def hac_difference(pairs: DataFrame, keys: list[str], order: str, kind: str, min_obs: int = 12) -> DataFrame:
    """HAC test of a difference of Sharpe ratios or log variances of aligned x and y.

    By the delta method the difference is the mean of one influence series.  That series is prewhitened by its first
    autocorrelation; the long-run variance of the rest weighs all pairs of its rows with the quadratic-spectral kernel at
    the AR(1) plug-in bandwidth.  A group is one pair of series, so the pairs of rows are bounded by the calendar.  The
    series are written between the steps, else one task would hold the sorts of all of them.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(order)
    m = pairs.select(*keys, order, "x", "y", F.avg("x").over(whole).alias("mx"), F.avg("y").over(whole).alias("my"), F.var_pop("x").over(whole).alias("vx"), F.var_pop("y").over(whole).alias("vy"),
                     F.count("*").over(whole).alias("n")).where(F.col("n") >= min_obs)

    def part(x, mean, var):
        dev = F.col(x) - F.col(mean)
        if kind == "variance":
            return dev * dev / F.col(var) - 1.0
        return dev / F.sqrt(var) - F.col(mean) / (2.0 * F.pow(var, F.lit(1.5))) * (dev * dev - F.col(var))
    delta = F.ln(F.col("vx") / F.col("vy")) if kind == "variance" else F.col("mx") / F.sqrt("vx") - F.col("my") / F.sqrt("vy")
    d = m.select(*keys, "n", delta.alias("delta"), F.row_number().over(w).alias("i"), (part("x", "mx", "vx") - part("y", "my", "vy")).alias("f"))
    before = whole.orderBy("i")

    def ar1(value, lagged):
        return F.greatest(F.lit(-0.97), F.least(F.lit(0.97), F.sum(F.col(value) * F.col(lagged)) / F.sum(F.col(lagged) * F.col(lagged))))
    d = stage(d.withColumn("_g", F.lag("f").over(before)).where("_g is not null"))
    u = d.join(d.groupBy(*keys).agg(ar1("f", "_g").alias("rho")), keys).withColumn("u", F.col("f") - F.col("rho") * F.col("_g")).drop("_g", "f")
    u = stage(u.withColumn("_h", F.lag("u").over(before)))
    size = u.groupBy(*keys).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("delta").alias("delta"), F.first("rho").alias("rho"), ar1("u", "_h").alias("q")).where("c > 1")
    head = stage(size).withColumn("bandwidth", 1.3221 * F.pow(4.0 * F.col("q") * F.col("q") / F.pow(1.0 - F.col("q"), F.lit(4.0)) * F.col("c"), F.lit(0.2))).drop("q")
    other = u.select(*keys, F.col("i").alias("j"), F.col("u").alias("v"))
    both = u.select(*keys, "i", "u").join(other, keys).join(head.select(*keys, "bandwidth"), keys)
    gap = F.abs(F.col("i") - F.col("j")) / F.col("bandwidth")
    angle = 1.2 * math.pi * gap
    kernel = F.when(F.col("i") == F.col("j"), 1.0).otherwise(25.0 / (12.0 * F.pow(math.pi * gap, F.lit(2.0))) * (F.sin(angle) / angle - F.cos(angle)))
    total = both.groupBy(*keys).agg(F.sum(F.col("u") * F.col("v") * kernel).alias("s"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("s") / F.col("c")) / F.pow(1.0 - F.col("rho"), F.lit(2.0)) / F.col("n"))
    return head.join(total, keys).select(*keys, "n", "delta", se.alias("se"), F.try_divide("delta", se).alias("z"), "bandwidth")


# ---------------------------------------------------------------- bootstrap
def block_start(counter: Column, n: Column, seed: int) -> Column:
    """Deterministic start position in 0..n-1 from a draw counter (integer mixing, no driver RNG)."""
    m = F.lit(2147483648).cast("bigint")
    c = counter.cast("bigint") + F.lit(seed).cast("bigint")
    x = F.pmod(c * F.lit(1103515245).cast("bigint") + F.lit(12345), m)
    x = F.pmod(F.shiftright(x * x, 10) + c * F.lit(7919).cast("bigint"), m)
    x = F.pmod(x * F.lit(69069).cast("bigint") + F.lit(1), m)
    return F.shiftright(x * n.cast("bigint"), 31)


def positions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds pos (0-based) and n per series."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"pos": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})


def block_sums(df: DataFrame, keys: list[str], values: list[str], block: int) -> DataFrame:
    """Sums over the circular block that starts at each position, full and cut to the last block's length."""
    off = F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_o")
    d = df.select(*keys, "n", "pos", *values, off)
    last = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block
    d = d.withColumns({"start": F.pmod(F.col("pos") - F.col("_o"), F.col("n")), "_in": F.col("_o") < last})
    return d.groupBy(*keys, "start").agg(*[F.sum(v).alias(v) for v in values],
                                         *[F.sum(F.when(F.col("_in"), F.col(v)).otherwise(0.0)).alias(f"{v}_cut") for v in values])


def bootstrap_blocks(df: DataFrame, keys: list[str], values: list[str], block: int, reps: int, seed: int) -> DataFrame:
    """One row per (series, replicate, block) with that block's sums and length.

    Replicates are rows: draws are spread over the cluster by (series, replicate) and joined to
    n block-sum rows per series, so no replicate is ever simulated in one task or on the driver.
    """
    sums = block_sums(df, keys, values, block)
    blocks = F.ceil(F.col("n") / block)
    draws = df.groupBy(*keys).agg(F.max("n").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draws = draws.repartition(*keys, "rep").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    draws = draws.withColumn("start", block_start(F.col("rep") * blocks + F.col("blk"), F.col("n"), seed))
    d = draws.join(sums, [*keys, "start"])
    cut = F.col("blk") == blocks - 1
    return d.select(*keys, "rep", "n", F.when(cut, F.col("n") - (blocks - 1) * block).otherwise(F.lit(block)).cast("double").alias("len"),
                    *[F.when(cut, F.col(f"{v}_cut")).otherwise(F.col(v)).alias(v) for v in values])


def bootstrap_sharpe_ci(df: DataFrame, keys: list[str], order: str, value: str, block: int = 3, reps: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile interval of the geometric Sharpe ratio from circular blocks."""
    d = positions(df.where(F.col(value).isNotNull()), keys, order)
    d = d.withColumns({"r1": F.col(value), "r2": F.col(value) * F.col(value), "lg": F.log1p(F.col(value))})
    b = bootstrap_blocks(d.where(F.col("n") >= max(4, block)), keys, ["r1", "r2", "lg"], block, reps, seed)
    n = F.col("n").cast("double")
    s = b.groupBy(*keys, "rep").agg(F.first("n").alias("n"), F.sum("r1").alias("s1"), F.sum("r2").alias("s2"), F.sum("lg").alias("sl"))
    vol = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))) * SQRT12
    s = s.withColumn("sharpe", F.when(vol > 0, F.try_divide(F.exp(F.col("sl") * 12.0 / n) - 1.0, vol)))
    q = F.percentile("sharpe", F.array(F.lit(0.025), F.lit(0.975)))
    return s.groupBy(*keys).agg(q[0].alias("lo"), q[1].alias("hi"), F.count("sharpe").alias("reps"))


def _pair_moments(prefix: str, n: Column, kind: str) -> dict[str, Column]:
    """Statistic and gradient of a pair from sums of x, y, x^2, y^2 (kind: 'sharpe' or 'variance')."""
    mx, my, gx, gy = (F.col(f"{prefix}{v}") / n for v in ("x", "y", "x2", "y2"))
    vx, vy = gx - mx * mx, gy - my * my
    if kind == "variance":
        return {"delta": F.ln(vx) - F.ln(vy), "c1": -2.0 * mx / vx, "c2": 2.0 * my / vy, "c3": 1.0 / vx, "c4": -1.0 / vy,
                "mx": mx, "my": my, "gx": gx, "gy": gy}
    sx, sy = F.sqrt(vx), F.sqrt(vy)
    return {"delta": mx / sx - my / sy, "c1": gx / (sx * sx * sx), "c2": -gy / (sy * sy * sy),
            "c3": -mx / (2.0 * sx * sx * sx), "c4": my / (2.0 * sy * sy * sy), "mx": mx, "my": my, "gx": gx, "gy": gy}


def studentised(blocks: DataFrame, keys: list[str], block: int, kind: str) -> DataFrame:
    """delta and its natural block standard error from block sums, in one aggregate.

    sum_k (c'(S_k - len_k m))^2 is a quadratic form in sums of S_i S_j, S_i len and len^2, so the
    second pass over the blocks is not needed.
    """
    vs = ["x", "y", "x2", "y2", "len"]
    prods = {f"q{i}{j}": F.sum(F.col(vs[i]) * F.col(vs[j])) for i in range(5) for j in range(i, 5)}
    a = blocks.groupBy(*keys).agg(F.first("n").alias("n"), F.count("*").alias("k"), *[F.sum(v).alias(f"s_{v}") for v in vs[:4]],
                                  *[e.alias(k) for k, e in prods.items()])
    m = _pair_moments("s_", F.col("n").cast("double"), kind)
    a = a.select("*", *[e.alias(f"m_{k}") for k, e in m.items()])
    c = [F.col("m_c1"), F.col("m_c2"), F.col("m_c3"), F.col("m_c4"),
         -(F.col("m_c1") * F.col("m_mx") + F.col("m_c2") * F.col("m_my") + F.col("m_c3") * F.col("m_gx") + F.col("m_c4") * F.col("m_gy"))]
    quad = F.lit(0.0)
    for i in range(5):
        for j in range(i, 5):
            quad = quad + c[i] * c[j] * F.col(f"q{i}{j}") * (1.0 if i == j else 2.0)
    se = F.sqrt(F.greatest(F.lit(0.0), quad) / F.col("k") / block / F.col("n"))
    return a.select(*keys, "n", F.col("m_delta").alias("delta"), se.alias("se"))


def paired_bootstrap(pairs: DataFrame, keys: list[str], order: str, kind: str = "sharpe", block: int = 4, reps: int = 5000,
                     seed: int = 20260926, min_obs: int = 12) -> DataFrame:
    """Studentised paired circular block bootstrap of a Sharpe or log-variance difference.

    ``pairs``: keys, order, x, y (excess returns).  One-sided p is for a larger Sharpe or a smaller variance.
    """
    d = positions(pairs.where("x is not null and y is not null"), keys, order).where(F.col("n") >= min_obs)
    scale = d.groupBy(*keys).agg(F.sqrt((F.sum(F.col("x") * F.col("x")) + F.sum(F.col("y") * F.col("y"))) / (2.0 * F.count("*"))).alias("_s"))
    d = d.join(scale, keys).withColumns({"x": F.col("x") / F.col("_s"), "y": F.col("y") / F.col("_s")})
    d = d.withColumns({"x2": F.col("x") * F.col("x"), "y2": F.col("y") * F.col("y")})
    vals = ["x", "y", "x2", "y2"]
    own = d.groupBy(*keys, F.floor(F.col("pos") / block).alias("_b")).agg(F.first("n").alias("n"), F.count("*").cast("double").alias("len"), *[F.sum(v).alias(v) for v in vals])
    base = studentised(own, keys, block, kind).select(*keys, F.col("delta").alias("delta0"), F.col("se").alias("se_nat"), F.col("n").alias("n_obs"))
    reps_ = studentised(bootstrap_blocks(d, keys, vals, block, reps, seed), [*keys, "rep"], block, kind).join(base, keys)
    z0 = F.when(F.col("se_nat") > 1e-14, F.col("delta0") / F.nullif(F.col("se_nat"), F.lit(0.0))).otherwise(F.lit(0.0))
    zc = F.when(F.col("se") > 1e-14, (F.col("delta") - F.col("delta0")) / F.nullif(F.col("se"), F.lit(0.0))).otherwise(F.lit(0.0))
    one = F.count_if(zc >= z0) if kind == "sharpe" else F.count_if(zc <= z0)
    g = reps_.groupBy(*keys).agg(F.first("n_obs").alias("n"), F.first("delta0").alias("delta"), F.first("se_nat").alias("se_nat"), F.first(z0).alias("z"),
                                 one.alias("_one"), F.count_if(F.abs(zc) >= F.abs(z0)).alias("_two"), F.count("*").alias("reps"))
    return g.select(*keys, "n", "delta", "se_nat", "z", ((1.0 + F.col("_one")) / (1.0 + F.col("reps"))).alias("p_one_sided"),
                    ((1.0 + F.col("_two")) / (1.0 + F.col("reps"))).alias("p_two_sided"), "reps")


# ---------------------------------------------------------------- hurdles and power
def hurdle_sharpe(target, sr0, n_obs, skew, kurt, lo: float = 0.0, hi: float = 3.0, steps: int = 60) -> Column:
    """Annual Sharpe at which the deflated Sharpe reaches the target: bisection inside one column."""
    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        low = F.coalesce(deflated_sharpe_full(mid / SQRT12, sr0, n_obs, skew, kurt) < col(target), F.lit(False))
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))
    zero = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step, lambda a: (a["lo"] + a["hi"]) / 2.0)


def detectable_gap(se, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Gap that a one-sided test finds with the given power."""
    return (norm_ppf(F.lit(1.0 - alpha)) + norm_ppf(F.lit(power))) * col(se)


def two_sided_p(z) -> Column:
    return 2.0 * (1.0 - norm_cdf(F.abs(col(z))))
