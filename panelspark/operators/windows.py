"""Time-series windows: one shuffle on the series key, shared by every column.

Frames over ``idx`` are RANGE frames, so a missing period is a gap and never a shifted
row, and no key x calendar cross product is needed to densify the panel.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import col, ratio
from panelspark.functions.stats import safe_corr
from panelspark.operators.ordered import left_tail
from panelspark.sources.stage import stage

UNB = Window.unboundedPreceding


def by(*keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def simple_return(value, w, idx: str | None = None, fill: str = "none") -> Column:
    """Lag ratio minus one.  fill='none': NULL across a missing period; 'pad': last seen value."""
    prev = F.lag(col(value)).over(w)
    r = ratio(value, prev) - 1.0
    return r if fill == "pad" or idx is None else F.when(F.lag(idx).over(w) == F.col(idx) - 1, r)


def log_return(value, w) -> Column:
    prev = F.lag(col(value)).over(w)
    return F.when((col(value) > 0) & (prev > 0), F.ln(col(value) / prev))


def momentum_observed(price, w, months: int = 12) -> Column:
    """P[t-1] / P[t-12] - 1 over observed rows; needs 13 of them."""
    return F.when(F.row_number().over(w) >= months + 1,
                  ratio(F.lag(col(price), 1).over(w), F.lag(col(price), months).over(w)) - 1.0)


def momentum_gapless(ret, w, first: int = 12, last: int = 2) -> Column:
    """Compounded return of periods t-first .. t-last, NULL when any of them is missing."""
    f = w.rangeBetween(-first, -last)
    return F.when(F.count(col(ret)).over(f) == first - last + 1, F.expm1(F.sum(F.log1p(col(ret))).over(f)))


def trailing_vol(ret, w, rows: int, per_year: float = 252.0, min_periods: int | None = None) -> Column:
    f = w.rowsBetween(-rows + 1, 0)
    need = rows if min_periods is None else min_periods
    return F.when(F.count(col(ret)).over(f) >= need, F.stddev_samp(col(ret)).over(f) * math.sqrt(per_year))


def expanding(agg: Column, w, value, min_periods: int = 1, prior: bool = True) -> Column:
    """Aggregate over all rows up to t-1 (prior) or t, NULL below min_periods values."""
    f = w.rowsBetween(UNB, -1 if prior else 0)
    return F.when(F.count(col(value)).over(f) >= min_periods, agg.over(f))


def expanding_z(value, w, min_periods: int = 12) -> Column:
    mu = expanding(F.avg(col(value)), w, value, min_periods)
    sd = expanding(F.stddev_samp(col(value)), w, value, min_periods)
    return ratio(col(value) - mu, sd)


def expanding_quantile(value, w, q: float, min_periods: int = 1, prior: bool = True) -> Column:
    """Exact interpolated quantile of a short series' past: rows x history.  `ordered.frame_quantile` is for long ones."""
    return expanding(F.percentile(col(value), F.lit(q)), w, value, min_periods, prior)


def wealth(ret, w) -> Column:
    return F.product(1.0 + F.coalesce(col(ret), F.lit(0.0))).over(w.rowsBetween(UNB, 0))


def drawdown(df: DataFrame, w, ret: str = "ret", start_at_one: bool = True) -> DataFrame:
    """Adds wealth and dd.  start_at_one puts the first peak before the first return."""
    out = df.withColumn("wealth", wealth(ret, w))
    peak = F.max("wealth").over(w.rowsBetween(UNB, 0))
    return out.withColumn("dd", F.col("wealth") / (F.greatest(F.lit(1.0), peak) if start_at_one else peak) - 1.0)


def rolling_sharpe(ex, w, rows: int = 36) -> Column:
    f = w.rowsBetween(-rows + 1, 0)
    return F.when(F.count(col(ex)).over(f) == rows,
                  ratio(F.avg(col(ex)).over(f) * 12.0, F.stddev_samp(col(ex)).over(f) * math.sqrt(12.0)))


def rolling_compound(ret, w, rows: int = 12) -> Column:
    f = w.rowsBetween(-rows + 1, 0)
    return F.when(F.count(col(ret)).over(f) == rows, F.product(1.0 + col(ret)).over(f) - 1.0)


def average_rank(value, partition: list[str]) -> Column:
    """Rank with ties averaged."""
    first = F.rank().over(Window.partitionBy(*partition).orderBy(col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, col(value)))
    return F.when(col(value).isNotNull(), first + (ties - 1) / 2.0)


def cuts_below(value: Column, cuts: list[float]) -> Column:
    """Number of the sorted cuts below a value, by halving: as many steps as the count of cuts has binary digits."""
    n = len(cuts).bit_length()
    arr = F.array(*[F.lit(float(c)) for c in [*cuts, *[math.inf] * ((1 << n) - 1 - len(cuts))]]) if cuts else F.array().cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in range(n - 1, -1, -1)]) if cuts else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(arr, at + step - 1) < value, at + step).otherwise(at))
    return F.least(found, F.lit(len(cuts)))  # NaN is above the filling too


def counted_values(df: DataFrame, group: list[str], value: str, buckets: int = 256) -> tuple[DataFrame, list[float]]:
    """(group, _v, _c, _b): distinct values with their counts, and a bucket by approximate quantile cuts over all rows.

    The cuts are a literal list, so a row's bucket needs no shuffle; an outlier or a hot group changes the cuts, not the
    balance.  The table is keyed by (group, value), where counts were combined.
    """
    d = stage(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    cuts = sorted(set(d.where(~F.isnan("_v")).approxQuantile("_v", [i / buckets for i in range(1, buckets)], 0.001)))
    return d.withColumn("_b", cuts_below(F.col("_v"), cuts)), cuts


def spread_average_rank(df: DataFrame, group: list[str], value: str, out: str, buckets: int = 256) -> DataFrame:
    """Exact average-tie rank when a group is too large for one task.

    Ranks are found for distinct values, inside value buckets with an offset from the counts of the buckets below; rows join
    the rank of their value.  A value that very many rows share is one row here, and only that join is skewed, which the
    engine splits.
    """
    d, _ = counted_values(df, group, value, buckets)
    size = d.groupBy(*group, "_b").agg(F.sum("_c").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(UNB, -1)), F.lit(0))  # at most `buckets` rows of a group
    d = d.join(size.select(*group, "_b", before.alias("_off")), [*group, "_b"]).repartition(*[F.col(c) for c in group], F.col("_b"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(UNB, -1)), F.lit(0))
    rank = d.select(*group, F.col("_v").alias("_rank_value"), (F.col("_off") + inside + (F.col("_c") + 1) / 2.0).alias(out))
    return df.withColumn("_rank_value", F.col(value).cast("double")).join(rank, [*group, "_rank_value"], "left").drop("_rank_value")


def percent_rank_avg(value, partition: list[str]) -> Column:
    return average_rank(value, partition) / F.count(col(value)).over(Window.partitionBy(*partition))


def rolling_pair(a: str, b: str, w, rows: int) -> dict[str, Column]:
    """Volatility, Sharpe (full window only), beta and correlation on complete pairs."""
    f = w.rowsBetween(-rows + 1, 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    n = F.count(x).over(f)
    sx, sy, cov = F.stddev_samp(x).over(f), F.stddev_samp(y).over(f), F.covar_samp(x, y).over(f)
    seen = (F.count(F.lit(1)).over(f) == rows) & (n >= 2)
    return {"pairs": n,
            "vol": F.when(n == rows, sx * math.sqrt(252.0)),
            "sharpe": F.when(n == rows, ratio(F.avg(x).over(f) * math.sqrt(252.0), sx)),
            "beta": F.when(seen, F.try_divide(cov, sy * sy)),
            "corr": F.when(seen, F.try_divide(cov, sx * sy))}


def hysteresis(raw: Column | str, w, fails: int = 2) -> Column:
    """ON at once; OFF after ``fails`` consecutive fails: ON iff any of the last ``fails`` rows is ON."""
    on = F.coalesce(col(raw), F.lit(False))
    return F.max(on).over(w.rowsBetween(-max(fails, 1) + 1, 0))


def drawdown_state(dd, up: float = -0.05, correction: float = -0.20) -> Column:
    return F.when(col(dd) > up, "Up").when(col(dd) > correction, "Correction").otherwise("Bear")


def drawdown_episodes(df: DataFrame, keys: list[str], order: str, dd: str = "dd", threshold: float = -0.10) -> DataFrame:
    """Runs of dd < 0 (gaps and islands), from first month under water to the trough."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.count_if(F.col(dd) >= 0).over(w.rowsBetween(UNB, 0))
    return (df.withColumn("island", island).where(F.col(dd) < 0)
            .groupBy(*keys, "island").agg(F.min(order).alias("start"), F.min_by(order, F.struct(dd, order)).alias("trough"),
                                          F.min(dd).alias("depth"), F.count("*").alias("months"))
            .where(F.col("depth") <= threshold).drop("island"))


def autocorrelation(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int = 40) -> DataFrame:
    """Correlation of x_t with x_{t+k}, and of their absolute values, for k = 1..max_lag.

    All lags share one window sort; the rows fan out by the fixed lag count only.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("y")) for k in range(1, max_lag + 1)])
    long = df.select(*keys, F.col(value).alias("x"), lags.alias("ls")).select(*keys, "x", F.inline("ls"))
    return long.groupBy(*keys, "lag").agg(safe_corr("x", "y").alias("acf"),
                                          safe_corr(F.abs("x"), F.abs("y")).alias("acf_abs"))


def realized_skew(ret) -> Column:
    """sqrt(n) sum r^3 / (sum r^2)^1.5 of a group, from three observations."""
    r = col(ret)
    rv, n = F.sum(r * r), F.count(r)
    return F.when((n >= 3) & (rv >= 1e-20), F.sqrt(n.cast("double")) * F.sum(r * r * r) / F.pow(rv, F.lit(1.5)))


def ar1_forecast(df: DataFrame, keys: list[str], order: str, value: str, min_values: int = 5) -> DataFrame:
    """Expanding regression of x_t on x_{t-1}; the last value where history is short or flat."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = w.rowsBetween(UNB, 0)
    d = df.withColumn("_x", F.lag(value).over(w))
    pair = F.col("_x").isNotNull() & F.col(value).isNotNull()
    x, y = F.when(pair, F.col("_x")), F.when(pair, F.col(value))
    slope = F.try_divide(F.covar_pop(x, y).over(f), F.var_pop(x).over(f))
    fit = F.avg(y).over(f) + slope * (F.col(value) - F.avg(x).over(f))
    return d.withColumn("forecast", F.coalesce(F.when(F.count(value).over(f) >= min_values, fit), F.col(value))).drop("_x")


def left_tail_score(df: DataFrame, keys: list[str], order: str, ret: str, rule: str, rows: int, skew: str | None = None) -> DataFrame:
    """Adds left_tail by the selected rule: 'cvar_5', 'below_sigma' or 'adverse_skew' (realised skewness on its bad side)."""
    if rule == "adverse_skew":
        if skew is None:
            raise ValueError("adverse_skew needs the skewness column")
        return df.withColumn("left_tail", F.when(F.col(skew).isNotNull(), F.greatest(F.lit(0.0), -F.col(skew))))
    if rule not in ("cvar_5", "below_sigma"):
        raise ValueError(f"no such rule: {rule}")
    return left_tail(df, keys, order, ret, rows).withColumn("left_tail", F.col(rule)).drop("cvar_5", "below_sigma")


def daily_rate(calendar: DataFrame, own: DataFrame, rates: DataFrame) -> DataFrame:
    """Own daily log rate where priced; before its first value a monthly rate spread over the month's sessions."""
    month = F.trunc("date", "MM")
    per_month = calendar.groupBy(month.alias("month")).agg(F.count("*").alias("sessions"))
    first = own.where("own is not null").agg(F.min("date").alias("first"))
    d = (calendar.withColumn("month", month).join(own, "date", "left").join(per_month, "month")
         .join(rates.select("month", "rate"), "month", "left"))
    early = F.col("date") < first.scalar()
    return d.select("date",
                    F.when(F.col("own").isNotNull(), "own").when(early & F.col("rate").isNotNull(), "fallback").alias("source"),
                    F.coalesce("own", F.when(early, F.ln(1.0 + F.col("rate")) / F.col("sessions"))).alias("daily"))
