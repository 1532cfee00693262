"""Walk-forward books: weights at t earn the return of t + 1, less turnover cost.

Targets never depend on past profit and loss, so a whole grid of trials is one job keyed by
trial; turnover is a difference with the previous rebalance and not a loop.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.scalar import SQRT12, correlation_gate, ratio, scale_factor, tail_gate
from panelspark.functions.stats import ann_return, ann_vol, deflated_sharpe_normal, sharpe_excess, sharpe_rf0, total_return
from panelspark.operators import inference as I, ordered as O, portfolio as L, windows as W
from panelspark.sources.stage import stage


# ---------------------------------------------------------------- grids
def grid(start: DataFrame, **axes) -> DataFrame:
    """Cartesian grid of literal parameter axes; each axis is a short literal array."""
    out = start
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


# ---------------------------------------------------------------- accounting
def run_book(weights: DataFrame, returns: DataFrame, keys: list[str], idx: str = "midx", cost_bps: float = 5.0, first: str = "half",
             baseline: str = "target", missing: str = "null") -> DataFrame:
    """Gross, turnover, cost and net return per (keys, decision).

    Weights are an output in their own right and feed three branches, so they are staged once.
    """
    weights = stage(weights)
    gross = L.book_returns(weights, returns, keys, idx, missing)
    prev = L.drifted(weights, returns, keys, idx) if baseline == "drifted" else None
    t = L.turnover(weights, keys, idx, first, cost_bps, prev)
    return gross.join(t.drop("first"), [*keys, idx]).withColumn("net", F.col("gross") - F.col("cost"))


def performance(df: DataFrame, keys: list[str], order: str, value: str, rate: DataFrame | None = None, start_at_one: bool = True) -> DataFrame:
    """Length, total, annual return and volatility, both Sharpe ratios and drawdown per series: one shuffle."""
    d = df.where(F.col(value).isNotNull())
    if rate is not None:
        d = d.join(rate, order, "left").withColumn("_ex", F.col(value) - F.col("rate"))
    d = W.drawdown(d, Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order), value, start_at_one)
    cols = [F.count("*").alias("n"), F.min(order).alias("start"), F.max(order).alias("end_month"), total_return(value).alias("total"),
            ann_return(value).alias("cagr"), ann_vol(value).alias("vol"), sharpe_rf0(value).alias("sharpe_rf0"), F.min("dd").alias("maxdd")]
    if rate is not None:
        cols.append(sharpe_excess("_ex").alias("sharpe_ex"))
    return d.groupBy(*keys).agg(*cols)


# ---------------------------------------------------------------- scaled core
def core_returns(ret: DataFrame, mix: dict[str, float], period: str, value: str = "ret") -> DataFrame:
    """Fixed mix return; NULL unless every leg is there."""
    w = F.element_at(F.create_map(*[x for k, x_ in mix.items() for x in (F.lit(k), F.lit(float(x_)))]), F.col("key"))
    d = ret.where(F.col("key").isin(*mix)).withColumn("_w", w)
    return d.groupBy(period).agg(F.when(F.count(value) == len(mix), F.sum(F.col("_w") * F.col(value))).alias("r"))


def sigma_table(core: DataFrame, lookbacks: list[int], date: str = "date") -> DataFrame:
    """sigma_hat and expanding sigma_star at each month end, one row per (month, lookback).

    One ordered pass over the core's calendar (one row per day), a column pair per distinct lookback.
    """
    w = Window.orderBy(date)
    f = w.rowsBetween(Window.unboundedPreceding, -1)
    d = core.where("r is not null")
    cells = [F.struct(F.lit(n).alias("lookback"), W.trailing_vol("r", w, n).alias("sigma_hat"),
                      F.when(F.count("r").over(f) >= n, F.stddev_samp("r").over(f) * math.sqrt(252.0)).alias("sigma_star")) for n in lookbacks]
    d = d.select(date, F.array(*cells).alias("cs")).select(date, F.inline("cs"))
    m = d.groupBy(F.trunc(date, "MM").alias("month"), "lookback").agg(F.max_by(F.struct("sigma_hat", "sigma_star"), date).alias("s"))
    return m.select("month", "lookback", "s.*").withColumn("midx", (F.year("month") * 12 + F.month("month")).cast("int"))


def scaled_core_returns(sigma: DataFrame, trials: DataFrame, core_m: DataFrame, cash_m: DataFrame, gate: DataFrame | None = None,
                        cost_bps: float = 5.0, gate_keys: list[str] = ()) -> DataFrame:
    """Returns of a core scaled by f (and an optional gate g), remainder in cash, for every trial.

    The book has two legs, so half turnover is the absolute change of the core share.
    """
    d = sigma.join(F.broadcast(trials), "lookback")  # trials: literal grid
    d = d.withColumn("f", scale_factor("sigma_hat", "sigma_star", F.col("f_min"), F.col("f_max"))).where("f is not null")
    if gate is not None:
        d = d.join(gate, ["midx", *gate_keys], "left").withColumn("g", F.coalesce("g", F.lit(1.0)))
    else:
        d = d.withColumn("g", F.lit(1.0))
    nxt = core_m.select((F.col("midx") - 1).alias("midx"), F.col("r").alias("r_core")).join(
        cash_m.select((F.col("midx") - 1).alias("midx"), F.col("r").alias("r_cash")), "midx").where("r_core is not null and r_cash is not null")
    d = d.join(nxt, "midx").withColumn("share", F.col("f") * F.col("g"))
    w = Window.partitionBy("trial_id").orderBy("midx")
    for name, share in (("", F.col("share")), ("_null", F.col("f"))):
        d = d.withColumn(f"gross{name}", share * F.col("r_core") + F.greatest(F.lit(0.0), 1.0 - share) * F.col("r_cash"))
        d = d.withColumn(f"turnover{name}", F.coalesce(F.abs(share - F.lag(share).over(w)), F.lit(0.0)))
        d = d.withColumn(f"net{name}", F.col(f"gross{name}") - F.col(f"turnover{name}") * cost_bps / 10000.0)
    return d.withColumn("active", F.col("net") - F.col("r_core"))


def overlay_summary(book: DataFrame, n_trials: int, reps: int = 1000, block: int = 3) -> DataFrame:
    """Per trial: performance, NW t of the active return, bootstrap interval, deflated Sharpe (per-period)."""
    keys = ["trial_id"]
    book = stage(book)  # four branches read it
    p = performance(book.select("trial_id", "midx", "net"), keys, "midx", "net")
    t = I.newey_west(book, keys, "midx", "active", 3).select("trial_id", "nw_t")
    ci = I.bootstrap_sharpe_ci(book, keys, "midx", "net", block, reps)
    m = book.groupBy("trial_id").agg((F.avg("turnover") * 12).alias("turnover_per_year"), F.avg("share").alias("mean_share"),
                                     F.avg((F.col("f") < 1 - 1e-12).cast("double")).alias("pct_scaled"))
    d = p.join(t, keys).join(ci.select("trial_id", "lo", "hi"), keys, "left").join(m, keys)
    return d.withColumn("dsr", deflated_sharpe_normal(F.col("sharpe_rf0") / SQRT12, "n", F.lit(n_trials)))


def state_table(book: DataFrame, state, value: str = "active", keys: list[str] = ("trial_id",)) -> DataFrame:
    d = book.withColumn("state", state)
    return d.groupBy(*keys, "state").agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("hit"), F.count(value).alias("n"))


def prior_median_gate(df: DataFrame, corr: str, z: str, g_min: list[float], lookback: int) -> DataFrame:
    """Correlation-and-volatility gate for each g_min: expanding medians of the past."""
    d = O.frame_quantile(O.frame_quantile(df, [], "midx", corr, {"_cm": 0.5}), [], "midx", z, {"_zm": 0.5})
    d = d.withColumn("g_min", F.explode(F.array(*[F.lit(x) for x in g_min])))
    return d.select("midx", F.lit(lookback).alias("corr_lookback"), "g_min", correlation_gate(corr, z, "_cm", "_zm", F.col("g_min")).alias("c")).select(
        "midx", "corr_lookback", "g_min", "c.g", "c.binding")


def left_tail_gate(core_m: DataFrame, rows: int, g_min: list[float]) -> DataFrame:
    """Tail gate on the trailing shortfall of the core's monthly returns."""
    d = O.left_tail(core_m.where("r is not null"), [], "midx", "r", rows)
    d = O.frame_quantile(d, [], "midx", "cvar_5", {"_m": 0.5})
    d = d.withColumn("g_min", F.explode(F.array(*[F.lit(x) for x in g_min])))
    return d.select("midx", "g_min", "cvar_5", tail_gate("cvar_5", "_m", F.col("g_min")).alias("t")).select("midx", "g_min", "cvar_5", "t.g", "t.binding")


# ---------------------------------------------------------------- comparison
def compare(series: DataFrame, base: str, rate: DataFrame, n_trials: int) -> DataFrame:
    """Strategies on their common months: performance, NW t against the base, deflated Sharpe."""
    from panelspark.operators.panel import common_periods
    d = stage(common_periods(series.where("ret is not null"), "id", "midx"))  # read three times
    p = performance(d, ["id"], "midx", "ret", rate)
    b = d.where(F.col("id") == base).select("midx", F.col("ret").alias("_b"))
    t = I.newey_west(d.where(F.col("id") != base).join(b, "midx").withColumn("d", F.col("ret") - F.col("_b")), ["id"], "midx", "d", 3).select("id", "nw_t")
    return p.join(t, "id", "left").withColumn("dsr", deflated_sharpe_normal(F.col("sharpe_ex") / SQRT12, "n", F.lit(n_trials)))
