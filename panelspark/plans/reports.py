"""Report tables keyed by subject: no per-subject loop, one grouped query per block."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.scalar import SQRT12, attach_one, ratio
from panelspark.functions.stats import ann_return, ann_vol, sharpe_excess, total_return
from panelspark.operators import inference as I, panel as P, scores as S, windows as W
from panelspark.plans.books import performance
from panelspark.sources.stage import stage


def window_table(series: DataFrame, rates: DataFrame, sid: str, period: str = "month") -> DataFrame:
    """Headline and legacy Sharpe, volatility, drawdown and rate coverage on the common window."""
    d = stage(P.common_periods(series, sid, period))
    perf = performance(d.select(sid, period, "ret"), [sid], period, "ret", rates.select(period, "rate"))
    cov = d.join(rates.select(period, "source"), period, "left").groupBy(sid).agg(F.avg((F.col("source") == "fallback").cast("double")).alias("fallback_share"))
    return perf.join(cov, sid)


def head_to_head(pairs: DataFrame, rates: DataFrame, min_months: int = 12, lags: int = 3) -> DataFrame:
    """Both sides of every (a, b) pair, their differences, NW t of the gap and the detectable gap."""
    d = stage(pairs.join(rates.select("month", "rate"), "month", "left"))
    both = d.select("a", "b", "month", "rate", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("x").alias("ret")), F.struct(F.lit("b").alias("side"), F.col("y").alias("ret")))))
    both = W.drawdown(both, Window.partitionBy("a", "b", "side").orderBy("month"))
    n = F.count("*")
    s = both.withColumn("ex", F.col("ret") - F.col("rate")).groupBy("a", "b", "side").agg(
        n.alias("n"), total_return("ret").alias("total"), ann_return("ret").alias("cagr"), F.min("dd").alias("maxdd"),
        F.when(n >= min_months, sharpe_excess("ex")).alias("sharpe"))
    def pick(c, side):
        return F.max(F.when(F.col("side") == side, F.col(c)))
    wide = s.groupBy("a", "b").agg(F.max("n").alias("n"), *[(pick(c, "a") - pick(c, "b")).alias(f"{c}_diff") for c in ("total", "cagr", "maxdd", "sharpe")])
    t = I.newey_west(d.withColumn("gap", F.col("x") - F.col("y")), ["a", "b"], "month", "gap", lags)
    t = t.select("a", "b", "nw_t", I.two_sided_p("nw_t").alias("p_two_sided"), (I.detectable_gap("se") * 12.0).alias("detectable_gap"))
    return wide.join(t, ["a", "b"])


def subject_profile(series: DataFrame, sid: str = "series_id") -> DataFrame:
    """Long table (subject, block, period, value): growth curve, drawdown, rolling year, calendar years."""
    w = Window.partitionBy(sid).orderBy("month")
    d = W.drawdown(series, w).withColumn("r12", W.rolling_compound("ret", w, 12))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.col(c).alias("value")) for b, c in (("curve", "wealth"), ("drawdown", "dd"), ("rolling_12", "r12"))])
    long = d.select(sid, "month", F.inline(blocks)).where("value is not null")
    years = series.groupBy(sid, F.trunc("month", "YEAR").alias("month")).agg(total_return("ret").alias("value")).withColumn("block", F.lit("year"))
    return long.unionByName(years)


MOMENTS = ("n", "lr", "r", "rr", "e", "ee", "lc", "c", "cc", "rc")


def window_stats(series: DataFrame, windows: DataFrame, sid: str, order: str = "midx") -> DataFrame:
    """Figures of every subject over every (block, window), each of one or more [start, stop] ranges of `order`.

    ``series``: subject, order, ret, ex (over the rate) and core, on months with both returns.  Running sums of logs, values,
    squares and products are made once a subject; a range is the difference of two of them, looked up as of its ends by one
    union and sort, so a further window costs two rows and no scan of the series.  ``windows`` is calendar-sized.
    """
    w = Window.partitionBy(sid).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = {"n": F.lit(1.0), "lr": F.log1p("ret"), "r": F.col("ret"), "rr": F.col("ret") * F.col("ret"), "e": F.col("ex"), "ee": F.col("ex") * F.col("ex"),
             "lc": F.log1p("core"), "c": F.col("core"), "cc": F.col("core") * F.col("core"), "rc": F.col("ret") * F.col("core")}
    sums = stage(series.select(sid, F.col(order).alias("_at"), *[F.sum(c).over(w).alias(n) for n, c in parts.items()]))
    every = windows.agg(F.collect_list(F.struct("block", "window", "start", "stop")).alias("_w"))
    asked = attach_one(sums.select(sid).distinct(), every).select(sid, F.inline("_w"))
    ends = F.array(F.struct(F.col("stop").alias("_at"), F.lit(1.0).alias("_sign")), F.struct((F.col("start") - 1).alias("_at"), F.lit(-1.0).alias("_sign")))
    asked = asked.select(sid, "block", "window", F.inline(ends)).withColumn("_ask", F.lit(1))
    both = sums.withColumn("_ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(sid).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(sid, "block", "window", "_sign", "_ask", *[F.coalesce(F.last(m, ignorenulls=True).over(upto), F.lit(0.0)).alias(m) for m in MOMENTS]).where("_ask = 1")
    g = seen.groupBy(sid, "block", "window").agg(*[F.sum(F.col("_sign") * F.col(m)).alias(m) for m in MOMENTS]).where("n > 0.5")
    n = F.col("n")
    var = lambda s, q: F.when(n > 1.5, F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0)) / (n - 1.0))
    cov = F.when(n > 1.5, (F.col("rc") - F.col("r") * F.col("c") / n) / (n - 1.0))
    return g.select(sid, "block", "window", F.round(n).cast("long").alias("months"), F.expm1("lr").alias("total"), F.expm1(F.col("lr") * 12.0 / n).alias("cagr"), (F.sqrt(var("r", "rr")) * SQRT12).alias("vol"),
                    F.when(n > 11.5, ratio(F.col("e") / n * 12.0, F.sqrt(var("e", "ee")) * SQRT12)).alias("sharpe"), F.expm1("lc").alias("core_total"), (F.expm1("lr") - F.expm1("lc")).alias("total_diff"),
                    ratio(cov, var("c", "cc")).alias("beta"), ratio(cov, F.sqrt(var("r", "rr") * var("c", "cc"))).alias("corr"))


def state_windows(states: DataFrame, block: str, state: str, order: str = "midx") -> DataFrame:
    """The runs of each state as ranges of one window per state; one row a month goes in."""
    w = Window.orderBy(order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)) | (F.lag(order).over(w) != F.col(order) - 1), F.lit(True))
    d = states.where(F.col(state).isNotNull()).withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(F.lit(block).alias("block"), F.col(state).alias("window"), "_run").agg(F.min(order).alias("start"), F.max(order).alias("stop")).drop("_run")


def curves_vs_core(series: DataFrame, sid: str, order: str = "midx", rows: int = 36) -> DataFrame:
    """Long table (subject, block, order, value): growth of both sides, cumulative and rolling-year excess, core drawdown, rolling
    Sharpe ratios and their difference, on the months with both returns."""
    w = Window.partitionBy(sid).orderBy(order)
    d = W.drawdown(series.withColumnRenamed("ret", "_own").withColumnRenamed("core", "ret"), w).withColumnsRenamed({"ret": "core", "wealth": "core_growth", "dd": "core_drawdown", "_own": "ret"})
    d = d.withColumns({"growth": W.wealth("ret", w), "rolling_sharpe": W.rolling_sharpe("ex", w, rows), "core_rolling_sharpe": W.rolling_sharpe("core_ex", w, rows),
                       "rolling_excess": W.rolling_compound("ret", w, 12) - W.rolling_compound("core", w, 12)})
    d = d.withColumns({"cumulative_excess": F.col("growth") - F.col("core_growth"), "rolling_sharpe_diff": F.col("rolling_sharpe") - F.col("core_rolling_sharpe")})
    names = ("growth", "core_growth", "cumulative_excess", "rolling_excess", "core_drawdown", "rolling_sharpe", "core_rolling_sharpe", "rolling_sharpe_diff")
    return d.select(sid, order, F.inline(F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("value")) for b in names]))).where("value is not null")


def leaderboard(rows: DataFrame, score: str, benchmark: str, void: DataFrame) -> DataFrame:
    """Subjects by score; the benchmark stays in place unranked, void subjects are listed apart.

    Ranks come from ranges of (ranked, score, id) with offsets, so a board of any size is no single task's work.
    """
    d = rows.join(void.select("id").distinct().withColumn("void", F.lit(True)), "id", "left").withColumn("void", F.coalesce("void", F.lit(False)))
    d = S.group_rank(d.withColumn("_ranked", ~F.col("void") & (F.col("id") != benchmark)), ["_ranked"], score, "id")
    return d.withColumn("rank", F.when(F.col("_ranked"), F.col("rank"))).withColumn("is_benchmark", F.col("id") == benchmark).drop("_ranked")


def band_series(weights: DataFrame, bands: DataFrame, keys: list[str], period: str, names: list[str]) -> DataFrame:
    """Weight per band and period, dense over the literal band list."""
    d = weights.join(bands.select("key", "band"), "key", "left").withColumn("band", F.coalesce("band", F.lit("Untagged")))
    g = d.groupBy(*keys, period).agg(*[F.sum(F.when(F.col("band") == b, F.col("weight")).otherwise(0.0)).alias(b) for b in names])
    return g.unpivot([*keys, period], names, "band", "weight")


def apply_corrections(series: DataFrame, corrections: DataFrame, sid: str = "series_id", tol: float = 1e-9) -> DataFrame:
    """Replace a month whose value equals the known bad one; drop it when it differs from both; log column says which."""
    d = series.join(corrections.select(sid, "month", "bad", "good"), [sid, "month"], "left")
    is_bad, is_good = F.abs(F.col("ret") - F.col("bad")) <= tol, F.abs(F.col("ret") - F.col("good")) <= tol
    action = F.when(F.col("bad").isNull(), "kept").when(is_bad, "replaced").when(is_good, "kept").otherwise("dropped")
    return d.withColumn("action", action).withColumn("ret", F.when(F.col("action") == "replaced", F.col("good")).when(F.col("action") == "kept", F.col("ret"))).drop("bad", "good")


def restatement(old: DataFrame, new: DataFrame, sid: str = "series_id") -> DataFrame:
    """Before and after figures per series, with the number of changed months."""
    d = old.select(sid, "month", F.col("ret").alias("x")).join(new.select(sid, "month", F.col("ret").alias("y")), [sid, "month"], "full")
    changed = F.count_if(~F.col("x").eqNullSafe(F.col("y")))
    return d.groupBy(sid).agg(F.count("x").alias("n_old"), F.count("y").alias("n_new"), changed.alias("changed"),
                              total_return("x").alias("total_old"), total_return("y").alias("total_new"), ann_vol("x").alias("vol_old"), ann_vol("y").alias("vol_new"))


def matrix_with_counts(ret: DataFrame, key: str, period: str) -> DataFrame:
    """Correlation of every key pair with its overlap; the mirror half is added from the triangle."""
    from panelspark.functions.stats import safe_corr
    p = P.pair_returns(ret, [], key, period).groupBy("k1", "k2").agg(safe_corr("x", "y").alias("corr"), F.count("*").alias("n"))
    return p.unionByName(p.select(F.col("k2").alias("k1"), F.col("k1").alias("k2"), "corr", "n"))


def recompute_lookup(recorded: DataFrame, recomputed: DataFrame, on: str = "trial_id") -> DataFrame:
    """Recorded next to corrected value; the shown value prefers the correction."""
    d = recorded.join(recomputed.select(on, "corrected"), on, "left")
    return d.withColumn("shown", F.coalesce("corrected", "recorded")).withColumn("rule", F.when(F.col("corrected").isNull(), "recorded").otherwise("corrected"))


def gate_rows(**parts: DataFrame) -> DataFrame:
    """Union of (id, status) checks into (id, gate, status)."""
    out = None
    for gate, d in parts.items():
        d = d.select("id", F.lit(gate).alias("gate"), "status")
        out = d if out is None else out.unionByName(d)
    return out
