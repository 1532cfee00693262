"""Cross-sectional normalisation, scores and information coefficients."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import SQRT252, col, ratio
from panelspark.functions.stats import safe_corr
from panelspark.sources.stage import stage
from panelspark.operators.ordered import sliding_drawdown
from panelspark.operators.windows import UNB, average_rank, counted_values, percent_rank_avg, spread_average_rank, trailing_vol

MAD_SCALE = 1.4826
# Feature weights of the composite score.
FEATURE_WEIGHTS = {"mom12_1": 0.30, "quality_v1": 0.25, "neg_vol_252": 0.15, "neg_maxdd_252": 0.15, "liquidity_adv": 0.10, "neg_vol_63": 0.05}


def group_quantile(df: DataFrame, group: list[str], value: str, q: float, out: str, buckets: int = 256) -> DataFrame:
    """Exact interpolated quantile per group without holding a group in one task.

    Rows become counts of distinct values (combined map-side), which fall into value buckets by cuts over all rows, so a
    group with a large share of the rows spreads over as large a share of the buckets.  Bucket totals tell which buckets
    hold the bracketing order statistics, and only these are put in order.  ``percentile`` is cheaper for bounded groups.
    """
    d, cuts = counted_values(df, group, value, buckets)
    hist = d.groupBy(*group, "_b").agg(F.sum("_c").alias("_t"))
    n = hist.groupBy(*group).agg(F.sum("_t").alias("_n"))
    upto = F.sum("_t").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(UNB, 0))  # at most `buckets` rows of a group
    hist = hist.join(n, group).select(*group, "_b", ((F.col("_n") - 1) * F.lit(q)).alias("_pos"), (upto - F.col("_t")).alias("_before"), upto.alias("_upto"))
    need = hist.where((F.col("_upto") > F.floor("_pos")) & (F.col("_before") <= F.ceil("_pos")))
    near = d.join(need, [*group, "_b"]).repartition(*[F.col(c) for c in group], F.col("_b"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(UNB, 0))
    near = near.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda k: F.max(F.when((F.col("_start") <= k) & (F.col("_end") > k), F.col("_v")))
    g = near.groupBy(*group).agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_z"), F.first("_pos").alias("_pos"))
    return g.select(*group, (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))).alias(out))


def robust_z(df: DataFrame, group: list[str], features: list[str], spread: bool = False) -> DataFrame:
    """Adds z_<feature>: (x - median) / (1.4826 MAD) within group; std when MAD is 0; 0 when both are.

    A group without any value stays NULL.  With spread=True the medians come from value counts in buckets, so a group that
    holds a third of all keys is never gathered in one task; the default sorts a group in a task.
    """
    df = stage(df) if spread else df  # the bucketed quantile reads its input three times

    def medians(d, cols):
        if not spread:
            return d.groupBy(*group).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in cols])
        out = None
        for c in cols:
            m = group_quantile(d, group, c, 0.5, f"_m_{c}")
            out = m if out is None else out.join(m, group, "full")
        return out

    sd = df.groupBy(*group).agg(*[F.stddev_samp(c).alias(f"_s_{c}") for c in features])
    d = df.join(medians(df, features), group, "left").join(sd, group, "left")
    for c in features:
        d = d.withColumn(f"_d_{c}", F.abs(F.col(c) - F.col(f"_m_{c}")))
    d = stage(d) if spread else d
    d = d.join(medians(d, [f"_d_{c}" for c in features]), group, "left")
    for c in features:
        mad, s, dev = F.col(f"_m__d_{c}"), F.col(f"_s_{c}"), F.col(c) - F.col(f"_m_{c}")
        z = F.when(mad > 0, dev / (mad * MAD_SCALE)).when(s > 0, dev / s).when(F.col(f"_m_{c}").isNotNull(), F.lit(0.0))
        d = d.withColumn(f"z_{c}", z)
    return d.drop(*[f"{p}{c}" for c in features for p in ("_m_", "_s_", "_d_", "_m__d_")])


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of z columns; a missing z adds 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(f"z_{name}"), F.lit(0.0)) * w
    return out


def group_rank(df: DataFrame, group: list[str], score: str, tie: str, out: str = "rank", ranges: int = 256) -> DataFrame:
    """Row number by (score desc, tie) inside each group without a task for a group.

    Rows are dealt into ranges of (group, score, tie) by sampled cuts, so one group with most rows, and equal scores, also
    NULLs, spread over many ranges; a range counts its rows by group, the counts of the ranges before it are a group's offset,
    and rows are numbered inside their range.
    """
    keys = [F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_first()]
    d = stage(df.repartitionByRange(ranges, *group, *keys).withColumn("_p", F.spark_partition_id()))
    counts = d.groupBy(*group, "_p").agg(F.count("*").alias("_c"))  # at most `ranges` rows more than groups
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(UNB, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_p").alias("_o"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    out_ = d.join(offsets, [F.col("_p") == F.col("_o"), *same])
    return out_.withColumn(out, F.col("_off") + F.row_number().over(Window.partitionBy("_p", *group).orderBy(*keys))).drop("_p", "_o", "_off", *[f"_g_{g}" for g in group])


def global_rank(df: DataFrame, score: str, tie: str, out: str = "rank", ranges: int = 256) -> DataFrame:
    """Row number by (score desc, tie) over the whole table without a one-task sort."""
    return group_rank(df, [], score, tie, out, ranges)


def choose_benchmark(ret: DataFrame, first: str, fallback: str, date: str = "date", least: int = 51) -> DataFrame:
    """(date, bench, benchmark_used): returns of `first` if it has `least` rows, else of `fallback`; an error without either."""
    n = ret.where(F.col("key").isin(first, fallback)).agg(F.count_if(F.col("key") == first).alias("a"), F.count_if(F.col("key") == fallback).alias("b"))
    used = n.select(F.when(F.col("a") >= least, first).when(F.col("b") > 0, fallback).otherwise(F.raise_error(F.lit(f"neither {first} nor {fallback} is in the panel"))).alias("benchmark_used"))
    return ret.join(F.broadcast(used), F.col("key") == F.col("benchmark_used")).select(date, F.col("ret").alias("bench"), "benchmark_used")  # one row


def raw_features(px: DataFrame, order: str, bench_ret: DataFrame, expense: DataFrame | None = None, year: int = 252,
                 quarter: int = 63, month: int = 21) -> DataFrame:
    """All raw features per (key, period): frame aggregates, and running block states for the drawdown.

    ``px``: key, order, price, volume.  ``bench_ret``: order, bench (the chosen benchmark's return).
    """
    w = Window.partitionBy("key").orderBy(order)
    d = px.where("price is not null").withColumn("ret", ratio("price", F.lag("price").over(w)) - 1.0)
    d = d.join(bench_ret, order, "left")
    pair = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    d = d.withColumn("ex", F.when(pair, F.col("ret") - F.col("bench"))).withColumn("_pv", F.col("price") * F.col("volume"))
    if expense is not None:
        d = d.join(expense.select("key", "expense"), "key", "left")
    else:
        d = d.withColumn("expense", F.lit(None).cast("double"))
    d = sliding_drawdown(d, ["key"], order, "price", year, "maxdd_252")
    fy, fm = w.rowsBetween(-year + 1, 0), w.rowsBetween(-month + 1, 0)
    ir = F.when(F.count("ex").over(fy) >= 3, ratio(F.avg("ex").over(fy), F.stddev_samp("ex").over(fy)) * SQRT252)
    return d.select("key", order, "price", "ret",
                    trailing_vol("ret", w, quarter, min_periods=2).alias("vol_63"),
                    trailing_vol("ret", w, year, min_periods=2).alias("vol_252"),
                    "maxdd_252",
                    (ir - F.coalesce("expense", F.lit(0.0))).alias("quality_v1"), F.col("expense").isNull().alias("er_missing"),
                    F.avg("_pv").over(fm).alias("liquidity_adv"), F.col("volume").isNull().alias("liquidity_missing"),
                    (F.datediff(order, F.min(order).over(w)) / 365.25).alias("history_years"))


def signed_features(df: DataFrame) -> DataFrame:
    """Point every feature up: volatility is negated, the drawdown is already <= 0."""
    return df.withColumns({"neg_vol_252": -F.col("vol_252"), "neg_vol_63": -F.col("vol_63"), "neg_maxdd_252": F.col("maxdd_252")})


def spearman_ic(df: DataFrame, period: list[str], score: str, label: str, min_pairs: int = 3, spread: bool = False) -> DataFrame:
    """Rank correlation of score and label per period; NULL below min_pairs."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if spread:
        d = spread_average_rank(spread_average_rank(d, period, score, "_a"), period, label, "_b")
    else:
        d = d.select(*period, average_rank(score, period).alias("_a"), average_rank(label, period).alias("_b"))
    n = F.count("*")
    return d.groupBy(*period).agg(F.when(n >= min_pairs, safe_corr("_a", "_b")).alias("ic"), n.alias("n_names"))


def james_stein(mean, grand, var, n, dev2) -> Column:
    """Shrink a mean toward the grand mean; unchanged for n < 3 or a degenerate cross-section."""
    shrink = F.greatest(F.lit(0.0), 1.0 - F.try_divide((col(n) - 2.0) * col(var), col(dev2)))
    usable = (col(n) >= 3) & (col(var) >= 1e-16) & (col(dev2) >= 1e-16)
    return F.when(usable, col(grand) + shrink * (col(mean) - col(grand))).otherwise(col(mean))


def expected_returns(df: DataFrame, period: list[str], mean: str, score: str, scale: float = 0.015, spread: bool = False) -> DataFrame:
    """0.5 James-Stein mean + 0.5 score percentile mapped around the grand mean.

    spread: the percentile comes from value counts in buckets, for cross-sections too large for one task.
    """
    g = df.groupBy(*period).agg(F.count(mean).alias("_n"), F.coalesce(F.avg(mean), F.lit(0.0)).alias("_g"), F.var_samp(mean).alias("_v"))
    d = df.join(g, period).withColumn("_dev2", F.col("_v") * (F.col("_n") - 1.0))
    d = d.withColumn("mu_js", james_stein(mean, "_g", "_v", "_n", "_dev2"))
    if spread:
        scored = df.groupBy(*period).agg(F.count(score).alias("_k"))
        d = spread_average_rank(d, period, score, "_r").join(scored, period).withColumn("_pct", F.col("_r") / F.col("_k")).drop("_r", "_k")
    else:
        d = d.withColumn("_pct", percent_rank_avg(score, period))
    d = d.withColumn("mu_score", F.col("_g") + scale * (F.col("_pct") - 0.5) * 2.0).drop("_pct")
    return d.withColumn("mu", 0.5 * F.coalesce("mu_js", "_g") + 0.5 * F.coalesce("mu_score", "_g")).drop("_n", "_v", "_dev2")
