"""Universe gates, panel filters and panel joins."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import col, ratio

APPENDIX = r"(?i)appendix\s*3"


# ---------------------------------------------------------------- universe
def eligible(universe: DataFrame, deny: list[DataFrame], key: str = "key", section: str = "section") -> DataFrame:
    """Approved keys, minus every deny list, minus keys of the excluded section."""
    out = universe.where(F.col("approved") & ~F.coalesce(F.col(section).rlike(APPENDIX), F.lit(False)))
    for d in deny:
        out = out.join(d.select(key), key, "left_anti")
    return out


def ineligible_reasons(requested: DataFrame, universe: DataFrame, deny: DataFrame, key: str = "key") -> DataFrame:
    """One row per requested key that fails the gate, with the first reason that applies."""
    u = universe.select(key, "approved", "section", F.lit(True).alias("_known"))
    d = requested.select(key).distinct().join(u, key, "left").join(deny.select(key, F.lit(True).alias("_deny")), key, "left")
    reason = (F.when(F.col("_deny"), "deny list").when(F.col("_known").isNull(), "not in universe")
               .when(~F.col("approved"), "not approved").when(F.col("section").rlike(APPENDIX), "excluded section"))
    return d.select(key, reason.alias("reason")).where("reason is not null")


def assert_none(violations: DataFrame, message: str) -> None:
    """Raise with a short sample when a violation frame has rows (one bounded action)."""
    sample = violations.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def drop_tagged(df: DataFrame, universe: DataFrame, tags: list[str], key: str = "key") -> DataFrame:
    """Remove tagged keys once, so method and nulls see the same panel."""
    bad = universe.where(" or ".join(tags)).select(key)
    return df.join(bad, key, "left_anti")


# ---------------------------------------------------------------- live names
def live_names(ret: DataFrame, lookback: int, min_prior: int, floor: int, key: str = "key", idx: str = "midx",
               value: str = "ret", min_std: float = 1e-10, below: str = "skip") -> DataFrame:
    """Keys usable at each decision: complete trailing window, non-constant, enough history, enough names.

    The window counts come from RANGE frames, so decisions x history is never materialised.  below: what becomes of a
    decision with some usable names but fewer than `floor`, 'skip' or 'raise'.
    """
    w = Window.partitionBy(key).orderBy(idx)
    f = w.rangeBetween(-lookback + 1, 0)
    d = ret.select("*", F.count(value).over(f).alias("n_window"), F.stddev_samp(value).over(f).alias("sd"),
                   F.count(value).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("n_history"))
    d = d.where((F.col("n_window") == lookback) & (F.col("sd") > min_std) & (F.col("n_history") >= min_prior))
    n = d.groupBy(idx).agg(F.count("*").alias("n_live"))
    enough = F.col("n_live") >= floor
    if below == "raise":
        enough = F.when(enough, True).otherwise(F.raise_error(F.concat(F.lit("too few usable names at "), F.col(idx).cast("string"))).cast("boolean"))
    return d.join(n, idx).where(enough)


def name_counts(ret: DataFrame, lookback: int, min_prior: int, floor: int, key: str = "key", idx: str = "midx", value: str = "ret") -> DataFrame:
    """Per decision: usable names, whether they are below the floor, and whether the decision is skipped for it."""
    n = live_names(ret, lookback, min_prior, 0, key, idx, value).groupBy(idx).agg(F.count("*").alias("n_eligible"))
    d = ret.select(idx).distinct().join(n, idx, "left").withColumn("n_eligible", F.coalesce("n_eligible", F.lit(0)))
    return d.withColumn("below_floor", F.col("n_eligible") < floor).withColumn("skipped", F.col("below_floor"))


def select_complete_keys(df: DataFrame, thin: DataFrame, n: int, key: str = "key", value: str = "ret") -> DataFrame:
    """The n most complete keys, liquid ones first; a top-k plan, not a global sort."""
    c = df.groupBy(key).agg(F.count(value).alias("n_obs"))
    c = c.join(thin.select(key, F.col("thin").cast("int").alias("_thin")), key, "left")
    return c.orderBy(F.coalesce("_thin", F.lit(0)), F.desc("n_obs"), key).limit(n).drop("_thin")


# ---------------------------------------------------------------- joins
def excess_over(df: DataFrame, bench_key: str, keys: str = "key", on: str = "month", value: str = "ret") -> DataFrame:
    """Value minus the benchmark's value on common periods."""
    b = df.where(F.col(keys) == bench_key).select(on, F.col(value).alias("bench")).where("bench is not null")
    return df.where(F.col(value).isNotNull()).join(b, on).withColumn("excess", F.col(value) - F.col("bench"))


def attach_rate(df: DataFrame, rates: DataFrame, on: str = "month", required: bool = False) -> DataFrame:
    """Left join of the period rate; with required, a missing rate raises when the row is read."""
    d = df.join(rates.select(on, "rate", "source"), on, "left")
    if required:
        d = d.withColumn("rate", F.coalesce("rate", F.raise_error(F.concat(F.lit("no rate for "), F.col(on).cast("string"))).cast("double")))
    return d


def look_through(weights: DataFrame, constituents: DataFrame, keys: list[str], key: str = "key", period: str | None = None) -> DataFrame:
    """Replace sleeve rows by their constituents (weight x within-weight); other rows pass through.

    period: membership is by this column too.  Within-weights that do not sum to 1, and a sleeve without members in the
    period of a holding, are errors.
    """
    by = ["sleeve", period] if period else ["sleeve"]
    whole = constituents.groupBy(*by).agg(F.sum("within").alias("_sum"))
    c = constituents.join(whole, by).select(*by, F.col(key).alias("_member"), F.when(F.abs(F.col("_sum") - 1.0) <= 1e-8, F.col("within")).otherwise(
        F.raise_error(F.concat(F.lit("within-weights do not sum to 1 in "), F.col("sleeve"))).cast("double")).alias("within"))
    known = constituents.select("sleeve").distinct().withColumn("_sleeve", F.lit(True))
    d = weights.join(known, weights[key] == known["sleeve"], "left").drop("sleeve")
    d = d.join(c.withColumnRenamed("sleeve", "_s"), (d[key] == F.col("_s")) & ((d[period] == c[period]) if period else F.lit(True)), "left")
    d = d.drop(c[period]) if period else d
    d = d.withColumn("within", F.when(F.col("_sleeve") & F.col("_member").isNull(), F.raise_error(F.concat(F.lit("no members of "), F.col(key))).cast("double")).otherwise(F.col("within")))
    return (d.select(*keys, F.coalesce("_member", key).alias(key), (F.col("weight") * F.coalesce("within", F.lit(1.0))).alias("weight"))
            .groupBy(*keys, key).agg(F.sum("weight").alias("weight")))


def common_periods(df: DataFrame, series: str, period: str) -> DataFrame:
    """Rows on the periods that every series has."""
    total = df.agg(F.count_distinct(series)).scalar()
    common = df.groupBy(period).agg(F.count_distinct(series).alias("k")).where(F.col("k") == total)
    return df.join(common.select(period), period, "left_semi")


def aligned_pairs(series: DataFrame, pairs: DataFrame, series_id: str = "series_id", period: str = "month",
                  value: str = "ret") -> DataFrame:
    """(a, b, period, x, y) for an explicit table of pairs; two equi joins."""
    left = series.select(F.col(series_id).alias("a"), period, F.col(value).alias("x"))
    right = series.select(F.col(series_id).alias("b"), period, F.col(value).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, ["b", period]).where("x is not null and y is not null")


def weight_changes(weights: DataFrame, keys: list[str], idx: str, key: str = "key") -> DataFrame:
    """Outer difference of each rebalance with the one before: rows for held, new and dropped keys.

    Each weight row is emitted at its own rebalance (+w) and at the next one (-w); summing
    per key gives the full outer join with one shuffle and no densified grid.
    """
    nxt = weights.select(*keys, idx).distinct()
    w = Window.partitionBy(*keys).orderBy(idx)
    nxt = nxt.select(*keys, idx, F.lead(idx).over(w).alias("_next"), F.lag(idx).over(w).alias("_prev"))
    d = weights.join(nxt, [*keys, idx])
    cur = d.select(*keys, F.col(idx), key, F.col("weight").alias("w_now"), F.lit(0.0).alias("w_prev"))
    old = d.where("_next is not null").select(*keys, F.col("_next").alias(idx), key, F.lit(0.0).alias("w_now"), F.col("weight").alias("w_prev"))
    return (cur.unionByName(old).groupBy(*keys, idx, key).agg(F.sum("w_now").alias("w_now"), F.sum("w_prev").alias("w_prev"))
            .join(nxt.select(*keys, idx, F.col("_prev").isNull().alias("first")), [*keys, idx])
            .withColumn("dw", F.col("w_now") - F.col("w_prev")))


def panel_gap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest absolute difference between two panels and where it is, per first key."""
    d = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    d = d.withColumn("gap", F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))
    only = F.count_if(F.col("x").isNull() != F.col("y").isNull())
    return d.groupBy(keys[0]).agg(F.max("gap").alias("gap"), F.max_by(keys[1], F.struct("gap", keys[1])).alias("gap_at"), only.alias("one_sided"))


# ---------------------------------------------------------------- pairs
BLOCK = 512


def pair_cells(df: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Send a key's rows to one row and one column of a grid of key blocks: add _own, _lo <= _hi.

    Keys fall into as many hash blocks as give about `block` keys each, and any two keys meet in one cell (_lo, _hi), as the
    left side those of block _lo and as the right side those of block _hi.  With few keys there is one cell and no copy.
    """
    n = df.agg(F.approx_count_distinct(key)).scalar()
    blocks = F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    d = df.withColumn("_own", F.pmod(F.xxhash64(key), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return d.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_other")


def paired(df: DataFrame, on: list[str], key: str, value: str, own: bool = False, block: int = BLOCK) -> DataFrame:
    """(on, k1 < k2, x, y) of all keys with a value at the same `on`; own: k1 = k2 too.

    The join key is (on, cell), so a period with very many keys is worked off cell by cell: a join key has at most the rows
    of two blocks, and a row is copied once for each block.
    """
    c = pair_cells(df.where(F.col(value).isNotNull()).select(*on, F.col(key).alias("_k"), F.col(value).alias("_v")), "_k", block)
    a = c.where("_own = _lo").select(*on, "_lo", "_hi", F.col("_k").alias("_k1"), F.col("_v").alias("_x"))
    b = c.where("_own = _hi").select(*on, "_lo", "_hi", F.col("_k").alias("_k2"), F.col("_v").alias("_y"))
    first = F.col("_k1") <= F.col("_k2")
    d = a.join(b, [*on, "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (first if own else F.col("_k1") < F.col("_k2")))
    return d.select(*on, F.least("_k1", "_k2").alias("k1"), F.greatest("_k1", "_k2").alias("k2"), F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("x"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("y"))


def pair_returns(df: DataFrame, group: list[str], key: str = "key", idx: str = "midx", value: str = "ret", block: int = BLOCK) -> DataFrame:
    """(k1 < k2) rows of one matrix's keys per period: an equi join on (group, period, cell).  The output is the upper triangle."""
    return paired(df, [*group, idx], key, value, block=block)


def corr_of(x, y) -> Column:
    from panelspark.functions.stats import safe_corr
    return safe_corr(x, y)


def rolling_pair_corr(pairs: DataFrame, group: list[str], rows: int, min_pairs: int = 3, idx: str = "midx") -> DataFrame:
    """Correlation of every pair over the trailing periods, by RANGE frame on each pair."""
    w = Window.partitionBy(*group, "k1", "k2").orderBy(idx).rangeBetween(-rows + 1, 0)
    sx, sy = F.stddev_samp("x").over(w), F.stddev_samp("y").over(w)
    c = F.when((F.count("x").over(w) >= min_pairs) & (sx > 1e-12) & (sy > 1e-12), ratio(F.covar_samp("x", "y").over(w), sx * sy))
    return pairs.select(*group, idx, "k1", "k2", c.alias("corr"), F.count("x").over(w).alias("n"))


def mean_abs_corr(pair_corr: DataFrame, group: list[str]) -> DataFrame:
    return pair_corr.groupBy(*group).agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), F.avg("corr").alias("mean_corr"),
                                         F.count("corr").alias("pairs"))


def lead_lag(df: DataFrame, pairs: DataFrame, lags: range, series: str = "key", idx: str = "idx", value: str = "ret") -> DataFrame:
    """corr(a_t, b_{t+k}) for every pair and lag: lag shifts the join key, so it stays an equi join."""
    a = df.select(F.col(series).alias("a"), idx, F.col(value).alias("x"))
    b = df.select(F.col(series).alias("b"), F.col(value).alias("y"), idx, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    b = b.select("b", "lag", "y", (F.col(idx) - F.col("lag")).alias(idx))
    d = pairs.join(a, "a").join(b, ["b", idx]).where("x is not null and y is not null")
    return d.groupBy("a", "b", "lag").agg(corr_of("x", "y").alias("corr"), F.count("*").alias("n"))
