"""Scalar column helpers: missing-value rules, ratios, text, dates, tolerance."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SQRT12 = math.sqrt(12.0)
SQRT252 = math.sqrt(252.0)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0 or either side is missing (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def round_finite(x, digits: int = 10) -> Column:
    return F.round(finite(x), digits)


def attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame on every row, as a scalar subquery (more than one row is an error)."""
    one = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.withColumn("_one", one).select(*[F.col(c) for c in df.columns], "_one.*")


def norm_key(x) -> Column:
    return F.upper(F.trim(col(x)))


def month_of(d) -> Column:
    return F.trunc(col(d), "MM")


def month_idx(d) -> Column:
    return (F.year(col(d)) * 12 + F.month(col(d))).cast("int")


def iso(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def strict_bool(x) -> Column:
    """true/false/1/0 text to boolean; any other non-null text raises."""
    t = F.lower(F.trim(col(x).cast("string")))
    return (F.when(t.isin("true", "1"), F.lit(True))
             .when(t.isin("false", "0"), F.lit(False))
             .when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean")))


def loose_true(x) -> Column:
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def lookback_months_from_days(days) -> Column:
    """Trading days to months, 21 per month, half-even, at least 6."""
    return F.greatest(F.lit(6), F.bround(col(days) / 21.0).cast("int"))


def scale_factor(sigma, target, lo=0.25, hi=1.0) -> Column:
    """clip(target / sigma, lo, hi); NULL unless both are finite and positive."""
    s, t = finite(sigma), finite(target)
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when((s > 0) & (t > 0), F.least(hi, F.greatest(lo, F.try_divide(t, s))))


def sigma_target(spec) -> Column:
    """Target spec: 'expanding' selects the expanding estimate (NULL here), else a number."""
    t = F.lower(F.trim(col(spec)))
    return F.when(~t.isin("expanding", "expanding_annvol"), F.try_to_number(t, F.lit("9.9999")).cast("double"))


def correlation_gate(corr, z, corr_med, z_med, g_min, inverse=False) -> Column:
    """Bind when correlation and market state are both above their prior medians."""
    known = col(corr).isNotNull() & col(z).isNotNull() & col(corr_med).isNotNull() & col(z_med).isNotNull()
    corr_hi = F.coalesce(known & (col(corr) > col(corr_med)), F.lit(False))
    inverse = inverse if isinstance(inverse, Column) else F.lit(inverse)
    z_hi = F.coalesce(known & F.when(inverse, col(z) < col(z_med)).otherwise(col(z) > col(z_med)), F.lit(False))
    bind = corr_hi & z_hi
    return F.struct(F.when(bind, col(g_min)).otherwise(F.lit(1.0)).cast("double").alias("g"), bind.alias("binding"),
                    corr_hi.alias("corr_elevated"), z_hi.alias("z_elevated"))


def tail_gate(score, median, g_min) -> Column:
    """Bind when the left-tail score exceeds its prior median; open when either is missing."""
    bind = F.coalesce(col(score) > col(median), F.lit(False))
    return F.struct(F.when(bind, col(g_min)).otherwise(F.lit(1.0)).cast("double").alias("g"), bind.alias("binding"))


def breakdown_scalar(avg_corr, threshold) -> Column:
    """Scale risky weights down once average |corr| passes a threshold, never below one half."""
    c, t = col(avg_corr), col(threshold)
    return F.when(c > t, F.greatest(F.lit(0.5), 1.0 - (c - t))).otherwise(F.lit(1.0))


def raw_on(z, excess, vol_ok, use_vol_gate: bool = True) -> Column:
    """Rotation rule before hysteresis; missing inputs leave it OFF."""
    ex = F.coalesce(col(excess) > 0, F.lit(False))
    if not use_vol_gate:
        return ex
    z = col(z)
    return F.coalesce(z.isNotNull() & ((z > 0) | ex) & col(vol_ok), F.lit(False))


def within_printed(value, printed) -> Column:
    """Value agrees with a printed decimal text to half a unit in its last place."""
    decimals = F.length(F.coalesce(F.get(F.split(col(printed), r"\."), F.lit(1)), F.lit("")))
    return F.abs(col(value) - col(printed).cast("double")) <= F.pow(F.lit(10.0), -decimals.cast("double")) * 0.5 + 1e-9


def params_hash(*cols) -> Column:
    """12-hex digest of a parameter struct; fields sorted by name."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256), 1, 12)


def pct_text(x, digits: int = 2, missing: str = "not computable") -> Column:
    return F.when(col(x).isNotNull(), F.format_string(f"%.{digits}f%%", col(x) * 100.0)).otherwise(missing)
