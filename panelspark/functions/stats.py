"""Statistical column expressions: normal law, Sharpe ratios, deflation, moments."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from panelspark.functions.scalar import SQRT12, col, ratio

# Abramowitz & Stegun 26.2.17.
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Acklam's rational approximation of the normal quantile.
AC_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
        1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
AC_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
        6.680131188771972e1, -1.328068155288572e1)
AC_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0,
        -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
AC_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0)
EULER_GAMMA = 0.5772156649015329


def _horner(coeffs, x: Column) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + c
    return out


def steady_sum(x) -> Column:
    """Sum of doubles that does not depend on the order of rows, so equal groups have equal sums to the last bit.

    Each value is split at 1/1024; sums of the coarse parts are exact up to 8e12, and those of the fine parts for two million
    values of 500 and more.  Beyond that the sum is rounded like any other.
    """
    x = col(x).cast("double")
    coarse = F.when(F.abs(x) < 2.0 ** 43, F.rint(x * 1024.0) / 1024.0).otherwise(x)
    return F.sum(coarse) + F.sum(F.nanvl(x - coarse, F.lit(0.0)))


def let(x: Column, body) -> Column:
    """Evaluate x once and use it many times: keeps polynomial expressions small."""
    return F.transform(F.array(x), body)[0]


def norm_cdf(z) -> Column:
    def of(z):
        tail = let(1.0 / (1.0 + AS_P * F.abs(z)),
                   lambda t: F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) * t * _horner(AS_B[::-1], t))
        return F.when(z >= 0, 1.0 - tail).otherwise(tail)
    return let(col(z).cast("double"), of)


def norm_ppf(p) -> Column:
    """NULL outside (0, 1)."""
    lo = 0.02425

    def centre(c):
        return let(c * c, lambda r: _horner(AC_A, r) * c / (_horner(AC_B, r) * r + 1.0))

    def tail(q):
        return _horner(AC_C, q) / (_horner(AC_D, q) * q + 1.0)

    def of(p):
        q = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
        return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < lo, let(q, tail))
                 .when(p > 1 - lo, -let(q, tail)).otherwise(let(p - 0.5, centre)))
    return let(col(p).cast("double"), of)


def total_return(r) -> Column:
    """Compounded return of a group; a loss of 100 % or more has no log, so those rows use the product."""
    return F.product(1.0 + col(r)) - 1.0


def ann_return(r, per_year: float = 12.0) -> Column:
    return F.pow(F.product(1.0 + col(r)), F.try_divide(F.lit(per_year), F.count(col(r)).cast("double"))) - 1.0


def ann_vol(r, per_year: float = 12.0) -> Column:
    return F.stddev_samp(col(r)) * math.sqrt(per_year)


def sharpe_rf0(r) -> Column:
    """Geometric annual return over annual volatility; NULL without volatility."""
    return F.when(ann_vol(r) > 0, ratio(ann_return(r), ann_vol(r)))


def sharpe_excess(ex) -> Column:
    """Arithmetic annual mean of excess over its annual std; 0 when both vanish."""
    sd, mean = F.stddev_samp(col(ex)), F.avg(col(ex))
    return (F.when(sd > 1e-15, F.try_divide(mean * 12.0, sd * SQRT12))
             .when(F.abs(mean) <= 1e-15, F.when(sd.isNotNull(), F.lit(0.0))))


def deflated_sharpe_normal(per_period_sharpe, n_obs, n_trials) -> Column:
    """Probability the Sharpe beats the expected best of n_trials noise trials (normal returns)."""
    n = F.sqrt(F.greatest(col(n_obs).cast("double") - 1.0, F.lit(1.0)))
    hurdle = norm_ppf(1.0 - F.try_divide(F.lit(1.0), col(n_trials).cast("double"))) / n
    return F.when((col(n_obs) >= 3) & (col(n_trials) > 1), norm_cdf((col(per_period_sharpe) - hurdle) * n))


def expected_max_sharpe(trial_var, n_trials) -> Column:
    """Expected best Sharpe of n noise trials with the given cross-trial variance."""
    n = col(n_trials).cast("double")
    z = ((1.0 - EULER_GAMMA) * norm_ppf(1.0 - F.try_divide(F.lit(1.0), n))
         + EULER_GAMMA * norm_ppf(1.0 - F.try_divide(F.lit(1.0), n * math.e)))
    return F.sqrt(col(trial_var)) * z


def deflated_sharpe_full(per_period_sharpe, sr0, n_obs, skew, kurt) -> Column:
    """Deflated Sharpe with skewness and (non-excess) kurtosis of the returns."""
    sr = col(per_period_sharpe)
    var = 1.0 - col(skew) * sr + (col(kurt) - 1.0) / 4.0 * sr * sr
    return F.when(var > 0, norm_cdf((sr - col(sr0)) * F.sqrt(col(n_obs) - 1.0) / F.sqrt(var)))


def skew_unbiased(x) -> Column:
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2.0) * F.skewness(col(x)))


def kurt_unbiased(x, excess: bool = True) -> Column:
    n = F.count(col(x)).cast("double")
    k = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(col(x)) + 6.0)
    return F.when(n > 3, k if excess else k + 3.0)


def safe_corr(x, y) -> Column:
    """Pearson correlation on complete pairs; NULL instead of an error on a constant side."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(
        F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))))
