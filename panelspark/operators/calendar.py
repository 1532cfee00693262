"""Calendars, month ends, as-of and next-period joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import col

# Exceptional full-day exchange closures.
SPECIAL_CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11",
    "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
# Fixed values: (peak month, trough month, announcement date of the trough).
RECESSIONS = (
    ("1990-07-01", "1991-03-01", "1992-12-22"), ("2001-03-01", "2001-11-01", "2003-07-17"),
    ("2007-12-01", "2009-06-01", "2010-09-20"), ("2020-02-01", "2020-04-01", "2021-07-19"))
MON, THU, FRI = 2, 5, 6  # Spark dayofweek, Sunday = 1


def date_range(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar day of a one-row (start, end) frame."""
    return bounds.select(F.explode(F.sequence(start, end)).alias("date"))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by integer arithmetic."""
    def div(a, b):
        return F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    el = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + el - 7 * div(a + 11 * h + 22 * el, 451) + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def is_holiday(date) -> Column:
    """Full-day exchange holiday, rules plus listed closures."""
    d = col(date)
    y, m, day, dow = F.year(d), F.month(d), F.dayofmonth(d), F.dayofweek(d)

    def nth(month, weekday, lo, hi, since=0):
        return (m == month) & (dow == weekday) & day.between(lo, hi) & (y >= since)

    def observed(month, dom, since=0):
        """On the day itself, the Friday before a Saturday, the Monday after a Sunday."""
        def hit(x):
            return (F.month(x) == month) & (F.dayofmonth(x) == dom)
        return (y >= since) & (hit(d) | ((dow == FRI) & hit(F.date_add(d, 1))) | ((dow == MON) & hit(F.date_sub(d, 1))))

    new_year = (m == 1) & ((day == 1) | ((day == 2) & (dow == MON)))
    return (new_year | nth(1, MON, 15, 21, 1998) | nth(2, MON, 15, 21) | (d == F.date_sub(easter_sunday(y), 2))
            | nth(5, MON, 25, 31) | observed(6, 19, 2022) | observed(7, 4) | nth(9, MON, 1, 7)
            | nth(11, THU, 22, 28) | observed(12, 25) | d.isin(*[F.lit(x).cast("date") for x in SPECIAL_CLOSURES]))


def sessions(calendar: DataFrame, date: str = "date") -> DataFrame:
    """Adds is_session: a weekday that is no holiday."""
    return calendar.withColumn("is_session", ~F.dayofweek(date).isin(1, 7) & ~is_holiday(date))


def last_sessions(calendar: DataFrame) -> DataFrame:
    return calendar.where("is_session").groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("last_session"))


def last_session_of(month) -> Column:
    """Last session of a month without a calendar table: the latest open day of its last ten."""
    end = F.last_day(col(month))
    days = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.date_sub(end, k))
    open_days = F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7) & ~is_holiday(d))
    return F.array_max(open_days)


def drop_partial_month(df: DataFrame, date: str, asof: str | None = None, coverage: DataFrame | None = None,
                       coverage_end: str = "end") -> DataFrame:
    """Remove the final month when the source as-of falls before that month's last session.

    As-of precedence: explicit, then latest coverage end, then latest panel date.
    """
    bound = df.agg(F.max(date).alias("top"))
    end = F.lit(asof).cast("date") if asof else F.col("top")
    if coverage is not None and not asof:
        end = F.coalesce(coverage.agg(F.max(coverage_end)).scalar(), end)
    one_row = bound.select("top", end.alias("asof"))
    partial = one_row.select(F.when(F.col("asof") < last_session_of("top"), F.trunc("top", "MM"))).scalar()
    return df.where(partial.isNull() | (F.trunc(date, "MM") != partial))


def complete_months_simple(df: DataFrame, date: str) -> DataFrame:
    """Keep months before the last one, and the last one only when it reaches its calendar end."""
    top = df.agg(F.max(date)).scalar()
    return df.where((F.trunc(date, "MM") < F.trunc(top, "MM")) | (top == F.last_day(top)))


def month_end_values(df: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Last non-null value per key and month, labelled by month."""
    return df.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(date))).alias(v) for v in values])


def month_end_dates(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max(date).alias("date"))


def next_period(df: DataFrame, keys: list[str], idx: str, value: str, out: str) -> DataFrame:
    """Value of the next period (idx + 1), NULL when that period is missing: the label join as a window."""
    w = Window.partitionBy(*keys).orderBy(idx).rangeBetween(1, 1)
    return df.withColumn(out, F.first(value).over(w))


def next_label(decisions: DataFrame, panel: DataFrame, at: str, idx: str, value: str, key: str = "key") -> DataFrame:
    """(at, idx, key, label): each decision takes the last panel period at or before it; the label is the value of the
    panel's next period.  A decision before the first period has no row."""
    periods = panel.select(idx).distinct()
    periods = periods.withColumn("_next", F.lead(idx).over(Window.orderBy(idx)))  # one row per period
    d = asof_join(decisions.select(at, F.lit(0).alias("_k")), periods.withColumn("_k", F.lit(0)).withColumn("_own", F.col(idx)), ["_k"], at, idx, ["_own", "_next"]).where("_own is not null")
    label = panel.select(F.col(idx).alias("_next"), key, F.col(value).alias("label"))
    return d.join(label, "_next").select(at, F.col("_own").alias(idx), key, "label")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str],
              suffix_date: str | None = None) -> DataFrame:
    """Last right row at or before each left row: union, one sort per key, last non-null.

    One shuffle on the keys; no range join and no broadcast.
    """
    row = F.struct(*[F.col(v) for v in values], F.col(right_on).alias("_rdate"))
    lcols = [c for c in left.columns]
    a = left.select(*[F.col(c) for c in lcols], F.col(left_on).alias("_t"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), row.alias("_row"))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    u = u.withColumn("_hit", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    extra = [F.col("_hit._rdate").alias(suffix_date)] if suffix_date else []
    return u.select(*lcols, *[F.col(f"_hit.{v}").alias(v) for v in values], *extra)


def announced_regime(month, decision, intervals=RECESSIONS) -> Column:
    """1 when the month lies in [peak, trough] of an interval announced before the decision.

    The interval table is a fixed handful of rows, so it is a predicate and not a join.
    """
    hit = F.lit(False)
    for peak, trough, announced in intervals:
        hit = hit | (col(month).between(F.lit(peak).cast("date"), F.lit(trough).cast("date"))
                     & (col(decision) > F.lit(announced).cast("date")))
    return hit.cast("int")
