"""Audits and decision rules: each is one aggregate or anti join, returned as rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import attach_one, col

INCOMPLETE = "INCOMPLETE (composition not computable)"


def timing_audit(df: DataFrame, keys: list[str], feature_end: str, decision: str, label_start: str, label_end: str) -> DataFrame:
    """feature_end <= decision < label_start <= label_end, counted per source."""
    bad = (F.col(feature_end) > F.col(decision)) | (F.col(decision) >= F.col(label_start)) | (F.col(label_start) > F.col(label_end))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_fail"), F.count_if(F.col(feature_end).isNull()).alias("n_no_cutoff"))
    return g.withColumn("status", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_no_cutoff") == F.col("n"), "partial").otherwise("pass"))


def outside_holdings(weights: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Held keys that the universe does not allow, with how often."""
    return weights.where("weight <> 0").join(allowed.select("key"), "key", "left_anti").groupBy(*keys, "key").agg(F.count("*").alias("n"))


def weight_rules(weights: DataFrame, keys: list[str], flag: str | None = None, single: float = 0.15, total: float = 0.25, tol: float = 1e-8) -> DataFrame:
    """Sum to one, long only, single and group caps per rebalance."""
    s = F.sum("weight")
    checks = {"sum_ok": F.abs(s - 1.0) <= tol, "long_only": F.min("weight") >= -tol}
    if flag:
        w = F.when(F.col(flag), F.col("weight"))
        checks["single_ok"] = F.coalesce(F.max(w), F.lit(0.0)) <= single + tol
        checks["group_ok"] = F.coalesce(F.sum(w), F.lit(0.0)) <= total + tol
    return weights.groupBy(*keys).agg(s.alias("total"), *[c.alias(n) for n, c in checks.items()])


def panel_invariants(df: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """Duplicates, gaps after the first value, infinities and impossible returns per key, from one window and one aggregate."""
    w = Window.partitionBy(key).orderBy(idx)
    x = F.col(value)
    d = df.select(key, idx, x, (F.lead(idx).over(w) - F.col(idx)).alias("_step"))
    return d.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("_step") == 0).alias("duplicates"), F.count_if(F.col("_step") > 1).alias("gaps"),
                              F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite"), F.count_if(x < -1).alias("below_minus_one"),
                              F.count_if(x.isNull()).alias("nulls"))


def completeness(df: DataFrame, series: str, period: str, value: str) -> DataFrame:
    """Missing periods of each series on the union calendar, without building the grid."""
    total = df.agg(F.count_distinct(period)).scalar()
    return df.groupBy(series).agg(F.count(value).alias("have"), (total - F.count(value)).alias("missing"))


def composition_status(method: DataFrame, null: DataFrame, max_share: float = 0.5, opt_out: bool = False, reason: str | None = None) -> DataFrame:
    """Tripwire on the tagged share of a method and its null: VOID strictly above the limit."""
    if opt_out and not (reason or "").strip():
        raise ValueError("an opt-out needs a written reason")
    if (reason or "").strip() and not opt_out:
        raise ValueError("a reason without an opt-out")
    m = method.select("id", F.col("tagged_share").alias("method_share"), F.col("computable").alias("_mc"))
    n = null.select(F.col("id").alias("null_id"), F.col("tagged_share").alias("null_share"), F.col("computable").alias("_nc"))
    d = attach_one(m, n)
    computable = F.col("_mc") & F.col("_nc")
    void_m = F.coalesce(computable & (F.col("method_share") > max_share), F.lit(False))
    void_n = F.coalesce(computable & (F.col("null_share") > max_share), F.lit(False))
    status = F.lit("OPTED OUT") if opt_out else F.when(~computable, "NOT COMPUTABLE").when(void_m | void_n, "VOID").otherwise("PASS")
    return d.select("id", "null_id", "method_share", "null_share", computable.alias("computable"), void_m.alias("void_method"), void_n.alias("void_null"), status.alias("status"))


def final_label(mechanical, composition) -> Column:
    """VOID wins, a FAIL stays, a would-be PASS is incomplete when composition is not computable."""
    m, c = F.upper(col(mechanical)), col(composition)
    return (F.when((m == "VOID") | (c == "VOID"), "VOID").when(m == "FAIL", "FAIL").when(c == "NOT COMPUTABLE", INCOMPLETE)
             .when(m == "PASS", "PASS").otherwise(F.raise_error(F.concat(F.lit("unknown reading "), m))))


def record_errors(df: DataFrame, label: str, mechanical: str, composition: str) -> DataFrame:
    """Rows whose recorded label does not follow from their parts."""
    want = final_label(mechanical, composition)
    return df.where(~F.col(label).eqNullSafe(want)).withColumn("expected", want)


def mechanical_reading(summary: DataFrame, rules: list[tuple[str, str, str]], void: str | None = None) -> DataFrame:
    """Criteria as a table: (name, column, null column) passes when the method is strictly better.

    Adds one boolean per rule and the reading PASS / FAIL / VOID.
    """
    d, ok = summary, F.lit(True)
    for name, a, b in rules:
        c = F.coalesce(F.col(a) > F.col(b), F.lit(False))
        d, ok = d.withColumn(name, c), ok & c
    reading = F.when(ok, "PASS").otherwise("FAIL")
    return d.withColumn("reading", F.when(F.col(void), "VOID").otherwise(reading) if void else reading)


def failure_reasons(**conditions: Column) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n.replace("_", " "))) for n, c in conditions.items()]))


def structure_profile(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Rows, duplicate dates, weekend rows and nulls per key."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), (F.count(date) - F.count_distinct(date)).alias("duplicates"),
                               F.count_if(F.dayofweek(date).isin(1, 7)).alias("weekend"), F.count_if(F.col(value).isNull()).alias("nulls"))
