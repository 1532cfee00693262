"""Formula checks on small literal frames."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as X, stats as T, text as N
from panelspark.operators import calendar as C, inference as I, panel as P, portfolio as L, quality as Q, scores as S, windows as W


def frame(spark, values, key="a", first=24000):
    return spark.createDataFrame([(key, first + i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, midx int, x double")


def column(df, name, order="midx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_return_is_null_across_a_missing_month(spark):
    d = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 11.0), ("a", 4, 22.0)], "key string, midx int, p double")
    w = W.by("key", order="midx")
    d = d.select("midx", W.simple_return("p", w, "midx").alias("none"), W.simple_return("p", w, fill="pad").alias("pad"))
    assert column(d, "none") == [None, pytest.approx(0.1), None]
    assert column(d, "pad")[2] == pytest.approx(1.0)


def test_momentum_forms(spark):
    p = np.cumprod(1 + np.linspace(0.01, 0.2, 16)) * 100
    d = frame(spark, p).withColumn("ret", W.simple_return("x", W.by("key", order="midx"), "midx"))
    w = W.by("key", order="midx")
    d = d.select("midx", W.momentum_observed("x", w).alias("a"), W.momentum_gapless("ret", w).alias("b"))
    assert column(d, "a")[15] == pytest.approx(p[14] / p[3] - 1)
    assert column(d, "b")[15] == pytest.approx(p[13] / p[2] - 1)
    assert column(d, "a")[11] is None


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_hysteresis_equals_the_streak_rule(spark, k):
    rng = np.random.default_rng(k)
    raw = rng.random(60) < 0.35
    state, streak, want = False, 0, []
    for on in raw:
        streak = 0 if on else streak + 1
        state = True if on else (state and streak < k)
        want.append(state)
    d = spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate(raw)], "key string, midx int, raw boolean")
    assert column(d.select("midx", W.hysteresis("raw", W.by("key", order="midx"), k).alias("on")), "on") == want


def test_average_rank_of_ties(spark):
    d = spark.createDataFrame([("m", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, x double")
    got = {(r.x, r.rk) for r in d.select("x", W.average_rank("x", ["g"]).alias("rk")).collect()}
    assert got == {(1.0, 1.0), (2.0, 2.0), (3.0, 3.5)}


def test_group_quantile_is_exact_on_a_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.round(rng.standard_normal(3001), 2)] + [("cold", float(v)) for v in rng.random(7)] + [("one", 5.0)]
    d = spark.createDataFrame(rows, "g string, x double")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for q in (0.1, 0.5, 0.93):
        got = {r.g: r.v for r in S.group_quantile(d, ["g"], "x", q, "v", buckets=32).collect()}
        for g, x in pdf.groupby("g")["x"]:
            assert got[g] == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_robust_z_fallbacks(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, x double")
    z = {}
    for r in S.robust_z(d, ["g"], ["x"]).collect():
        z.setdefault(r.g, []).append(r.z_x)
    assert max(z["a"]) == pytest.approx((9 - 1) / np.std([1, 1, 1, 9], ddof=1))
    assert z["b"] == [0.0, 0.0] and z["c"] == [None]


def test_global_rank_matches_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i:04d}", float(np.round(v, 1))) for i, v in enumerate(rng.standard_normal(2000))] + [("zz", None)]
    d = spark.createDataFrame(rows, "key string, s double")
    got = {r.key: r["rank"] for r in S.global_rank(d, "s", "key", ranges=16).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(want)}


def _largest_share(df, used):
    """Share of the rows in the largest task after the plan's own dealing, without coalescing."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(used)).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    return max(n) / sum(n)


def test_large_groups_split(spark):
    """One group with three quarters of the rows and an outlier; two-valued and all-NULL scores."""
    d = spark.range(60_000).selectExpr("if(id % 4 < 3, 'g', 'h') g", "if(id = 7, 1e9, double(xxhash64(id) % 100000)) v", "id")
    counted, cuts = W.counted_values(d, ["g"], "v")
    by_bucket = counted.groupBy("g", "_b").agg(F.sum("_c").alias("n")).collect()
    assert len(cuts) > 200 and max(r.n for r in by_bucket) < 0.02 * 60_000
    for c in ("v", "if(id % 2 = 0, 1.0D, 2.0D)", "cast(null as double)"):
        ranked = S.global_rank(d.selectExpr("id", f"{c} s"), "s", "id", ranges=64)
        assert _largest_share(ranked, "rank") < 0.12
        assert ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (60_000, 1, 60_000)


def test_staging_needs_a_shared_folder(spark):
    from panelspark.sources import stage as st

    class Bare:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        st.scratch_dir(Bare)


def test_a_later_month_is_seen(spark, sf, tmp_path):
    """A row after the last month of the tables makes that month complete and the new one the incomplete one."""
    from panelspark.plans.views import Views
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    end = t.agg(F.max("l_shipdate").alias("d")).first().d
    more = t.limit(1).withColumn("l_shipdate", F.lit(end) + F.expr("INTERVAL 3 MONTHS"))
    t.unionByName(more).write.parquet(f"{tmp_path}/lineitem.parquet")
    old, new = (Views(spark, d).rates.agg(F.max("month")).first()[0] for d in (sf, str(tmp_path)))
    assert new > old


def test_normal_law(spark):
    d = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.3, 0.5, 0.975, 0.9999, 0.0, 1.0)], "p double")
    rows = d.select("p", T.norm_ppf("p").alias("z")).select("p", "z", T.norm_cdf("z").alias("c")).collect()
    assert [r.z for r in rows[-2:]] == [None, None]
    for r in rows[:-2]:
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-6, abs=1e-8)
        assert r.c == pytest.approx(r.p, abs=1e-6)


def test_newey_west(spark):
    x = np.random.default_rng(1).standard_normal(50) + 0.3
    d = frame(spark, x)
    r = I.newey_west(d, ["key"], "midx", "x", 3).collect()[0]
    e = x - x.mean()
    var = e @ e / 50 + sum(2 * (1 - k / 4) * (e[k:] @ e[:-k]) / 50 for k in (1, 2, 3))
    assert r.nw_t == pytest.approx(x.mean() / math.sqrt(var / 50))


@pytest.mark.parametrize("kind", ["sharpe", "variance"])
def test_paired_bootstrap_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n, block, reps, seed = 30, 4, 40, 11
    xy = rng.standard_normal((n, 2)) * [1.0, 1.4] + 0.2
    d = spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id string, t int, x double, y double")
    got = I.paired_bootstrap(d, ["id"], "t", kind, block, reps, seed).collect()[0]

    def stat(z, pieces):
        mu, g = z.mean(0), (z * z).mean(0)
        v = g - mu * mu
        if kind == "sharpe":
            delta = mu[0] / v[0] ** .5 - mu[1] / v[1] ** .5
            c = [g[0] / v[0] ** 1.5, -g[1] / v[1] ** 1.5, -mu[0] / (2 * v[0] ** 1.5), mu[1] / (2 * v[1] ** 1.5)]
        else:
            delta, c = np.log(v[0] / v[1]), [-2 * mu[0] / v[0], 2 * mu[1] / v[1], 1 / v[0], -1 / v[1]]
        f = np.column_stack([z - mu, z * z - g]) @ np.array(c)
        sums = np.array([f[p].sum() for p in pieces])
        return delta, math.sqrt((sums ** 2).mean() / block / n)

    def start(c):
        m = 2 ** 31
        x = ((c + seed) * 1103515245 + 12345) % m
        x = (((x * x) >> 10) + (c + seed) * 7919) % m
        return (((x * 69069 + 1) % m) * n) >> 31

    z = xy / math.sqrt((xy * xy).mean())
    blocks = -(-n // block)
    pieces = [range(b * block, min(n, (b + 1) * block)) for b in range(blocks)]
    d0, s0 = stat(z, pieces)
    one = two = 0
    for r in range(reps):
        idx = np.concatenate([(start(r * blocks + b) + np.arange(block)) % n for b in range(blocks)])[:n]
        dr, sr = stat(z[idx], pieces)
        t = (dr - d0) / sr
        one += t >= d0 / s0 if kind == "sharpe" else t <= d0 / s0
        two += abs(t) >= abs(d0 / s0)
    assert got.delta == pytest.approx(d0) and got.se_nat == pytest.approx(s0)
    assert got.p_one_sided == pytest.approx((1 + one) / (1 + reps)) and got.p_two_sided == pytest.approx((1 + two) / (1 + reps))


def test_asof_join_takes_the_last_known_row(spark):
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 5.0), ("b", 3, 3.0)], "key string, t int, v double")
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 2)], "key string, s int")
    got = {(r.key, r.s): r.v for r in C.asof_join(left, right, ["key"], "s", "t", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 1.0, ("a", 4): 1.0, ("a", 9): 5.0, ("b", 2): None}


def test_exchange_calendar(spark):
    d = C.sessions(spark.sql("select explode(sequence(date'2001-01-01', date'2026-12-31')) as date"))
    closed = {str(r.date) for r in d.where("not is_session and dayofweek(date) not in (1, 7)").collect()}
    for day in ("2001-09-11", "2012-10-29", "2022-06-20", "2021-07-05", "2024-03-29", "2010-12-24", "2023-01-02", "2025-01-09", "2024-11-28"):
        assert day in closed
    for day in ("2021-12-31", "2021-06-18", "2011-01-03", "2024-07-05"):
        assert day not in closed
    last = {str(r.month): str(r.last_session) for r in C.last_sessions(d).collect()}
    assert last["2024-03-01"] == "2024-03-28" and last["2010-12-01"] == "2010-12-31"


def test_partial_month_precedence(spark):
    d = spark.sql("select explode(sequence(date'2024-01-02', date'2024-03-20')) as date")
    months = lambda x: {str(r[0])[:7] for r in x.select("date").collect()}
    assert "2024-03" not in months(C.drop_partial_month(d, "date"))
    assert "2024-03" in months(C.drop_partial_month(d, "date", asof="2024-03-28"))
    cov = spark.sql("select date'2024-03-29' as `end`")
    assert "2024-03" in months(C.drop_partial_month(d, "date", coverage=cov))


def test_turnover_counts_dropped_names_and_gaps(spark):
    rows = [("s", 1, "a", 0.5), ("s", 1, "b", 0.5), ("s", 3, "b", 0.2), ("s", 3, "c", 0.8)]
    w = spark.createDataFrame(rows, "strategy string, midx int, key string, weight double")
    t = {r.midx: r.turnover for r in L.turnover(w, ["strategy"], "midx").collect()}
    assert t == {1: pytest.approx(0.5), 3: pytest.approx(0.5 * (0.5 + 0.3 + 0.8))}
    z = {r.midx: r.turnover for r in L.turnover(w, ["strategy"], "midx", first="zero").collect()}
    assert z[1] == 0.0


def test_drift_compounds_a_skipped_rebalance(spark):
    w = spark.createDataFrame([("s", 1, "a", 0.5), ("s", 1, "b", 0.5), ("s", 3, "a", 1.0)], "strategy string, midx int, key string, weight double")
    r = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 0.1), ("a", 3, 0.2), ("b", 1, 9.0), ("b", 2, -0.5), ("b", 3, 0.0)], "key string, midx int, ret double")
    got = {x.key: x.weight for x in L.drifted(w, r, ["strategy"], "midx").collect()}
    a, b = 0.5 * 1.1 * 1.2, 0.5 * 0.5
    assert got == {"a": pytest.approx(a / (a + b)), "b": pytest.approx(b / (a + b))}


def test_missing_held_return_policies(spark):
    w = spark.createDataFrame([("s", 1, "a", 0.5), ("s", 1, "b", 0.5)], "strategy string, midx int, key string, weight double")
    r = spark.createDataFrame([("a", 2, 0.1)], "key string, midx int, ret double")
    assert L.book_returns(w, r, ["strategy"], "midx").collect()[0].gross is None
    assert L.book_returns(w, r, ["strategy"], "midx", "skip").collect()[0].gross == pytest.approx(0.05)
    with pytest.raises(Exception, match="missing return"):
        L.book_returns(w, r, ["strategy"], "midx", "error").collect()


def test_caps_hold_and_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [("s", i, f"k{j}", float(x), j < 5) for i in range(20) for j, x in enumerate(rng.dirichlet(np.full(20, 0.4)))]
    w = spark.createDataFrame(rows, "strategy string, midx int, key string, weight double, flag boolean")
    for out in (L.capped_frozen(w, ["strategy", "midx"], "flag", 0.2, 0.3), L.capped(w, ["strategy", "midx"], "flag", 0.2, 0.2, 0.3)):
        for r in Q.weight_rules(out, ["strategy", "midx"], "flag", 0.2, 0.3, tol=1e-6).collect():
            assert r.sum_ok and r.long_only and r.single_ok and r.group_ok
        assert out.agg(F.max("weight")).collect()[0][0] <= 0.2 + 1e-6


def test_frozen_caps_without_room_raise(spark):
    """Four flagged and three other names at 0.2 and 0.3 hold at most 0.9, although seven names at 0.2 have room."""
    w = spark.createDataFrame([(1, f"k{i}", i < 4, 1 / 7) for i in range(7)], "midx int, key string, flag boolean, weight double")
    with pytest.raises(Exception, match="infeasible caps"):
        L.capped_frozen(w, ["midx"], "flag", 0.2, 0.3).collect()


def test_label_truth_table(spark):
    rows = [(m, c) for m in ("PASS", "FAIL", "VOID") for c in ("PASS", "VOID", "NOT COMPUTABLE", "OPTED OUT")]
    d = spark.createDataFrame(rows, "m string, c string").select("m", "c", Q.final_label("m", "c").alias("l"))
    got = {(r.m, r.c): r.l for r in d.collect()}
    assert got[("PASS", "PASS")] == got[("PASS", "OPTED OUT")] == "PASS"
    assert got[("PASS", "NOT COMPUTABLE")] == Q.INCOMPLETE
    assert got[("FAIL", "NOT COMPUTABLE")] == "FAIL" and got[("FAIL", "VOID")] == "VOID" and got[("VOID", "PASS")] == "VOID"


def test_strict_boolean_rejects_other_text(spark):
    ok = spark.createDataFrame([("TRUE",), ("0",), (None,)], "t string").select(X.strict_bool("t").alias("b")).collect()
    assert [r.b for r in ok] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("yes",)], "t string").select(X.strict_bool("t")).collect()


def test_name_cleaning(spark):
    long = "PACER FUNDS TRUST - " + "alpha beta " * 4 + "ETF gamma delta epsilon zeta eta theta iota ETF kappa"
    rows = [("ISHARES TRUST - ISHARES MSCI EAFE ETF",), ("Schwab Strategic Trust - SCHWAB U.S. REIT ETF",), ("VANGUARD BOND INDEX FUNDS - VANGUARD TOTAL BOND ETF",),
            ("VANGUARD GROWTH - INCOME ETF",), ("GOLDMAN SACHS ETF TRUST - GOLDMAN SACHS ACTIVE ETF",), (long,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(N.clean_name("n")).collect()]
    assert got == ["Ishares MSCI EAFE ETF", "Schwab U.S. REIT ETF", "Vanguard Total Bond ETF", "Vanguard Growth - Income ETF", "Gs Gs Active ETF", "Alpha Beta " * 4 + "ETF"]


def test_gate_assertion_names_the_offender(spark):
    u = spark.createDataFrame([("A", True, "Core"), ("B", False, "Core")], "key string, approved boolean, section string")
    deny = spark.createDataFrame([("C",)], "key string")
    bad = P.ineligible_reasons(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "key string"), u, deny)
    assert {(r.key, r.reason) for r in bad.collect()} == {("B", "not approved"), ("C", "deny list"), ("D", "not in universe")}
    with pytest.raises(ValueError, match="deny list"):
        P.assert_none(bad, "gate")
