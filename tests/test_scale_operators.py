"""Operators that must not gather a group: caps by prefix sums, block pairs, walks over ranks, block drawdowns, group ranks."""
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ordered as O, panel as P, portfolio as L, scores as S


# ---- caps
def passes(w, flagged, name_cap, group_cap, tol=1e-10):
    """Group cap, name cap, excess pro rata to the names under no cap; again until nothing is over."""
    w, frozen, bound, group = dict(w), set(), set(), False

    def give(excess):
        free = [k for k in w if k not in frozen]
        base = sum(w[k] for k in free)
        for k in free:
            w[k] += excess * (w[k] / base if base > 0 else 1 / len(free))
    while True:
        held, moved = sum(w[k] for k in flagged), False
        if held > group_cap + tol:
            moved = group = True
            for k in flagged:
                w[k] *= group_cap / held
            frozen |= set(flagged)
            give(held - group_cap)
        over = [k for k in w if w[k] > name_cap + tol]
        if over:
            moved = True
            excess = sum(w[k] - name_cap for k in over)
            for k in over:
                w[k] = name_cap
            frozen |= set(over)
            bound |= set(over)
            give(excess)
        if not moved:
            return w, bound, group


def cases():
    r = random.Random(7)
    out = []
    for i in range(140):
        n, kind = r.randint(6, 14), i % 5
        raw = [r.random() ** r.choice([1, 3, 8]) for _ in range(n)]
        if kind == 1:
            raw = [1.0] + [0.0] * (n - 1)
        if kind == 2:
            raw = [x if j < 2 else 0.0 for j, x in enumerate(raw)]
        if kind == 3:
            raw = [1.0] * n
        names = [f"k{j}" for j in range(n)]
        flags = {k: r.random() < 0.4 for k in names}
        low, cap, group = sum(flags.values()), r.choice([0.2, 0.25, 0.4]), r.choice([0.3, 0.15, 0.6])
        if (n - low) * cap + min(group, low * cap) < 1 - 1e-9 or (kind in (1, 2) and low == n):
            continue
        out.append((i, cap, group, {k: x / sum(raw) for k, x in zip(names, raw)}, flags))
    return out


def test_frozen_caps_equal_the_passes(spark):
    every = cases()
    assert len(every) >= 100
    rows = [(i, cap, group, k, x, flags[k]) for i, cap, group, w, flags in every for k, x in w.items()]
    df = spark.createDataFrame(rows, "id int, cap double, grp double, key string, weight double, flag boolean")
    kinds = set()
    for cap, group in sorted({(c, g) for _, c, g, _, _ in every}):
        got = {(r["id"], r["key"]): r for r in L.capped_frozen(df.where(f"cap = {cap} and grp = {group}"), ["id"], "flag", cap, group, "binding").collect()}
        for i, c, g, w, flags in every:
            if (c, g) != (cap, group):
                continue
            want, bound, grouped = passes(w, [k for k in w if flags[k]], cap, group)
            kinds.add((bool(bound), grouped))
            for k in w:
                row = got[i, k]
                assert row["weight"] == pytest.approx(want[k], abs=1e-9), (i, k)
                assert row["binding"] == ("name cap" if k in bound else "group cap" if grouped and flags[k] else None), (i, k)
    assert kinds == {(False, False), (False, True), (True, False), (True, True)}


def test_cap_report_and_errors(spark):
    w = {"u": .25, "e": .2, "s": .1, "A": .25, "B": .1, "C": .05, "D": .03, "E": .02}
    df = spark.createDataFrame([("x", k, v, k in "ues") for k, v in w.items()], "id string, key string, weight double, flag boolean")
    after = L.capped_frozen(df, ["id"], "flag", 0.2, 0.3, "binding")
    r = L.cap_report(df, after, ["id"], "flag", "binding").first()
    assert r["group_binds"] and r["names_bound"].split(",") == ["A", "B"] and r["share_pre"] == pytest.approx(0.55) and r["share_post"] == pytest.approx(0.3)
    for bad, text in ((df.where("key in ('A', 'B')").withColumn("weight", F.lit(0.5)), "infeasible"), (df.withColumn("weight", F.lit(0.5)), "sum to 1")):
        with pytest.raises(Exception, match=text):
            L.capped_frozen(bad, ["id"], "flag", 0.2, 0.3).collect()


def test_frozen_caps_plan_is_small_and_windows_are_cut_map_side(spark):
    df = spark.createDataFrame([("x", "a", 1.0, False)], "id string, key string, weight double, flag boolean")
    plan = L.capped_frozen(df, ["id"], "flag", 0.2, 0.3)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert len(windows) == 3 and sum("WindowGroupLimit" in x for x in windows) == 2  # the few largest, before and after the shuffle


# ---- pairs
def test_pair_blocks_equal_the_plain_join(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame([(f"k{i}", t, None if r.random() < 0.1 else float(r.normal())) for i in range(60) for t in range(4)], columns=["key", "midx", "ret"])
    df = spark.createDataFrame(pdf).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))
    a, b = df.where("ret is not null").select("midx", F.col("key").alias("k1"), F.col("ret").alias("x")), df.where("ret is not null").select("midx", F.col("key").alias("k2"), F.col("ret").alias("y"))
    for own in (False, True):
        want = sorted(map(tuple, a.join(b, "midx").where("k1 <= k2" if own else "k1 < k2").select("midx", "k1", "k2", "x", "y").collect()))
        for block in (512, 7, 1):
            assert sorted(map(tuple, P.paired(df, ["midx"], "key", "ret", own, block).collect())) == want


def test_one_period_with_20000_keys_has_no_large_join_key(spark):
    df = spark.range(20_000).select(F.format_string("n%05d", "id").alias("key"), F.lit(1).alias("midx"), F.lit(0.5).alias("ret"))
    cells = P.pair_cells(df, "key", 512).groupBy("_lo", "_hi").agg(F.count_if(F.expr("_own = _lo")).alias("a"), F.count_if(F.expr("_own = _hi")).alias("b")).collect()
    blocks = len({c["_lo"] for c in cells})
    assert 30 <= blocks <= 50 and len(cells) == blocks * (blocks + 1) // 2 and max(max(c["a"], c["b"]) for c in cells) < 2 * 512


def test_pairs_of_one_period_are_dealt_evenly(spark):
    df = spark.range(3000).select(F.format_string("n%05d", "id").alias("key"), F.lit(1).alias("midx"), F.lit(0.5).alias("ret"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = P.paired(df, ["midx"], "key", "ret", block=128).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [r["count"] for r in parts]
    assert sum(sizes) == 3000 * 2999 // 2 and len(sizes) == 4 and max(sizes) < 2 * min(sizes)


# ---- walks over ranks
def series(n, seed, ties=False, gaps=0.1):
    r = np.random.default_rng(seed)
    x = r.normal(size=n).round(1 if ties else 12)
    return [None if r.random() < gaps else float(v) for v in x]


@pytest.fixture(scope="module")
def walk_table(spark):
    rows = [(k, t, v) for k, (n, ties) in {"a": (400, False), "b": (300, True), "c": (1, False), "d": (37, True), "e": (5, False)}.items() for t, v in enumerate(series(n, len(k) + n, ties))]
    rows += [("f", t, None) for t in range(4)]
    return spark.createDataFrame(rows, "key string, t int, v double"), pd.DataFrame(rows, columns=["key", "t", "v"])


@pytest.mark.parametrize("rows, prior, short", [(None, True, 0), (None, False, 0), (30, True, 0), (30, False, 0), (None, True, 310), (None, False, 100_000)])
def test_frame_quantiles_equal_sql(spark, monkeypatch, walk_table, rows, prior, short):
    monkeypatch.setattr(O, "SHORT", short)
    df, pdf = walk_table
    end = "1 PRECEDING" if prior else "CURRENT ROW"
    begin = "UNBOUNDED PRECEDING" if rows is None else f"{rows - (0 if prior else 1)} PRECEDING"
    sql = "SELECT key, t, " + ", ".join(f"CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, {q}) OVER w END AS q{i}" for i, q in enumerate((0.5, 0.05, 0.9)))
    want = duckdb.sql(sql + f" FROM pdf WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN {begin} AND {end}) ORDER BY key, t").df()
    got = O.frame_quantile(df, ["key"], "t", "v", {"q0": 0.5, "q1": 0.05, "q2": 0.9}, rows, prior, 3).orderBy("key", "t").toPandas()
    assert list(got.columns) == ["key", "t", "v", "q0", "q1", "q2"]
    for c in ("q0", "q1", "q2"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=1e-12)


def test_expanding_median_of_100000_rows(spark):
    pdf = pd.DataFrame({"t": range(100_000), "v": np.random.default_rng(1).normal(size=100_000)})
    want = duckdb.sql("SELECT t, quantile_cont(v, 0.5) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pdf ORDER BY t").df()
    got = O.frame_quantile(spark.createDataFrame(pdf), [], "t", "v", {"m": 0.5}).orderBy("t").toPandas()
    np.testing.assert_allclose(got["m"].to_numpy(float), want["m"].to_numpy(float), rtol=0, atol=1e-12)


def test_left_tail_by_lags_and_by_walk(spark, monkeypatch, walk_table):
    df = walk_table[0].where("v is not null")
    lags = O.left_tail(df, ["key"], "t", "v", 24).orderBy("key", "t").toPandas()
    monkeypatch.setattr(O, "LAGS", 0)
    walk = O.left_tail(df, ["key"], "t", "v", 24).orderBy("key", "t")
    plan = walk._jdf.queryExecution().executedPlan().toString()
    walk = walk.toPandas()
    for c in ("cvar_5", "below_sigma"):
        np.testing.assert_allclose(walk[c].to_numpy(float), lags[c].to_numpy(float), rtol=0, atol=1e-9)
    assert "collect_list" not in plan
    x = [r["v"] for r in df.where("key = 'a'").orderBy("t").collect()]
    got = lags[lags.key == "a"].reset_index()
    for i in (2, 10, 60, len(x) - 1):
        w = np.array(x[max(0, i - 23):i + 1])
        cut = np.quantile(w, 0.05)
        assert got.cvar_5[i] == pytest.approx(-w[w <= cut].mean(), abs=1e-9) and got.below_sigma[i] == pytest.approx((w < -w.std(ddof=1)).mean(), abs=1e-12)


@pytest.mark.parametrize("rows", [1, 2, 5, 12, 300, 1000])
def test_sliding_drawdown_equals_every_window(spark, rows):
    r = np.random.default_rng(rows)
    prices = {"a": np.exp(np.cumsum(r.normal(0, 0.05, 700))), "b": np.ones(40), "c": np.array([3.0])}
    data = [(k, t, float(p) if not (k == "a" and t % 17 == 5) else None) for k, x in prices.items() for t, p in enumerate(x)]
    d = O.sliding_drawdown(spark.createDataFrame(data, "key string, t int, price double"), ["key"], "t", "price", rows, "worst")
    assert "collect_list" not in d._jdf.queryExecution().executedPlan().toString()
    got = {(x["key"], x["t"]): x["worst"] for x in d.collect()}
    for k in prices:
        x = [p for kk, _, p in data if kk == k]
        for t in range(len(x)):
            w = np.array([p for p in x[max(0, t - rows + 1):t + 1] if p is not None])
            if len(w) < 2:
                assert got[k, t] is None
            else:
                assert got[k, t] == pytest.approx((w / np.maximum.accumulate(w) - 1).min(), abs=1e-12)


# ---- ranks
def test_group_rank_of_one_large_board_is_dealt_out(spark):
    n = 300_000
    d = spark.range(n).select(F.when(F.col("id") % 50 == 0, F.format_string("g%d", F.col("id") % 7)).otherwise("big").alias("board"), F.format_string("%07d", "id").alias("id"),
                              F.when(F.col("id") % 3 == 0, F.lit(1.0)).when(F.col("id") % 11 != 0, F.rand(5)).alias("score"))
    d = S.stage(d)
    out = S.group_rank(d, ["board"], "score", "id", ranges=64)
    sizes = [r["count"] for r in d.repartitionByRange(64, "board", F.desc_nulls_last("score"), "id").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 3 * n / 64
    pdf = d.toPandas()
    want = duckdb.sql("SELECT id, row_number() OVER (PARTITION BY board ORDER BY score DESC NULLS LAST, id) AS rank FROM pdf ORDER BY id").df()
    assert (out.orderBy("id").select("rank").toPandas()["rank"].to_numpy() == want["rank"].to_numpy()).all()
