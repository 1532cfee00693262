"""Verification queries: weights, composition, turnover and closed-form allocations."""
from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.functions.scalar import SQRT12, breakdown_scalar, scale_factor
from panelspark.operators import calendar as C, ordered as O, panel as P, portfolio as L, windows as W

KEYS = ["strategy"]
TURN = """ch AS (SELECT coalesce(a.strategy,b.strategy) AS strategy, coalesce(a.midx,b.midx+1) AS midx, coalesce(a.weight,0)-coalesce(b.weight,0) AS dw FROM weights a
 FULL JOIN (SELECT * FROM weights WHERE midx < (SELECT max(midx) FROM weights)) b ON a.strategy=b.strategy AND a.key=b.key AND a.midx=b.midx+1),
 t0 AS (SELECT strategy, midx, 0.5*sum(abs(dw)) AS turnover FROM ch GROUP BY strategy, midx), tt AS (SELECT *, midx=min(midx) OVER (PARTITION BY strategy) AS first FROM t0)"""


@query("a18_concentration", "strategy hhi_mean:8 eff_n_mean:f names_held_mean:f largest_mean:f rebalances:i eff_n_group:f", """WITH p AS (SELECT strategy, month, sum(weight*weight) AS hhi, count(*) FILTER (weight>0.001) AS held, max(weight) AS mx FROM weights GROUP BY ALL),
 g AS (SELECT strategy, month, sum(gw*gw) AS h FROM (SELECT strategy, month, category, sum(weight) AS gw FROM weights JOIN uni_n USING (key) GROUP BY ALL) GROUP BY ALL)
SELECT strategy, avg(hhi) AS hhi_mean, avg(1/hhi) AS eff_n_mean, avg(held) AS names_held_mean, avg(mx) AS largest_mean, count(*) AS rebalances, (SELECT avg(1/h) FROM g WHERE g.strategy=p.strategy) AS eff_n_group FROM p GROUP BY strategy""")
def a18(v):
    own = L.concentration(v.weights, KEYS, "month")
    grp = v.weights.join(v.uni_n.select("key", "category"), "key").groupBy("strategy", "month", "category").agg(F.sum("weight").alias("weight"))
    return own.join(L.concentration(grp, KEYS, "month").select("strategy", F.col("eff_n_mean").alias("eff_n_group")), "strategy")


@query("a19_average_holdings", "strategy key avg_weight:8 rank:i", """SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY avg_weight DESC, key) AS rank FROM (SELECT strategy, key, sum(weight)/any_value(n) AS avg_weight FROM weights JOIN
 (SELECT strategy, count(DISTINCT month) AS n FROM weights GROUP BY 1) USING (strategy) GROUP BY ALL) QUALIFY rank <= 10""")
def a19(v):
    return L.average_holdings(v.weights, KEYS, "month").where("rank <= 10")


@query("a20_turnover_target", "strategy midx:i turnover:f cost:8 turnover_zero:f", f"WITH {TURN} SELECT strategy, midx, turnover, turnover*5/10000 AS cost, CASE WHEN first THEN 0 ELSE turnover END AS turnover_zero FROM tt")
def a20(v):
    t = L.turnover(v.weights, KEYS, "midx")
    return t.withColumn("turnover_zero", F.when(F.col("first"), F.lit(0.0)).otherwise(F.col("turnover")))


DR = """dr AS (SELECT w.strategy, w.midx+1 AS midx, w.key, w.weight*(1+coalesce(n.ret,0)) AS g FROM weights w LEFT JOIN nation_ret n ON n.key=w.key AND n.midx=w.midx+1 WHERE w.midx < (SELECT max(midx) FROM weights)),
 dw AS (SELECT strategy, midx, key, g/sum(g) OVER (PARTITION BY strategy, midx) AS weight FROM dr)"""


@query("w28_drifted_weights", "strategy midx:i key weight:8", f"WITH {DR} SELECT * FROM dw")
def w28(v):
    return L.drifted(v.weights, v.nation_ret, KEYS, "midx")


@query("a20_turnover_drifted", "strategy midx:i turnover:f", f"WITH {DR} SELECT coalesce(a.strategy,b.strategy) AS strategy, coalesce(a.midx,b.midx) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS turnover FROM weights a FULL JOIN dw b ON a.strategy=b.strategy AND a.midx=b.midx AND a.key=b.key GROUP BY 1,2")
def a20d(v):
    return L.turnover(v.weights, KEYS, "midx", previous=w28(v))


@query("a21_tag_composition", "strategy computable:b cash_like_share:f short_duration_share:f near_cash_share:f tagged_share:f reason", """WITH x AS (SELECT w.strategy, w.month, CASE WHEN w.strategy='MACHINERY' AND w.key='NATION_3' THEN 'SLEEVE_X' ELSE w.key END AS key, weight FROM weights w),
 j AS (SELECT x.*, u.cash_like, u.short_duration, u.near_cash, u.key IS NULL AS bad FROM x LEFT JOIN uni_n u ON u.key=x.key),
 g AS (SELECT strategy, count(*) FILTER (bad)=0 AS computable, sum(CASE WHEN cash_like THEN weight ELSE 0 END)/count(DISTINCT month) AS c, sum(CASE WHEN short_duration THEN weight ELSE 0 END)/count(DISTINCT month) AS s, sum(CASE WHEN near_cash THEN weight ELSE 0 END)/count(DISTINCT month) AS n FROM j GROUP BY 1)
SELECT strategy, computable, CASE WHEN computable THEN c END AS cash_like_share, CASE WHEN computable THEN s END AS short_duration_share, CASE WHEN computable THEN n END AS near_cash_share, CASE WHEN computable THEN c+s+n END AS tagged_share,
 CASE WHEN computable THEN '' ELSE 'no constituent weights for: SLEEVE_X' END AS reason FROM g""")
def a21(v):
    return L.tag_shares(odd_weights(v), v.uni_n, KEYS, "month", ["cash_like", "short_duration", "near_cash"])


def odd_weights(v):
    """Weights with one holding that the universe does not know."""
    odd = (F.col("strategy") == "MACHINERY") & (F.col("key") == "NATION_3")
    return v.weights.withColumn("key", F.when(odd, "SLEEVE_X").otherwise(F.col("key")))


@query("a22_exposure_groups", "strategy grp share:f", """WITH x AS (SELECT strategy, month, unnest([asset_class, CASE WHEN equity_only THEN 'risky' ELSE 'defensive' END]) AS grp, weight FROM weights JOIN uni_n USING (key))
SELECT strategy, grp, sum(weight)/any_value(n) AS share FROM x JOIN (SELECT strategy, count(DISTINCT month) AS n FROM weights GROUP BY 1) USING (strategy) GROUP BY ALL""")
def a22(v):
    n = v.weights.groupBy("strategy").agg(F.count_distinct("month").alias("n"))
    d = v.weights.join(v.uni_n, "key").select("strategy", "weight", F.explode(F.array("asset_class", F.when(F.col("equity_only"), "risky").otherwise("defensive"))).alias("grp"))
    return d.groupBy("strategy", "grp").agg(F.sum("weight").alias("w")).join(n, "strategy").withColumn("share", F.col("w") / F.col("n"))


@query("t02_top_with_other", "strategy month:d key weight:8", """WITH a AS (SELECT strategy, key, row_number() OVER (PARTITION BY strategy ORDER BY tw DESC, key) AS rk FROM (SELECT strategy, key, sum(weight) AS tw FROM weights GROUP BY 1,2))
SELECT strategy, month, lab AS key, sum(weight) AS weight FROM (SELECT w.strategy, month, weight, CASE WHEN rk<=5 OR w.key='NATION_7' THEN w.key ELSE 'Other' END AS lab FROM weights w JOIN a ON a.strategy=w.strategy AND a.key=w.key) GROUP BY 1, 2, 3""")
def t02(v):
    return L.with_other(v.weights, KEYS, "month", 5, ["NATION_7"])


# ------------------------------------------------------------------ allocations
SIG = "sg AS (SELECT r.key, midx, month, category, equity_only, stddev_samp(ret) OVER w AS sigma, count(ret) OVER w AS n FROM ret_s r JOIN uni_s USING (key) WINDOW w AS (PARTITION BY r.key ORDER BY midx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))"


def live(v):
    return P.live_names(v.ret_s, 24, 24, 3).withColumnRenamed("sd", "sigma").join(v.uni_s, "key")


@query("l01_static_mix", "month:d key weight:f", "SELECT month, key, w AS weight FROM (SELECT DISTINCT month FROM px_s), (VALUES ('A',0.7),('B',0.2),('C',0.1)) m(key,w)")
def l01(v):
    return L.static_mix(v.px_s.select("month").distinct(), {"A": 0.7, "B": 0.2, "C": 0.1})


@query("l02_equal_weight", "key midx:i weight:8", f"WITH {SIG} SELECT key, midx, 1.0/count(*) OVER (PARTITION BY midx) AS weight FROM sg WHERE n=24")
def l02(v):
    return L.equal_weight(live(v), ["midx"])


@query("l03_inverse_vol", "key midx:i weight:8", f"WITH {SIG} SELECT key, midx, (1/sigma)/sum(1/sigma) OVER (PARTITION BY midx) AS weight FROM sg WHERE n=24")
def l03(v):
    return L.inverse_vol(live(v), ["midx"], "sigma")


@query("l04_trend_inverse_vol", "key midx:i weight:8", f"""WITH {SIG}, a AS (SELECT sg.key, sg.midx, (1/sigma)/sum(1/sigma) OVER (PARTITION BY sg.midx) AS w, ret FROM sg JOIN ret_s r ON r.key=sg.key AND r.midx=sg.midx WHERE n=24),
 b AS (SELECT *, sum(CASE WHEN ret>0.3 THEN w ELSE 0 END) OVER (PARTITION BY midx) AS t FROM a) SELECT key, midx, CASE WHEN t>0 THEN CASE WHEN ret>0.3 THEN w/t ELSE 0 END ELSE w END AS weight FROM b""")
def l04(v):
    return L.trend_filtered(L.inverse_vol(live(v), ["midx"], "sigma").withColumn("sig", F.col("ret") - 0.3), ["midx"], "sig")


def scaled_core(v):
    """Three-sleeve core scaled by clip(target / sigma) at each month."""
    m = v.ret_s.groupBy("month", "midx").agg(F.avg("ret").alias("r"))
    # one row per month: the ordered frame runs over the bounded calendar
    m = m.withColumn("sigma", W.trailing_vol("r", Window.orderBy("midx"), 12, 12.0)).where("sigma is not null")
    return L.static_mix(m.select("month", scale_factor("sigma", F.lit(0.08)).alias("f")), {"A": 0.7, "B": 0.2, "C": 0.1})


@query("l05_scaled_with_cash", "month:d key weight:f", """WITH m AS (SELECT month, midx, avg(ret) AS r FROM ret_s GROUP BY ALL), s AS (SELECT month, least(1.0, greatest(0.25, 0.08/(stddev_samp(r) OVER w*sqrt(12)))) AS f, count(r) OVER w AS n FROM m WINDOW w AS (ORDER BY midx ROWS 11 PRECEDING))
SELECT month, key, w*f AS weight FROM s, (VALUES ('A',0.7),('B',0.2),('C',0.1)) m(key,w) WHERE n=12 UNION ALL SELECT month, 'CASH', greatest(0, 1-f) FROM s WHERE n=12""")
def l05(v):
    return L.scaled_with_cash(scaled_core(v), ["month"], "f", "CASH")


@query("l06_core_trim", "month:d key weight:8", """WITH sl AS (SELECT month, key, weight*0.2 AS weight FROM weights WHERE strategy='MACHINERY'), s AS (SELECT month, sum(weight) AS t FROM sl GROUP BY month)
SELECT month, key, sum(weight) AS weight FROM (SELECT b.month, key, weight*(1-coalesce(t,0)) AS weight FROM weights b LEFT JOIN s USING (month) WHERE strategy='BUILDING' UNION ALL SELECT month, key, weight FROM sl) GROUP BY ALL""")
def l06(v):
    core = v.weights.where("strategy = 'BUILDING'").select("month", "key", "weight")
    sleeve = v.weights.where("strategy = 'MACHINERY'").select("month", "key", (F.col("weight") * 0.2).alias("weight"))
    return L.fund_by_core_trim(core, sleeve, ["month"])


@query("l07_sleeve_caps", "strategy month:d key weight:8", """WITH c AS (SELECT *, least(greatest(weight,0),0.06) AS w FROM weights), t AS (SELECT *, sum(w) OVER (PARTITION BY strategy, month) AS s FROM c)
SELECT strategy, month, key, CASE WHEN s > 0.5+1e-12 THEN w*0.5/s ELSE w END AS weight FROM t""")
def l07(v):
    return L.sleeve_caps(v.weights, ["strategy", "month"], 0.06, 0.5)


def cap_sql(src, grp, passes, cf, co, tot):
    """Unrolled capped redistribution as a chain of CTEs."""
    out = f"c0 AS (SELECT *, CASE WHEN flag THEN {cf} ELSE {co} END AS cap, weight/sum(weight) OVER (PARTITION BY {grp}) AS w FROM {src})"
    for i in range(passes):
        out += (f", k{i} AS (SELECT * REPLACE (least(w, cap) AS w) FROM c{i}), s{i} AS (SELECT *, sum(CASE WHEN flag THEN w END) OVER (PARTITION BY {grp}) AS ts FROM k{i}),"
                f" q{i} AS (SELECT * REPLACE (CASE WHEN flag AND ts > {tot} THEN w*{tot}/ts ELSE w END AS w) FROM s{i}), r{i} AS (SELECT *, 1-sum(w) OVER (PARTITION BY {grp}) AS rem, greatest(0, cap-w) AS room FROM q{i}),"
                f" z{i} AS (SELECT *, sum(room) OVER (PARTITION BY {grp}) AS sr FROM r{i}), c{i+1} AS (SELECT * EXCLUDE (ts, rem, room, sr) REPLACE (CASE WHEN abs(rem)>=1e-10 AND sr>1e-12 THEN w+rem*room/sr ELSE w END AS w) FROM z{i})")
    return out


@query("l08_capped_redistribution", "strategy month:d key weight:8", f"WITH src AS (SELECT w.*, equity_only AS flag FROM weights w JOIN uni_n USING (key)), {cap_sql('src', 'strategy, month', 20, 0.05, 0.12, 0.25)} SELECT strategy, month, key, w/sum(w) OVER (PARTITION BY strategy, month) AS weight FROM c20")
def l08(v):
    d = v.weights.join(v.uni_n.select("key", F.col("equity_only").alias("flag")), "key")
    return L.capped(d, ["strategy", "month"], "flag", 0.05, 0.12, 0.25)


def frozen_sql(src, grp, cf, cap, tol="1e-10"):
    """Recursive oracle of group cap, name cap and pro-rata excess: one pass a step over a decision's list of names."""
    base = lambda ws, z: f"list_sum(list_transform(list_filter({ws}, lambda e: NOT e.{z}), lambda e: e.w))"
    free = lambda ws, z: f"len(list_filter({ws}, lambda e: NOT e.{z}))"
    spread = lambda ws, e: (f"list_transform({ws}, lambda i: {{'k': i.k, 'f': i.f, 'n': i.n, 'z': i.z, 'w': CASE WHEN i.z THEN i.w ELSE i.w + {e} * "  # noqa: E731
                            f"CASE WHEN {base(ws, 'z')} > 0 THEN i.w / {base(ws, 'z')} ELSE 1.0 / {free(ws, 'z')} END END}})")
    return f"""fr AS (
  SELECT {grp}, list({{'k': key, 'f': flag, 'n': false, 'z': false, 'w': weight}} ORDER BY key) AS l, true AS more, false AS gb FROM {src} GROUP BY {grp}
  UNION ALL
  SELECT {grp}, {spread('c', 'x')}, gover OR x > 0, gb OR gover FROM (
   SELECT *, list_sum(list_transform(b, lambda e: greatest(0, CASE WHEN e.w > {cap} + {tol} THEN e.w - {cap} ELSE 0 END))) AS x,
    list_transform(b, lambda e: {{'k': e.k, 'f': e.f, 'n': e.n OR e.w > {cap} + {tol}, 'z': e.z OR e.w > {cap} + {tol}, 'w': CASE WHEN e.w > {cap} + {tol} THEN {cap} ELSE e.w END}}) AS c FROM (
    SELECT *, {spread('a', '(CASE WHEN gover THEN lv - ' + str(cf) + ' ELSE 0 END)')} AS b FROM (
     SELECT *, lv > {cf} + {tol} AS gover, list_transform(l, lambda e: {{'k': e.k, 'f': e.f, 'n': e.n, 'z': e.z OR (e.f AND lv > {cf} + {tol}), 'w': CASE WHEN e.f AND lv > {cf} + {tol} THEN e.w * {cf} / lv ELSE e.w END}}) AS a FROM (
      SELECT *, list_sum(list_transform(list_filter(l, lambda e: e.f), lambda e: e.w)) AS lv FROM fr WHERE more))))),
 fz AS (SELECT {grp}, gb, unnest(l, recursive := true) FROM fr WHERE NOT more)"""


@query("l08_frozen_caps", "strategy month:d key weight:8 binding", f"""WITH RECURSIVE src AS (SELECT strategy, month, key, weight, equity_only AS flag FROM weights JOIN uni_n USING (key)), {frozen_sql('src', 'strategy, month', 0.30, 0.12)}
SELECT strategy, month, k AS key, w AS weight, CASE WHEN n THEN 'name cap' WHEN f AND gb THEN 'group cap' END AS binding FROM fz""")
def l08f(v):
    d = v.weights.join(v.uni_n.select("key", F.col("equity_only").alias("flag")), "key")
    return L.capped_frozen(d, ["strategy", "month"], "flag", 0.12, 0.30, "binding")


@query("l08_cap_report", "strategy month:d group_binds:b names_bound share_pre:f share_post:f largest_pre:f largest_post:f", f"""WITH RECURSIVE src AS (SELECT strategy, month, key, weight, equity_only AS flag FROM weights JOIN uni_n USING (key)), {frozen_sql('src', 'strategy, month', 0.30, 0.12)}
SELECT strategy, month, any_value(gb) AS group_binds, coalesce(string_agg(k, ',' ORDER BY k) FILTER (n), '') AS names_bound, any_value(p.share_pre) AS share_pre, sum(CASE WHEN f THEN w ELSE 0 END) AS share_post, any_value(p.largest_pre) AS largest_pre, max(w) AS largest_post
FROM fz JOIN (SELECT strategy, month, sum(CASE WHEN flag THEN weight ELSE 0 END) AS share_pre, max(weight) AS largest_pre FROM src GROUP BY ALL) p USING (strategy, month) GROUP BY ALL""")
def l08r(v):
    """Which names and groups the caps hold down, and by how much."""
    from panelspark.sources.stage import stage
    d = stage(v.weights.join(v.uni_n.select("key", F.col("equity_only").alias("flag")), "key"))
    return L.cap_report(d, L.capped_frozen(d, ["strategy", "month"], "flag", 0.12, 0.30, "binding"), ["strategy", "month"], "flag", "binding")


PICK = """b AS (SELECT sc.key, sc.midx, s, equity_only AS flag, sum(CASE WHEN equity_only THEN 1 ELSE 0 END) OVER (PARTITION BY sc.midx ORDER BY s DESC, sc.key ROWS UNBOUNDED PRECEDING) AS f FROM sc JOIN uni_s USING (key) WHERE ready),
 pk AS (SELECT *, row_number() OVER (PARTITION BY midx ORDER BY s DESC, key) AS pick FROM b WHERE NOT flag OR f <= 2)"""


def _picked(v):
    from panelspark.catalog.q_scores import monthly_scores
    d = monthly_scores(v).where("ready").join(v.uni_s.select("key", F.col("equity_only").alias("flag")), "key")
    return L.pick_top(d, ["midx"], "s", 8, "flag")


def _sc():
    from panelspark.catalog.q_scores import SC
    return SC


@query("t04_budgeted_top_n", "midx:i key pick:i", f"WITH {_sc()}, {PICK} SELECT midx, key, pick FROM pk WHERE pick <= 8")
def t04(v):
    return _picked(v)


@query("l09_static_from_scores", "midx:i key weight:8", f"WITH {_sc()}, {PICK}, src AS (SELECT midx, key, flag, 1.0/count(*) OVER (PARTITION BY midx) AS weight FROM pk WHERE pick <= 8), {cap_sql('src', 'midx', 20, 0.15, 0.40, 0.25)} SELECT midx, key, w/sum(w) OVER (PARTITION BY midx) AS weight FROM c20")
def l09(v):
    return L.capped(L.equal_weight(_picked(v), ["midx"]).select("midx", "key", "flag", "weight"), ["midx"], "flag")


@query("l21_sleeve_to_members", "midx:i key weight:8", f"""WITH {SIG}, s AS (SELECT midx, category, avg(sigma) AS sigma, count(*) AS n FROM sg WHERE n=24 GROUP BY ALL), w AS (SELECT midx, category, n, (1/sigma)/sum(1/sigma) OVER (PARTITION BY midx) AS w FROM s)
SELECT midx, key, w/w.n AS weight FROM w JOIN (SELECT midx, key, category FROM sg WHERE n=24) USING (midx, category)""")
def l21(v):
    d = live(v).withColumnRenamed("category", "sleeve")
    sl = d.groupBy("midx", "sleeve").agg(F.avg("sigma").alias("sigma"))
    return L.sleeve_to_members(L.inverse_vol(sl, ["midx"], "sigma"), d.select("midx", "sleeve", "key"), ["midx"])


@query("l22_weight_distance", "month:d l2:f half_l1:f", """SELECT coalesce(a.month,b.month) AS month, sqrt(sum(pow(coalesce(a.weight,0)-coalesce(b.weight,0),2))) AS l2, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS half_l1
FROM (SELECT * FROM weights WHERE strategy='MACHINERY') a FULL JOIN (SELECT * FROM weights WHERE strategy='BUILDING') b ON a.month=b.month AND a.key=b.key GROUP BY 1""")
def l22(v):
    a, b = (v.weights.where(F.col("strategy") == s) for s in ("MACHINERY", "BUILDING"))
    return L.distance(a, b, ["month"])


# ------------------------------------------------------------------ rotation and scaled books
ROT = """b AS (SELECT r.key, r.midx, r.month, r.ret, m.mom, m.vol FROM ret_s r JOIN (SELECT a.key, a.midx,
  (SELECT CASE WHEN count(b.ret)=11 THEN exp(sum(ln(1+b.ret)))-1 END FROM ret_s b WHERE b.key=a.key AND b.midx BETWEEN a.midx-12 AND a.midx-2) AS mom,
  CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w*sqrt(12) END AS vol FROM ret_s a WINDOW w AS (PARTITION BY key ORDER BY midx ROWS 5 PRECEDING)) m USING (key, midx)),
 g AS (SELECT b.*, mom - (SELECT z.mom FROM b z WHERE z.key='S1' AND z.midx=b.midx) AS excess, CASE WHEN count(mom) OVER u >= 12 THEN (mom - avg(mom) OVER u)/nullif(stddev_samp(mom) OVER u,0) END AS z,
  vol <= CASE WHEN count(vol) OVER u >= 21 THEN quantile_cont(vol, 0.9) OVER u END AS vol_ok FROM b WINDOW u AS (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, z IS NOT NULL AND vol_ok IS NOT NULL AND coalesce((z>0 OR coalesce(excess,0)>0) AND vol_ok, false) AS raw_on FROM g),
 sig AS (SELECT *, bool_or(raw_on) OVER (PARTITION BY key ORDER BY midx ROWS 1 PRECEDING) AS is_on FROM o)"""


def rotation_signals(v, ret=None, bench="S1"):
    """Momentum against a benchmark, expanding z and volatility gate, hysteresis: one window pass per key."""
    w = W.by("key", order="midx")
    d = (ret or v.ret_s).select("*", W.momentum_gapless("ret", w).alias("mom"), W.trailing_vol("ret", w, 6, 12.0).alias("vol"))
    b = d.where(F.col("key") == bench).select("midx", F.col("mom").alias("mom_bench"))
    d = d.join(b, "midx", "left").withColumn("excess", F.col("mom") - F.col("mom_bench"))
    d = O.frame_quantile(d.withColumn("z", W.expanding_z("mom", w)), ["key"], "midx", "vol", {"vol_top": 0.9}, min_periods=21)
    d = d.withColumn("vol_ok", F.col("vol") <= F.col("vol_top")).drop("vol_top")
    from panelspark.functions.scalar import raw_on
    return d.withColumn("raw_on", raw_on("z", "excess", "vol_ok")).withColumn("is_on", W.hysteresis("raw_on", w, 2))


@query("b03_rotation_signals", "key month:d mom:f excess:f z:f vol_ok:b raw_on:b is_on:b", f"WITH {ROT} SELECT * FROM sig")
def b03(v):
    v.shared("ret_s")
    return rotation_signals(v)


@query("f12_raw_on_rules", "key midx:i plain:b gated:b", f"WITH {ROT} SELECT key, midx, coalesce(excess>0, false) AS plain, raw_on AS gated FROM sig")
def f12(v):
    from panelspark.functions.scalar import raw_on
    v.shared("ret_s")  # the benchmark is compared with itself: both sides must be the same numbers
    return rotation_signals(v).select("key", "midx", raw_on("z", "excess", "vol_ok", use_vol_gate=False).alias("plain"), raw_on("z", "excess", "vol_ok").alias("gated"))


@query("b04_rotation_on_off", "is_on:b mean:f hit:f n:i", f"""WITH {ROT}, l AS (SELECT s.is_on, n.ret-b.ret AS x FROM sig s JOIN ret_s n ON n.key=s.key AND n.midx=s.midx+1 JOIN ret_s b ON b.key='S1' AND b.midx=s.midx+1 WHERE s.excess IS NOT NULL)
SELECT is_on, avg(x) AS mean, avg(CASE WHEN x>0 THEN 1.0 ELSE 0.0 END) AS hit, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY is_on""")
def b04(v):
    v.shared("ret_s")
    # months without the key's or the benchmark's momentum have no signal, neither ON nor OFF
    d = C.next_period(rotation_signals(v), ["key"], "midx", "ret", "nxt").where("excess is not null")
    b = v.ret_s.where("key = 'S1'").select((F.col("midx") - 1).alias("midx"), F.col("ret").alias("bench"))
    d = d.join(b, "midx").withColumn("x", F.col("nxt") - F.col("bench")).where("x is not null")
    return d.groupBy("is_on").agg(F.avg("x").alias("mean"), F.avg((F.col("x") > 0).cast("double")).alias("hit"), F.count("*").alias("n"))


ROTW = """sl AS (SELECT midx, key, CASE WHEN is_on THEN least(0.10, 0.15) ELSE 0.0 END AS w0 FROM sig JOIN uni_s USING (key) WHERE category='C2' AND key<>'S1'),
 st AS (SELECT *, sum(w0) OVER (PARTITION BY midx) AS t FROM sl), sw AS (SELECT midx, key, CASE WHEN t>0.25+1e-12 THEN w0*0.25/t ELSE w0 END AS weight FROM st)"""


def rotated_book(v):
    """Core sleeve trimmed to fund the ON names of one category; OFF names stay as zero rows."""
    d = rotation_signals(v).join(v.uni_s.where("category = 'C2'").select("key"), "key").where("key <> 'S1'")
    sleeve = L.sleeve_caps(d.select("midx", "key", F.when(F.col("is_on"), 0.10).otherwise(0.0).alias("weight")), ["midx"])
    return L.fund_by_core_trim(L.static_mix(d.select("midx").distinct(), {"S1": 0.7, "S6": 0.3}), sleeve, ["midx"])


ROTB = f"""{ROTW}, ss AS (SELECT midx, sum(weight) AS t FROM sw GROUP BY midx), bk AS (SELECT midx, key, sum(weight) AS weight FROM (SELECT midx, key, weight FROM sw UNION ALL SELECT midx, k, w*(1-t) FROM ss, (VALUES ('S1',0.7),('S6',0.3)) c(k,w)) GROUP BY ALL)"""


@query("l10_rotation_portfolio", "midx:i key weight:8", f"WITH {ROT}, {ROTB} SELECT * FROM bk")
def l10(v):
    v.shared("ret_s")
    return rotated_book(v)


@query("b04_rotation_returns", "midx:i gross:f turnover:f net:f", f"""WITH {ROT}, {ROTB}, gr AS (SELECT b.midx, CASE WHEN count(*)=count(n.ret) THEN sum(b.weight*n.ret) END AS gross FROM bk b LEFT JOIN ret_s n ON n.key=b.key AND n.midx=b.midx+1 WHERE weight<>0 GROUP BY 1),
 c AS (SELECT coalesce(a.midx, p.midx+1) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(p.weight,0))) AS turnover FROM bk a FULL JOIN (SELECT * FROM bk WHERE midx<(SELECT max(midx) FROM bk)) p ON a.key=p.key AND a.midx=p.midx+1 GROUP BY 1)
SELECT midx, gross, turnover, gross-turnover*5/10000 AS net FROM gr JOIN c USING (midx)""")
def b04r(v):
    v.shared("ret_s")
    w = rotated_book(v).withColumn("book", F.lit("rotation"))
    g = L.book_returns(w, v.ret_s, ["book"], "midx")
    return g.join(L.turnover(w, ["book"], "midx"), ["book", "midx"]).withColumn("net", F.col("gross") - F.col("cost"))


@query("f11_gates", "midx:i g:f binding:b g_tail:f scalar:f", """WITH p AS (SELECT a.midx, a.key AS k1, b.key AS k2, a.ret AS x, b.ret AS y FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
 c AS (SELECT midx, avg(abs(corr)) AS c FROM (SELECT midx, CASE WHEN count(*) OVER w >= 3 THEN covar_samp(x,y) OVER w/nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END AS corr FROM p WINDOW w AS (PARTITION BY k1,k2 ORDER BY midx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY midx),
 m AS (SELECT midx, CASE WHEN count(r) OVER w=12 THEN stddev_samp(r) OVER w END AS z FROM (SELECT midx, avg(ret) AS r FROM ret_b GROUP BY 1) WINDOW w AS (ORDER BY midx ROWS 11 PRECEDING)),
 d AS (SELECT midx, c, z, quantile_cont(c,0.5) OVER w AS cm, quantile_cont(z,0.5) OVER w AS zm FROM c JOIN m USING (midx) WINDOW w AS (ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT midx, CASE WHEN coalesce(c>cm AND z>zm, false) THEN 0.5 ELSE 1 END AS g, coalesce(c>cm AND z>zm, false) AS binding, CASE WHEN coalesce(z>zm,false) THEN 0.25 ELSE 1 END AS g_tail, CASE WHEN c>0.3 THEN greatest(0.5, 1-(c-0.3)) ELSE 1 END AS scalar FROM d""")
def f11(v):
    from panelspark.functions.scalar import correlation_gate, tail_gate
    c = P.mean_abs_corr(P.rolling_pair_corr(P.pair_returns(v.ret_b, []), [], 12), ["midx"])
    w = Window.orderBy("midx")  # one row per month
    m = v.ret_b.groupBy("midx").agg(F.avg("ret").alias("r")).withColumn("z", W.trailing_vol("r", w, 12, 1.0))
    d = O.frame_quantile(c.join(m, "midx"), [], "midx", "mean_abs_corr", {"cm": 0.5})
    d = O.frame_quantile(d, [], "midx", "z", {"zm": 0.5})
    return d.select("midx", correlation_gate("mean_abs_corr", "z", "cm", "zm", F.lit(0.5)).alias("c"), tail_gate("z", "zm", F.lit(0.25)).alias("t"),
                    breakdown_scalar("mean_abs_corr", F.lit(0.3)).alias("scalar")).select("midx", "c.g", "c.binding", F.col("t.g").alias("g_tail"), "scalar")
