"""Verification queries: aggregates, cross-section scores, sorts and limits."""
from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.functions.scalar import SQRT12, ratio
from panelspark.functions.stats import ann_return, ann_vol, safe_corr, sharpe_excess, sharpe_rf0, total_return
from panelspark.operators import calendar as C, panel as P, scores as S, windows as W


def km():
    return W.by("key", order="midx")


@query("a01_month_end_price", "key month:d log_price:f", "SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, ln(arg_max(price, date)) AS log_price FROM px_d WHERE price IS NOT NULL GROUP BY ALL")
def a01(v):
    return C.month_end_values(v.px_d, ["key"], "date", ["price"]).withColumn("log_price", F.ln("price"))


@query("a02_month_end_date", "month:d date:d", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date FROM px_d GROUP BY 1")
def a02(v):
    return C.month_end_dates(v.px_d, "date")


@query("a03_history_years", "key years:f", "SELECT key, date_diff('day', min(month), max(month))/365.25 AS years FROM px_s WHERE price IS NOT NULL GROUP BY key")
def a03(v):
    return v.px_s.where("price is not null").groupBy("key").agg((F.datediff(F.max("month"), F.min("month")) / 365.25).alias("years"))


FEATS = """r AS (SELECT key, date, price, volume, price/lag(price) OVER (PARTITION BY key ORDER BY date) - 1 AS ret FROM px_d),
 j AS (SELECT r.*, r.ret-b.ret AS ex, price*volume AS pv, row_number() OVER (PARTITION BY r.key ORDER BY r.date) AS rn FROM r LEFT JOIN (SELECT date, ret FROM r WHERE key='ECONOMY') b USING (date)),
 p AS (SELECT t.key, t.rn, u.price/max(u.price) OVER (PARTITION BY t.key, t.rn ORDER BY u.rn) - 1 AS f FROM j t JOIN j u ON u.key=t.key AND u.rn BETWEEN t.rn-251 AND t.rn WHERE t.rn = (SELECT max(rn) FROM j z WHERE z.key=t.key)),
 m AS (SELECT key, rn, CASE WHEN count(*)>=2 THEN min(f) END AS maxdd_252 FROM p GROUP BY ALL),
 f AS (SELECT key, date, rn, CASE WHEN count(ret) OVER q >= 2 THEN stddev_samp(ret) OVER q * sqrt(252) END AS vol_63, CASE WHEN count(ret) OVER y >= 2 THEN stddev_samp(ret) OVER y * sqrt(252) END AS vol_252,
  CASE WHEN count(ex) OVER y >= 3 THEN avg(ex) OVER y / nullif(stddev_samp(ex) OVER y, 0) * sqrt(252) END AS quality_v1, avg(pv) OVER o AS liquidity_adv, date_diff('day', min(date) OVER (PARTITION BY key), date)/365.25 AS history_years
  FROM j WINDOW q AS (PARTITION BY key ORDER BY date ROWS 62 PRECEDING), y AS (PARTITION BY key ORDER BY date ROWS 251 PRECEDING), o AS (PARTITION BY key ORDER BY date ROWS 20 PRECEDING))"""


@query("a04_feature_panel", "key vol_63:f vol_252:f maxdd_252:f quality_v1:f liquidity_adv:f history_years:f mom12_1:f",
       f"""WITH {FEATS}, me AS (SELECT key, month, price, row_number() OVER (PARTITION BY key ORDER BY month) AS n FROM (SELECT key, date_trunc('month', date) AS month, arg_max(price, date) AS price FROM px_d GROUP BY ALL)),
 mo AS (SELECT key, CASE WHEN n>=13 THEN lag(price,1) OVER w/lag(price,12) OVER w - 1 END AS mom12_1, n FROM me WINDOW w AS (PARTITION BY key ORDER BY n))
SELECT f.key, vol_63, vol_252, maxdd_252, quality_v1, liquidity_adv, history_years, mom12_1 FROM f JOIN m USING (key, rn) JOIN mo ON mo.key=f.key AND mo.n=(SELECT max(n) FROM me WHERE me.key=f.key)""")
def a04(v):
    v.shared("px_d")
    bench = v.ret_d.where("key = 'ECONOMY'").select("date", F.col("ret").alias("bench"))
    feats = S.raw_features(v.px_d, "date", bench)
    last = feats.groupBy("key").agg(F.max_by(F.struct("vol_63", "vol_252", "maxdd_252", "quality_v1", "liquidity_adv", "history_years"), "date").alias("f")).select("key", "f.*")
    me = C.month_end_values(v.px_d, ["key"], "date", ["price"]).withColumn("m", W.momentum_observed("price", W.by("key", order="month")))
    return last.join(me.groupBy("key").agg(F.max_by("m", "month").alias("mom12_1")), "key")


@query("a04_benchmark_choice", "requested benchmark_used date:d bench:f", """SELECT 'ECONOMY' AS requested, key AS benchmark_used, date, ret AS bench FROM ret_d WHERE key='ECONOMY' UNION ALL SELECT 'ABSENT', key, date, ret FROM ret_d WHERE key='LARGE'""")
def a04b(v):
    """The wanted benchmark, and one that is not in the panel with its fallback."""
    v.shared("ret_d")
    out = None
    for first in ("ECONOMY", "ABSENT"):
        b = S.choose_benchmark(v.ret_d, first, "LARGE").withColumn("requested", F.lit(first))
        out = b if out is None else out.unionByName(b)
    return out


@query("a05_quality_ir", "key month:d quality:f er_missing:b", """WITH x AS (SELECT a.key, a.month, a.midx, a.ret-b.ret AS ex, CASE WHEN num%4<>0 THEN (num%10)/1000.0 END AS er FROM ret_s a JOIN uni_s USING (key) LEFT JOIN (SELECT midx, ret FROM ret_s WHERE key='S1') b USING (midx))
SELECT key, month, CASE WHEN count(ex) OVER w >= 3 THEN avg(ex) OVER w/nullif(stddev_samp(ex) OVER w, 0)*sqrt(12) END - coalesce(er,0) AS quality, er IS NULL AS er_missing FROM x WINDOW w AS (PARTITION BY key ORDER BY midx ROWS 23 PRECEDING)""")
def a05(v):
    v.shared("ret_s")  # the benchmark is compared with itself: both sides must be the same numbers
    bench = v.ret_s.where("key = 'S1'").select("midx", F.col("ret").alias("b"))
    d = v.ret_s.join(v.uni_s.select("key", F.when(F.col("num") % 4 != 0, (F.col("num") % 10) / 1000.0).alias("er")), "key").join(bench, "midx", "left")
    d = d.withColumn("ex", F.col("ret") - F.col("b"))
    f = km().rowsBetween(-23, 0)
    ir = F.when(F.count("ex").over(f) >= 3, ratio(F.avg("ex").over(f), F.stddev_samp("ex").over(f)) * SQRT12)
    return d.select("key", "month", (ir - F.coalesce("er", F.lit(0.0))).alias("quality"), F.col("er").isNull().alias("er_missing"))


@query("a06_dollar_liquidity", "key date:d adv:f missing:b", """SELECT key, date, avg(price*volume) OVER (PARTITION BY key ORDER BY date ROWS 20 PRECEDING) AS adv, volume IS NULL AS missing FROM px_d WHERE price IS NOT NULL""")
def a06(v):
    return v.px_d.where("price is not null").select("key", "date", F.avg(F.col("price") * F.col("volume")).over(W.by("key", order="date").rowsBetween(-20, 0)).alias("adv"),
                                                    F.col("volume").isNull().alias("missing"))


_MED = """m AS (SELECT *, quantile_cont(x, 0.5) OVER g AS med, stddev_samp(x) OVER g AS sd FROM s WINDOW g AS (PARTITION BY midx, category)),
 d AS (SELECT *, quantile_cont(abs(x-med), 0.5) OVER (PARTITION BY midx, category) AS mad FROM m)"""
ZSQL = f"""WITH s AS (SELECT key, midx, category, round(ret, 1) AS x FROM ret_s JOIN uni_s USING (key)), {_MED}
SELECT key, midx, category, CASE WHEN mad>0 THEN (x-med)/(mad*1.4826) WHEN sd>0 THEN (x-med)/sd WHEN med IS NOT NULL THEN 0.0 END AS z_x FROM d"""


def _z(v, spread=False):
    s = v.ret_s.join(v.uni_s, "key").select("key", "midx", "category", F.round("ret", 1).alias("x"))
    return S.robust_z(s, ["midx", "category"], ["x"], spread=spread)


@query("a07_robust_z", "key midx:i category z_x:f", ZSQL)
def a07(v):
    v.shared("px_s")
    return _z(v)


@query("a07_robust_z_large_groups", "key midx:i category z_x:f", ZSQL)
def a07b(v):
    v.shared("px_s")
    return _z(v, True)


SC = f"""x AS (SELECT r.key, r.midx, r.month, category, CASE WHEN row_number() OVER w >= 13 THEN lag(price,1) OVER w/lag(price,12) OVER w - 1 END AS mom, CASE WHEN count(ret) OVER v >= 2 THEN -stddev_samp(ret) OVER v * sqrt(12) END AS nvol
 FROM ret_s r JOIN px_s USING (key, midx) JOIN uni_s u ON u.key=r.key WINDOW w AS (PARTITION BY r.key ORDER BY midx), v AS (PARTITION BY r.key ORDER BY midx ROWS 11 PRECEDING)),
 m AS (SELECT *, quantile_cont(mom, 0.5) OVER g AS m1, stddev_samp(mom) OVER g AS s1, quantile_cont(nvol, 0.5) OVER g AS m2, stddev_samp(nvol) OVER g AS s2 FROM x WINDOW g AS (PARTITION BY midx, category)),
 d AS (SELECT *, quantile_cont(abs(mom-m1), 0.5) OVER g AS d1, quantile_cont(abs(nvol-m2), 0.5) OVER g AS d2 FROM m WINDOW g AS (PARTITION BY midx, category)),
 sc AS (SELECT key, midx, month, category, round(0.6*coalesce(CASE WHEN d1>0 THEN (mom-m1)/(d1*1.4826) WHEN s1>0 THEN (mom-m1)/s1 WHEN m1 IS NOT NULL THEN 0.0 END, 0) + 0.4*coalesce(CASE WHEN d2>0 THEN (nvol-m2)/(d2*1.4826) WHEN s2>0 THEN (nvol-m2)/s2 WHEN m2 IS NOT NULL THEN 0.0 END, 0), 9) AS s, mom IS NOT NULL AS ready FROM d)"""


def monthly_scores(v, spread=False):
    """Two-feature robust-z score per (key, month)."""
    d = v.px_s.withColumn("ret", W.simple_return("price", km(), "midx"))
    d = d.withColumns({"mom": W.momentum_observed("price", km()), "nvol": -W.trailing_vol("ret", km(), 12, 12.0, min_periods=2)})
    d = d.join(v.uni_s.select("key", "category"), "key")
    z = S.robust_z(d, ["midx", "category"], ["mom", "nvol"], spread=spread)
    return z.select("key", "midx", "month", "category", "ret", F.round(S.composite({"mom": 0.6, "nvol": 0.4}), 9).alias("s"), F.col("mom").isNotNull().alias("ready"))


@query("a08_composite_score", "key month:d category s:f", f"WITH {SC} SELECT * FROM sc WHERE ready")
def a08(v):
    v.shared("px_s")
    return monthly_scores(v).where("ready")


@query("a09_category_sleeve", "category month:d ret:f n:i", """SELECT category, month, avg(ret) AS ret, count(ret) AS n FROM ret_s JOIN uni_s USING (key) WHERE category <> 'C4' AND NOT thin
 AND category IN (SELECT category FROM uni_s WHERE NOT thin GROUP BY category HAVING count(*) >= 2) GROUP BY ALL HAVING count(ret) > 0""")
def a09(v):
    u = v.uni_s.where("category <> 'C4' and not thin")
    enough = u.groupBy("category").agg(F.count("*").alias("n")).where("n >= 2").select("category")
    d = v.ret_s.join(u.join(enough, "category").select("key", "category"), "key")
    return d.groupBy("category", "month").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n")).where("n > 0")


@query("a10_sleeve_prior_membership", "category month:d ret:f n:i", """SELECT category, month, avg(ret) AS ret, count(ret) AS n FROM (SELECT *, count(ret) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ret_s)
 JOIN uni_s USING (key) WHERE prior >= 12 GROUP BY ALL""")
def a10(v):
    d = v.ret_s.withColumn("prior", F.count("ret").over(km().rowsBetween(W.UNB, -1))).where("prior >= 12")
    return d.join(v.uni_s, "key").groupBy("category", "month").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))


@query("a11_sleeve_metadata", "category key n_names:i n_thin:i thin_sleeve:b", """SELECT category, key, count(*) OVER c AS n_names, count(*) FILTER (thin) OVER c AS n_thin, count(*) FILTER (thin) OVER c >= greatest(1, count(*) OVER c//2) AS thin_sleeve FROM uni_b WINDOW c AS (PARTITION BY category)""")
def a11(v):
    """One row a member, with its sleeve's counts; no row holds a whole sleeve."""
    g = v.uni_b.groupBy("category").agg(F.count("*").alias("n_names"), F.count_if("thin").alias("n_thin"))
    g = g.withColumn("thin_sleeve", F.col("n_thin") >= F.greatest(F.lit(1), F.floor(F.col("n_names") / 2)))
    return v.uni_b.select("category", "key").join(g, "category")


@query("a12_fixed_mix_return", "date:d ret:f legs:i", """SELECT date, CASE WHEN count(ret)=3 THEN sum(w*ret) END AS ret, count(ret) AS legs FROM ret_d JOIN (VALUES ('ECONOMY',0.7),('LARGE',0.2),('SMALL',0.1)) m(key,w) USING (key) GROUP BY date""")
def a12(v):
    mix = F.create_map(*[x for k, w in (("ECONOMY", 0.7), ("LARGE", 0.2), ("SMALL", 0.1)) for x in (F.lit(k), F.lit(w))])
    d = v.ret_d.where(F.col("key").isin("ECONOMY", "LARGE", "SMALL")).withColumn("w", F.element_at(mix, F.col("key")))
    return d.groupBy("date").agg(F.when(F.count("ret") == 3, F.sum(F.col("w") * F.col("ret"))).alias("ret"), F.count("ret").alias("legs"))


@query("a13_performance", "trial_id n:i total:f cagr:f vol:f sharpe:f", """SELECT trial_id, count(*) AS n, exp(sum(ln(1+ret)))-1 AS total, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, stddev_samp(ret)*sqrt(12) AS vol,
 (pow(exp(sum(ln(1+ret))), 12.0/count(*))-1)/(stddev_samp(ret)*sqrt(12)) AS sharpe FROM trial_ret GROUP BY trial_id""")
def a13(v):
    return v.trial_ret.groupBy("trial_id").agg(F.count("*").alias("n"), total_return("ret").alias("total"), ann_return("ret").alias("cagr"),
                                               ann_vol("ret").alias("vol"), sharpe_rf0("ret").alias("sharpe"))


@query("a14_excess_sharpe", "trial_id sharpe:f", "SELECT trial_id, avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS sharpe FROM trial_ret JOIN rates USING (month) GROUP BY trial_id")
def a14(v):
    d = P.attach_rate(v.trial_ret, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    return d.groupBy("trial_id").agg(sharpe_excess("ex").alias("sharpe"))


@query("a15_coverage_profile", "key start:d end_month:d n_obs:i years:f thin:b", """SELECT key, min(month) AS start, max(month) AS end_month, count(price) AS n_obs, date_diff('day', min(month), max(month))/365.25 AS years,
 date_diff('day', min(month), max(month))/365.25 < 6.5 OR count(price) < 82 AS thin FROM px_s GROUP BY key""")
def a15(v):
    g = v.px_s.groupBy("key").agg(F.min("month").alias("start"), F.max("month").alias("end_month"), F.count("price").alias("n_obs"))
    g = g.withColumn("years", F.datediff("end_month", "start") / 365.25)
    return g.withColumn("thin", (F.col("years") < 6.5) | (F.col("n_obs") < 82))


@query("a16_mean_pair_corr", "mean_abs_corr:f mean_corr:f pairs:i", """SELECT avg(abs(c)) AS mean_abs_corr, avg(c) AS mean_corr, count(c) AS pairs FROM (SELECT corr(a.ret, b.ret) AS c FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<b.key
 WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.key, b.key)""")
def a16(v):
    c = P.pair_returns(v.ret_b, []).groupBy("k1", "k2").agg(safe_corr("x", "y").alias("corr"))
    return P.mean_abs_corr(c, [])


@query("a17_sync_score", "category sync:f", """WITH m AS (SELECT category, midx, ret, avg(ret) OVER (PARTITION BY category, midx) AS m FROM ret_s JOIN uni_s USING (key) WHERE ret IS NOT NULL)
SELECT category, avg(s) AS sync FROM (SELECT category, midx, avg(CASE WHEN ret*m>0 THEN 1.0 ELSE 0.0 END) AS s FROM m GROUP BY ALL) GROUP BY category""")
def a17(v):
    d = v.ret_s.where("ret is not null").join(v.uni_s, "key")
    mean = d.groupBy("category", "midx").agg(F.avg("ret").alias("m"))
    per = d.join(mean, ["category", "midx"]).groupBy("category", "midx").agg(F.avg((F.col("ret") * F.col("m") > 0).cast("double")).alias("s"))
    return per.groupBy("category").agg(F.avg("s").alias("sync"))


@query("a23_state_table", "key state:b mean:f hit:f n:i", """WITH a AS (SELECT key, midx, coalesce(ret > 0.02, false) AS state FROM ret_s) SELECT a.key, state, avg(n.ret) AS mean, avg(CASE WHEN n.ret>0 THEN 1.0 WHEN n.ret<=0 THEN 0.0 END) AS hit, count(n.ret) AS n
FROM a JOIN ret_s n ON n.key=a.key AND n.midx=a.midx+1 WHERE n.ret IS NOT NULL GROUP BY ALL""")
def a23(v):
    d = C.next_period(v.ret_s, ["key"], "midx", "ret", "nxt").withColumn("state", F.coalesce(F.col("ret") > 0.02, F.lit(False))).where("nxt is not null")
    return d.groupBy("key", "state").agg(F.avg("nxt").alias("mean"), F.avg((F.col("nxt") > 0).cast("double")).alias("hit"), F.count("*").alias("n"))


TRANS = """s AS (SELECT key, midx, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS st FROM ret_s WHERE ret IS NOT NULL), t AS (SELECT key, st AS a, lead(st) OVER (PARTITION BY key ORDER BY midx) AS b FROM s)"""


def transitions(v):
    s = v.ret_s.where("ret is not null").withColumn("st", (F.col("ret") > 0).cast("int"))
    return s.withColumn("nxt", F.lead("st").over(km())).where("nxt is not null").groupBy("key", F.col("st").alias("a"), F.col("nxt").alias("b")).agg(F.count("*").alias("n"))


@query("a24_transitions", "key a:i b:i n:i p:f", f"WITH {TRANS} SELECT key, a, b, count(*) AS n, count(*)*1.0/sum(count(*)) OVER (PARTITION BY key, a) AS p FROM t WHERE b IS NOT NULL GROUP BY key, a, b")
def a24(v):
    return transitions(v).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("key", "a")))


@query("a25_state_frequency", "key st:i pi:f", """WITH s AS (SELECT key, greatest(1e-6, avg(CASE WHEN ret>0 THEN 1.0 ELSE 0.0 END)) AS p1, greatest(1e-6, avg(CASE WHEN ret>0 THEN 0.0 ELSE 1.0 END)) AS p0 FROM ret_s WHERE ret IS NOT NULL GROUP BY key)
SELECT key, 0 AS st, p0/(p0+p1) AS pi FROM s UNION ALL SELECT key, 1, p1/(p0+p1) FROM s""")
def a25(v):
    g = v.ret_s.where("ret is not null").groupBy("key").agg(F.avg((F.col("ret") > 0).cast("double")).alias("p"))
    g = g.select("key", F.inline(F.array(F.struct(F.lit(0).alias("st"), F.greatest(F.lit(1e-6), 1 - F.col("p")).alias("q")), F.struct(F.lit(1).alias("st"), F.greatest(F.lit(1e-6), F.col("p")).alias("q")))))
    return g.withColumn("pi", F.col("q") / F.sum("q").over(Window.partitionBy("key")))


@query("a26_calendar_years", "trial_id year:i months:i subject:f core:f partial:b", """SELECT trial_id, year(month) AS year, count(*) AS months, exp(sum(ln(1+t.ret)))-1 AS subject, exp(sum(ln(1+s.ret)))-1 AS core, count(*)<12 AS partial
FROM trial_ret t JOIN series s USING (month) WHERE s.series_id='AUTOMOBILE' GROUP BY ALL""")
def a26(v):
    core = v.series.where("series_id = 'AUTOMOBILE'").select("month", F.col("ret").alias("c"))
    return v.trial_ret.join(core, "month").groupBy("trial_id", F.year("month").alias("year")).agg(
        F.count("*").alias("months"), total_return("ret").alias("subject"), total_return("c").alias("core"), (F.count("*") < 12).alias("partial"))


@query("a27_period_block", "series_id block k:i total:f vol:f sharpe:f", """WITH b AS (SELECT month, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS block FROM series WHERE series_id='AUTOMOBILE')
SELECT series_id, block, count(*) AS k, exp(sum(ln(1+ret)))-1 AS total, stddev_samp(ret)*sqrt(12) AS vol, CASE WHEN count(*)>=12 THEN avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) END AS sharpe FROM series JOIN b USING (month) JOIN rates USING (month) GROUP BY ALL""")
def a27(v):
    blocks = v.series.where("series_id = 'AUTOMOBILE'").select("month", F.when(F.col("ret") > 0, "up").otherwise("down").alias("block"))
    d = P.attach_rate(v.series.join(blocks, "month"), v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    return d.groupBy("series_id", "block").agg(F.count("*").alias("k"), total_return("ret").alias("total"), ann_vol("ret").alias("vol"),
                                               F.when(F.count("*") >= 12, sharpe_excess("ex")).alias("sharpe"))


@query("a28_win_counts", "segment n:i wins:i losses:i", """WITH m AS (SELECT trial_id, split_part(trial_id,'_R',1) AS segment, avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS sr FROM trial_ret JOIN rates USING (month) GROUP BY 1),
a AS (SELECT series_id AS segment, avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS nul FROM series JOIN rates USING (month) GROUP BY 1)
SELECT segment, count(*) AS n, count(*) FILTER (sr > nul) AS wins, count(*) FILTER (sr <= nul) AS losses FROM m JOIN a USING (segment) GROUP BY segment""")
def a28(v):
    m = a14(v).withColumn("segment", F.split("trial_id", "_R")[0])
    d = P.attach_rate(v.series, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    nul = d.groupBy(F.col("series_id").alias("segment")).agg(sharpe_excess("ex").alias("nul"))
    return m.join(nul, "segment").groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("sharpe") > F.col("nul")).alias("wins"), F.count_if(F.col("sharpe") <= F.col("nul")).alias("losses"))


@query("a29_cross_trial_variance", "var_monthly:8 n:i", "SELECT var_samp(sr/sqrt(12)) AS var_monthly, count(*) AS n FROM (SELECT avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS sr FROM trial_ret JOIN rates USING (month) GROUP BY trial_id)")
def a29(v):
    return a14(v).agg(F.var_samp(F.col("sharpe") / SQRT12).alias("var_monthly"), F.count("sharpe").alias("n"))


@query("a30_status_counts", "status n:i names", """SELECT o_orderstatus AS status, count(*) AS n, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1""")
def a30(v):
    return v.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("names"))


@query("a31_moments", "trial_id n:i mean:f sd:f pearson:f spearman:f", """WITH p AS (SELECT trial_id, t.ret AS x, s.ret AS y FROM trial_ret t JOIN series s USING (month) WHERE series_id='MACHINERY'),
r AS (SELECT *, rank() OVER (PARTITION BY trial_id ORDER BY x) + (count(*) OVER (PARTITION BY trial_id, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY trial_id ORDER BY y) + (count(*) OVER (PARTITION BY trial_id, y)-1)/2.0 AS ry FROM p)
SELECT trial_id, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, corr(x,y) AS pearson, corr(rx,ry) AS spearman FROM r GROUP BY trial_id""")
def a31(v):
    other = v.series.where("series_id = 'MACHINERY'").select("month", F.col("ret").alias("y"))
    d = v.trial_ret.join(other, "month").select("trial_id", F.col("ret").alias("x"), "y")
    d = d.select("*", W.average_rank("x", ["trial_id"]).alias("rx"), W.average_rank("y", ["trial_id"]).alias("ry"))
    return d.groupBy("trial_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))


@query("a32_distribution", "key bin:i n:i lo:f", """WITH r AS (SELECT key, ret, min(ret) OVER (PARTITION BY key) AS mn, (max(ret) OVER (PARTITION BY key)-min(ret) OVER (PARTITION BY key))/40 AS w FROM ret_d WHERE ret IS NOT NULL)
SELECT key, least(39, floor((ret-mn)/w)) AS bin, count(*) AS n, any_value(mn)+least(39, floor((ret-mn)/w))*any_value(w) AS lo FROM r GROUP BY key, bin""")
def a32(v):
    d = v.ret_d.where("ret is not null")
    span = d.groupBy("key").agg(F.min("ret").alias("mn"), ((F.max("ret") - F.min("ret")) / 40).alias("w"))
    d = d.join(span, "key").withColumn("bin", F.least(F.lit(39), F.floor((F.col("ret") - F.col("mn")) / F.col("w"))))
    return d.groupBy("key", "bin").agg(F.count("*").alias("n"), F.first(F.col("mn") + F.col("bin") * F.col("w")).alias("lo"))


@query("a32_qq_and_shape", "key p:f q:f skew:f kurt:f negative:f", """WITH s AS (SELECT key, avg(ret) AS m, stddev_samp(ret) AS sd, avg(pow(ret,2)) AS m2, avg(pow(ret,3)) AS m3, avg(pow(ret,4)) AS m4, avg(CASE WHEN ret<0 THEN 1.0 ELSE 0.0 END) AS negative,
 quantile_cont(ret, [(i+0.5)/101 FOR i IN range(101)]) AS qs FROM ret_d WHERE ret IS NOT NULL GROUP BY key),
u AS (SELECT key, unnest(range(101)) AS i, unnest(qs) AS x, m, sd, m2-m*m AS v, m3-3*m*m2+2*m*m*m AS c3, m4-4*m*m3+6*m*m*m2-3*m*m*m*m AS c4, negative FROM s)
SELECT key, (i+0.5)/101 AS p, (x-m)/sd AS q, c3/pow(v,1.5) AS skew, c4/(v*v)-3 AS kurt, negative FROM u""")
def a32b(v):
    ps = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: (i + 0.5) / 101)
    d = v.ret_d.where("ret is not null").groupBy("key").agg(
        F.percentile("ret", F.array(*[F.lit((i + 0.5) / 101) for i in range(101)])).alias("qs"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"),
        F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"), F.avg((F.col("ret") < 0).cast("double")).alias("negative"))
    return d.select("key", "m", "sd", "skew", "kurt", "negative", F.inline(F.arrays_zip(ps.alias("p"), F.col("qs").alias("x")))).withColumn("q", (F.col("x") - F.col("m")) / F.col("sd"))


@query("a33_monthly_compounding", "key month:d ret:f", """WITH e AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(price, date) AS p FROM px_d GROUP BY ALL),
l AS (SELECT *, lag(p) OVER w AS q, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY month))
SELECT key, month, p/q-1 AS ret FROM l WHERE i > 1 AND i < n""")
def a33(v):
    e = C.month_end_values(v.px_d, ["key"], "date", ["price"])
    w = W.by("key", order="month")
    d = e.withColumns({"q": F.lag("price").over(w), "last": F.lead("price").over(w).isNull()})
    return d.where("q is not null and not last").select("key", "month", (F.col("price") / F.col("q") - 1.0).alias("ret"))


@query("a34_beta", "trial_id beta:f corr:f n:i", "SELECT trial_id, regr_slope(t.ret, s.ret) AS beta, corr(t.ret, s.ret) AS corr, count(*) AS n FROM trial_ret t JOIN series s USING (month) WHERE series_id='AUTOMOBILE' GROUP BY trial_id")
def a34(v):
    core = v.series.where("series_id = 'AUTOMOBILE'").select("month", F.col("ret").alias("c"))
    return v.trial_ret.join(core, "month").groupBy("trial_id").agg(F.regr_slope("ret", "c").alias("beta"), safe_corr("ret", "c").alias("corr"), F.count("*").alias("n"))


@query("a35_split_log_summary", "flag n:i share_flagged:f weighted_ratio:f", "SELECT l_returnflag AS flag, count(*) AS n, avg(CASE WHEN l_discount>0.05 THEN 1.0 ELSE 0.0 END) AS share_flagged, sum(l_quantity*l_discount)/sum(l_quantity) AS weighted_ratio FROM lineitem GROUP BY 1")
def a35(v):
    return v.table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("share_flagged"),
                                                                               ratio(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity")).alias("weighted_ratio"))


# ------------------------------------------------------------------ sorts and limits
@query("t01_global_rank", "key rank:i s:f", "SELECT key, row_number() OVER (ORDER BY s DESC NULLS LAST, key) AS rank, s FROM (SELECT s_suppkey AS n, 'S'||CAST(s_suppkey AS VARCHAR) AS key, round(s_acctbal/1000) AS s FROM supplier)")
def t01(v):
    d = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), F.round(F.col("s_acctbal") / 1000).alias("s"))
    return S.global_rank(d, "s", "key")


@query("t03_stress_months", "category month:d vol:f", """WITH m AS (SELECT category, month, midx, avg(ret) AS r FROM ret_s JOIN uni_s USING (key) GROUP BY ALL), a AS (SELECT *, CASE WHEN count(r) OVER w >= 3 THEN stddev_samp(r) OVER w*sqrt(12) END AS vol FROM m WINDOW w AS (PARTITION BY category ORDER BY midx ROWS 11 PRECEDING))
SELECT category, month, vol FROM a WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY vol DESC, month) <= 12""")
def t03(v):
    m = v.ret_s.join(v.uni_s, "key").groupBy("category", "month", "midx").agg(F.avg("ret").alias("r"))
    m = m.withColumn("vol", W.trailing_vol("r", W.by("category", order="midx"), 12, 12.0, min_periods=3)).where("vol is not null")
    return m.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("vol"), "month"))).where("k <= 12")


@query("t05_most_complete", "category key n:i", "SELECT category, key, n FROM (SELECT category, key, count(ret) AS n FROM ret_s JOIN uni_s USING (key) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, key) <= 3")
def t05(v):
    d = v.ret_s.groupBy("key").agg(F.count("ret").alias("n")).join(v.uni_s, "key")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "key"))).where("k <= 3")


@query("t07_catalogue_sort", "key pos:i", "SELECT key, row_number() OVER (ORDER BY bal DESC NULLS LAST, key) AS pos FROM (SELECT 'S'||CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey%6<>0 THEN s_acctbal END AS bal FROM supplier)")
def t07(v):
    d = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("bal"))
    return S.global_rank(d, "bal", "key", "pos")


@query("t08_preferred_order", "strategy pos:i n:i", "SELECT c_mktsegment AS strategy, list_position(['MACHINERY','BUILDING','FURNITURE'], c_mktsegment) AS pos, count(*) AS n FROM customer GROUP BY 1,2")
def t08(v):
    order = F.array(F.lit("MACHINERY"), F.lit("BUILDING"), F.lit("FURNITURE"))
    return v.table("customer").groupBy(F.col("c_mktsegment").alias("strategy")).agg(F.count("*").alias("n")).withColumn("pos", F.nullif(F.array_position(order, F.col("strategy")), F.lit(0))).orderBy(F.col("pos").asc_nulls_last())


@query("t09_latest_row", "strategy key weight:8 month:d", "SELECT strategy, key, arg_max(weight, month) AS weight, max(month) AS month FROM weights GROUP BY ALL")
def t09(v):
    return v.weights.groupBy("strategy", "key").agg(F.max_by("weight", "month").alias("weight"), F.max("month").alias("month"))


@query("t10_best_worst", "trial_id best:d worst:d hi:f lo:f", "SELECT trial_id, arg_max(month, ret) AS best, arg_min(month, ret) AS worst, max(ret) AS hi, min(ret) AS lo FROM trial_ret GROUP BY 1")
def t10(v):
    return v.trial_ret.groupBy("trial_id").agg(F.max_by("month", "ret").alias("best"), F.min_by("month", "ret").alias("worst"), F.max("ret").alias("hi"), F.min("ret").alias("lo"))


# ------------------------------------------------------------------ set operations
@query("u01_union_superset", "id month:d ret:f source", "SELECT series_id AS id, month, ret, NULL AS source FROM series UNION ALL SELECT 'rate', month, rate, source FROM rates")
def u01(v):
    a = v.series.select(F.col("series_id").alias("id"), "month", "ret")
    b = v.rates.select(F.lit("rate").alias("id"), "month", F.col("rate").alias("ret"), "source")
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_rate_splice", "month:d rate:f source", """WITH own AS (SELECT month, ret AS rate FROM series WHERE series_id='BUILDING' AND month >= DATE '1998-03-01'), f AS (SELECT min(month) AS b FROM own)
SELECT month, rate, 'fallback' AS source FROM rates, f WHERE month < b UNION ALL SELECT month, rate, 'own' FROM own""")
def u02(v):
    own = v.series.where("series_id = 'BUILDING' and month >= '1998-03-01'").select("month", F.col("ret").alias("rate"))
    first = own.agg(F.min("month")).scalar()
    return v.rates.where(F.col("month") < first).select("month", "rate", F.lit("fallback").alias("source")).unionByName(own.withColumn("source", F.lit("own")))


@query("u03_key_sets", "op n:i", """SELECT 'except' AS op, count(*) AS n FROM (SELECT key FROM uni_s EXCEPT SELECT key FROM deny_s) UNION ALL SELECT 'intersect', count(*) FROM (SELECT key FROM px_s INTERSECT SELECT key FROM uni_s WHERE cash_like)
 UNION ALL SELECT 'union', count(*) FROM (SELECT key FROM uni_s WHERE cash_like UNION SELECT key FROM uni_s WHERE num%2=0)""")
def u03(v):
    k = v.uni_s.select("key")
    cash = v.uni_s.where("cash_like").select("key")
    sets = {"except": k.exceptAll(v.deny_s), "intersect": v.px_s.select("key").intersect(cash), "union": cash.union(v.uni_s.where("num % 2 = 0").select("key")).distinct()}
    out = None
    for name, d in sets.items():
        d = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("u04_calendar_intersection", "month:d", "SELECT month FROM trial_ret GROUP BY month HAVING count(DISTINCT trial_id)=(SELECT count(DISTINCT trial_id) FROM trial_ret)")
def u04(v):
    return P.common_periods(v.trial_ret, "trial_id", "month").select("month").distinct()


@query("u05_reference_rows", "id month:d ret:f", "SELECT trial_id AS id, month, ret FROM trial_ret UNION ALL SELECT 'reference', month, avg(ret) FROM series GROUP BY month")
def u05(v):
    ref = v.series.groupBy("month").agg(F.avg("ret").alias("ret")).withColumn("id", F.lit("reference"))
    return v.trial_ret.select(F.col("trial_id").alias("id"), "month", "ret").unionByName(ref.select("id", "month", "ret"))


# ------------------------------------------------------------------ cross-section statistics
IC = f"""{SC}, l AS (SELECT a.key, a.midx, n.ret - b.ret AS label FROM ret_s a JOIN ret_s n ON n.key=a.key AND n.midx=a.midx+1 JOIN ret_s b ON b.key='S1' AND b.midx=a.midx+1),
 c AS (SELECT sc.midx, month, rank() OVER (PARTITION BY sc.midx ORDER BY s) + (count(*) OVER (PARTITION BY sc.midx, s)-1)/2.0 AS a, rank() OVER (PARTITION BY sc.midx ORDER BY label) + (count(*) OVER (PARTITION BY sc.midx, label)-1)/2.0 AS b
 FROM sc JOIN l USING (key, midx) WHERE ready AND label IS NOT NULL),
 ic AS (SELECT midx, month, CASE WHEN count(*)>=3 THEN corr(a,b) END AS ic, count(*) AS n_names FROM c GROUP BY ALL)"""


def walkforward_ic(v, spread=False):
    s = monthly_scores(v, spread)
    nxt = C.next_period(s, ["key"], "midx", "ret", "nxt")
    b = v.ret_s.where("key = 'S1'").select((F.col("midx") - 1).alias("midx"), F.col("ret").alias("bench"))
    d = nxt.where("ready").join(b, "midx").withColumn("label", F.col("nxt") - F.col("bench"))
    return S.spearman_ic(d, ["midx", "month"], "s", "label", spread=spread)


@query("g01_spearman_ic", "month:d ic:f n_names:i", f"WITH {IC} SELECT * FROM ic")
def g01(v):
    v.shared("px_s")
    return walkforward_ic(v)


@query("g01_spearman_ic_large_groups", "month:d ic:f n_names:i", f"WITH {IC} SELECT * FROM ic")
def g01b(v):
    v.shared("px_s")
    return walkforward_ic(v, spread=True)


@query("g02_ic_ratio", "mean:f ir:f n:i", f"WITH {IC} SELECT avg(ic) AS mean, avg(ic)/stddev_samp(ic) AS ir, count(ic) AS n FROM ic")
def g02(v):
    v.shared("px_s")
    return walkforward_ic(v).agg(F.avg("ic").alias("mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.count("ic").alias("n"))


@query("g12_james_stein", "key midx:i mean:f shrunk:f", """WITH m AS (SELECT key, midx, avg(ret) OVER (PARTITION BY key ORDER BY midx ROWS 23 PRECEDING) AS mean FROM ret_s), s AS (SELECT *, 0.004 AS grand, count(mean) OVER w AS n, var_samp(mean) OVER w AS v, sum(pow(mean-0.004,2)) OVER w AS d2 FROM m WINDOW w AS (PARTITION BY midx))
SELECT key, midx, mean, CASE WHEN n>=3 AND v>=1e-16 AND d2>=1e-16 THEN grand + greatest(0, 1-(n-2)*v/d2)*(mean-grand) ELSE mean END AS shrunk FROM s""")
def g12(v):
    m = v.ret_s.select("key", "midx", F.avg("ret").over(km().rowsBetween(-23, 0)).alias("mean"))
    grand = F.lit(0.004)
    g = m.groupBy("midx").agg(F.count("mean").alias("n"), F.var_samp("mean").alias("vv"), F.sum(F.pow(F.col("mean") - grand, 2)).alias("d2"))
    d = m.join(g, "midx")
    return d.withColumn("shrunk", S.james_stein("mean", grand, "vv", "n", "d2"))


@query("g13_expected_returns", "key midx:i mu:f", f"""WITH {SC}, mm AS (SELECT key, midx, s, avg(ret) OVER (PARTITION BY key ORDER BY midx ROWS 23 PRECEDING) AS mean FROM sc JOIN ret_s USING (key, midx)),
 gg AS (SELECT *, avg(mean) OVER w AS grand, count(mean) OVER w AS n, rank() OVER (PARTITION BY midx ORDER BY s) + (count(*) OVER (PARTITION BY midx, s)-1)/2.0 AS rk, count(s) OVER w AS ns, var_samp(mean) OVER w AS vv FROM mm WINDOW w AS (PARTITION BY midx)),
 h AS (SELECT *, sum(pow(mean-grand,2)) OVER (PARTITION BY midx) AS d2 FROM gg)
SELECT key, midx, 0.5*coalesce(CASE WHEN n>=3 AND vv>=1e-16 AND d2>=1e-16 THEN grand+greatest(0,1-(n-2)*vv/d2)*(mean-grand) ELSE mean END, grand, 0) + 0.5*(coalesce(grand,0)+0.015*(rk/ns-0.5)*2) AS mu FROM h""")
def g13(v):
    v.shared("px_s")
    d = monthly_scores(v).withColumn("mean", F.avg("ret").over(km().rowsBetween(-23, 0)))
    return S.expected_returns(d, ["midx"], "mean", "s")


@query("g21_trend_signal", "key month:d signal:f", """WITH x AS (SELECT key, month, r.midx, ret-rate AS ex, stddev_samp(ret) OVER (PARTITION BY key ORDER BY r.midx ROWS 23 PRECEDING)*sqrt(12) AS sd FROM ret_s r JOIN rates USING (month))
SELECT a.key, a.month, (SELECT CASE WHEN count(b.ex)=12 THEN 0.1*a.sd*sign(exp(sum(CASE WHEN b.midx<a.midx THEN ln(1+b.ex) END))-1) END FROM x b WHERE b.key=a.key AND b.midx BETWEEN a.midx-11 AND a.midx) AS signal FROM x a""")
def g21(v):
    d = P.attach_rate(v.ret_s, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    w = km()
    d = d.withColumn("sigma", F.stddev_samp("ret").over(w.rowsBetween(-23, 0)) * SQRT12)
    whole = F.count("ex").over(w.rangeBetween(-11, 0)) == 12
    return d.withColumn("signal", F.when(whole, 0.1 * F.col("sigma") * F.signum(F.product(1.0 + F.col("ex")).over(w.rangeBetween(-11, -1)) - 1.0)))


@query("b02_walkforward_ic", "month:d ic:f n_names:i ic_mean_expanding:f", f"WITH {IC} SELECT month, ic, n_names, avg(ic) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS ic_mean_expanding FROM ic")
def b02(v):
    v.shared("px_s")
    ic = walkforward_ic(v)
    # the decision calendar is one row per month, so a single ordered frame is bounded
    return ic.withColumn("ic_mean_expanding", F.avg("ic").over(Window.orderBy("month").rowsBetween(W.UNB, 0)))
