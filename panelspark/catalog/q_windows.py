"""Verification queries: time-series windows."""
from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.functions.scalar import SQRT12, ratio
from panelspark.functions.stats import safe_corr
from panelspark.operators import ordered as O, windows as W

def km():
    return W.by("key", order="midx")


def kd():
    return W.by("key", order="date")



@query("w01_simple_return", "key month:d ret_none ret_pad".replace("ret_none ret_pad", "ret_none:f ret_pad:f"), """
SELECT key, month, CASE WHEN lag(midx) OVER w = midx-1 THEN price/lag(price) OVER w - 1 END AS ret_none,
       price/lag(price) OVER w - 1 AS ret_pad FROM px_s WINDOW w AS (PARTITION BY key ORDER BY midx)""")
def w01(v):
    return v.px_s.select("key", "month", W.simple_return("price", km(), "midx").alias("ret_none"),
                         W.simple_return("price", km(), fill="pad").alias("ret_pad"))


@query("w02_log_return", "key date:d lr:f", """
SELECT key, date, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price/lag(price) OVER w) END AS lr
FROM px_d WINDOW w AS (PARTITION BY key ORDER BY date)""")
def w02(v):
    return v.px_d.select("key", "date", W.log_return("price", kd()).alias("lr"))


@query("w03_momentum_12_1", "key month:d mom_features:f mom_rotation:f", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY midx) AS rn FROM ret_s JOIN px_s USING (key, month, midx))
SELECT a.key, a.month, CASE WHEN rn >= 13 THEN lag(price,1) OVER w / lag(price,12) OVER w - 1 END AS mom_features,
  (SELECT CASE WHEN count(b.ret)=11 THEN exp(sum(ln(1+b.ret)))-1 END FROM ret_s b WHERE b.key=a.key AND b.midx BETWEEN a.midx-12 AND a.midx-2) AS mom_rotation
FROM a WINDOW w AS (PARTITION BY key ORDER BY midx)""")
def w03(v):
    d = v.px_s.withColumn("ret", W.simple_return("price", km(), "midx"))
    return d.select("key", "month", W.momentum_observed("price", km()).alias("mom_features"),
                    W.momentum_gapless("ret", km()).alias("mom_rotation"))


@query("w04_trailing_vol", "key date:d vol_63:f vol_63_full:f vol_252:f", """
SELECT key, date, CASE WHEN count(ret) OVER a >= 2 THEN stddev_samp(ret) OVER a * sqrt(252) END AS vol_63,
 CASE WHEN count(ret) OVER a >= 63 THEN stddev_samp(ret) OVER a * sqrt(252) END AS vol_63_full,
 CASE WHEN count(ret) OVER b >= 2 THEN stddev_samp(ret) OVER b * sqrt(252) END AS vol_252
FROM ret_d WINDOW a AS (PARTITION BY key ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY key ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def w04(v):
    return v.ret_d.select("key", "date", W.trailing_vol("ret", kd(), 63, min_periods=2).alias("vol_63"),
                          W.trailing_vol("ret", kd(), 63).alias("vol_63_full"),
                          W.trailing_vol("ret", kd(), 252, min_periods=2).alias("vol_252"))


@query("w05_expanding_vol", "key date:d sigma_star:f", """
SELECT key, date, CASE WHEN count(ret) OVER w >= 252 THEN stddev_samp(ret) OVER w * sqrt(252) END AS sigma_star
FROM ret_d WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w05(v):
    return v.ret_d.select("key", "date", (W.expanding(F.stddev_samp("ret"), kd(), "ret", 252) * F.sqrt(F.lit(252.0)))
                          .alias("sigma_star"))


@query("w06_running_count", "key month:d n_prior:i", """
SELECT key, month, count(ret) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM ret_s""")
def w06(v):
    return v.ret_s.select("key", "month", F.count("ret").over(km().rowsBetween(W.UNB, -1)).alias("n_prior"))


@query("w07_expanding_z", "key month:d z:f", """
SELECT key, month, CASE WHEN count(ret) OVER w >= 12 THEN (ret - avg(ret) OVER w)/nullif(stddev_samp(ret) OVER w, 0) END AS z
FROM ret_s WINDOW w AS (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w07(v):
    return v.ret_s.select("key", "month", W.expanding_z("ret", km()).alias("z"))


@query("w08_expanding_quantile_gate", "key month:d vol:f threshold:f vol_ok:b", """
WITH a AS (SELECT key, month, midx, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(12) END AS vol FROM ret_s
  WINDOW w AS (PARTITION BY key ORDER BY midx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN count(vol) OVER u >= 21 THEN quantile_cont(vol, 0.9) OVER u END AS threshold FROM a
  WINDOW u AS (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, month, vol, threshold, coalesce(vol <= threshold, false) AS vol_ok FROM b""")
def w08(v):
    d = v.ret_s.withColumn("vol", W.trailing_vol("ret", km(), 6, 12.0))
    d = O.frame_quantile(d, ["key"], "midx", "vol", {"threshold": 0.9}, min_periods=21)
    return d.withColumn("vol_ok", F.coalesce(F.col("vol") <= F.col("threshold"), F.lit(False)))


@query("w09_prior_median", "key month:d med:f", """
SELECT key, month, quantile_cont(ret, 0.5) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM ret_s""")
def w09(v):
    return O.frame_quantile(v.ret_s, ["key"], "midx", "ret", {"med": 0.5})


@query("w10_drawdown", "key month:d dd_first:f dd_one:f maxdd_12:f", """
WITH r AS (SELECT key, month, midx, price, exp(sum(ln(1+coalesce(ret,0))) OVER w) AS wealth FROM ret_s JOIN px_s USING (key, month, midx)
  WINDOW w AS (PARTITION BY key ORDER BY midx)),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY midx) AS rn FROM r),
p AS (SELECT t.key, t.rn, u.price / max(u.price) OVER (PARTITION BY t.key, t.rn ORDER BY u.rn) - 1 AS f
  FROM n t JOIN n u ON u.key = t.key AND u.rn BETWEEN t.rn-11 AND t.rn),
m AS (SELECT key, rn, CASE WHEN count(*) >= 2 THEN min(f) END AS maxdd_12 FROM p GROUP BY ALL)
SELECT n.key, month, wealth / max(wealth) OVER w - 1 AS dd_first, wealth / greatest(1.0, max(wealth) OVER w) - 1 AS dd_one, maxdd_12
FROM n JOIN m USING (key, rn) WINDOW w AS (PARTITION BY key ORDER BY midx)""")
def w10(v):
    d = v.px_s.withColumn("ret", W.simple_return("price", km(), "midx"))
    d = W.drawdown(d, km(), start_at_one=False).withColumnRenamed("dd", "dd_first")
    return O.sliding_drawdown(W.drawdown(d, km()).withColumnRenamed("dd", "dd_one"), ["key"], "midx", "price", 12, "maxdd_12")


@query("w11_wealth_curve", "series_id month:d wealth:f", """
SELECT series_id, month, exp(sum(ln(1+ret)) OVER (PARTITION BY series_id ORDER BY midx)) AS wealth FROM series""")
def w11(v):
    return v.series.withColumn("wealth", W.wealth("ret", W.by("series_id", order="midx")))


@query("w12_rolling_sharpe", "series_id month:d sharpe_36:f ret_12:f", """
SELECT series_id, month, CASE WHEN count(*) OVER a = 36 THEN avg(ex) OVER a * 12 / (stddev_samp(ex) OVER a * sqrt(12)) END AS sharpe_36,
 CASE WHEN count(*) OVER b = 12 THEN exp(sum(ln(1+ret)) OVER b) - 1 END AS ret_12
FROM (SELECT s.*, ret - rate AS ex FROM series s JOIN rates USING (month))
WINDOW a AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def w12(v):
    w = W.by("series_id", order="month")
    d = v.series.join(v.rates.select("month", "rate"), "month").withColumn("ex", F.col("ret") - F.col("rate"))
    return d.select("series_id", "month", W.rolling_sharpe("ex", w).alias("sharpe_36"),
                    W.rolling_compound("ret", w).alias("ret_12"))


@query("w13_average_rank", "key month:d rank:f pct:f", """
SELECT key, month, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY month ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY month, x) - 1)/2.0 END AS rank,
 CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY month ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY month, x) - 1)/2.0) / count(x) OVER (PARTITION BY month) END AS pct
FROM (SELECT key, month, round(ret, 1) AS x FROM ret_s)""")
def w13(v):
    d = v.ret_s.select("key", "month", F.round("ret", 1).alias("x"))
    return d.select("key", "month", W.average_rank("x", ["month"]).alias("rank"),
                    W.percent_rank_avg("x", ["month"]).alias("pct"))


@query("w13_average_rank_large_groups", "key month:d rank:f", """
SELECT key, month, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY month ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY month, x) - 1)/2.0 END AS rank
FROM (SELECT key, month, round(ret, 1) AS x FROM ret_s)""")
def w13b(v):
    return W.spread_average_rank(v.ret_s.select("key", "month", F.round("ret", 1).alias("x")), ["month"], "x", "rank", 64)


@query("w14_rolling_pair", "key date:d pairs:i vol:f sharpe:f beta:f corr:f", """
WITH a AS (SELECT r.key, r.date, CASE WHEN b.ret IS NOT NULL THEN r.ret END AS x, CASE WHEN r.ret IS NOT NULL THEN b.ret END AS y
  FROM ret_d r LEFT JOIN (SELECT date, ret FROM ret_d WHERE key='ECONOMY') b USING (date) WHERE r.key <> 'ECONOMY')
SELECT key, date, count(x) OVER w AS pairs,
 CASE WHEN count(x) OVER w = 63 THEN stddev_samp(x) OVER w * sqrt(252) END AS vol,
 CASE WHEN count(x) OVER w = 63 THEN avg(x) OVER w * sqrt(252) / stddev_samp(x) OVER w END AS sharpe,
 CASE WHEN count(*) OVER w = 63 AND count(x) OVER w >= 2 THEN covar_samp(x, y) OVER w / nullif(var_samp(y) OVER w, 0) END AS beta,
 CASE WHEN count(*) OVER w = 63 AND count(x) OVER w >= 2 THEN covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END AS corr
FROM a WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def w14(v):
    bench = v.ret_d.where(F.col("key") == "ECONOMY").select("date", F.col("ret").alias("b"))
    d = v.ret_d.where(F.col("key") != "ECONOMY").join(bench, "date", "left")
    return d.select("key", "date", *[c.alias(n) for n, c in W.rolling_pair("ret", "b", kd(), 63).items()])


@query("w15_expanding_mean", "series_id month:d mean:f", """
SELECT series_id, month, avg(ret) OVER (PARTITION BY series_id ORDER BY midx ROWS UNBOUNDED PRECEDING) AS mean FROM series""")
def w15(v):
    return v.series.withColumn("mean", W.expanding(F.avg("ret"), W.by("series_id", order="midx"), "ret", prior=False))


@query("w16_market_features", "category month:d vol:f spread:f", """
WITH m AS (SELECT category, month, midx, avg(ret) AS r, avg(CASE WHEN cash_like OR short_duration THEN ret END) - avg(CASE WHEN equity_only THEN ret END) AS s
  FROM ret_s JOIN uni_s USING (key) GROUP BY ALL)
SELECT category, month, CASE WHEN count(r) OVER w = 6 THEN stddev_samp(r) OVER w * sqrt(12) END AS vol, CASE WHEN count(s) OVER w = 6 THEN avg(s) OVER w END AS spread
FROM m WINDOW w AS (PARTITION BY category ORDER BY midx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def w16(v):
    d = v.ret_s.join(v.uni_s, "key").groupBy("category", "month", "midx").agg(
        F.avg("ret").alias("r"),
        (F.avg(F.when(F.col("cash_like") | F.col("short_duration"), F.col("ret"))) - F.avg(F.when(F.col("equity_only"), F.col("ret")))).alias("s"))
    w = W.by("category", order="midx")
    f = w.rowsBetween(-5, 0)
    return d.select("category", "month", W.trailing_vol("r", w, 6, 12.0).alias("vol"),
                    F.when(F.count("s").over(f) == 6, F.avg("s").over(f)).alias("spread"))


@query("w17_market_vol_state", "month:d z:f z_inv:f", """
WITH b AS (SELECT *, CASE WHEN count(ret) OVER w >= 63 THEN stddev_samp(ret) OVER w * sqrt(252) END AS z FROM ret_d WHERE key='ECONOMY'
  WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(z, date) AS z, 1/nullif(arg_max(z, date), 0) AS z_inv FROM b GROUP BY 1""")
def w17(v):
    d = v.ret_d.where(F.col("key") == "ECONOMY").withColumn("z", W.trailing_vol("ret", kd(), 63))
    m = d.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("z", "date").alias("z"))
    return m.withColumn("z_inv", ratio(F.lit(1.0), "z"))


@query("w19_vol_regime", "category month:d vol:f regime:i", """
WITH m AS (SELECT category, month, midx, avg(ret) AS r FROM ret_s JOIN uni_s USING (key) GROUP BY ALL),
a AS (SELECT *, CASE WHEN count(r) OVER w >= 2 THEN stddev_samp(r) OVER w * sqrt(12) END AS vol FROM m WINDOW w AS (PARTITION BY category ORDER BY midx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT category, month, vol, CASE WHEN count(vol) OVER u >= 2 AND vol >= quantile_cont(vol, 0.5) OVER u THEN 1 ELSE 0 END AS regime
FROM a WHERE vol IS NOT NULL WINDOW u AS (PARTITION BY category ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w19(v):
    w = W.by("category", order="midx")
    d = v.ret_s.join(v.uni_s, "key").groupBy("category", "month", "midx").agg(F.avg("ret").alias("r"))
    d = d.withColumn("vol", W.trailing_vol("r", w, 6, 12.0, min_periods=2)).where("vol is not null")
    d = O.frame_quantile(d, ["category"], "midx", "vol", {"med": 0.5}, prior=False, min_periods=2)
    return d.withColumn("regime", F.coalesce((F.col("vol") >= F.col("med")).cast("int"), F.lit(0)))


@query("w20_market_states", "key month:d dd:f dd_state vol:f vol_state", """
WITH r AS (SELECT key, month, midx, exp(sum(ln(1+ret)) OVER (PARTITION BY key ORDER BY midx)) AS wealth,
  CASE WHEN count(ret) OVER w = 12 THEN stddev_samp(ret) OVER w * sqrt(12) END AS vol FROM ret_s WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY key ORDER BY midx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, wealth/greatest(1.0, max(wealth) OVER (PARTITION BY key ORDER BY midx)) - 1 AS dd, quantile_cont(vol, 0.5) OVER (PARTITION BY key) AS med FROM r)
SELECT key, month, dd, CASE WHEN dd > -0.05 THEN 'Up' WHEN dd > -0.20 THEN 'Correction' ELSE 'Bear' END AS dd_state, vol,
 CASE WHEN vol IS NULL THEN NULL WHEN vol > med THEN 'High vol' ELSE 'Low vol' END AS vol_state FROM d""")
def w20(v):
    d = W.drawdown(v.ret_s.where("ret is not null").withColumn("vol", W.trailing_vol("ret", km(), 12, 12.0)), km())
    med = F.percentile("vol", F.lit(0.5)).over(Window.partitionBy("key"))
    return d.select("key", "month", "dd", W.drawdown_state("dd").alias("dd_state"), "vol",
                    F.when(F.col("vol") > med, "High vol").when(F.col("vol").isNotNull(), "Low vol").alias("vol_state"))


@query("w21_drawdown_episodes", "key start:d trough:d depth:f months:i", """
WITH r AS (SELECT key, month, midx, exp(sum(ln(1+ret)) OVER (PARTITION BY key ORDER BY midx)) AS wealth FROM ret_s WHERE ret IS NOT NULL),
d AS (SELECT *, wealth/greatest(1.0, max(wealth) OVER w) - 1 AS dd, wealth >= greatest(1.0, max(wealth) OVER w) AS top FROM r WINDOW w AS (PARTITION BY key ORDER BY midx)),
i AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY key ORDER BY midx) AS island FROM d)
SELECT key, min(month) AS start, arg_min(month, dd) AS trough, min(dd) AS depth, count(*) AS months FROM i WHERE NOT top GROUP BY key, island HAVING min(dd) <= -0.10""")
def w21(v):
    return W.drawdown_episodes(W.drawdown(v.ret_s.where("ret is not null"), km()), ["key"], "month")


@query("w22_hysteresis", "key month:d raw:b on_2:b on_3:b", """
WITH a AS (SELECT key, month, midx, coalesce(ret > 0.05, false) AS raw FROM ret_s)
SELECT key, month, raw, bool_or(raw) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS on_2,
 bool_or(raw) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS on_3 FROM a""")
def w22(v):
    d = v.ret_s.withColumn("raw", F.coalesce(F.col("ret") > 0.05, F.lit(False)))
    return d.withColumn("on_2", W.hysteresis("raw", km(), 2)).withColumn("on_3", W.hysteresis("raw", km(), 3))


@query("w23_autocorrelation", "key lag:i acf:f acf_abs:f", """
WITH a AS (SELECT key, date, ret, row_number() OVER (PARTITION BY key ORDER BY date) AS rn FROM ret_d)
SELECT x.key, y.rn - x.rn AS lag, corr(x.ret, y.ret) AS acf, corr(abs(x.ret), abs(y.ret)) AS acf_abs
FROM a x JOIN a y ON x.key = y.key AND y.rn BETWEEN x.rn+1 AND x.rn+40 GROUP BY ALL""")
def w23(v):
    return W.autocorrelation(v.ret_d, ["key"], "date", "ret")


@query("w24_realized_skew", "key month:d rs:f", """
SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(ret) >= 3 AND sum(ret*ret) >= 1e-20 THEN sqrt(count(ret))*sum(ret*ret*ret)/pow(sum(ret*ret), 1.5) END AS rs
FROM ret_d GROUP BY ALL""")
def w24(v):
    return v.ret_d.groupBy("key", F.trunc("date", "MM").alias("month")).agg(W.realized_skew("ret").alias("rs"))


@query("w25_ar1_forecast", "key month:d forecast:f", """
WITH s AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, sqrt(count(ret))*sum(ret*ret*ret)/pow(sum(ret*ret), 1.5) AS rs FROM ret_d GROUP BY ALL HAVING count(ret) >= 3),
l AS (SELECT *, lag(rs) OVER (PARTITION BY key ORDER BY month) AS x FROM s)
SELECT key, month, coalesce(CASE WHEN count(rs) OVER w >= 5 THEN regr_intercept(rs, x) OVER w + regr_slope(rs, x) OVER w * rs END, rs) AS forecast
FROM l WINDOW w AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)""")
def w25(v):
    s = v.ret_d.groupBy("key", F.trunc("date", "MM").alias("month")).agg(W.realized_skew("ret").alias("rs")).where("rs is not null")
    return W.ar1_forecast(s, ["key"], "month", "rs")


@query("w26_left_tail", "key month:d cvar_5:f below_sigma:f", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY midx) AS rn FROM ret_s WHERE ret IS NOT NULL),
q AS (SELECT t.key, t.rn, t.month, quantile_cont(u.ret, 0.05) AS thr, stddev_samp(u.ret) AS sd, count(*) AS n FROM n t JOIN n u ON u.key=t.key AND u.rn BETWEEN t.rn-23 AND t.rn GROUP BY ALL)
SELECT q.key, q.month, CASE WHEN any_value(q.n) >= 3 THEN -avg(CASE WHEN u.ret <= thr THEN u.ret END) END AS cvar_5,
 CASE WHEN any_value(q.n) >= 3 AND any_value(sd) >= 1e-12 THEN avg(CASE WHEN u.ret < -sd THEN 1.0 ELSE 0.0 END) END AS below_sigma
FROM q JOIN n u ON u.key=q.key AND u.rn BETWEEN q.rn-23 AND q.rn GROUP BY ALL""")
def w26(v):
    return O.left_tail(v.ret_s.where("ret is not null"), ["key"], "midx", "ret", 24)


@query("w26_selected_left_tail", "rule key midx:i left_tail:f", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY midx) AS rn FROM ret_b WHERE ret IS NOT NULL), k AS (SELECT key, midx, rn, CASE WHEN sum(ret*ret) OVER w > 0 THEN sqrt(count(*) OVER w)*sum(ret*ret*ret) OVER w/pow(sum(ret*ret) OVER w, 1.5) END AS sk FROM n WINDOW w AS (PARTITION BY key ORDER BY rn ROWS 11 PRECEDING)),
q AS (SELECT t.key, t.rn, t.midx, quantile_cont(u.ret, 0.05) AS thr, stddev_samp(u.ret) AS sd, count(*) AS c FROM n t JOIN n u ON u.key=t.key AND u.rn BETWEEN t.rn-23 AND t.rn GROUP BY ALL),
s AS (SELECT q.key, q.midx, CASE WHEN any_value(q.c) >= 3 THEN -avg(CASE WHEN u.ret <= thr THEN u.ret END) END AS c5, CASE WHEN any_value(q.c) >= 3 AND any_value(sd) >= 1e-12 THEN avg(CASE WHEN u.ret < -sd THEN 1.0 ELSE 0.0 END) END AS bs
 FROM q JOIN n u ON u.key=q.key AND u.rn BETWEEN q.rn-23 AND q.rn GROUP BY ALL)
SELECT 'cvar_5' AS rule, key, midx, c5 AS left_tail FROM s UNION ALL SELECT 'below_sigma', key, midx, bs FROM s UNION ALL SELECT 'adverse_skew', key, midx, greatest(0, -sk) FROM k""")
def w26s(v):
    """The three selectable rules on one panel."""
    v.shared("ret_b")
    w, out = km(), None
    f = w.rowsBetween(-11, 0)
    r = F.col("ret")
    d = v.ret_b.where("ret is not null")
    d = d.withColumn("sk", F.when(F.sum(r * r).over(f) > 0, F.sqrt(F.count("*").over(f)) * F.sum(r * r * r).over(f) / F.pow(F.sum(r * r).over(f), F.lit(1.5))))
    for rule in ("cvar_5", "below_sigma", "adverse_skew"):
        x = W.left_tail_score(d, ["key"], "midx", "ret", rule, 24, "sk").select(F.lit(rule).alias("rule"), "key", "midx", "left_tail")
        out = x if out is None else out.unionByName(x)
    return out


@query("w27_prior_weights", "strategy key month:d weight:f prev_weight:f", """
SELECT w.strategy, w.key, w.month, w.weight, coalesce(p.weight, 0) AS prev_weight FROM weights w LEFT JOIN weights p
 ON p.strategy=w.strategy AND p.key=w.key AND p.midx=w.midx-1""")
def w27(v):
    w = Window.partitionBy("strategy", "key").orderBy("midx").rangeBetween(-1, -1)
    return v.weights.withColumn("prev_weight", F.coalesce(F.first("weight").over(w), F.lit(0.0)))


@query("w29_daily_rate_share", "date:d source daily:f", """
WITH b AS (SELECT date, price FROM px_d WHERE key='PROMO' AND date >= DATE '1996-01-01'),
l AS (SELECT date, ln(price/lag(price) OVER (ORDER BY date)) AS lr FROM b),
c AS (SELECT date, CAST(date_trunc('month', date) AS DATE) AS month, count(*) OVER (PARTITION BY date_trunc('month', date)) AS n FROM (SELECT DISTINCT date FROM px_d)),
f AS (SELECT min(date) AS first FROM l WHERE lr IS NOT NULL)
SELECT c.date, CASE WHEN lr IS NOT NULL THEN 'own' WHEN c.date < first AND rate IS NOT NULL THEN 'fallback' END AS source,
 CASE WHEN lr IS NOT NULL THEN lr WHEN c.date < first THEN ln(1+rate)/n END AS daily
FROM c LEFT JOIN l USING (date) LEFT JOIN rates USING (month), f""")
def w29(v):
    own = v.px_d.where((F.col("key") == "PROMO") & (F.col("date") >= "1996-01-01"))
    own = own.select("date", W.log_return("price", kd()).alias("own"))
    return W.daily_rate(v.px_d.select("date").distinct(), own, v.rates)
