"""Verification queries: walk-forward books and grids."""
from pyspark.sql import Window, functions as F

from panelspark.catalog import book_sql as BS, q_alloc as QA, q_inference as QI, q_panel as QP, q_portfolio as QW, q_scores as QS
from panelspark.catalog.base import query
from panelspark.functions.scalar import attach_one
from panelspark.operators import allocate as A, calendar as C, covariance as V, kernels as K, panel as P, portfolio as L, quality as Q, scores as S, windows as W
from panelspark.plans import books as B, registry as G
from panelspark.sources.stage import stage

MIX = {"ECONOMY": 0.7, "LARGE": 0.2, "SMALL": 0.1}
CASH = "PROMO"


def rate_idx(v):
    return v.rates.select("midx", "rate")


# ------------------------------------------------------------------ scores at one date
@query("b01_score_universe", "key category s:f rank:i", f"""WITH e AS (SELECT key, category FROM uni_s WHERE approved AND section<>'Appendix 3' AND key NOT IN (SELECT key FROM deny_s)),
 p AS (SELECT px_s.*, category FROM px_s JOIN e USING (key) WHERE month <= DATE '2001-06-01'), r AS (SELECT *, CASE WHEN lag(price) OVER w IS NOT NULL THEN price/lag(price) OVER w - 1 END AS ret, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY key ORDER BY month)),
 b AS (SELECT month, price/lag(price) OVER (ORDER BY month) - 1 AS bench FROM px_s WHERE key='S1' AND month <= DATE '2001-06-01'), j AS (SELECT r.*, ret-bench AS ex, price*volume AS pv FROM r LEFT JOIN b USING (month)),
 d AS (SELECT t.key, t.rn, u.price/max(u.price) OVER (PARTITION BY t.key, t.rn ORDER BY u.rn) - 1 AS f FROM j t JOIN j u ON u.key=t.key AND u.rn BETWEEN t.rn-11 AND t.rn), m AS (SELECT key, rn, CASE WHEN count(*)>=2 THEN min(f) END AS dd FROM d GROUP BY ALL),
 f AS (SELECT j.key, category, month, rn, CASE WHEN rn>=13 THEN lag(price,1) OVER w/lag(price,12) OVER w - 1 END AS f1, CASE WHEN count(ex) OVER y>=3 THEN avg(ex) OVER y/nullif(stddev_samp(ex) OVER y,0)*sqrt(252) END AS f2,
  CASE WHEN count(ret) OVER y>=2 THEN -stddev_samp(ret) OVER y*sqrt(252) END AS f3, dd AS f4, avg(pv) OVER o AS f5, CASE WHEN count(ret) OVER q>=2 THEN -stddev_samp(ret) OVER q*sqrt(252) END AS f6
  FROM j JOIN m USING (key, rn) WINDOW w AS (PARTITION BY j.key ORDER BY rn), y AS (PARTITION BY j.key ORDER BY rn ROWS 11 PRECEDING), q AS (PARTITION BY j.key ORDER BY rn ROWS 2 PRECEDING), o AS (PARTITION BY j.key ORDER BY rn ROWS CURRENT ROW)),
 l AS (SELECT key, category, unnest([1,2,3,4,5,6]) AS k, unnest([f1,f2,f3,f4,f5,f6]) AS x, unnest([0.30,0.25,0.15,0.15,0.10,0.05]) AS wt FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY month DESC)=1),
 md AS (SELECT *, quantile_cont(x,0.5) OVER g AS med, stddev_samp(x) OVER g AS sd FROM l WINDOW g AS (PARTITION BY category, k)), mm AS (SELECT *, quantile_cont(abs(x-med),0.5) OVER (PARTITION BY category, k) AS mad FROM md),
 sc AS (SELECT key, category, round(sum(wt*coalesce(CASE WHEN mad>0 THEN (x-med)/(mad*1.4826) WHEN sd>0 THEN (x-med)/sd WHEN med IS NOT NULL THEN 0.0 END, 0)), 9) AS s FROM mm GROUP BY ALL)
SELECT key, category, s, row_number() OVER (ORDER BY s DESC, key) AS rank FROM sc""")
def b01(v):
    v.shared("px_s")
    u = P.eligible(v.uni_s, [v.deny_s])
    px = v.px_s.where("month <= '2001-06-01'")
    bench = px.where("key = 'S1'").select("month", (F.col("price") / F.lag("price").over(W.by("key", order="month")) - 1.0).alias("bench"))
    px = px.join(u.select("key", "category"), "key")
    f = S.raw_features(px, "month", bench, year=12, quarter=3, month=1)
    f = f.withColumn("mom12_1", W.momentum_observed("price", W.by("key", order="month")))
    last = f.groupBy("key").agg(F.max_by(F.struct(*[c for c in f.columns if c != "key"]), "month").alias("x")).select("key", "x.*")
    d = S.signed_features(last).join(u.select("key", "category"), "key")
    z = S.robust_z(d, ["category"], list(S.FEATURE_WEIGHTS))
    return S.global_rank(z.select("key", "category", F.round(S.composite(S.FEATURE_WEIGHTS), 9).alias("s")), "s", "key")


# ------------------------------------------------------------------ scaled core grid
ME = """me AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(price, date) AS p FROM px_d GROUP BY ALL), mr AS (SELECT key, year(month)*12+month(month) AS midx, p/lag(p) OVER (PARTITION BY key ORDER BY month)-1 AS r FROM me),
 cm AS (SELECT midx, sum(CASE key WHEN 'ECONOMY' THEN 0.7 WHEN 'LARGE' THEN 0.2 ELSE 0.1 END*r) AS r FROM mr WHERE key IN ('ECONOMY','LARGE','SMALL') GROUP BY midx HAVING count(r)=3), ca AS (SELECT midx, r FROM mr WHERE key='PROMO' AND r IS NOT NULL)"""
SIG = """cd AS (SELECT date, sum(CASE key WHEN 'ECONOMY' THEN 0.7 WHEN 'LARGE' THEN 0.2 ELSE 0.1 END*ret) AS r FROM ret_d WHERE key IN ('ECONOMY','LARGE','SMALL') GROUP BY date HAVING count(ret)=3),
 sg AS (SELECT date, CASE WHEN count(r) OVER a=21 THEN stddev_samp(r) OVER a*sqrt(252) END AS h21, CASE WHEN count(r) OVER b=63 THEN stddev_samp(r) OVER b*sqrt(252) END AS h63, CASE WHEN count(r) OVER e>=21 THEN stddev_samp(r) OVER e*sqrt(252) END AS s21, CASE WHEN count(r) OVER e>=63 THEN stddev_samp(r) OVER e*sqrt(252) END AS s63
  FROM cd WINDOW a AS (ORDER BY date ROWS 20 PRECEDING), b AS (ORDER BY date ROWS 62 PRECEDING), e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 sm AS (SELECT year(date)*12+month(date) AS midx, unnest([21,63]) AS lookback, unnest([h21,h63]) AS h, unnest([s21,s63]) AS s FROM sg QUALIFY row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC)=1)"""
SM2 = SIG.replace("QUALIFY row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC)=1", "WHERE date IN (SELECT max(date) FROM cd GROUP BY date_trunc('month', date))")
BOOK = f"""{ME}, {SM2}, tr AS (SELECT 'L'||lookback||'_f'||fi AS trial_id, lookback, f_min FROM (VALUES (21),(63)) a(lookback), (VALUES ('25',0.25),('50',0.5)) b(fi,f_min)),
 fb AS (SELECT trial_id, sm.midx, least(1.0, greatest(f_min, s/h)) AS f, cm.r AS rc, ca.r AS rk FROM sm JOIN tr USING (lookback) JOIN cm ON cm.midx=sm.midx+1 JOIN ca ON ca.midx=sm.midx+1 WHERE h>0 AND s>0),
 bt AS (SELECT *, f*rc+(1-f)*rk AS gross, coalesce(abs(f-lag(f) OVER (PARTITION BY trial_id ORDER BY midx)),0) AS turnover FROM fb), bk AS (SELECT *, gross-turnover*5/10000 AS net, gross-turnover*5/10000-rc AS active FROM bt)"""


def monthly_core(v):
    me = C.month_end_values(v.px_d, ["key"], "date", ["price"]).withColumn("midx", (F.year("month") * 12 + F.month("month")).cast("int"))
    r = me.withColumn("ret", F.col("price") / F.lag("price").over(W.by("key", order="month")) - 1.0)
    return B.core_returns(r, MIX, "midx"), r.where(F.col("key") == CASH).select("midx", F.col("ret").alias("r"))


def sigma(v):
    return B.sigma_table(B.core_returns(v.ret_d, MIX, "date"), [21, 63])


def vt_trials(v):
    d = B.grid(v.rows("z int", (0,)), lookback=[21, 63], f_min=[0.25, 0.5])
    return d.select(F.format_string("L%d_f%.0f", "lookback", F.col("f_min") * 100).alias("trial_id"), "lookback", "f_min", F.lit(1.0).alias("f_max"))


def vt_book(v):
    core, cash = monthly_core(v)
    return B.scaled_core_returns(sigma(v), vt_trials(v), core, cash)


@query("b05_scaled_core_returns", "trial_id midx:i f:f gross:f turnover:f net:f active:f", f"WITH {BOOK} SELECT * FROM bk")
def b05(v):
    v.shared("px_d")
    return vt_book(v)


@query("b05_scaled_core_summary", "trial_id n:i cagr:f vol:f sharpe_rf0:f maxdd:f nw_t:f turnover_per_year:f dsr:f lo:f hi:f", f"""WITH {BOOK}, s AS (SELECT trial_id, midx AS month, active AS x FROM bk), {QI.NW.format(k='trial_id')},
 w AS (SELECT trial_id, midx, net, turnover, exp(sum(ln(1+net)) OVER (PARTITION BY trial_id ORDER BY midx)) AS wl FROM bk), q AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY trial_id ORDER BY midx))-1 AS dd FROM w),
 a AS (SELECT trial_id, count(*) AS n, pow(exp(sum(ln(1+net))), 12.0/count(*))-1 AS cagr, stddev_samp(net)*sqrt(12) AS vol, min(dd) AS maxdd, avg(turnover)*12 AS turnover_per_year FROM q GROUP BY 1),
 bp AS (SELECT trial_id, net AS ret, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY midx)-1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY trial_id) AS n FROM bk),
 bd AS (SELECT trial_id, n, rep, blk, {QI.start_sql('(rep*CAST(ceil(n/3.0) AS BIGINT)+blk)', 'n', 7)} AS st FROM (SELECT DISTINCT trial_id, n FROM bp), range(1000) r(rep), range(1000) b(blk) WHERE blk < ceil(n/3.0)),
 bx AS (SELECT bd.trial_id, rep, ret FROM bd JOIN range(3) o(off) ON blk*3+off < bd.n JOIN bp ON bp.trial_id=bd.trial_id AND bp.pos=(st+off)%bd.n),
 bs AS (SELECT trial_id, rep, (exp(sum(ln(1+ret))*12.0/count(*))-1)/(stddev_samp(ret)*sqrt(12)) AS sh FROM bx GROUP BY ALL), ci AS (SELECT trial_id, quantile_cont(sh, 0.025) AS lo, quantile_cont(sh, 0.975) AS hi FROM bs GROUP BY trial_id)
SELECT trial_id, a.n, cagr, vol, cagr/vol AS sharpe_rf0, maxdd, mean/se AS nw_t, turnover_per_year, {QI.cdf_sql('z')} AS dsr, lo, hi FROM (SELECT *, (cagr/vol/sqrt(12)-{QI.ppf_sql('0.75')}/sqrt(n-1))*sqrt(n-1) AS z FROM a) a JOIN nw USING (trial_id) JOIN ci USING (trial_id)""")
def b05s(v):
    v.shared("px_d")
    return B.overlay_summary(vt_book(v), 4)


@query("b05_scaled_core_states", "trial_id state mean:f hit:f n:i", f"WITH {BOOK} SELECT trial_id, CASE WHEN f<1-1e-12 THEN 'f_lt_1' ELSE 'f_eq_1' END AS state, avg(active) AS mean, avg(CASE WHEN active>0 THEN 1.0 ELSE 0.0 END) AS hit, count(*) AS n FROM bk GROUP BY ALL")
def b05r(v):
    v.shared("px_d")
    return B.state_table(vt_book(v), F.when(F.col("f") < 1 - 1e-12, "f_lt_1").otherwise("f_eq_1"))


# ------------------------------------------------------------------ correlation overlay
SLV = """sl AS (SELECT category AS key, midx, avg(ret) AS ret FROM ret_s JOIN uni_s USING (key) WHERE NOT thin GROUP BY ALL HAVING count(ret)>0)"""
CORR = f"""{SLV}, pr AS (SELECT a.midx, a.key AS k1, b.key AS k2, a.ret AS x, b.ret AS y FROM sl a JOIN sl b ON a.midx=b.midx AND a.key<b.key),
 cc AS (SELECT midx, avg(abs(c)) AS mac FROM (SELECT midx, CASE WHEN count(*) OVER w=12 THEN covar_samp(x,y) OVER w/nullif(stddev_samp(x) OVER w*stddev_samp(y) OVER w,0) END AS c FROM pr WINDOW w AS (PARTITION BY k1,k2 ORDER BY midx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY midx),
 mv AS (SELECT date, CASE WHEN count(ret) OVER w=63 THEN stddev_samp(ret) OVER w*sqrt(252) END AS z FROM ret_d WHERE key='ECONOMY' WINDOW w AS (ORDER BY date ROWS 62 PRECEDING)), zz AS (SELECT year(date)*12+month(date) AS midx, arg_max(z, date) AS z FROM mv WHERE z IS NOT NULL GROUP BY 1),
 gg AS (SELECT midx, mac, z, quantile_cont(mac,0.5) OVER w AS cmd, quantile_cont(z,0.5) OVER w AS zmd FROM cc JOIN zz USING (midx) WINDOW w AS (ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def category_sleeves(v):
    d = v.ret_s.join(v.uni_s.where("not thin").select("key", "category"), "key")
    return d.groupBy(F.col("category").alias("key"), "midx").agg(F.avg("ret").alias("ret")).where("ret is not null")


def corr_gate(v, g_min, lookback=12):
    c = P.mean_abs_corr(P.rolling_pair_corr(P.pair_returns(category_sleeves(v), []), [], lookback, lookback), ["midx"])
    d = v.ret_d.where("key = 'ECONOMY'").withColumn("z", W.trailing_vol("ret", W.by("key", order="date"), 63)).where("z is not null")
    z = d.groupBy((F.year("date") * 12 + F.month("date")).cast("int").alias("midx")).agg(F.max_by("z", "date").alias("z"))
    return B.prior_median_gate(c.join(z, "midx"), "mean_abs_corr", "z", g_min, lookback)


def corr_book(v):
    core, cash = monthly_core(v)
    trials = vt_trials(v).where("f_min = 0.25")
    trials = B.grid(trials, g_min=[0.25, 0.5]).withColumn("trial_id", F.format_string("%s_g%.0f", "trial_id", F.col("g_min") * 100))
    return B.scaled_core_returns(sigma(v), trials, core, cash, corr_gate(v, [0.25, 0.5]), gate_keys=["g_min"])


@query("b06_correlation_overlay", "trial_id midx:i f:f g:f net:f net_null:f r_core:f r_sleeves:f", f"""WITH {BOOK}, {CORR}, x AS (SELECT trial_id||'_g'||gi AS trial_id, fb.midx, f, CASE WHEN coalesce(mac>cmd AND z>zmd,false) THEN gm ELSE 1.0 END AS g, rc, rk FROM fb JOIN (VALUES ('25',0.25),('50',0.5)) q(gi,gm) ON trial_id LIKE '%f25' LEFT JOIN gg ON gg.midx=fb.midx),
 y AS (SELECT *, f*g AS sh, coalesce(abs(f*g-lag(f*g) OVER w),0) AS t1, coalesce(abs(f-lag(f) OVER w),0) AS t2 FROM x WINDOW w AS (PARTITION BY trial_id ORDER BY midx)), ew AS (SELECT midx-1 AS midx, avg(ret) AS r_sleeves FROM sl GROUP BY midx)
SELECT trial_id, y.midx, f, g, sh*rc+(1-sh)*rk-t1*5/10000 AS net, f*rc+(1-f)*rk-t2*5/10000 AS net_null, rc AS r_core, r_sleeves FROM y LEFT JOIN ew ON ew.midx=y.midx""")
def b06(v):
    v.shared("px_d")
    ew = category_sleeves(v).groupBy((F.col("midx") - 1).alias("midx")).agg(F.avg("ret").alias("r_sleeves"))
    return corr_book(v).join(ew, "midx", "left")


@query("b06_correlation_states", "trial_id state mean:f hit:f n:i", f"""WITH {BOOK}, {CORR}, x AS (SELECT trial_id||'_g'||gi AS trial_id, fb.midx, f, coalesce(mac>cmd AND z>zmd,false) AS b, CASE WHEN coalesce(mac>cmd AND z>zmd,false) THEN gm ELSE 1.0 END AS g, rc, rk FROM fb JOIN (VALUES ('25',0.25),('50',0.5)) q(gi,gm) ON trial_id LIKE '%f25' LEFT JOIN gg ON gg.midx=fb.midx),
 y AS (SELECT *, f*g AS sh, coalesce(abs(f*g-lag(f*g) OVER w),0) AS t1 FROM x WINDOW w AS (PARTITION BY trial_id ORDER BY midx)), a AS (SELECT trial_id, b, sh*rc+(1-sh)*rk-t1*5/10000-rc AS active FROM y)
SELECT trial_id, CASE WHEN b THEN 'gated' ELSE 'open' END AS state, avg(active) AS mean, avg(CASE WHEN active>0 THEN 1.0 ELSE 0.0 END) AS hit, count(*) AS n FROM a GROUP BY ALL""")
def b06s(v):
    v.shared("px_d")
    return B.state_table(corr_book(v), F.when(F.coalesce("binding", F.lit(False)), "gated").otherwise("open"))


# ------------------------------------------------------------------ left-tail overlay
TAIL = """tn AS (SELECT midx, r, row_number() OVER (ORDER BY midx) AS rn FROM cm), tq AS (SELECT t.midx, t.rn, quantile_cont(u.r,0.05) AS thr, count(*) AS n FROM tn t JOIN tn u ON u.rn BETWEEN t.rn-23 AND t.rn GROUP BY ALL),
 tc AS (SELECT tq.midx, CASE WHEN any_value(tq.n)>=3 THEN -avg(CASE WHEN u.r<=thr THEN u.r END) END AS cvar_5 FROM tq JOIN tn u ON u.rn BETWEEN tq.rn-23 AND tq.rn GROUP BY ALL), tg AS (SELECT *, quantile_cont(cvar_5,0.5) OVER (ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM tc)"""


@query("b07_left_tail_overlay", "trial_id midx:i f:f g:f net:f net_null:f", f"""WITH {BOOK}, {TAIL}, x AS (SELECT trial_id||'_g'||gi AS trial_id, fb.midx, f, CASE WHEN coalesce(cvar_5>med,false) THEN gm ELSE 1.0 END AS g, rc, rk FROM fb JOIN (VALUES ('25',0.25),('50',0.5)) q(gi,gm) ON trial_id LIKE '%f25' LEFT JOIN tg ON tg.midx=fb.midx),
 y AS (SELECT *, f*g AS sh, coalesce(abs(f*g-lag(f*g) OVER w),0) AS t1, coalesce(abs(f-lag(f) OVER w),0) AS t2 FROM x WINDOW w AS (PARTITION BY trial_id ORDER BY midx))
SELECT trial_id, midx, f, g, sh*rc+(1-sh)*rk-t1*5/10000 AS net, f*rc+(1-f)*rk-t2*5/10000 AS net_null FROM y""")
def b07(v):
    v.shared("px_d")
    core, cash = monthly_core(v)
    trials = B.grid(vt_trials(v).where("f_min = 0.25"), g_min=[0.25, 0.5]).withColumn("trial_id", F.format_string("%s_g%.0f", "trial_id", F.col("g_min") * 100))
    return B.scaled_core_returns(sigma(v), trials, core, cash, B.left_tail_gate(core, 24, [0.25, 0.5]), gate_keys=["g_min"])


def kernel_books(v, kernels, cov=None):
    """Weights of several kernels on one covariance table, keyed by strategy."""
    return A.allocate_many(QA.lw_cov(v) if cov is None else cov, ["midx"], kernels)


def _equal(c):
    return [1.0 / len(c)] * len(c)


NULLS = {"equal_weight": _equal, "minvar_lw": K.min_variance, "erc": K.equal_risk}


@query("b07_null_books", "strategy n:i cagr:f vol:f sharpe_rf0:f maxdd:f")
def b07n(v):
    v.shared("ret_b")
    w = kernel_books(v, NULLS)
    return B.performance(B.run_book(w, v.ret_b, ["strategy"]), ["strategy"], "midx", "net")


# ------------------------------------------------------------------ panel allocators
@query("b08_panel_allocators", "strategy n:i cagr:f vol:f sharpe_rf0:f maxdd:f turnover:f")
def b08(v):
    v.shared("ret_b")
    w = kernel_books(v, NULLS | {"inverse_variance": lambda c: (1.0 / c.diagonal()) / (1.0 / c.diagonal()).sum()})
    book = stage(B.run_book(w, v.ret_b, ["strategy"]))
    from panelspark.operators.panel import common_periods
    book = common_periods(book.where("net is not null"), "strategy", "midx")
    return B.performance(book, ["strategy"], "midx", "net").join(book.groupBy("strategy").agg(F.avg("turnover").alias("turnover")), "strategy")


EWB = f"""{QA.LIVE}, w AS (SELECT midx, key, 1.0/count(*) OVER (PARTITION BY midx) AS weight FROM lv), g AS (SELECT w.midx, CASE WHEN count(*)=count(n.ret) THEN sum(weight*n.ret) END AS gross FROM w LEFT JOIN ret_b n ON n.key=w.key AND n.midx=w.midx+1 GROUP BY w.midx),
 t AS (SELECT coalesce(a.midx,b.nx) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS turnover FROM w a FULL JOIN (SELECT w.*, x.nx FROM w JOIN (SELECT midx, lead(midx) OVER (ORDER BY midx) AS nx FROM (SELECT DISTINCT midx FROM w)) x USING (midx) WHERE x.nx IS NOT NULL) b ON a.key=b.key AND a.midx=b.nx GROUP BY 1)"""


@query("b08_equal_weight_book", "midx:i gross:f turnover:f net:f", f"WITH {EWB} SELECT midx, gross, turnover, gross-turnover*5/10000 AS net FROM g JOIN t USING (midx)")
def b08e(v):
    v.shared("ret_b")
    w = L.equal_weight(QA.live(v), ["midx"]).select("midx", "key", "weight").withColumn("strategy", F.lit("ew"))
    return B.run_book(w, v.ret_b, ["strategy"])


# ------------------------------------------------------------------ weekly windows
def weekly(v):
    week = F.date_add(F.date_trunc("week", "date").cast("date"), 4)
    d = v.ret_d.where("ret is not null").groupBy("key", week.alias("week")).agg((F.product(1.0 + F.col("ret")) - 1.0).alias("ret"))
    return d.withColumn("widx", F.floor(F.datediff("week", F.lit("1990-01-05").cast("date")) / 7).cast("int"))


def weekly_cov(v, lookback=52, linear=True):
    """Covariances of the 52 weeks that end at or before each month end."""
    w = weekly(v)
    live = P.live_names(w, lookback, lookback, 3, idx="widx")
    last = w.where(F.col("week") <= F.last_day("week")).groupBy(F.trunc("week", "MM").alias("month")).agg(F.max("widx").alias("widx"))
    live = live.join(last, "widx")
    e = V.window_entries(live, w, lookback, idx="widx")
    if linear:
        e = V.shrunk(e, V.shrinkage_intensity(live, w, e, lookback, idx="widx"), "widx")
    return e.join(last, "widx").withColumn("midx", (F.year("month") * 12 + F.month("month")).cast("int"))


def monthly_types(v):
    me = C.month_end_values(v.px_d, ["key"], "date", ["price"]).withColumn("midx", (F.year("month") * 12 + F.month("month")).cast("int"))
    return me.select("key", "midx", (F.col("price") / F.lag("price").over(W.by("key", order="midx")) - 1.0).alias("ret"))


@query("b10_weekly_min_variance", "strategy n:i cagr:f vol:f sharpe_rf0:f maxdd:f eff_n_mean:f")
def b10(v):
    v.shared("px_d")
    w = stage(kernel_books(v, NULLS, weekly_cov(v)).unionByName(kernel_books(v, {"minvar_sample": K.min_variance}, weekly_cov(v, linear=False))))
    book = B.run_book(w, monthly_types(v), ["strategy"])
    return B.performance(book, ["strategy"], "midx", "net").join(L.concentration(w, ["strategy"], "midx").select("strategy", "eff_n_mean"), "strategy")


TREND = f"""{QA.LIVE}, tx AS (SELECT key, midx, CASE WHEN count(ex) OVER p = 11 THEN exp(sum(ln(1+ex)) OVER p)-1 END AS mom FROM (SELECT key, r.midx, ret-rate AS ex FROM ret_b r JOIN rates USING (month)) WINDOW p AS (PARTITION BY key ORDER BY midx RANGE BETWEEN 11 PRECEDING AND 1 PRECEDING)),
 ti AS (SELECT lv.midx, key, (1/greatest(sd,1e-8))/sum(1/greatest(sd,1e-8)) OVER (PARTITION BY lv.midx) AS a, mom > 0 AND sd > 0 AS up FROM lv LEFT JOIN tx USING (key, midx)), tt AS (SELECT *, sum(CASE WHEN up THEN a ELSE 0 END) OVER (PARTITION BY midx) AS t FROM ti),
 bw AS (SELECT 'anchor_w'||lpad(CAST(s AS VARCHAR), 3, '0') AS id, midx, key, (s*a + (100-s)*CASE WHEN t > 0 THEN CASE WHEN up THEN a ELSE 0 END/t ELSE a END)/100 AS weight FROM tt, (VALUES (0),(50),(75),(100)) g(s))"""
COSTS = (5, 10, 25)


def anchor_trend(v):
    """Inverse-volatility anchor, the anchor filtered by trend, and blends of both."""
    v.shared("ret_b")
    x = stage(QA.trend_inputs(v))
    anchor = x.select("midx", "key", F.col("anchor").alias("weight"))
    trend = L.trend_filtered(x.withColumn("weight", F.col("anchor")), ["midx"], "signal").select("midx", "key", "weight")
    both = anchor.withColumnRenamed("weight", "a").join(trend.withColumnRenamed("weight", "t"), ["midx", "key"])
    both = both.withColumn("s", F.explode(F.array(*[F.lit(k) for k in (0, 50, 75, 100)])))
    return both.select("midx", "key", ((F.col("s") * F.col("a") + (100 - F.col("s")) * F.col("t")) / 100.0).alias("weight"), F.format_string("anchor_w%03d", "s").alias("trial_id"))


def stressed(book):
    """The same book at three costs a side."""
    d = book.withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in COSTS])))
    return d.withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10000.0)


ANCHOR = f"""WITH {TREND}, {BS.book_sql('bk', 'bw', 'ret_b')}, nb AS (SELECT id, midx, cost_bps, gross-turnover*cost_bps/10000 AS net FROM bk, (VALUES {', '.join(f'({c})' for c in COSTS)}) c(cost_bps))"""


@query("b11_anchor_trend_book", "trial_id cost_bps:i n:i cagr:f vol:f maxdd:f", f"{ANCHOR}, {BS.performance_sql('pf', 'nb', 'id, cost_bps')} SELECT id AS trial_id, cost_bps, n, cagr, vol, maxdd FROM pf")
def b11(v):
    """Anchor, trend-filtered anchor and their blends, with drifted turnover and a cost stress."""
    return B.performance(stressed(B.run_book(anchor_trend(v), v.ret_b, ["trial_id"], baseline="drifted")), ["trial_id", "cost_bps"], "midx", "net")


@query("b11_anchor_trend_periods", "trial_id period n:i cagr:f vol:f maxdd:f beats_anchor:b", f"""{ANCHOR}, md AS (SELECT median(midx) AS m FROM (SELECT DISTINCT midx FROM nb WHERE net IS NOT NULL)),
 sp AS (SELECT id, 'full' AS period, midx, net FROM nb WHERE cost_bps=5 UNION ALL SELECT id, CASE WHEN midx <= m THEN 'first half' ELSE 'second half' END, midx, net FROM nb, md WHERE cost_bps=5), {BS.performance_sql('pf', 'sp', 'id, period')}
SELECT p.id AS trial_id, p.period, p.n, p.cagr, p.vol, p.maxdd, p.id <> 'anchor_w100' AND p.sharpe_rf0 > a.sharpe_rf0 AS beats_anchor FROM pf p JOIN pf a ON a.period=p.period AND a.id='anchor_w100'""")
def b11p(v):
    """Both halves of the calendar, and whether a blend is better than the anchor alone in each: eligible if in all."""
    book = stage(B.run_book(anchor_trend(v), v.ret_b, ["trial_id"], baseline="drifted").where("net is not null").select("trial_id", "midx", "net"))
    mid = book.select("midx").distinct().agg(F.percentile("midx", F.lit(0.5))).scalar()
    both = book.withColumn("period", F.explode(F.array(F.lit("full"), F.when(F.col("midx") <= mid, "first half").otherwise("second half"))))
    p = stage(B.performance(both, ["trial_id", "period"], "midx", "net"))
    a = p.where("trial_id = 'anchor_w100'").select("period", F.col("sharpe_rf0").alias("own"))
    return p.join(a, "period").withColumn("beats_anchor", (F.col("trial_id") != "anchor_w100") & (F.col("sharpe_rf0") > F.col("own")))


CAPW = f"""{QA.LIVE}, src AS (SELECT 'inverse_vol' AS id, midx, key, (1/greatest(sd,1e-8))/sum(1/greatest(sd,1e-8)) OVER (PARTITION BY midx) AS weight, equity_only AS flag FROM lv JOIN uni_b USING (key)
  UNION ALL SELECT 'equal_weight', midx, key, 1.0/count(*) OVER (PARTITION BY midx), equity_only FROM lv JOIN uni_b USING (key)), {QW.frozen_sql('src', 'id, midx', 0.30, 0.06)}, bw AS (SELECT id, midx, k AS key, w AS weight FROM fz)"""


def capped_books(v, w):
    """Books under a group cap of 30 % and a name cap of 6 %, with what the caps did."""
    w = stage(w.join(v.uni_b.select("key", F.col("equity_only").alias("flag")), "key"))
    c = stage(L.capped_frozen(w, ["strategy", "midx"], "flag", 0.06, 0.30, "binding"))
    caps = L.cap_report(w, c, ["strategy", "midx"], "flag", "binding")
    caps = caps.groupBy("strategy").agg(((F.max("largest_post") <= 0.06 + 1e-8) & (F.max("share_post") <= 0.30 + 1e-8)).alias("cap_ok"), F.count_if("group_binds").alias("group_bound"), F.count_if(F.col("names_bound") != "").alias("names_bound"))
    book = B.run_book(c.select("strategy", "midx", "key", "weight"), v.ret_b, ["strategy"], baseline="drifted")
    return B.performance(book, ["strategy"], "midx", "net").join(L.concentration(c, ["strategy"], "midx").select("strategy", "eff_n_mean"), "strategy").join(caps, "strategy")


@query("b12_capped_book", "strategy n:i cagr:f vol:f maxdd:f eff_n_mean:f cap_ok:b group_bound:i names_bound:i", f"""WITH RECURSIVE {CAPW}, {BS.book_sql('bk', 'bw', 'ret_b')}, {BS.performance_sql('pf', 'bk')}, ef AS (SELECT id, avg(e) AS eff_n_mean FROM (SELECT id, midx, 1/sum(weight*weight) AS e FROM bw GROUP BY ALL) GROUP BY id),
 cp AS (SELECT id, max(mx) <= 0.06+1e-8 AND max(sh) <= 0.30+1e-8 AS cap_ok, count(*) FILTER (g) AS group_bound, count(*) FILTER (b) AS names_bound FROM (SELECT id, midx, max(w) AS mx, sum(CASE WHEN f THEN w ELSE 0 END) AS sh, any_value(gb) AS g, bool_or(n) AS b FROM fz GROUP BY ALL) GROUP BY id)
SELECT id AS strategy, n, cagr, vol, maxdd, eff_n_mean, cap_ok, group_bound, names_bound FROM pf JOIN ef USING (id) JOIN cp USING (id)""")
def b12(v):
    v.shared("ret_b")
    d = stage(P.live_names(v.ret_b, QA.LB, QA.LB, 5).select("midx", "key", "sd"))
    w = L.inverse_vol(d, ["midx"], "sd").withColumn("strategy", F.lit("inverse_vol")).unionByName(L.equal_weight(d, ["midx"]).withColumn("strategy", F.lit("equal_weight")))
    return capped_books(v, w.select("strategy", "midx", "key", "weight"))


@query("b12_capped_optimisers", "strategy n:i cagr:f vol:f maxdd:f eff_n_mean:f cap_ok:b group_bound:i names_bound:i")
def b12k(v):
    """Minimum variance and equal risk under the same caps."""
    v.shared("ret_b")
    return capped_books(v, kernel_books(v, {"minvar_lw": K.min_variance, "erc": K.equal_risk}))


# ------------------------------------------------------------------ comparison and gates
def _weighted(v, scheme: str):
    live = QW.live(v)
    w = L.equal_weight(live, ["midx"]) if scheme == "equal" else L.inverse_vol(live, ["midx"], "sigma")
    book = B.run_book(w.select("midx", "key", "weight", F.lit(scheme).alias("id")), v.ret_s, ["id"], missing="skip")
    return book.select("midx", F.col("net").alias("ret"))


def _core(v, trial: str, column: str):
    return vt_book(v).where(F.col("trial_id") == trial).select("midx", F.col(column).alias("ret"))


STRATEGIES = [G.Strategy("equal_weight", _weighted, {"scheme": "equal"}), G.Strategy("inverse_vol", _weighted, {"scheme": "inverse"}),
              G.Strategy("scaled_core", _core, {"trial": "L63_f25", "column": "net"}), G.Strategy("static_core", _core, {"trial": "L63_f25", "column": "r_core"}),
              G.Strategy("slow_core", _core, {"trial": "L252_f25", "column": "net"}, enabled=False)]


def all_books(v):
    """One (id, midx, ret) table of the enabled strategies, by return month."""
    return G.run_enabled(v, STRATEGIES)


CMP = f"""{BOOK}, {QW.SIG}, lw_ AS (SELECT midx, key, 1.0/count(*) OVER (PARTITION BY midx) AS e, (1/sigma)/sum(1/sigma) OVER (PARTITION BY midx) AS i FROM sg_ WHERE n=24)""".replace("sg AS (SELECT r.key", "sg_ AS (SELECT r.key")
CMPS = CMP + """, wl2 AS (SELECT 'equal_weight' AS id, midx, key, e AS weight FROM lw_ UNION ALL SELECT 'inverse_vol', midx, key, i FROM lw_), gr AS (SELECT id, wl2.midx, sum(weight*n.ret) AS gross FROM wl2 LEFT JOIN ret_s n ON n.key=wl2.key AND n.midx=wl2.midx+1 GROUP BY ALL),
 nx AS (SELECT id, midx, lead(midx) OVER (PARTITION BY id ORDER BY midx) AS nx FROM (SELECT DISTINCT id, midx FROM wl2)), pw AS (SELECT wl2.id, nx AS midx, key, weight FROM wl2 JOIN nx ON nx.id=wl2.id AND nx.midx=wl2.midx WHERE nx IS NOT NULL),
 tv AS (SELECT coalesce(a.id,b.id) AS id, coalesce(a.midx,b.midx) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS tn FROM wl2 a FULL JOIN pw b ON a.id=b.id AND a.midx=b.midx AND a.key=b.key GROUP BY 1,2),
 al AS (SELECT id, midx, gross-tn*5/10000 AS ret FROM gr JOIN tv USING (id, midx) WHERE gross IS NOT NULL UNION ALL SELECT 'scaled_core', midx, net FROM bk WHERE trial_id='L63_f25' UNION ALL SELECT 'static_core', midx, rc FROM bk WHERE trial_id='L63_f25'),
 co AS (SELECT * FROM al WHERE midx IN (SELECT midx FROM al GROUP BY midx HAVING count(DISTINCT id)=4))"""


@query("b15_registry_comparison", "id n:i cagr:f vol:f sharpe_ex:f maxdd:f nw_t:f", f"""WITH {CMPS}, s AS (SELECT a.id, a.midx AS month, a.ret-b.ret AS x FROM co a JOIN co b ON b.id='static_core' AND a.midx=b.midx WHERE a.id<>'static_core'), {QI.NW.format(k='id')},
 w AS (SELECT id, midx, ret, ret-rate AS ex, exp(sum(ln(1+ret)) OVER (PARTITION BY id ORDER BY midx)) AS wl FROM co LEFT JOIN rates USING (midx)), q AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY id ORDER BY midx))-1 AS dd FROM w),
 a AS (SELECT id, count(*) AS n, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, stddev_samp(ret)*sqrt(12) AS vol, avg(ex)*12/(stddev_samp(ex)*sqrt(12)) AS sharpe_ex, min(dd) AS maxdd FROM q GROUP BY id)
SELECT a.*, mean/se AS nw_t FROM a LEFT JOIN nw USING (id)""")
def b15(v):
    v.shared("px_d", "ret_s")
    return B.compare(stage(all_books(v)), "static_core", rate_idx(v), 4)


@query("b16_shared_universe_gate", "strategy n:i outside:i", f"""WITH {QA.LIVE}, w AS (SELECT s AS strategy, midx, cash_like AS bad FROM lv JOIN uni_b USING (key), (VALUES ('equal_weight'),('erc'),('minvar_lw')) t(s) WHERE NOT cash_like),
 p AS (SELECT strategy, bad FROM w UNION ALL SELECT 'erc', true FROM (SELECT DISTINCT midx FROM w) d JOIN uni_b ON cash_like WHERE d.midx % 10 = 0) SELECT strategy, count(*) AS n, count(*) FILTER (bad) AS outside FROM p GROUP BY strategy""")
def b16(v):
    """Method and nulls see one filtered panel; holdings outside it are counted.  Every tenth decision of one book gets the tagged
    names back, which the gate has to find."""
    v.shared("ret_b")
    panel = P.drop_tagged(v.ret_b, v.uni_b, ["cash_like"])
    cov = V.linear_shrinkage(P.live_names(panel, QA.LB, QA.LB, 5), panel, QA.LB)
    w = stage(kernel_books(v, NULLS, cov))
    tagged = v.uni_b.where("cash_like").select("key", F.lit("erc").alias("strategy"))
    planted = w.where("strategy = 'erc' and midx % 10 = 0").select("strategy", "midx").distinct().join(tagged, "strategy").withColumn("weight", F.lit(0.01))
    w = w.unionByName(planted)
    bad = Q.outside_holdings(w, panel.select("key").distinct(), ["strategy"]).groupBy("strategy").agg(F.sum("n").alias("outside"))
    return w.groupBy("strategy").agg(F.count("*").alias("n")).join(bad, "strategy", "left").fillna(0, ["outside"])


@query("b17_score_ranked_book", "midx:i gross:f turnover:f net:f", f"""WITH {QS.SC}, {QW.PICK}, src AS (SELECT midx, key, flag, 1.0/count(*) OVER (PARTITION BY midx) AS weight FROM pk WHERE pick <= 8), {QW.cap_sql('src', 'midx', 20, 0.15, 0.40, 0.25)},
 wb AS (SELECT midx, key, w/sum(w) OVER (PARTITION BY midx) AS weight FROM c20), gr AS (SELECT wb.midx, CASE WHEN count(*)=count(n.ret) THEN sum(weight*n.ret) END AS gross FROM wb LEFT JOIN ret_s n ON n.key=wb.key AND n.midx=wb.midx+1 WHERE weight<>0 GROUP BY wb.midx),
 tv AS (SELECT coalesce(a.midx,b.midx+1) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS turnover FROM wb a FULL JOIN (SELECT * FROM wb WHERE midx<(SELECT max(midx) FROM wb)) b ON a.key=b.key AND a.midx=b.midx+1 GROUP BY 1)
SELECT midx, gross, turnover, gross-turnover*5/10000 AS net FROM gr JOIN tv USING (midx)""")
def b17(v):
    v.shared("px_s")
    return B.run_book(QW.l09(v).withColumn("strategy", F.lit("score")), v.ret_s, ["strategy"])


@query("b18_grid_expansion", "key lookback:i f_min:f g_min:f", "SELECT key, lookback, f_min, g_min FROM uni_b, (VALUES (21),(63),(252)) a(lookback), (VALUES (0.25),(0.5)) b(f_min), (VALUES (0.25),(0.5)) c(g_min)")
def b18(v):
    return B.grid(v.uni_b.select("key"), lookback=[21, 63, 252], f_min=[0.25, 0.5], g_min=[0.25, 0.5])


@query("x03_strategy_registry", "name digest enabled:b months:i", f"""WITH {CMPS}, g(name, params, enabled) AS (VALUES ('equal_weight', '{{"scheme":"equal"}}', true), ('inverse_vol', '{{"scheme":"inverse"}}', true), ('scaled_core', '{{"column":"net","trial":"L63_f25"}}', true),
 ('static_core', '{{"column":"r_core","trial":"L63_f25"}}', true), ('slow_core', '{{"column":"net","trial":"L252_f25"}}', false))
SELECT name, substr(sha256(params),1,12) AS digest, enabled, (SELECT count(ret) FROM al WHERE id=name) AS months FROM g""")
def x03(v):
    """Every entry with the hash of its parameters, and the months that its book has when it runs."""
    v.shared("px_d", "ret_s")
    n = all_books(v).groupBy(F.col("id").alias("name")).agg(F.count("ret").alias("months"))
    return G.catalogue(v.spark, STRATEGIES).join(n, "name", "left").fillna(0, ["months"])


@query("x04_rolling_product", "series_id month:d ret_12:f", "SELECT series_id, month, CASE WHEN count(*) OVER w=12 THEN exp(sum(ln(1+ret)) OVER w)-1 END AS ret_12 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS 11 PRECEDING)")
def x04(v):
    return v.series.select("series_id", "month", W.rolling_compound("ret", W.by("series_id", order="month"), 12).alias("ret_12"))
