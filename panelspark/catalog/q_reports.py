"""Verification queries: report tables."""
from pyspark.sql import Window, functions as F

from panelspark.catalog import q_inference as QI, q_panel as QP, q_scores as QS
from panelspark.catalog.base import query
from panelspark.catalog.q_books import vt_book, BOOK
from panelspark.functions import text as N
from panelspark.functions.scalar import pct_text
from panelspark.functions.stats import deflated_sharpe_normal, safe_corr
from panelspark.operators import inference as I, panel as P, quality as Q, scores as S, windows as W
from panelspark.plans import reports as R

COM = "co AS (SELECT * FROM trial_ret WHERE month IN (SELECT month FROM trial_ret GROUP BY month HAVING count(DISTINCT trial_id)=(SELECT count(DISTINCT trial_id) FROM trial_ret)))"
PERF = """w AS (SELECT {k}, month, ret, rate, source, exp(sum(ln(1+ret)) OVER (PARTITION BY {k} ORDER BY month)) AS wl FROM {src} LEFT JOIN rates USING (month)), q AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY {k} ORDER BY month))-1 AS dd FROM w),
 pf AS (SELECT {k}, count(*) AS n, min(month) AS start, max(month) AS end_month, exp(sum(ln(1+ret)))-1 AS total, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, stddev_samp(ret)*sqrt(12) AS vol, min(dd) AS maxdd, avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS sharpe_ex,
  avg(CASE WHEN source='fallback' THEN 1.0 ELSE 0.0 END) AS fallback_share FROM q GROUP BY {k})"""


@query("r01_window_table", "trial_id n:i start:d end_month:d cagr:f vol:f sharpe_ex:f sharpe_rf0:f maxdd:f fallback_share:f", f"WITH {COM}, {PERF.format(k='trial_id', src='co')} SELECT *, cagr/vol AS sharpe_rf0 FROM pf")
def r01(v):
    return R.window_table(v.trial_ret, v.rates, "trial_id")


H2H = """p AS (SELECT s.series_id AS a, s.month, s.ret AS x, t.ret AS y FROM series s JOIN series t USING (month) WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE'),
 sd AS (SELECT a, 'a' AS side, month, x AS ret FROM p UNION ALL SELECT a, 'b', month, y FROM p), wl AS (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY a, side ORDER BY month)) AS wl FROM sd), dd AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY a, side ORDER BY month))-1 AS dd FROM wl),
 st AS (SELECT a, side, count(*) AS n, exp(sum(ln(1+ret)))-1 AS total, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, min(dd) AS maxdd, avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)) AS sharpe FROM dd JOIN rates USING (month) GROUP BY ALL)"""


@query("r02_head_to_head", "a b n:i total_diff:f cagr_diff:f maxdd_diff:f sharpe_diff:f nw_t:f p_two_sided:f detectable_gap:f", f"""WITH {H2H}, s AS (SELECT a, month, x-y AS x FROM p), {QI.NW.format(k='a')}
SELECT a, 'AUTOMOBILE' AS b, s1.n, s1.total-s2.total AS total_diff, s1.cagr-s2.cagr AS cagr_diff, s1.maxdd-s2.maxdd AS maxdd_diff, s1.sharpe-s2.sharpe AS sharpe_diff, mean/se AS nw_t, 2*(1-{QI.cdf_sql('abs(mean/se)')}) AS p_two_sided, ({QI.ppf_sql('0.95')}+{QI.ppf_sql('0.8')})*se*12 AS detectable_gap
FROM st s1 JOIN st s2 USING (a) JOIN nw USING (a) WHERE s1.side='a' AND s2.side='b'""")
def r02(v):
    return R.head_to_head(P.aligned_pairs(v.series, QP.pairs_vs(v)), v.rates)


@query("r03_subject_profile", "trial_id block month:d value:f", """WITH w AS (SELECT trial_id, month, exp(sum(ln(1+ret)) OVER o) AS wl, CASE WHEN count(*) OVER k=12 THEN exp(sum(ln(1+ret)) OVER k)-1 END AS r12 FROM trial_ret WINDOW o AS (PARTITION BY trial_id ORDER BY month), k AS (PARTITION BY trial_id ORDER BY month ROWS 11 PRECEDING)),
 d AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY trial_id ORDER BY month))-1 AS dd FROM w)
SELECT trial_id, 'curve' AS block, month, wl AS value FROM d UNION ALL SELECT trial_id, 'drawdown', month, dd FROM d UNION ALL SELECT trial_id, 'rolling_12', month, r12 FROM d WHERE r12 IS NOT NULL
UNION ALL SELECT trial_id, 'year', CAST(date_trunc('year', month) AS DATE), exp(sum(ln(1+ret)))-1 FROM trial_ret GROUP BY ALL""")
def r03(v):
    return R.subject_profile(v.trial_ret, "trial_id")


STRESS = (("spring_1994", 1994 * 12 + 2, 1994 * 12 + 6), ("year_1996", 1996 * 12 + 1, 1996 * 12 + 12), ("late_1997", 1997 * 12 + 7, 1998 * 12 + 3))
COMMON, BOOKS = (1993 * 12 + 6, 1997 * 12 + 12), (1995 * 12 + 1, 1998 * 12 + 6)
CORE = "AUTOMOBILE_R0"
SIDES = f"""core AS (SELECT midx, ret AS core FROM trial_ret WHERE trial_id='{CORE}'), sd AS (SELECT t.trial_id, t.midx, year(t.month) AS yr, t.ret, t.ret-rate AS ex, core, core-rate AS cx FROM trial_ret t JOIN core USING (midx) JOIN rates USING (month)),
 mk AS (SELECT midx, avg(ret) AS ret FROM trial_ret GROUP BY midx), ms AS (SELECT *, exp(sum(ln(1+ret)) OVER (ORDER BY midx)) AS wl, CASE WHEN count(*) OVER w = 12 THEN stddev_samp(ret) OVER w*sqrt(12) END AS vol FROM mk WINDOW w AS (ORDER BY midx ROWS 11 PRECEDING)),
 st AS (SELECT midx, CASE WHEN dd > -0.05 THEN 'Up' WHEN dd > -0.20 THEN 'Correction' ELSE 'Bear' END AS dd_state, CASE WHEN vol > med THEN 'High vol' WHEN vol IS NOT NULL THEN 'Low vol' END AS vol_state FROM (SELECT *, wl/greatest(1.0, max(wl) OVER (ORDER BY midx))-1 AS dd, quantile_cont(vol, 0.5) OVER () AS med FROM ms))"""


def _sides(v):
    """Subject and core returns, also over the rate, on the months with both."""
    core = v.trial_ret.where(F.col("trial_id") == CORE).select("midx", F.col("ret").alias("core"))
    d = v.trial_ret.join(core, "midx").join(v.rates.select("month", "rate"), "month")
    return d.select("trial_id", "month", "midx", "ret", (F.col("ret") - F.col("rate")).alias("ex"), "core", (F.col("core") - F.col("rate")).alias("core_ex"))


def _market_states(v):
    w = Window.orderBy("midx")  # one row per month
    m = W.drawdown(v.trial_ret.groupBy("midx").agg(F.avg("ret").alias("ret")).withColumn("vol", W.trailing_vol("ret", w, 12, 12.0)), w)
    med = m.agg(F.percentile("vol", F.lit(0.5))).scalar()
    return m.select("midx", W.drawdown_state("dd").alias("dd_state"), F.when(F.col("vol") > med, "High vol").when(F.col("vol").isNotNull(), "Low vol").alias("vol_state"))


@query("r03_window_blocks", "trial_id block span months:i total:f cagr:f vol:f sharpe:f core_total:f total_diff:f beta:f corr:f", f"""WITH {SIDES}, wm AS (
 SELECT 'own' AS block, 'all' AS span, midx FROM mk UNION ALL SELECT 'common', 'common', midx FROM mk WHERE midx BETWEEN {COMMON[0]} AND {COMMON[1]} UNION ALL SELECT 'books', 'books', midx FROM mk WHERE midx BETWEEN {BOOKS[0]} AND {BOOKS[1]}
 UNION ALL SELECT DISTINCT 'year', CAST(yr AS VARCHAR), midx FROM sd UNION ALL SELECT 'drawdown_state', dd_state, midx FROM st UNION ALL SELECT 'vol_state', vol_state, midx FROM st WHERE vol_state IS NOT NULL
 UNION ALL SELECT 'stress', s.n, midx FROM mk JOIN (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in STRESS)}) s(n, a, b) ON midx BETWEEN a AND b)
SELECT trial_id, block, span, count(*) AS months, exp(sum(ln(1+ret)))-1 AS total, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, stddev_samp(ret)*sqrt(12) AS vol, CASE WHEN count(*) >= 12 THEN avg(ex)*12/nullif(stddev_samp(ex)*sqrt(12), 0) END AS sharpe,
 exp(sum(ln(1+core)))-1 AS core_total, exp(sum(ln(1+ret)))-exp(sum(ln(1+core))) AS total_diff, covar_samp(ret, core)/nullif(var_samp(core), 0) AS beta, covar_samp(ret, core)/nullif(stddev_samp(ret)*stddev_samp(core), 0) AS corr FROM sd JOIN wm USING (midx) GROUP BY ALL""")
def r03w(v):
    """Own, common, books, calendar-year, regime and stress blocks of every subject against the core, from one set of running sums."""
    v.shared("trial_ret")
    s = _sides(v)
    span = v.trial_ret.agg(F.min("midx").alias("start"), F.max("midx").alias("stop")).select(F.lit("own").alias("block"), F.lit("all").alias("window"), "start", "stop")
    fixed = v.rows("block string, window string, start int, stop int", ("common", "common", *COMMON), ("books", "books", *BOOKS), *[("stress", *x) for x in STRESS])
    years = v.trial_ret.select(F.year("month").alias("y")).distinct().select(F.lit("year").alias("block"), F.col("y").cast("string").alias("window"), (F.col("y") * 12 + 1).alias("start"), (F.col("y") * 12 + 12).alias("stop"))
    m = _market_states(v)
    windows = span.unionByName(fixed).unionByName(years).unionByName(R.state_windows(m, "drawdown_state", "dd_state")).unionByName(R.state_windows(m, "vol_state", "vol_state"))
    return R.window_stats(s, windows, "trial_id").withColumnRenamed("window", "span")


@query("r03_curves_vs_core", "trial_id block midx:i value:f", f"""WITH {SIDES}, c AS (SELECT *, exp(sum(ln(1+ret)) OVER o) AS growth, exp(sum(ln(1+core)) OVER o) AS core_growth, CASE WHEN count(*) OVER y = 12 THEN exp(sum(ln(1+ret)) OVER y)-exp(sum(ln(1+core)) OVER y) END AS rolling_excess,
  CASE WHEN count(*) OVER z = 36 THEN avg(ex) OVER z*12/nullif(stddev_samp(ex) OVER z*sqrt(12), 0) END AS rs, CASE WHEN count(*) OVER z = 36 THEN avg(cx) OVER z*12/nullif(stddev_samp(cx) OVER z*sqrt(12), 0) END AS rc
  FROM sd WINDOW o AS (PARTITION BY trial_id ORDER BY midx), y AS (PARTITION BY trial_id ORDER BY midx ROWS 11 PRECEDING), z AS (PARTITION BY trial_id ORDER BY midx ROWS 35 PRECEDING)),
 d AS (SELECT *, core_growth/greatest(1.0, max(core_growth) OVER (PARTITION BY trial_id ORDER BY midx))-1 AS core_drawdown FROM c),
 u AS (SELECT trial_id, unnest(['growth','core_growth','cumulative_excess','rolling_excess','core_drawdown','rolling_sharpe','core_rolling_sharpe','rolling_sharpe_diff']) AS block, midx, unnest([growth, core_growth, growth-core_growth, rolling_excess, core_drawdown, rs, rc, rs-rc]) AS value FROM d)
SELECT * FROM u WHERE value IS NOT NULL""")
def r03c(v):
    v.shared("trial_ret")
    return R.curves_vs_core(_sides(v), "trial_id")


def _board(v):
    from panelspark.plans.books import performance
    rows = performance(v.trial_ret.select(F.col("trial_id").alias("id"), "month", "ret"), ["id"], "month", "ret").select("id", "cagr", "maxdd", "n")
    void = v.trial_ret.where(F.col("trial_id").endswith("_R4")).select(F.col("trial_id").alias("id"))
    return R.leaderboard(rows, "cagr", "AUTOMOBILE_R0", void)


LB = """WITH a AS (SELECT trial_id AS id, count(*) AS n, pow(exp(sum(ln(1+ret))), 12.0/count(*))-1 AS cagr, trial_id LIKE '%\\_R4' ESCAPE '\\' AS void, trial_id='AUTOMOBILE_R0' AS is_benchmark FROM trial_ret GROUP BY 1)
SELECT *, CASE WHEN NOT void AND NOT is_benchmark THEN row_number() OVER (PARTITION BY (NOT void AND NOT is_benchmark) ORDER BY cagr DESC, id) END AS rank FROM a"""


@query("r04_leaderboard", "id n:i cagr:f void:b is_benchmark:b rank:i", LB)
def r04(v):
    return _board(v)


@query("t06_ranked_board", "id rank:i void:b", LB)
def t06(v):
    return _board(v)


BANDS = "bd AS (SELECT key, CASE WHEN cash_like OR short_duration OR near_cash THEN 'Cash-like' ELSE upper(asset_class[1:1])||asset_class[2:] END AS band FROM uni_n)"


@query("r05_composition_bands", "strategy month:d band weight:8", f"""WITH {BANDS} SELECT m.strategy, m.month, b.band, coalesce(sum(w.weight),0) AS weight FROM (SELECT DISTINCT strategy, month FROM weights) m CROSS JOIN (VALUES ('Cash-like'),('Equity'),('Bond'),('Commodity')) b(band)
 LEFT JOIN (SELECT weights.*, band AS bnd FROM weights JOIN bd USING (key)) w ON w.strategy=m.strategy AND w.month=m.month AND w.bnd=b.band GROUP BY 1,2,3""")
def r05(v):
    bands = v.uni_n.select("key", N.band(F.col("cash_like") | F.col("short_duration") | F.col("near_cash"), "asset_class").alias("band"))
    return R.band_series(v.weights, bands, ["strategy"], "month", ["Cash-like", "Equity", "Bond", "Commodity"])


def corrections(v):
    """Known bad values: the recorded return of each series in two months, one of them no longer matching."""
    d = v.series.where("month in ('1999-03-01', '2000-07-01')")
    shift = F.when(F.month("month") == 7, 0.5).otherwise(0.0)
    return d.select("series_id", "month", (F.col("ret") + shift).alias("bad"), (F.col("ret") / 2).alias("good"))


FIX = """f AS (SELECT series_id, month, CASE WHEN month=DATE '1999-03-01' THEN 'replaced' WHEN month=DATE '2000-07-01' THEN 'dropped' ELSE 'kept' END AS action, CASE WHEN month=DATE '1999-03-01' THEN ret/2 WHEN month=DATE '2000-07-01' THEN NULL ELSE ret END AS ret FROM series)"""


@query("r06_correction_splice", "series_id month:d ret:f action", f"WITH {FIX} SELECT * FROM f")
def r06(v):
    return R.apply_corrections(v.series, corrections(v))


@query("r07_restatement", "series_id n_old:i n_new:i changed:i total_old:f total_new:f vol_old:f vol_new:f", f"""WITH {FIX} SELECT s.series_id, count(s.ret) AS n_old, count(f.ret) AS n_new, count(*) FILTER (s.ret IS DISTINCT FROM f.ret) AS changed, exp(sum(ln(1+s.ret)))-1 AS total_old, exp(sum(ln(1+f.ret)))-1 AS total_new,
 stddev_samp(s.ret)*sqrt(12) AS vol_old, stddev_samp(f.ret)*sqrt(12) AS vol_new FROM series s JOIN f USING (series_id, month) GROUP BY 1""")
def r07(v):
    return R.restatement(v.series, r06(v))


@query("r08_chart_tables", "trial_id midx:i log_equity:f drawdown:f f:f latest:b", f"""WITH {BOOK}, w AS (SELECT trial_id, midx, f, exp(sum(ln(1+net)) OVER (PARTITION BY trial_id ORDER BY midx)) AS equity, midx=max(midx) OVER (PARTITION BY trial_id) AS latest FROM bk)
SELECT trial_id, midx, ln(equity) AS log_equity, equity/greatest(1.0, max(equity) OVER (PARTITION BY trial_id ORDER BY midx))-1 AS drawdown, f, latest FROM w""")
def r08(v):
    v.shared("px_d")
    w = Window.partitionBy("trial_id").orderBy("midx")
    d = W.drawdown(vt_book(v), w, "net")
    return d.select("trial_id", "midx", F.ln("wealth").alias("log_equity"), F.col("dd").alias("drawdown"), "f", (F.lead("midx").over(w).isNull()).alias("latest"))


@query("r09_universe_catalogue", "key issuer display category thin:b listed:b pos:i", """WITH n AS (SELECT key, num, category, thin, 'spdr supplier '||num AS nm FROM uni_s), c AS (SELECT key, min(month) AS start FROM px_s GROUP BY key)
SELECT n.key, CASE WHEN num%9=4 THEN 'other' ELSE 'state_street' END AS issuer, 'Spdr Supplier '||num||' ETF' AS display, category, thin, start IS NOT NULL AS listed, row_number() OVER (ORDER BY num%7=0 DESC, n.key) AS pos FROM n LEFT JOIN c USING (key)""")
def r09(v):
    d = v.uni_s.join(v.coverage_s.select("key", "start"), "key", "left")
    raw = F.concat(F.lit("SPDR SUPPLIER "), F.col("num").cast("string"), F.lit(" ETF"))
    d = d.withColumns({"raw": raw, "issuer": F.when(F.col("num") % 9 == 4, "other").otherwise(N.classify(raw)), "display": N.clean_name(raw), "listed": F.col("start").isNotNull()})
    return S.global_rank(d.withColumn("short", F.col("cash_like").cast("double")), "short", "key", "pos")


@query("r10_correlation_matrix", "k1 k2 corr:f n:i", "SELECT a.key AS k1, b.key AS k2, corr(a.ret, b.ret) AS corr, count(*) AS n FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<>b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL")
def r10(v):
    return R.matrix_with_counts(v.ret_b, "key", "midx")


@query("r10_explorer_series", "key date:d excess:f wealth:f dd:f", """WITH l AS (SELECT key, date, ln(price/lag(price) OVER w) AS lr, row_number() OVER w AS i FROM px_d WINDOW w AS (PARTITION BY key ORDER BY date)), c AS (SELECT date, count(*) OVER (PARTITION BY date_trunc('month', date)) AS n FROM (SELECT DISTINCT date FROM px_d)),
 x AS (SELECT l.*, lr - ln(1+rate)/n AS excess, 100*exp(sum(coalesce(lr,0)) OVER (PARTITION BY key ORDER BY l.date)) AS wealth FROM l JOIN c USING (date) LEFT JOIN rates ON rates.month=date_trunc('month', l.date))
SELECT key, date, excess, wealth, wealth/greatest(100, max(wealth) OVER (PARTITION BY key ORDER BY date))-1 AS dd FROM x""")
def r10s(v):
    v.shared("px_d")
    w = W.by("key", order="date")
    cal = v.px_d.select("date").distinct()
    rate = W.daily_rate(cal, cal.select("date", F.lit(None).cast("double").alias("own")).unionByName(
        cal.agg(F.date_add(F.max("date"), 1).alias("date")).withColumn("own", F.lit(0.0))), v.rates).select("date", "daily")
    d = v.px_d.withColumn("lr", W.log_return("price", w)).join(rate, "date").withColumn("excess", F.col("lr") - F.col("daily"))
    d = d.withColumn("wealth", 100 * F.exp(F.sum(F.coalesce("lr", F.lit(0.0))).over(w.rowsBetween(W.UNB, 0))))
    peak = F.greatest(F.lit(100.0), F.max("wealth").over(w.rowsBetween(W.UNB, 0)))
    return d.withColumn("dd", F.col("wealth") / peak - 1.0)


@query("r11_weekly_vs_monthly", "key vol_week:f vol_month:f diff:f", """WITH wk AS (SELECT key, stddev_samp(r)*sqrt(52) AS vw FROM (SELECT key, date_trunc('week', date) AS w, exp(sum(ln(1+ret)))-1 AS r FROM ret_d WHERE ret IS NOT NULL GROUP BY ALL) GROUP BY key),
 mo AS (SELECT key, stddev_samp(r)*sqrt(12) AS vm FROM (SELECT key, p/lag(p) OVER (PARTITION BY key ORDER BY m)-1 AS r FROM (SELECT key, date_trunc('month', date) AS m, arg_max(price, date) AS p FROM px_d GROUP BY ALL)) GROUP BY key)
SELECT key, vw AS vol_week, vm AS vol_month, vw-vm AS diff FROM wk JOIN mo USING (key)""")
def r11(v):
    v.shared("px_d")
    from panelspark.catalog.q_books import monthly_types, weekly
    a = weekly(v).groupBy("key").agg((F.stddev_samp("ret") * F.sqrt(F.lit(52.0))).alias("vol_week"))
    b = monthly_types(v).groupBy("key").agg((F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("vol_month"))
    return a.join(b, "key").withColumn("diff", F.col("vol_week") - F.col("vol_month"))


@query("r12_published_figures", "book region sharpe_text:f total:f n:i", """SELECT split_part(trial_id,'_R',1) AS book, split_part(trial_id,'_R',2) AS region, round(avg(ret-rate)*12/(stddev_samp(ret-rate)*sqrt(12)), 2) AS sharpe_text, exp(sum(ln(1+ret)))-1 AS total, count(*) AS n FROM trial_ret JOIN rates USING (month) GROUP BY ALL""")
def r12(v):
    """Wide per-book columns, as published, turned back to one row per (book, column)."""
    from panelspark.plans.books import performance
    from panelspark.sources.io import pivot_keys
    d = v.trial_ret.select(F.split("trial_id", "_R")[0].alias("book"), F.split("trial_id", "_R")[1].alias("region"), "month", "ret")
    regions = pivot_keys(v.table("region"), "r_regionkey")
    wide = d.groupBy("book", "month").pivot("region", regions).agg(F.first("ret"))
    long = wide.unpivot(["book", "month"], regions, "region", "ret").where("ret is not null")
    p = performance(long, ["book", "region"], "month", "ret", v.rates.select("month", "rate"))
    return p.withColumn("sharpe_text", F.round("sharpe_ex", 2))


DSR = f"""t AS (SELECT trial_id, count(*) AS n, avg(ret-rate)/stddev_samp(ret-rate) AS sr FROM trial_ret JOIN rates USING (month) GROUP BY 1), z AS (SELECT trial_id, (sr-{QI.ppf_sql('0.96')}/sqrt(n-1))*sqrt(n-1) AS z, (sr*sqrt(12)-{QI.ppf_sql('0.96')}/sqrt(n-1))*sqrt(n-1) AS za FROM t)"""


def dsr_rows(v):
    t = QI.trial_stats(v)
    rec = t.select("trial_id", deflated_sharpe_normal(F.col("sr") * F.sqrt(F.lit(12.0)), "n", F.lit(25)).alias("recorded"))
    new = t.where(~F.col("trial_id").endswith("_R3")).select("trial_id", deflated_sharpe_normal("sr", "n", F.lit(25)).alias("corrected"))
    return R.recompute_lookup(rec, new)


@query("r13_dsr_recompute", "trial_id recorded:f corrected:f shown:f rule", f"""WITH {DSR} SELECT trial_id, {QI.cdf_sql('za')} AS recorded, CASE WHEN trial_id NOT LIKE '%R3' THEN {QI.cdf_sql('z')} END AS corrected, CASE WHEN trial_id LIKE '%R3' THEN {QI.cdf_sql('za')} ELSE {QI.cdf_sql('z')} END AS shown,
 CASE WHEN trial_id LIKE '%R3' THEN 'recorded' ELSE 'corrected' END AS rule FROM z""")
def r13(v):
    return dsr_rows(v)


@query("q13_gate_rows", "id gate status", f"""WITH {DSR} SELECT trial_id AS id, 'dsr' AS gate, CASE WHEN CASE WHEN trial_id LIKE '%R3' THEN {QI.cdf_sql('za')} ELSE {QI.cdf_sql('z')} END >= 0.95 THEN 'pass' ELSE 'fail' END AS status FROM z
 UNION ALL SELECT trial_id, 'timing', 'pass' FROM trial_ret GROUP BY 1 UNION ALL SELECT trial_id, 'complete', CASE WHEN count(*)=(SELECT count(DISTINCT month) FROM trial_ret) THEN 'pass' ELSE 'fail' END FROM trial_ret GROUP BY 1""")
def q13(v):
    dsr = dsr_rows(v).select(F.col("trial_id").alias("id"), F.when(F.col("shown") >= 0.95, "pass").otherwise("fail").alias("status"))
    t = v.trial_ret.select(F.col("trial_id").alias("id"), F.add_months("month", -1).alias("d"), "month")
    timing = Q.timing_audit(t, ["id"], "d", "d", "month", "month")
    full = Q.completeness(v.trial_ret, "trial_id", "month", "ret").select(F.col("trial_id").alias("id"), F.when(F.col("missing") == 0, "pass").otherwise("fail").alias("status"))
    return R.gate_rows(dsr=dsr, timing=timing, complete=full)
