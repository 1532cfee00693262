"""Verification queries: universe gates, filters, calendars and joins."""
from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.functions.scalar import attach_one
from panelspark.functions.scalar import month_idx, ratio, within_printed
from panelspark.functions.stats import safe_corr
from panelspark.operators import calendar as C, panel as P, windows as W

_HOL = """((m=1 AND (dd=1 OR (dd=2 AND dow=1))) OR (m=1 AND dow=1 AND dd BETWEEN 15 AND 21 AND y>=1998) OR (m=2 AND dow=1 AND dd BETWEEN 15 AND 21)
 OR (m=5 AND dow=1 AND dd>=25) OR (m=9 AND dow=1 AND dd<=7) OR (m=11 AND dow=4 AND dd BETWEEN 22 AND 28)
 OR (strftime(d,'%m-%d') IN ('07-04','12-25')) OR (dow=5 AND strftime(d+1,'%m-%d') IN ('07-04','12-25')) OR (dow=1 AND strftime(d-1,'%m-%d') IN ('07-04','12-25'))
 OR strftime(d,'%Y-%m-%d') IN ('2001-09-11','2001-09-12','2001-09-13','2001-09-14')
 OR d IN (DATE '1995-04-14',DATE '1996-04-05',DATE '1997-03-28',DATE '1998-04-10',DATE '1999-04-02',DATE '2000-04-21',DATE '2001-04-13'))"""
CAL = f"""cal AS (SELECT d, NOT {_HOL} AND dow NOT IN (0,6) AS is_session, {_HOL} AS is_holiday FROM (SELECT d, year(d) y, month(d) m, day(d) dd, dayofweek(d) dow FROM
 (SELECT CAST(unnest(generate_series(date_trunc('month', min(l_shipdate)), CAST(last_day(CAST(max(l_shipdate) AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM lineitem)))"""


def calendar(v):
    b = v.table("lineitem").agg(F.trunc(F.min("l_shipdate"), "MM").alias("a"), F.last_day(F.max("l_shipdate")).alias("b"))
    return C.sessions(C.date_range(b, "a", "b"))


@query("f04_exchange_holidays", "date:d is_session:b is_holiday:b", f"WITH {CAL} SELECT d AS date, is_session, is_holiday FROM cal")
def f04(v):
    return calendar(v).withColumn("is_holiday", C.is_holiday("date"))


@query("f05_last_session", "month:d last_session:d direct:d", f"""WITH {CAL} SELECT CAST(date_trunc('month', d) AS DATE) AS month,
 max(d) AS last_session, max(d) AS direct FROM cal WHERE is_session GROUP BY 1""")
def f05(v):
    return C.last_sessions(calendar(v)).withColumn("direct", C.last_session_of("month"))


@query("p09_drop_partial_month", "month:d rows:i", """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS rows FROM lineitem
 WHERE date_trunc('month', l_shipdate) < (SELECT CASE WHEN max(l_shipdate) < TIMESTAMP '2001-11-30' THEN date_trunc('month', max(l_shipdate)) ELSE TIMESTAMP '9999-01-01' END FROM lineitem) GROUP BY 1""")
def p09(v):
    d = v.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return C.drop_partial_month(d, "date").groupBy(F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("rows"))


@query("p10_complete_months_simple", "month:d rows:i", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS rows FROM orders
 WHERE date_trunc('month', o_orderdate) < (SELECT date_trunc('month', max(o_orderdate)) FROM orders) GROUP BY 1""")
def p10(v):
    d = v.table("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return C.complete_months_simple(d, "date").groupBy(F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("rows"))


@query("p01_eligible_universe", "key category", """SELECT key, category FROM uni_s WHERE approved AND section NOT ILIKE 'appendix%3' AND key NOT IN (SELECT key FROM deny_s)
 AND key NOT IN (SELECT 'S'||CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)""")
def p01(v):
    neg = v.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("key"))
    return P.eligible(v.uni_s, [v.deny_s, neg])


@query("p02_gate_reasons", "key reason", """SELECT key, CASE WHEN key IN (SELECT key FROM deny_s) THEN 'deny list' WHEN NOT approved THEN 'not approved' ELSE 'excluded section' END AS reason
 FROM uni_s WHERE key IN (SELECT key FROM px_s) AND (key IN (SELECT key FROM deny_s) OR NOT approved OR section = 'Appendix 3')""")
def p02(v):
    return P.ineligible_reasons(v.px_s, v.uni_s, v.deny_s)


@query("p03_tag_selection", "tag n:i", """SELECT tag, count(*) AS n FROM (SELECT unnest(['cash_like','short_duration','near_cash','equity_only']) AS tag,
 unnest([cash_like, short_duration, near_cash, equity_only]) AS hit FROM uni_s) WHERE hit GROUP BY tag""")
def p03(v):
    tags = ["cash_like", "short_duration", "near_cash", "equity_only"]
    return v.uni_s.unpivot("key", tags, "tag", "hit").where("hit").groupBy("tag").agg(F.count("*").alias("n"))


@query("p04_drop_tagged", "key n:i", """SELECT key, count(ret) AS n FROM ret_s JOIN uni_s USING (key) WHERE NOT (cash_like OR short_duration) GROUP BY key""")
def p04(v):
    return P.drop_tagged(v.ret_s, v.uni_s, ["cash_like", "short_duration"]).groupBy("key").agg(F.count("ret").alias("n"))


@query("p05_set_valued_rule", "key", "SELECT key FROM uni_s WHERE asset_class='equity' AND NOT cash_like AND NOT short_duration AND NOT near_cash")
def p05(v):
    return v.uni_s.where("asset_class = 'equity' and not cash_like and not short_duration and not near_cash")


@query("p06_asof_cut", "key n:i last:d", "SELECT key, count(*) AS n, max(date) AS last FROM px_d WHERE date <= DATE '1999-06-15' GROUP BY key")
def p06(v):
    return v.px_d.where("date <= '1999-06-15'").groupBy("key").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("p07_history_filter", "key month:d n:i", """SELECT * FROM (SELECT key, month, count(ret) OVER (PARTITION BY key ORDER BY midx) AS n FROM ret_s) WHERE n >= 36""")
def p07(v):
    return v.ret_s.withColumn("n", F.count("ret").over(W.by("key", order="midx"))).where("n >= 36")


@query("p08_live_names", "key midx:i n_window:i n_history:i n_live:i sd:f", """
WITH a AS (SELECT key, midx, count(ret) OVER w AS n_window, stddev_samp(ret) OVER w AS sd, count(ret) OVER (PARTITION BY key ORDER BY midx) AS n_history
 FROM ret_s WINDOW w AS (PARTITION BY key ORDER BY midx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT *, count(*) OVER (PARTITION BY midx) AS n_live FROM a WHERE n_window=24 AND sd > 1e-10 AND n_history >= 30 QUALIFY n_live >= 5""")
def p08(v):
    return P.live_names(v.ret_s, 24, 30, 5)


@query("p08_name_counts", "midx:i n_eligible:i below_floor:b skipped:b", """
WITH a AS (SELECT key, midx, count(ret) OVER w AS n_window, stddev_samp(ret) OVER w AS sd, count(ret) OVER (PARTITION BY key ORDER BY midx) AS n_history
 FROM ret_s WINDOW w AS (PARTITION BY key ORDER BY midx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT midx, n, n < 5, n < 5 FROM (SELECT midx, count(*) FILTER (n_window=24 AND sd > 1e-10 AND n_history >= 30) AS n FROM a GROUP BY midx) t(midx, n)""".replace("n < 5, n < 5", "n AS n_eligible, n < 5 AS below_floor, n < 5 AS skipped").replace("midx, n, n AS", "midx, n AS"))
def p08n(v):
    return P.name_counts(v.ret_s, 24, 30, 5)


@query("p11_period_window", "key n:i", "SELECT key, count(*) AS n FROM ret_s WHERE month BETWEEN DATE '1997-01-01' AND DATE '1998-12-01' GROUP BY key")
def p11(v):
    return v.ret_s.where("month between '1997-01-01' and '1998-12-01'").groupBy("key").agg(F.count("*").alias("n"))


@query("p12_complete_keys", "key n_obs:i", "SELECT key, count(ret) AS n_obs FROM ret_s JOIN uni_s USING (key) GROUP BY key, thin ORDER BY thin, n_obs DESC, key LIMIT 20")
def p12(v):
    return P.select_complete_keys(v.ret_s, v.uni_s, 20)


@query("p13_signed_features", "key neg_vol:f neg_maxdd:f", """
SELECT key, -stddev_samp(ret)*sqrt(12) AS neg_vol, min(dd) AS neg_maxdd FROM (SELECT key, ret, price/max(price) OVER (PARTITION BY key ORDER BY midx)-1 AS dd FROM ret_s JOIN px_s USING (key, month, midx)) GROUP BY key""")
def p13(v):
    w = W.by("key", order="midx")
    d = v.px_s.withColumn("ret", W.simple_return("price", w, "midx"))
    d = d.withColumn("dd", F.col("price") / F.max("price").over(w.rowsBetween(W.UNB, 0)) - 1.0)
    return d.groupBy("key").agg((-F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("neg_vol"), F.min("dd").alias("neg_maxdd"))


@query("p14_unpriced_next", "key month:d", """SELECT a.key, a.month FROM ret_s a LEFT JOIN ret_s n ON n.key=a.key AND n.midx=a.midx+1
 WHERE a.ret IS NOT NULL AND n.ret IS NULL AND a.midx < (SELECT max(midx) FROM ret_s)""")
def p14(v):
    last = v.ret_s.agg(F.max("midx")).scalar()
    d = C.next_period(v.ret_s, ["key"], "midx", "ret", "next")
    return d.where(F.col("ret").isNotNull() & F.col("next").isNull() & (F.col("midx") < last))


@query("p15_facet_search", "key name category", """SELECT key, name, category FROM uni_s WHERE asset_class='bond' AND contains(lower(concat_ws(' ', key, name, category, asset_class)), 's1')""")
def p15(v):
    text = F.lower(F.concat_ws(" ", "key", "name", "category", "asset_class"))
    return v.uni_s.where((F.col("asset_class") == "bond") & F.contains(text, F.lit("s1")))


@query("p16_weight_labels", "strategy date key weight:8 label", """SELECT strategy, month AS date, key, weight, strategy||' '||CAST(month AS VARCHAR) AS label FROM weights WHERE weight > 0""")
def p16(v):
    return v.weights.where("weight > 0").select("strategy", F.date_format("month", "yyyy-MM-dd").alias("date"), "key", "weight",
                                                F.format_string("%s %s", "strategy", F.date_format("month", "yyyy-MM-dd")).alias("label"))


# ------------------------------------------------------------------ joins
@query("j01_excess_return", "key month:d excess:f", "SELECT a.key, a.month, a.ret-b.ret AS excess FROM ret_s a JOIN ret_s b ON b.key='S1' AND a.month=b.month WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL")
def j01(v):
    return P.excess_over(v.ret_s, "S1")


@query("j02_attach_rate", "series_id month:d ex:f source", "SELECT series_id, month, ret-rate AS ex, source FROM series LEFT JOIN rates USING (month)")
def j02(v):
    return P.attach_rate(v.series, v.rates, required=True).withColumn("ex", F.col("ret") - F.col("rate"))


@query("j03_next_label", "key month:d label:f", """SELECT a.key, a.month, n.ret - b.ret AS label FROM ret_s a LEFT JOIN ret_s n ON n.key=a.key AND n.midx=a.midx+1 LEFT JOIN ret_s b ON b.key='S1' AND b.midx=a.midx+1""")
def j03(v):
    d = C.next_period(v.ret_s, ["key"], "midx", "ret", "next")
    b = v.ret_s.where("key = 'S1'").select((F.col("midx") - 1).alias("midx"), F.col("ret").alias("bench"))
    return d.join(b, "midx", "left").withColumn("label", F.col("next") - F.col("bench"))


@query("j03_nearest_prior_label", "decision:d month:d key label:f", """WITH p AS (SELECT month, lead(month) OVER (ORDER BY month) AS nxt FROM (SELECT DISTINCT month FROM ret_b)), d AS (SELECT DISTINCT CAST(date_trunc('quarter', month) + INTERVAL 40 DAY AS DATE) AS decision FROM ret_b)
SELECT d.decision, p.month, r.key, r.ret AS label FROM d ASOF JOIN p ON d.decision >= p.month JOIN ret_b r ON r.month = p.nxt""")
def j03n(v):
    """Decisions that are no panel dates take the last panel date before them."""
    v.shared("ret_b")
    d = v.ret_b.select(F.date_add(F.date_trunc("quarter", "month").cast("date"), 40).alias("decision")).distinct()
    return C.next_label(d, v.ret_b, "decision", "month", "ret")


@query("j04_asof_join", "key as_of:d log_price:f price_date:d", """WITH l AS (SELECT DISTINCT key, CAST(date_trunc('month', date) + INTERVAL 14 DAY AS DATE) AS as_of FROM px_d)
SELECT l.key, l.as_of, ln(p.price) AS log_price, p.date AS price_date FROM l ASOF LEFT JOIN px_d p ON l.key=p.key AND l.as_of >= p.date""")
def j04(v):
    left = v.px_d.select("key", F.date_add(F.trunc("date", "MM"), 14).alias("as_of")).distinct()
    return C.asof_join(left, v.px_d, ["key"], "as_of", "date", ["price"], "price_date").withColumn("log_price", F.ln("price"))


@query("j05_latest_prior_row", "trial_id month:d value:f value_month:d", """WITH o AS (SELECT * FROM series WHERE month(month) IN (1,4,7,10))
SELECT trial_id, t.month, o.ret AS value, o.month AS value_month FROM (SELECT *, split_part(trial_id,'_R',1) AS series_id FROM trial_ret) t
ASOF LEFT JOIN o ON t.series_id=o.series_id AND t.month >= o.month""")
def j05(v):
    left = v.trial_ret.withColumn("series_id", F.split("trial_id", "_R")[0]).select("trial_id", "series_id", "month")
    right = v.series.where(F.month("month").isin(1, 4, 7, 10)).withColumnRenamed("ret", "value")
    return C.asof_join(left, right, ["series_id"], "month", "month", ["value"], "value_month")


@query("j06_announced_interval", "series_id month:d decision:d regime:i", """SELECT series_id, month, decision, CASE WHEN (month BETWEEN DATE '1990-07-01' AND DATE '1991-03-01' AND decision > DATE '1992-12-22')
 OR (month BETWEEN DATE '2001-03-01' AND DATE '2001-11-01' AND decision > DATE '2003-07-17') THEN 1 ELSE 0 END AS regime
FROM series, (VALUES (DATE '2001-12-31'), (DATE '2003-12-31')) d(decision)""")
def j06(v):
    d = v.series.withColumn("decision", F.explode(F.array(F.lit("2001-12-31").cast("date"), F.lit("2003-12-31").cast("date"))))
    return d.withColumn("regime", C.announced_regime("month", "decision"))


@query("j07_look_through", "strategy month:d key weight:8", """WITH w AS (SELECT strategy, month, CASE WHEN n_nationkey%2=0 THEN r_name ELSE n_name END AS k, weight FROM weights JOIN nation ON key=n_name JOIN region ON n_regionkey=r_regionkey)
SELECT strategy, month, coalesce(c.key, k) AS key, sum(weight*coalesce(within, 1)) AS weight FROM w LEFT JOIN constituents c ON k=sleeve GROUP BY ALL""")
def j07(v):
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = v.weights.join(n, v.weights["key"] == n["n_name"]).select(
        "strategy", "month", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("key"), "weight")
    return P.look_through(w, v.constituents, ["strategy", "month"])


@query("j07_dated_look_through", "strategy month:d key weight:8", """WITH w AS (SELECT strategy, month, midx, CASE WHEN n_nationkey%2=0 THEN r_name ELSE n_name END AS k, weight FROM weights JOIN nation ON key=n_name JOIN region ON n_regionkey=r_regionkey),
 m AS (SELECT d.midx, r_name AS sleeve, n_name AS key, 1.0::DOUBLE/count(*) OVER (PARTITION BY d.midx, r_name) AS within FROM (SELECT DISTINCT midx FROM weights) d, nation JOIN region ON n_regionkey=r_regionkey WHERE (n_nationkey//5+d.midx)%5<>0)
SELECT strategy, month, coalesce(m.key, k) AS key, sum(weight*coalesce(within, 1)) AS weight FROM w LEFT JOIN m ON k=sleeve AND m.midx=w.midx GROUP BY ALL""")
def j07d(v):
    """Membership changes from month to month."""
    v.shared("weights")
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = v.weights.join(n, v.weights["key"] == n["n_name"]).select(
        "strategy", "month", "midx", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("key"), "weight")
    months = F.array_sort(F.collect_set("midx"))  # the calendar
    dated = attach_one(n, v.weights.agg(months.alias("all"))).select(F.col("r_name").alias("sleeve"), F.col("n_name").alias("key"), "n_nationkey", F.explode("all").alias("midx"))
    dated = dated.where((F.floor(F.col("n_nationkey") / 5) + F.col("midx")) % 5 != 0)
    size = dated.groupBy("sleeve", "midx").agg(F.count("*").alias("k"))
    c = dated.join(size, ["sleeve", "midx"]).select("sleeve", "key", "midx", (1.0 / F.col("k")).alias("within"))
    return P.look_through(w, c, ["strategy", "month"], period="midx")


@query("j08_dimension_lookup", "key category n:i", """SELECT p.key, coalesce(category,'Unknown') AS category, count(*) AS n FROM px_s p LEFT JOIN (SELECT * FROM uni_s WHERE NOT thin) u USING (key) GROUP BY ALL""")
def j08(v):
    n = v.px_s.groupBy("key").agg(F.count("*").alias("n"))
    return n.join(v.uni_s.where(~F.col("thin")).select("key", "category"), "key", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))


@query("j09_common_calendar", "trial_id month:d ret:f", """SELECT trial_id, month, ret FROM trial_ret WHERE month IN (SELECT month FROM trial_ret GROUP BY month HAVING count(DISTINCT trial_id)=(SELECT count(DISTINCT trial_id) FROM trial_ret))""")
def j09(v):
    return P.common_periods(v.trial_ret, "trial_id", "month")


def pairs_vs(v, base="AUTOMOBILE"):
    """Every other series against one null series."""
    return v.series.select(F.col("series_id").alias("a")).distinct().where(F.col("a") != base).withColumn("b", F.lit(base))


@query("j10_pair_alignment", "a b n:i diff:f", "SELECT s.series_id AS a, t.series_id AS b, count(*) AS n, sum(s.ret-t.ret) AS diff FROM series s JOIN series t USING (month) WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE' GROUP BY ALL")
def j10(v):
    return P.aligned_pairs(v.series, pairs_vs(v)).groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("y")).alias("diff"))


@query("j11_pair_correlation", "k1 k2 n:i corr:f cov:f", """SELECT a.key AS k1, b.key AS k2, count(*) AS n, corr(a.ret, b.ret) AS corr, covar_samp(a.ret, b.ret) AS cov FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL""")
def j11(v):
    return P.pair_returns(v.ret_b, []).groupBy("k1", "k2").agg(F.count("*").alias("n"), safe_corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"))


@query("j12_lead_lag", "a b lag:i corr:f n:i", """SELECT s.series_id AS a, t.series_id AS b, t.midx-s.midx AS lag, corr(s.ret, t.ret) AS corr, count(*) AS n FROM series s JOIN series t ON t.midx BETWEEN s.midx-5 AND s.midx+5 WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE' GROUP BY ALL""")
def j12(v):
    return P.lead_lag(v.series, pairs_vs(v), range(-5, 6), "series_id", "midx")


@query("j13_weights_times_returns", "strategy month:d ret:f", "SELECT w.strategy, w.month, sum(w.weight*n.ret) AS ret FROM weights w JOIN nation_ret n ON n.key=w.key AND n.midx=w.midx+1 GROUP BY ALL")
def j13(v):
    r = v.nation_ret.select("key", (F.col("midx") - 1).alias("midx"), "ret")
    return v.weights.join(r, ["key", "midx"]).groupBy("strategy", "month").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


@query("j14_weight_changes", "strategy midx:i key w_now:8 w_prev:8 dw:8", """SELECT coalesce(a.strategy,b.strategy) AS strategy, coalesce(a.midx,b.midx+1) AS midx, coalesce(a.key,b.key) AS key, coalesce(a.weight,0) AS w_now, coalesce(b.weight,0) AS w_prev,
 coalesce(a.weight,0)-coalesce(b.weight,0) AS dw FROM weights a FULL JOIN (SELECT * FROM weights WHERE midx < (SELECT max(midx) FROM weights)) b ON a.strategy=b.strategy AND a.key=b.key AND a.midx=b.midx+1""")
def j14(v):
    return P.weight_changes(v.weights, ["strategy"], "midx")


@query("j15_reconciliation", "key value:f printed ok:b", """WITH a AS (SELECT key, avg(ret) AS value FROM ret_s GROUP BY key), b AS (SELECT key, value, CASE WHEN CAST(substr(key,2) AS BIGINT)%3=0 THEN format('{:.3f}', round(value+0.01,3)) ELSE format('{:.3f}', round(value,3)) END AS printed FROM a)
SELECT key, value, printed, abs(value-CAST(printed AS DOUBLE)) <= 0.0005+1e-9 AS ok FROM b""")
def j15(v):
    a = v.ret_s.groupBy("key").agg(F.avg("ret").alias("value"))
    off = F.when(F.substring("key", 2, 20).cast("bigint") % 3 == 0, 0.01).otherwise(0.0)
    d = a.withColumn("printed", F.format_string("%.3f", F.round(F.col("value") + off, 3)))
    return d.withColumn("ok", within_printed("value", "printed"))


@query("j16_panel_gap", "key gap:4 gap_at:d one_sided:i", """WITH a AS (SELECT key, month, price AS x FROM px_s), b AS (SELECT key, month, avg(l_extendedprice/l_quantity) AS y FROM (SELECT 'S'||CAST(l_suppkey AS VARCHAR) AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, * FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-10-01') GROUP BY ALL),
d AS (SELECT key, month, abs(coalesce(x,0)-coalesce(y,0)) AS gap, (x IS NULL)<>(y IS NULL) AS o FROM a FULL JOIN b USING (key, month))
SELECT key, max(gap) AS gap, arg_max(month, gap) AS gap_at, count(*) FILTER (o) AS one_sided FROM d GROUP BY key""")
def j16(v):
    b = v.table("lineitem").where("l_shipdate < timestamp '2001-10-01'").groupBy(
        F.concat(F.lit("S"), "l_suppkey").alias("key"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return P.panel_gap(v.px_s, b, ["key", "month"], "price")


@query("j17_semi_anti", "month:d n_in:i n_out:i", """SELECT month, count(*) FILTER (key IN (SELECT key FROM deny_s)) AS n_in, count(*) FILTER (key NOT IN (SELECT key FROM deny_s)) AS n_out FROM px_s GROUP BY month""")
def j17(v):
    a = v.px_s.join(v.deny_s, "key", "left_semi").groupBy("month").agg(F.count("*").alias("n_in"))
    b = v.px_s.join(v.deny_s, "key", "left_anti").groupBy("month").agg(F.count("*").alias("n_out"))
    return a.join(b, "month", "full").fillna(0, ["n_in", "n_out"])


@query("j18_summary_enrichment", "strategy mean:f n_keys:i cash_share:f", """WITH r AS (SELECT w.strategy, w.month, sum(w.weight*n.ret) AS ret FROM weights w JOIN nation_ret n ON n.key=w.key AND n.midx=w.midx+1 GROUP BY ALL)
SELECT strategy, mean, n_keys, cash_share FROM (SELECT strategy, avg(ret) AS mean FROM r GROUP BY 1) JOIN (SELECT strategy, count(DISTINCT key) AS n_keys, sum(CASE WHEN cash_like THEN weight ELSE 0 END)/count(DISTINCT month) AS cash_share FROM weights JOIN uni_n USING (key) GROUP BY 1) USING (strategy)""")
def j18(v):
    m = j13(v).groupBy("strategy").agg(F.avg("ret").alias("mean"))
    c = v.weights.join(v.uni_n, "key").groupBy("strategy").agg(
        F.count_distinct("key").alias("n_keys"), ratio(F.sum(F.when(F.col("cash_like"), F.col("weight")).otherwise(0.0)), F.count_distinct("month")).alias("cash_share"))
    return m.join(c, "strategy")


@query("w18_rolling_pair_corr", "midx:i mean_abs_corr:f pairs:i", """WITH p AS (SELECT a.midx, a.key AS k1, b.key AS k2, a.ret AS x, b.ret AS y FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
c AS (SELECT midx, CASE WHEN count(*) OVER w >= 3 THEN covar_samp(x,y) OVER w/nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END AS corr FROM p WINDOW w AS (PARTITION BY k1,k2 ORDER BY midx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT midx, avg(abs(corr)) AS mean_abs_corr, count(corr) AS pairs FROM c GROUP BY midx""")
def w18(v):
    return P.mean_abs_corr(P.rolling_pair_corr(P.pair_returns(v.ret_b, []), [], 12), ["midx"])
