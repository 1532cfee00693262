"""Verification queries: scalar functions, sources and data-quality rules."""
from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.catalog.q_portfolio import odd_weights
from panelspark.functions import scalar as X, text as N
from panelspark.operators import calendar as C, panel as P, portfolio as L, quality as Q, windows as W
from panelspark.sources import io as S


# ------------------------------------------------------------------ scalar functions
@query("f01_key_normalisation", "raw key", "SELECT raw, upper(trim(raw)) AS key FROM (SELECT '  '||lower(c_name)||' ' AS raw FROM customer)")
def f01(v):
    return v.table("customer").select(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("raw")).withColumn("key", X.norm_key("raw"))


@query("f02_month_keys", "d:d month:d month_end:d midx:i", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, last_day(CAST(l_shipdate AS DATE)) AS month_end, year(l_shipdate)*12+month(l_shipdate) AS midx FROM lineitem")
def f02(v):
    d = v.table("lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return d.select("d", X.month_of("d").alias("month"), F.last_day("d").alias("month_end"), X.month_idx("d").alias("midx"))


@query("f03_iso_dates", "iso n:i", "SELECT strftime(ts, '%Y-%m-%d') AS iso, count(*) AS n FROM events GROUP BY 1")
def f03(v):
    return v.table("events").groupBy(X.iso("ts").alias("iso")).agg(F.count("*").alias("n"))


@query("f06_strict_boolean", "txt flag:b n:i", "SELECT txt, txt IN ('TRUE','1') AS flag, count(*) AS n FROM (SELECT CASE quality WHEN 1 THEN CASE WHEN doc_id%2=0 THEN 'TRUE' ELSE '1' END ELSE CASE WHEN doc_id%2=0 THEN 'False' ELSE '0' END END AS txt FROM labels) GROUP BY 1")
def f06(v):
    even = F.col("doc_id") % 2 == 0
    txt = F.when(F.col("quality") == 1, F.when(even, "TRUE").otherwise("1")).otherwise(F.when(even, "False").otherwise("0"))
    return v.table("labels").groupBy(txt.alias("txt")).agg(F.count("*").alias("n")).withColumn("flag", X.strict_bool("txt"))


@query("f07_issuer_rules", "key issuer", """WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey, CASE p_partkey%6 WHEN 0 THEN 'Vanguard '||p_name WHEN 1 THEN 'iShares '||p_name WHEN 2 THEN 'SPDR '||p_name WHEN 3 THEN 'Inv '||p_name WHEN 4 THEN 'The JPMorgan '||p_name ELSE p_name END AS n FROM part)
SELECT key, CASE WHEN key IN ('7','13') THEN 'other' WHEN p_partkey%6=0 THEN 'vanguard' WHEN p_partkey%6=1 THEN 'blackrock' WHEN p_partkey%6=2 THEN 'state_street' WHEN p_partkey%6=3 THEN 'invesco' WHEN p_partkey%6=4 THEN 'jpm' ELSE 'other' END AS issuer FROM a""")
def f07(v):
    pre = F.element_at(F.array(*[F.lit(x) for x in ("Vanguard ", "iShares ", "SPDR ", "Inv ", "The JPMorgan ", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    d = v.table("part").select(F.col("p_partkey").cast("string").alias("key"), F.concat(pre, "p_name").alias("n"))
    return N.classify_with_overrides(d, "key", "n", v.rows("key string, code string", ("7", "other"), ("13", "other")))


@query("f08_name_cleaning", "key cleaned", """WITH a AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, string_split(p_name,' ') AS p FROM part)
SELECT key, CASE WHEN p_partkey%2=0 THEN 'US ' ELSE '' END || array_to_string(list_transform(p, lambda x: upper(x[1:1])||lower(x[2:])), ' ') || ' ETF' AS cleaned FROM a""")
def f08(v):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "iShares Trust - us ").otherwise("SCHWAB STRATEGIC TRUST - "), F.upper("p_name"), F.lit(" ETF  "))
    return v.table("part").select(F.col("p_partkey").cast("string").alias("key"), N.clean_name(raw).alias("cleaned"))


@query("f09_lookback_units", "days:i months:i", "SELECT p_size*7 AS days, greatest(6, CAST(round_even(p_size*7/21.0, 0) AS INTEGER)) AS months FROM (SELECT DISTINCT p_size FROM part)")
def f09(v):
    return v.table("part").select((F.col("p_size") * 7).alias("days")).distinct().withColumn("months", X.lookback_months_from_days("days"))


@query("f10_scale_factor", "key midx:i f:f", "SELECT key, midx, CASE WHEN s>0 THEN least(1.0, greatest(0.25, 0.5/s)) END AS f FROM (SELECT key, midx, stddev_samp(ret) OVER (PARTITION BY key ORDER BY midx ROWS 5 PRECEDING) AS s FROM ret_s)")
def f10(v):
    return v.ret_s.withColumn("s", F.stddev_samp("ret").over(W.by("key", order="midx").rowsBetween(-5, 0))).select("key", "midx", X.scale_factor("s", F.lit(0.5)).alias("f"))


@query("f13_printed_tolerance", "key ok:b", "SELECT 'S'||CAST(s_suppkey AS VARCHAR) AS key, s_suppkey%2=0 AS ok FROM supplier")
def f13(v):
    printed = F.format_string("%.1f", F.round("s_acctbal", 1) + F.when(F.col("s_suppkey") % 2 == 0, 0.0).otherwise(0.3))
    return v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), X.within_printed("s_acctbal", printed).alias("ok"))


@query("f16_finite_rounding", "key x:f", "SELECT 'S'||CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey%3=0 THEN NULL ELSE round(s_acctbal, 1) END AS x FROM supplier")
def f16(v):
    bad = F.when(F.col("s_suppkey") % 6 == 0, F.lit(float("nan"))).when(F.col("s_suppkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    return v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), X.round_finite(bad, 1).alias("x"))


@query("f17_parameter_hash", "id digest", """SELECT c_custkey AS id, substr(sha256('{"lookback":'||CAST(c_custkey%3 AS VARCHAR)||',"segment":"'||c_mktsegment||'"}'), 1, 12) AS digest FROM customer""")
def f17(v):
    d = v.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("lookback"), F.col("c_mktsegment").alias("segment"))
    return d.withColumn("digest", X.params_hash("segment", "lookback"))


@query("f18_trial_labels", "label n:i", "SELECT 'L'||CAST(p_size AS VARCHAR)||'_g'||replace(CAST(p_size%4*0.25 AS VARCHAR), '.', 'p') AS label, count(*) AS n FROM (SELECT p_size, CAST(p_size%4*0.25 AS DOUBLE) FROM part) GROUP BY 1".replace("p_size%4*0.25 AS VARCHAR", "CAST(p_size%4*0.25 AS DOUBLE) AS VARCHAR"))
def f18(v):
    d = v.table("part").select("p_size", (F.col("p_size") % 4 * F.lit(0.25)).alias("g"))
    return d.groupBy(N.trial_label(L="p_size", g="g").alias("label")).agg(F.count("*").alias("n"))


@query("f19_bands", "key band", "SELECT key, CASE WHEN cash_like OR short_duration OR near_cash THEN 'Cash-like' WHEN num%8=5 THEN 'Untagged' ELSE upper(asset_class[1:1])||asset_class[2:] END AS band FROM uni_s")
def f19(v):
    d = v.uni_s.withColumn("asset_class", F.when(F.col("num") % 8 != 5, F.col("asset_class")))
    return d.select("key", N.band(F.col("cash_like") | F.col("short_duration") | F.col("near_cash"), "asset_class").alias("band"))


@query("f20_percent_text", "key txt", "SELECT key, CASE WHEN num%4=1 THEN 'not computable' ELSE printf('%.2f%%', num%97*100/127.0) END AS txt FROM uni_s")
def f20(v):
    x = F.when(F.col("num") % 4 != 1, F.col("num") % 97 / F.lit(127.0))
    return v.uni_s.select("key", X.pct_text(x).alias("txt"))


# ------------------------------------------------------------------ sources and sinks
@query("s01_wide_price_file", "key date:d log_price:f", "SELECT upper(key) AS key, date, ln(price) AS log_price FROM px_d WHERE price IS NOT NULL")
def s01(v):
    path = S.scratch_dir(v.spark)
    keys = S.pivot_keys(v.table("part"), "p_type")
    wide = v.px_d.groupBy(F.col("date").alias("Date")).pivot("key", keys).agg(F.first("price"))
    S.write_table(wide.select("Date", *[F.col(k).alias(f" {k.lower()} ") for k in keys]), path, "csv")
    return S.read_wide_panel(v.spark, path).withColumn("log_price", F.ln("price"))


@query("s02_universe_file", "Ticker category cash_like:b near_cash:b", 'SELECT key AS "Ticker", category, cash_like, near_cash FROM uni_s')
def s02(v):
    path = S.scratch_dir(v.spark)
    S.write_table(v.uni_s.select(F.concat(F.lit(" "), F.lower("key")).alias("Ticker"), "category", F.when(F.col("cash_like"), "True").otherwise("0").alias("cash_like"), F.col("near_cash").cast("string").alias("near_cash")), path, "csv")
    return S.read_universe(v.spark, path, tags=("cash_like", "near_cash"))


@query("s03_monthly_panel_file", "key month:d ret:f", "SELECT upper(key) AS key, month, ret FROM ret_b WHERE ret IS NOT NULL AND month < DATE '2001-10-01'")
def s03(v):
    path = S.scratch_dir(v.spark)
    keys = S.pivot_keys(v.table("part"), "p_brand")
    S.write_table(v.ret_b.groupBy(F.col("month").alias("date")).pivot("key", keys).agg(F.first("ret")), path, "csv")
    panel = S.read_wide_panel(v.spark, path, "ret")
    return C.drop_partial_month(panel, "date", asof="2001-10-15").withColumnRenamed("date", "month")


@query("s04_weekly_panel", "key week:d ret:f", """WITH w AS (SELECT key, CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE) AS week, exp(sum(ln(1+ret)))-1 AS ret FROM ret_d WHERE ret IS NOT NULL GROUP BY ALL) SELECT * FROM w""")
def s04(v):
    week = F.date_add(F.date_trunc("week", "date").cast("date"), 4)
    return v.ret_d.where("ret is not null").groupBy("key", week.alias("week")).agg((F.product(1.0 + F.col("ret")) - 1.0).alias("ret"))


@query("s05_thin_flags", "key thin:b", "SELECT key, num%7=3 AS thin FROM uni_s")
def s05(v):
    cov = v.uni_s.select(F.col("key").alias("Ticker"), F.when(F.col("thin"), F.when(F.col("num") % 2 == 0, "Yes").otherwise("TRUE")).otherwise("false").alias("thin_lt5y"))
    return S.thin_flags(cov)


@query("s06_rate_file", "month:d rate:8", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(avg(l_tax)*100, 4)/1200 AS rate FROM lineitem GROUP BY 1")
def s06(v):
    path = S.scratch_dir(v.spark)
    d = v.table("lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("observation_date")).agg(F.round(F.avg("l_tax") * 100, 4).alias("BILL"))
    S.write_table(d, path, "csv")
    return S.read_rate(v.spark, path, "BILL")


@query("s07_single_key", "month:d ret:f", "SELECT month, ret FROM ret_s WHERE key='S7' AND ret IS NOT NULL")
def s07(v):
    # the key filter reaches the supplier column of the scan
    lines = v.complete_months("lineitem", "l_shipdate").where("l_suppkey = 7").withColumn("d", F.col("l_shipdate").cast("date"))
    px = v._prices(lines, F.concat(F.lit("S"), F.col("l_suppkey")), X.month_of("d")).withColumnRenamed("period", "month").withColumn("midx", X.month_idx("month"))
    return v._ret(px).where("ret is not null")


@query("s08_saved_series", "month:d ret:f", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, ret FROM ret_d WHERE key='LARGE' AND day(date)>=25")
def s08(v):
    return S.saved_series(v.ret_d, {"key": "LARGE"}, "ret")


@query("s09_long_weights", "month:d key weight:8", "SELECT month, key, weight FROM weights WHERE strategy='MACHINERY'")
def s09(v):
    return S.long_weights(v.weights, {"strategy": "MACHINERY"})


@query("s10_wide_weights", "strategy month:d key weight:8", "SELECT s.strategy, s.month, k.key, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT strategy, month FROM weights) s CROSS JOIN (SELECT n_name AS key FROM nation) k LEFT JOIN weights w ON w.strategy=s.strategy AND w.month=s.month AND w.key=k.key")
def s10(v):
    wide = v.weights.groupBy("strategy", "month").pivot("key", S.pivot_keys(v.table("nation"), "n_name")).agg(F.first("weight"))
    return S.wide_weights(wide.select("strategy", "month", *[F.col(c).alias(f"w_{c}") for c in wide.columns[2:]]), ["strategy", "month"])


@query("s11_table_sink", "strategy month:d key weight:8", "SELECT strategy, month, key, weight FROM weights")
def s11(v):
    path = S.scratch_dir(v.spark)
    S.write_table(v.weights, path, partition_by=("strategy",))
    return v.spark.read.schema("key string, month date, midx int, weight double, strategy string").parquet(path)


@query("s12_result_bundle", "gate label n:i", "SELECT 'demo' AS gate, 'PASS' AS label, count(*) AS n FROM series")
def s12(v):
    path = S.scratch_dir(v.spark)
    rec = v.rows("gate string, mechanical string, composition string, label string", ("demo", "PASS", "PASS", "PASS"))
    S.write_bundle({"returns": v.series}, rec, path, S.provenance(v.series, "series", "month", "orders"))
    n = v.spark.read.parquet(f"{path}/returns").agg(F.count("*").alias("n"))
    return X.attach_one(v.spark.read.schema("gate string, label string").json(f"{path}/record"), n)


@query("s13_json_blocks", "strategy month:d key weight:8", "SELECT strategy, month, key, CASE WHEN key='NATION_3' THEN NULL ELSE weight END AS weight FROM weights")
def s13(v):
    path = S.scratch_dir(v.spark)
    S.write_json(v.weights.withColumn("weight", F.when(F.col("key") == "NATION_3", F.lit(float("nan"))).otherwise(F.col("weight"))), path, "strategy")
    return v.spark.read.schema("key string, month date, weight double, strategy string").json(path)


@query("s14_delimited_text", "id:i name", "SELECT s_suppkey AS id, 'He said \"x\", '||s_name AS name FROM supplier")
def s14(v):
    path = S.scratch_dir(v.spark)
    d = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit('He said "x", '), "s_name").alias("name"))
    d.write.option("header", True).option("escape", '"').csv(path)
    return S.read_delimited(v.spark, path)


# ------------------------------------------------------------------ data quality
@query("q01_timing_audit", "strategy n:i n_fail:i status", """WITH d AS (SELECT strategy, month, CASE WHEN strategy='MACHINERY' AND month=DATE '1999-05-01' THEN month + INTERVAL 1 DAY ELSE month END AS fe FROM weights GROUP BY ALL)
SELECT strategy, count(*) AS n, count(*) FILTER (fe > month) AS n_fail, CASE WHEN count(*) FILTER (fe > month) > 0 THEN 'fail' ELSE 'pass' END AS status FROM d GROUP BY 1""")
def q01(v):
    leak = (F.col("strategy") == "MACHINERY") & (F.col("month") == "1999-05-01")
    d = v.weights.select("strategy", "month").distinct().withColumns({
        "fe": F.when(leak, F.date_add("month", 1)).otherwise(F.col("month")), "ls": F.add_months("month", 1)})
    return Q.timing_audit(d, ["strategy"], "fe", "month", "ls", "ls")


@query("q02_outside_holdings", "strategy key n:i", "SELECT strategy, 'SLEEVE_X' AS key, count(*) AS n FROM weights WHERE strategy='MACHINERY' AND key='NATION_3' AND weight<>0 GROUP BY 1")
def q02(v):
    return Q.outside_holdings(odd_weights(v), v.uni_n, ["strategy"])


@query("q03_weight_rules", "strategy month:d total:f sum_ok:b long_only:b single_ok:b group_ok:b", """SELECT strategy, month, sum(weight) AS total, true AS sum_ok, min(weight)>=-1e-8 AS long_only, coalesce(max(CASE WHEN equity_only THEN weight END),0)<=0.1+1e-8 AS single_ok,
 coalesce(sum(CASE WHEN equity_only THEN weight END),0)<=0.45+1e-8 AS group_ok FROM weights JOIN uni_n USING (key) GROUP BY ALL""")
def q03(v):
    return Q.weight_rules(v.weights.join(v.uni_n.select("key", "equity_only"), "key"), ["strategy", "month"], "equity_only", 0.1, 0.45)


@query("q04_panel_invariants", "key rows:i duplicates:i gaps:i not_finite:i below_minus_one:i nulls:i", """SELECT key, count(*) AS rows, count(*) FILTER (st=0) AS duplicates, count(*) FILTER (st>1) AS gaps, count(*) FILTER (isinf(ret)) AS not_finite, count(*) FILTER (ret<-1) AS below_minus_one, count(*) FILTER (ret IS NULL) AS nulls
FROM (SELECT key, lead(midx) OVER (PARTITION BY key ORDER BY midx)-midx AS st, CASE WHEN key='S7' AND midx%12=3 THEN CAST('Infinity' AS DOUBLE) WHEN key='S8' AND midx%12=5 THEN -1.5 ELSE ret END AS ret FROM ret_s) GROUP BY key""")
def q04(v):
    """The panel with infinite and impossible returns planted in two keys."""
    bad = F.when((F.col("key") == "S7") & (F.col("midx") % 12 == 3), float("inf")).when((F.col("key") == "S8") & (F.col("midx") % 12 == 5), -1.5).otherwise(F.col("ret"))
    return Q.panel_invariants(v.ret_s.withColumn("ret", bad), "key", "midx", "ret")


@query("q05_completeness", "trial_id have:i missing:i", "SELECT trial_id, count(ret) AS have, (SELECT count(DISTINCT month) FROM trial_ret)-count(ret) AS missing FROM trial_ret GROUP BY 1")
def q05(v):
    return Q.completeness(v.trial_ret, "trial_id", "month", "ret")


@query("q06_composition_tripwire", "id null_id method_share:f null_share:f computable:b void_method:b status", """WITH g AS (SELECT strategy, NOT (strategy='MACHINERY') AS computable, sum(CASE WHEN cash_like OR short_duration OR near_cash THEN weight ELSE 0 END)/count(DISTINCT month) AS s FROM weights JOIN uni_n USING (key) GROUP BY 1),
 n AS (SELECT * FROM g WHERE strategy='AUTOMOBILE') SELECT g.strategy AS id, n.strategy AS null_id, CASE WHEN g.computable THEN g.s END AS method_share, n.s AS null_share, g.computable, coalesce(g.computable AND g.s>0.46, false) AS void_method,
 CASE WHEN NOT g.computable THEN 'NOT COMPUTABLE' WHEN g.s>0.46 OR n.s>0.46 THEN 'VOID' ELSE 'PASS' END AS status FROM g, n WHERE g.strategy<>'AUTOMOBILE'""")
def q06(v):
    t = L.tag_shares(odd_weights(v), v.uni_n, ["strategy"], "month", ["cash_like", "short_duration", "near_cash"]).withColumnRenamed("strategy", "id")
    return Q.composition_status(t.where("id <> 'AUTOMOBILE'"), t.where("id = 'AUTOMOBILE'"), 0.46)


@query("q07_final_labels", "o_orderkey:i label ok:b", """SELECT o_orderkey, CASE WHEN m='VOID' OR c='VOID' THEN 'VOID' WHEN m='FAIL' THEN 'FAIL' WHEN c='NOT COMPUTABLE' THEN 'INCOMPLETE (composition not computable)' ELSE 'PASS' END AS label, NOT (m='FAIL' AND c<>'VOID') AS ok
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' ELSE 'VOID' END AS m, CASE o_orderkey%4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'VOID' WHEN 2 THEN 'NOT COMPUTABLE' ELSE 'OPTED OUT' END AS c FROM orders)""")
def q07(v):
    d = v.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL").otherwise("VOID").alias("m"),
                                 F.element_at(F.array(*[F.lit(x) for x in ("PASS", "VOID", "NOT COMPUTABLE", "OPTED OUT")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("c"))
    d = d.withColumn("label", Q.final_label("m", "c")).withColumn("recorded", F.when(F.col("label") == "FAIL", "PASS").otherwise(F.col("label")))
    bad = Q.record_errors(d, "recorded", "m", "c").select("o_orderkey", F.lit(False).alias("_ok"))
    return d.join(bad, "o_orderkey", "left").withColumn("ok", F.coalesce("_ok", F.lit(True)))


@query("q08_provenance", "panel source source_asof:d rows:i", "SELECT 'ret_s' AS panel, 'lineitem' AS source, max(month) AS source_asof, count(*) AS rows FROM ret_s")
def q08(v):
    return S.provenance(v.ret_s, "ret_s", "month", "lineitem")


@query("q09_mechanical_reading", "trial_id better_sharpe:b shallower:b reading", """WITH s AS (SELECT trial_id, split_part(trial_id,'_R',1) AS seg, avg(ret)/stddev_samp(ret) AS sr, min(ret) AS worst FROM trial_ret GROUP BY 1), n AS (SELECT series_id AS seg, avg(ret)/stddev_samp(ret) AS nsr, min(ret) AS nworst FROM series GROUP BY 1)
SELECT trial_id, sr>nsr AS better_sharpe, worst>nworst AS shallower, CASE WHEN seg='FURNITURE' THEN 'VOID' WHEN sr>nsr AND worst>nworst THEN 'PASS' ELSE 'FAIL' END AS reading FROM s JOIN n USING (seg)""")
def q09(v):
    s = v.trial_ret.withColumn("seg", F.split("trial_id", "_R")[0]).groupBy("trial_id", "seg").agg(X.ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), F.min("ret").alias("worst"))
    n = v.series.groupBy(F.col("series_id").alias("seg")).agg(X.ratio(F.avg("ret"), F.stddev_samp("ret")).alias("nsr"), F.min("ret").alias("nworst"))
    return Q.mechanical_reading(s.join(n, "seg").withColumn("void", F.col("seg") == "FURNITURE"), [("better_sharpe", "sr", "nsr"), ("shallower", "worst", "nworst")], "void")


@query("q10_tripwires", "strategy eff_n:f max_group_share:f reasons", """WITH p AS (SELECT strategy, month, sum(weight*weight) AS h FROM weights GROUP BY ALL), e AS (SELECT strategy, avg(1/h) AS eff_n FROM p GROUP BY 1),
 g AS (SELECT strategy, month, category, sum(weight) AS w FROM weights JOIN uni_n USING (key) GROUP BY ALL), m AS (SELECT strategy, max(w) AS mx FROM g GROUP BY 1)
SELECT strategy, eff_n, mx AS max_group_share, concat_ws(', ', CASE WHEN eff_n<14 THEN 'low effective n' END, CASE WHEN mx>0.6 THEN 'group share' END) AS reasons FROM e JOIN m USING (strategy)""")
def q10(v):
    e = L.concentration(v.weights, ["strategy"], "month").select("strategy", F.col("eff_n_mean").alias("eff_n"))
    g = v.weights.join(v.uni_n.select("key", "category"), "key").groupBy("strategy", "month", "category").agg(F.sum("weight").alias("w"))
    m = g.groupBy("strategy").agg(F.max("w").alias("max_group_share"))
    r = Q.failure_reasons(low_effective_n=F.col("eff_n") < 14, group_share=F.col("max_group_share") > 0.6)
    return e.join(m, "strategy").withColumn("reasons", F.array_join(r, ", "))


@query("q11_book_eligibility", "trial_id eligible:b reasons", """WITH c AS (SELECT month FROM trial_ret GROUP BY month HAVING count(DISTINCT trial_id)=(SELECT count(DISTINCT trial_id) FROM trial_ret)), s AS (SELECT trial_id, avg(ret-rate)/stddev_samp(ret-rate) AS sr, stddev_samp(ret) AS sd FROM trial_ret JOIN c USING (month) JOIN rates USING (month) GROUP BY 1),
 b AS (SELECT avg(ret-rate)/stddev_samp(ret-rate) AS sr0, stddev_samp(ret) AS sd0 FROM series JOIN c USING (month) JOIN rates USING (month) WHERE series_id='AUTOMOBILE')
SELECT trial_id, NOT (sr<=sr0 OR sd>=sd0) AS eligible, concat_ws(', ', CASE WHEN sr<=sr0 THEN 'sharpe not above book' END, CASE WHEN sd>=sd0 THEN 'volatility not below book' END) AS reasons FROM s, b""")
def q11(v):
    c = P.common_periods(v.trial_ret, "trial_id", "month")
    months = c.select("month").distinct()
    def stat(d, keys, names):
        d = P.attach_rate(d, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
        return d.groupBy(*keys).agg(X.ratio(F.avg("ex"), F.stddev_samp("ex")).alias(names[0]), F.stddev_samp("ret").alias(names[1]))
    book = stat(v.series.where("series_id = 'AUTOMOBILE'").join(months, "month", "left_semi"), [], ("sr0", "sd0"))
    d = X.attach_one(stat(c, ["trial_id"], ("sr", "sd")), book)
    r = Q.failure_reasons(sharpe_not_above_book=F.col("sr") <= F.col("sr0"), volatility_not_below_book=F.col("sd") >= F.col("sd0"))
    return d.withColumn("reasons", F.array_join(r, ", ")).withColumn("eligible", F.col("reasons") == "")


@query("q12_structure_profile", "key rows:i duplicates:i weekend:i nulls:i", "SELECT key, count(*) AS rows, count(date)-count(DISTINCT date) AS duplicates, count(*) FILTER (dayofweek(date) IN (0,6)) AS weekend, count(*) FILTER (ret IS NULL) AS nulls FROM ret_d GROUP BY key")
def q12(v):
    return Q.structure_profile(v.ret_d, "key", "date", "ret")
