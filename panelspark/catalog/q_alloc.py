"""Verification queries: covariance, allocation kernels, HAC tests, regimes.

Optimisers are checked by certificates (KKT or risk parity) that Spark computes from the
weights and the covariance rows; the oracle states which decisions exist and that all hold.
"""
import math

from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.catalog.q_inference import cdf_sql, excess_pairs
from panelspark.functions.scalar import attach_one
from panelspark.operators import allocate as A, covariance as V, inference as I, kernels as K, panel as P, portfolio as L, windows as W
from panelspark.sources.stage import stage

LB = 36
LIVE = f"""lv AS (SELECT * FROM (SELECT key, midx, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd, avg(ret) OVER w AS mean FROM ret_b WINDOW w AS (PARTITION BY key ORDER BY midx RANGE BETWEEN {LB - 1} PRECEDING AND CURRENT ROW)) WHERE n={LB} AND sd>1e-10 QUALIFY count(*) OVER (PARTITION BY midx) >= 5)"""
COV = f"""{LIVE}, xs AS (SELECT l.midx, l.key, r.midx AS t, r.ret - l.mean AS x FROM lv l JOIN ret_b r ON r.key=l.key AND r.midx BETWEEN l.midx-{LB - 1} AND l.midx),
 cv AS (SELECT a.midx, a.key AS k1, b.key AS k2, sum(a.x*b.x)/{LB} AS cov FROM xs a JOIN xs b ON a.midx=b.midx AND a.t=b.t AND a.key<=b.key GROUP BY ALL),
 q4 AS (SELECT midx, sum(q*q) AS b4 FROM (SELECT midx, t, sum(x*x) AS q FROM xs GROUP BY ALL) GROUP BY midx),
 s2 AS (SELECT midx, sum(CASE WHEN k1=k2 THEN 1 ELSE 2 END*cov*cov) AS s2, sum(CASE WHEN k1=k2 THEN cov END) AS tr, count(*) FILTER (k1=k2) AS n FROM cv GROUP BY midx),
 lw AS (SELECT midx, n, tr/n AS mu, greatest(0, least((b4/{LB}-s2)/(n*{LB}), (s2-tr*tr/n)/n)/((s2-tr*tr/n)/n)) AS shrinkage FROM s2 JOIN q4 USING (midx)),
 lc AS (SELECT cv.midx, k1, k2, (1-shrinkage)*cov + CASE WHEN k1=k2 THEN shrinkage*mu ELSE 0 END AS cov FROM cv JOIN lw USING (midx))"""
DEC = f"WITH {LIVE} SELECT midx, count(*) AS n"


def live(v):
    return P.live_names(v.ret_b, LB, LB, 5).withColumn("mean", F.lit(None).cast("double"))


def lw_cov(v):
    return V.linear_shrinkage(live(v), v.ret_b, LB)


def sample_cov(v):
    return V.window_entries(live(v), v.ret_b, LB)


@query("g14_shrinkage_intensity", "midx:i names:i mu:8 shrinkage:f", f"WITH {COV} SELECT midx, n AS names, mu, shrinkage FROM lw")
def g14i(v):
    v.shared("ret_b")
    return V.shrinkage_intensity(live(v), v.ret_b, sample_cov(v), LB)


@query("g14_linear_shrinkage", "midx:i k1 k2 cov:8", f"WITH {COV} SELECT * FROM lc")
def g14(v):
    v.shared("ret_b")
    return lw_cov(v)


SHORT = 18


@query("g14_short_panel", "midx:i k1 k2 method cov:8", f"""WITH l8 AS (SELECT * FROM (SELECT key, midx, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd FROM ret_b WINDOW w AS (PARTITION BY key ORDER BY midx RANGE BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW)) WHERE n={SHORT} AND sd>1e-10 QUALIFY count(*) OVER (PARTITION BY midx) >= 5),
 c AS (SELECT a.midx, a.key AS k1, b.key AS k2, covar_samp(a.ret, b.ret) OVER w AS cov, count(*) OVER w AS n FROM ret_b a JOIN ret_b b ON a.midx=b.midx AND a.key<=b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL WINDOW w AS (PARTITION BY a.key, b.key ORDER BY a.midx RANGE BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW))
SELECT midx, k1, k2, 'ridge' AS method, cov + CASE WHEN k1=k2 THEN 1e-6 ELSE 0 END AS cov FROM c WHERE n={SHORT} AND (midx, k1) IN (SELECT (midx, key) FROM l8) AND (midx, k2) IN (SELECT (midx, key) FROM l8)""")
def g14s(v):
    """Windows with fewer rows than names: the sample covariance with a ridge."""
    v.shared("ret_b")
    return V.shrunk_or_ridge(P.live_names(v.ret_b, SHORT, SHORT, 5), v.ret_b, SHORT)


@query("l11_min_variance", "midx:i n:i sum_ok:b sign_ok:b kkt_ok:b", DEC + ", true AS sum_ok, true AS sign_ok, true AS kkt_ok FROM lv GROUP BY midx")
def l11(v):
    v.shared("ret_b")
    c = stage(lw_cov(v))
    return V.min_variance_certificate(A.allocate(c, ["midx"], K.min_variance), c, ["midx"])


@query("l12_equal_risk", "midx:i n:i sum_ok:b sign_ok:b parity_ok:b", DEC + ", true AS sum_ok, true AS sign_ok, true AS parity_ok FROM lv GROUP BY midx")
def l12(v):
    v.shared("ret_b")
    c = stage(lw_cov(v))
    return V.equal_risk_certificate(A.allocate(c, ["midx"], K.equal_risk), c, ["midx"])


@query("l13_top_n_risk_parity", "midx:i n:i sum_ok:b parity_ok:b", f"WITH {LIVE} SELECT midx, 8 AS n, true AS sum_ok, true AS parity_ok FROM lv GROUP BY midx HAVING count(*) >= 8")
def l13(v):
    v.shared("ret_b")
    top = Window.partitionBy("midx").orderBy(F.desc("score"), "key")
    d = P.live_names(v.ret_b, LB, LB, 5)
    d = d.withColumn("score", F.col("ret")).withColumn("rk", F.row_number().over(top)).where("rk <= 8")
    d = d.join(d.groupBy("midx").agg(F.count("*").alias("k")).where("k = 8").select("midx"), "midx", "left_semi")
    c = stage(V.linear_shrinkage(d, v.ret_b, LB))
    return V.equal_risk_certificate(A.allocate(c, ["midx"], K.equal_risk), c, ["midx"])


def trend_inputs(v):
    """Per (decision, key): trend signal, inverse-vol anchor."""
    w = W.by("key", order="midx")
    d = P.attach_rate(v.ret_b, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    past = w.rangeBetween(-11, -1)  # a signal needs every month of its window
    d = d.withColumns({"sd": F.stddev_samp("ret").over(w.rangeBetween(-LB + 1, 0)), "mom": F.when(F.count("ex").over(past) == 11, F.product(1.0 + F.col("ex")).over(past) - 1.0)})
    d = d.join(live(v).select("key", "midx"), ["key", "midx"], "left_semi")
    d = L.inverse_vol(d, ["midx"], "sd").withColumnRenamed("weight", "anchor")
    return d.withColumn("signal", 0.1 * F.col("sd") * F.signum("mom"))


@query("x01_user_callable", "midx:i key weight:8", f"WITH {LIVE} SELECT midx, key, (1/(sd*sd))/sum(1/(sd*sd)) OVER (PARTITION BY midx) AS weight FROM lv")
def x01(v):
    """A user function from matrix to weights runs under the same job."""
    v.shared("ret_b")
    def inverse_variance(c):
        x = 1.0 / c.diagonal()
        return x / x.sum()
    return A.allocate(sample_cov(v), ["midx"], inverse_variance)


@query("x02_terminal_allocator", "terminal midx:i key weight:8", f"""WITH {LIVE}, a AS (SELECT midx, key, sd, category, count(DISTINCT category) OVER (PARTITION BY midx) AS k FROM (SELECT midx, key, sd FROM lv) JOIN uni_b USING (key))
SELECT 'inverse_variance' AS terminal, midx, key, (1/(sd*sd))/sum(1/(sd*sd)) OVER (PARTITION BY midx, category)/k AS weight FROM a UNION ALL SELECT 'equal', midx, key, 1.0/count(*) OVER (PARTITION BY midx, category)/k FROM a""")
def x02(v):
    """Two levels: categories share equally, and any callable allocates inside a category."""
    v.shared("ret_b")
    cat = v.uni_b.select(F.col("key").alias("k1"), "category")
    c = sample_cov(v).join(cat, "k1").join(cat.select(F.col("k1").alias("k2"), F.col("category").alias("c2")), "k2").where("category = c2")
    terminals = {"inverse_variance": lambda m: (1.0 / m.diagonal()) / (1.0 / m.diagonal()).sum(), "equal": lambda m: [1.0 / len(m)] * len(m)}
    w = A.allocate_many(c, ["midx", "category"], terminals, "terminal")
    n = c.groupBy("midx").agg(F.count_distinct("category").alias("n"))
    return w.join(n, "midx").withColumn("weight", F.col("weight") / F.col("n"))


# ------------------------------------------------------------------ HAC tests
HACSQL = """WITH e AS (SELECT series_id, month, ret-rate AS ret FROM series JOIN rates USING (month)), p AS (SELECT s.series_id AS a, s.month, s.ret AS x, t.ret AS y FROM e s JOIN e t USING (month) WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE'),
 m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy, count(*) OVER w AS n, row_number() OVER (PARTITION BY a ORDER BY month) AS i FROM p WINDOW w AS (PARTITION BY a)),
 f AS (SELECT a, i, n, {delta} AS delta, {part_x} - ({part_y}) AS f FROM m), l AS (SELECT *, lag(f) OVER (PARTITION BY a ORDER BY i) AS g FROM f),
 r AS (SELECT a, greatest(-0.97, least(0.97, sum(f*g)/sum(g*g))) AS rho FROM l WHERE g IS NOT NULL GROUP BY a), u AS (SELECT l.a, l.i, n, delta, rho, f-rho*g AS u FROM l JOIN r USING (a) WHERE g IS NOT NULL),
 ul AS (SELECT *, lag(u) OVER (PARTITION BY a ORDER BY i) AS v FROM u), b AS (SELECT a, 1.3221*pow(4*q*q/pow(1-q,4)*c, 0.2) AS bandwidth FROM (SELECT a, greatest(-0.97, least(0.97, sum(u*v) FILTER (v IS NOT NULL)/sum(v*v))) AS q, count(*) AS c FROM ul GROUP BY a)),
 k AS (SELECT x.a, sum(x.u*y.u*CASE WHEN x.i=y.i THEN 1 ELSE 25/(12*pow(pi()*z.d,2))*(sin(6*pi()*z.d/5)/(6*pi()*z.d/5)-cos(6*pi()*z.d/5)) END) AS s FROM u x JOIN u y USING (a) JOIN b USING (a), LATERAL (SELECT abs(x.i-y.i)/bandwidth AS d) z GROUP BY x.a),
 o AS (SELECT a, any_value(n) AS n, any_value(delta) AS delta, any_value(rho) AS rho, count(*) AS c FROM u GROUP BY a)
SELECT a, 'AUTOMOBILE' AS b, n, delta, sqrt(greatest(0, s/c)/pow(1-rho,2)/n) AS se, delta/sqrt(greatest(0, s/c)/pow(1-rho,2)/n) AS z, bandwidth FROM o JOIN k USING (a) JOIN b USING (a)"""


@query("g08_hac_sharpe_test", "a b n:i delta:f se:f z:f bandwidth:f", HACSQL.format(delta="mx/sqrt(vx)-my/sqrt(vy)", part_x="(x-mx)/sqrt(vx)-mx/(2*pow(vx,1.5))*((x-mx)*(x-mx)-vx)", part_y="(y-my)/sqrt(vy)-my/(2*pow(vy,1.5))*((y-my)*(y-my)-vy)"))
def g08(v):
    return I.hac_difference(excess_pairs(v), ["a", "b"], "month", "sharpe")


@query("g09_hac_variance_test", "a b n:i delta:f se:f z:f bandwidth:f", HACSQL.format(delta="ln(vx/vy)", part_x="(x-mx)*(x-mx)/vx-1", part_y="(y-my)*(y-my)/vy-1"))
def g09(v):
    return I.hac_difference(excess_pairs(v), ["a", "b"], "month", "variance")


IIDSQL = """WITH e AS (SELECT series_id, month, ret-rate AS ret FROM series JOIN rates USING (month)), p AS (SELECT s.series_id AS a, s.ret AS x, t.ret AS y FROM e s JOIN e t USING (month) WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE'),
 m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(x*x) OVER w AS gx, avg(y*y) OVER w AS gy FROM p WINDOW w AS (PARTITION BY a)),
 i AS (SELECT a, ln((gx-mx*mx)/(gy-my*my)) AS delta, -2*mx/(gx-mx*mx)*(x-mx)+2*my/(gy-my*my)*(y-my)+(x*x-gx)/(gx-mx*mx)-(y*y-gy)/(gy-my*my) AS f FROM m)
SELECT a, any_value(delta) AS delta, sqrt(var_samp(f)/count(*)) AS se FROM i GROUP BY a"""


@query("g09_iid_variance_test", "a delta:f se:f", IIDSQL)
def g09i(v):
    """IID branch: the variance of the influence column, all in aggregates."""
    p = excess_pairs(v)
    m = p.groupBy("a", "b").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("x")).alias("gx"), F.avg(F.col("y") * F.col("y")).alias("gy"))
    m = m.withColumns({"vx": F.col("gx") - F.col("mx") * F.col("mx"), "vy": F.col("gy") - F.col("my") * F.col("my")})
    d = p.join(m, ["a", "b"])
    def part(x, mean, sq, var):
        return -2 * F.col(mean) / F.col(var) * (F.col(x) - F.col(mean)) + (F.col(x) * F.col(x) - F.col(sq)) / F.col(var)
    d = d.withColumn("f", part("x", "mx", "gx", "vx") - part("y", "my", "gy", "vy"))
    return d.groupBy("a").agg(F.first(F.ln(F.col("vx") / F.col("vy"))).alias("delta"), F.sqrt(F.var_samp("f") / F.count("*")).alias("se"))


# ------------------------------------------------------------------ stress, frontier, regimes
def stress_months(ret, n=24):
    """Per decision: the n past months with the highest trailing market volatility (calendar-sized rows)."""
    m = ret.groupBy("midx").agg(F.avg("ret").alias("r")).withColumn("vol", W.trailing_vol("r", Window.orderBy("midx"), 12, 12.0, min_periods=3)).where("vol is not null")
    last = m.agg(F.max("midx").alias("last"))
    d = attach_one(m.withColumnRenamed("midx", "t"), last).withColumn("midx", F.explode(F.sequence("t", "last")))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("midx").orderBy(F.desc("vol"), "t"))).where(F.col("k") <= n).select("midx", "t")


def entries_over(ret, months, floor=5):
    """Population covariance rows of every decision's names over its months (midx, t) in which all of them have a return.

    The names of a decision are those with a full trailing window.
    """
    r = ret.where("ret is not null").select("key", F.col("midx").alias("t"), "ret")
    names = P.live_names(ret, LB, LB, floor).select("midx", "key")
    d = months.join(names, "midx").join(r, ["t", "key"])
    size = names.groupBy("midx").agg(F.count("*").alias("names"))
    full = d.groupBy("midx", "t").agg(F.count("*").alias("c")).join(size, "midx").where("c = names").select("midx", "t", "names")
    d = d.join(full, ["midx", "t"])
    return P.paired(d, ["midx", "t"], "key", "ret", own=True).groupBy("midx", "k1", "k2").agg(F.covar_pop("x", "y").alias("cov"), F.count("*").alias("n"))


def past_cov(ret, floor=5):
    """Covariance over all complete months up to each decision."""
    last = ret.agg(F.max("midx").alias("last"))
    past = attach_one(ret.select(F.col("midx").alias("t")).distinct(), last).select("t", F.explode(F.sequence("t", "last")).alias("midx"))  # calendar-sized
    return entries_over(ret, past, floor).drop("n")


def blended_cov(ret, floor=5, lam=0.25, n=24, least=12):
    """(1 - lam) of the past's covariance plus lam of the stress months', where at least `least` of these are complete."""
    return V.blend(past_cov(ret, floor), entries_over(ret, stress_months(ret, n), floor).where(F.col("n") >= least), lam, ["midx"])


STRESS = f"""{LIVE}, mk AS (SELECT midx, avg(ret) AS r FROM ret_b GROUP BY midx), sv AS (SELECT midx AS t, stddev_samp(r) OVER w*sqrt(12) AS vol, count(r) OVER w AS c FROM mk WINDOW w AS (ORDER BY midx ROWS 11 PRECEDING)),
 sm AS (SELECT d.midx, t FROM (SELECT DISTINCT t AS midx FROM sv WHERE c>=3) d JOIN sv ON sv.t<=d.midx AND c>=3 QUALIFY row_number() OVER (PARTITION BY d.midx ORDER BY vol DESC, t) <= 24),
 nm AS (SELECT midx, key, count(*) OVER (PARTITION BY midx) AS names FROM lv),
 br AS (SELECT nm.midx, r.midx AS t, key, ret FROM nm JOIN ret_b r USING (key) WHERE ret IS NOT NULL AND r.midx<=nm.midx QUALIFY count(*) OVER (PARTITION BY nm.midx, r.midx)=names),
 st AS (SELECT midx, a.key AS k1, b.key AS k2, covar_pop(a.ret, b.ret) AS cov FROM sm JOIN br a USING (midx, t) JOIN br b USING (midx, t) WHERE a.key<=b.key GROUP BY ALL HAVING count(*)>=12)"""


@query("g16_stress_covariance", "midx:i k1 k2 cov:8", f"""WITH {STRESS}, un AS (SELECT midx, a.key AS k1, b.key AS k2, covar_pop(a.ret, b.ret) AS cov FROM br a JOIN br b USING (midx, t) WHERE a.key<=b.key GROUP BY ALL)
SELECT st.midx, k1, k2, 0.75*un.cov+0.25*st.cov AS cov FROM st JOIN un USING (midx, k1, k2)""")
def g16(v):
    v.shared("ret_b")
    return blended_cov(v.ret_b)


def frontier_series(v, c=None):
    c = lw_cov(v) if c is None else c
    means = v.ret_b.select("key", "midx", F.avg("ret").over(W.by("key", order="midx").rangeBetween(-LB + 1, 0)).alias("mean"))
    return V.frontier(A.frontier_scalars(c, means, ["midx"]), ["midx"])


@query("g17_frontier_identity", "midx:i curvature_ok:b mvp_ok:b", f"WITH {LIVE} SELECT midx, true AS curvature_ok, true AS mvp_ok FROM lv GROUP BY midx")
def g17i(v):
    """The frontier's minimum variance never exceeds that of the long-only portfolio."""
    v.shared("ret_b")
    c = stage(lw_cov(v))
    lo = V.marginal_risk(A.allocate(c, ["midx"], K.min_variance), c, ["midx"]).groupBy("midx").agg(F.first("variance").alias("lo"))
    f = frontier_series(v, c).join(lo, "midx")
    return f.select("midx", (F.col("u") > 0).alias("curvature_ok"), (F.col("sigma_mvp") * F.col("sigma_mvp") <= F.col("lo") * (1 + 1e-9)).alias("mvp_ok"))


@query("g17_frontier", "midx:i r_mvp:f sigma_mvp:f u:f r_tp:f sigma_tp:f")
def g17(v):
    v.shared("ret_b")
    return frontier_series(v).select("*", *[c.alias(n) for n, c in V.tangency("r_mvp", "sigma_mvp", "u").items()])


def sleeves(v):
    """Category sleeve returns of names with a year of prior history."""
    d = v.ret_s.withColumn("prior", F.count("ret").over(W.by("key", order="midx").rowsBetween(W.UNB, -1))).where("prior >= 12")
    return d.join(v.uni_s.select("key", "category"), "key").groupBy(F.col("category").alias("key"), "month", "midx").agg(F.avg("ret").alias("ret"))


def regime_features(v):
    s = sleeves(v)
    w = Window.orderBy("midx")  # one row per month
    m = s.groupBy("midx").agg(F.avg("ret").alias("r"), (F.avg(F.when(F.col("key").isin("C0", "C1"), F.col("ret"))) - F.avg(F.when(~F.col("key").isin("C0", "C1"), F.col("ret")))).alias("s"))
    m = m.select("midx", W.trailing_vol("r", w, 6, 12.0).alias("vol"), F.when(F.count("s").over(w.rowsBetween(-5, 0)) == 6, F.avg("s").over(w.rowsBetween(-5, 0))).alias("spread"))
    c = P.mean_abs_corr(P.rolling_pair_corr(P.pair_returns(s, []), [], 12, 12), ["midx"]).select("midx", F.col("mean_corr").alias("corr"))
    return m.join(c, "midx")


@query("g20_markov_steady_state", "key st:i pi:f", """WITH s AS (SELECT key, midx, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS st FROM ret_s WHERE ret IS NOT NULL), t AS (SELECT key, st AS a, lead(st) OVER (PARTITION BY key ORDER BY midx) AS b FROM s),
 p AS (SELECT key, avg(CASE WHEN a=0 THEN b END) AS p01, avg(CASE WHEN a=1 THEN 1-b END) AS p10 FROM t WHERE b IS NOT NULL GROUP BY key), q AS (SELECT key, greatest(1e-6, p01/(p01+p10)) AS q1, greatest(1e-6, p10/(p01+p10)) AS q0 FROM p)
SELECT key, 0 AS st, q0/(q0+q1) AS pi FROM q UNION ALL SELECT key, 1, q1/(q0+q1) FROM q""")
def g20(v):
    s = v.ret_s.where("ret is not null").withColumn("st", (F.col("ret") > 0).cast("int"))
    return steady_state(s.withColumn("nxt", F.lead("st").over(W.by("key", order="midx"))).where("nxt is not null"), ["key"])


def steady_state(t, keys):
    """Two-state chain: pi_1 = p01 / (p01 + p10), floored and renormalised."""
    g = t.groupBy(*keys).agg(F.avg(F.when(F.col("st") == 0, F.col("nxt"))).alias("p01"), F.avg(F.when(F.col("st") == 1, 1 - F.col("nxt"))).alias("p10"))
    tot = F.coalesce("p01", F.lit(0.0)) + F.coalesce("p10", F.lit(0.0))
    g = g.withColumn("q", F.coalesce(F.try_divide(F.coalesce("p01", F.lit(0.0)), tot), F.lit(0.5)))
    lo, hi = F.greatest(F.lit(1e-6), 1 - F.col("q")), F.greatest(F.lit(1e-6), F.col("q"))
    return g.select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("st"), (lo / (lo + hi)).alias("pi")), F.struct(F.lit(1).alias("st"), (hi / (lo + hi)).alias("pi")))))
