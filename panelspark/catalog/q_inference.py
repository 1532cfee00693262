"""Verification queries: inference and normal-law functions."""
import math

from pyspark.sql import Window, functions as F

from panelspark.catalog.base import query
from panelspark.catalog.q_panel import pairs_vs
from panelspark.functions import stats as T
from panelspark.functions.scalar import SQRT12, attach_one
from panelspark.operators import inference as I, panel as P

TWO_PI = math.sqrt(2 * math.pi)


def cdf_sql(z):
    t = f"(1.0/(1.0+0.2316419*abs({z})))"
    poly = "1.330274429"
    for b in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"({poly}*{t}+({b}))"
    tail = f"(exp(-({z})*({z})/2)/{TWO_PI!r}*{t}*{poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1-{tail} ELSE {tail} END)"


def ppf_sql(p):
    def h(cs, x):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out}*{x}+({c!r}))"
        return out
    q = f"sqrt(-2*ln(least({p},1-({p}))))"
    tail = f"({h(T.AC_C, q)}/({h(T.AC_D, q)}*{q}+1))"
    r = f"(({p}-0.5)*({p}-0.5))"
    mid = f"({h(T.AC_A, r)}*({p}-0.5)/({h(T.AC_B, r)}*{r}+1))"
    return f"(CASE WHEN {p}<=0 OR {p}>=1 THEN NULL WHEN {p}<0.02425 THEN {tail} WHEN {p}>0.97575 THEN -{tail} ELSE {mid} END)"


@query("f14_normal_law", "key p:f z:f back:f", f"""WITH a AS (SELECT key, (rank() OVER (PARTITION BY midx ORDER BY ret)-0.5)/count(*) OVER (PARTITION BY midx) AS p FROM ret_s WHERE ret IS NOT NULL)
SELECT key, p, {ppf_sql('p')} AS z, {cdf_sql('zz')} AS back FROM (SELECT *, {ppf_sql('p')} AS zz FROM a)""")
def f14(v):
    w = Window.partitionBy("midx")
    d = v.ret_s.where("ret is not null").withColumn("p", (F.rank().over(w.orderBy("ret")) - 0.5) / F.count("*").over(w))
    return d.withColumn("z", T.norm_ppf("p")).withColumn("back", T.norm_cdf("z"))


@query("f15_unbiased_moments", "trial_id skew:f kurt:f", """SELECT trial_id, skewness(ret) AS skew, kurtosis(ret)+3 AS kurt FROM trial_ret GROUP BY trial_id""")
def f15(v):
    return v.trial_ret.groupBy("trial_id").agg(T.skew_unbiased("ret").alias("skew"), T.kurt_unbiased("ret", excess=False).alias("kurt"))


NW = """d AS (SELECT {k}, x, x - avg(x) OVER (PARTITION BY {k}) AS d, row_number() OVER (PARTITION BY {k} ORDER BY month) AS i FROM s),
 l AS (SELECT {k}, x, d, d*lag(d,1) OVER w AS p1, d*lag(d,2) OVER w AS p2, d*lag(d,3) OVER w AS p3 FROM d WINDOW w AS (PARTITION BY {k} ORDER BY i)),
 nw AS (SELECT {k}, count(*) AS n, avg(x) AS mean, sqrt(greatest(0, sum(d*d)/count(*) + 2*0.75*sum(p1)/count(*) + 2*0.5*sum(p2)/count(*) + 2*0.25*sum(p3)/count(*))/count(*)) AS se FROM l GROUP BY {k})"""


@query("g03_newey_west", "trial_id n:i mean:f se:f nw_t:f", f"WITH s AS (SELECT trial_id, month, ret AS x FROM trial_ret), {NW.format(k='trial_id')} SELECT *, mean/se AS nw_t FROM nw")
def g03(v):
    return I.newey_west(v.trial_ret, ["trial_id"], "month", "ret", 3)


def start_sql(c, n, seed):
    m = 2147483648
    x1 = f"((({c}+{seed})*1103515245+12345)%{m})"
    x2 = f"(((({x1}*{x1})>>10)+({c}+{seed})*7919)%{m})"
    return f"(((({x2}*69069+1)%{m})*{n})>>31)"


@query("g04_bootstrap_sharpe_ci", "series_id lo:f hi:f reps:i", f"""WITH p AS (SELECT series_id, ret, CAST(row_number() OVER (PARTITION BY series_id ORDER BY month)-1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM series),
 d AS (SELECT series_id, n, rep, blk, {start_sql('(rep*CAST(ceil(n/3.0) AS BIGINT)+blk)', 'n', 7)} AS st FROM (SELECT DISTINCT series_id, n FROM p), range(1000) r(rep), range(1000) b(blk) WHERE blk < ceil(n/3.0)),
 x AS (SELECT d.series_id, rep, d.n, ret FROM d JOIN range(3) o(off) ON blk*3+off < d.n JOIN p ON p.series_id=d.series_id AND p.pos=(st+off)%d.n),
 s AS (SELECT series_id, rep, (exp(sum(ln(1+ret))*12.0/count(*))-1)/(stddev_samp(ret)*sqrt(12)) AS sh FROM x GROUP BY ALL)
SELECT series_id, quantile_cont(sh, 0.025) AS lo, quantile_cont(sh, 0.975) AS hi, count(*) AS reps FROM s GROUP BY series_id""")
def g04(v):
    return I.bootstrap_sharpe_ci(v.series, ["series_id"], "month", "ret", 3, 1000, 7)


TS = """ts AS (SELECT trial_id, count(*) AS n, avg(ret-rate)/stddev_samp(ret-rate) AS sr, skewness(ret-rate) AS sk, kurtosis(ret-rate)+3 AS ku FROM trial_ret JOIN rates USING (month) GROUP BY trial_id),
 vv AS (SELECT var_samp(sr) AS v, count(*) AS k FROM ts)"""


def trial_stats(v):
    d = P.attach_rate(v.trial_ret, v.rates).withColumn("ex", F.col("ret") - F.col("rate"))
    t = d.groupBy("trial_id").agg(F.count("*").alias("n"), (T.sharpe_excess("ex") / SQRT12).alias("sr"), T.skew_unbiased("ex").alias("sk"), T.kurt_unbiased("ex", excess=False).alias("ku"))
    var = t.agg(F.var_samp("sr").alias("v"), F.count("sr").alias("k"))
    return attach_one(t, var).withColumn("sr0", T.expected_max_sharpe("v", "k"))


SR0 = f"(sqrt(v)*((1-0.5772156649015329)*{ppf_sql('(1-1.0/k)')}+0.5772156649015329*{ppf_sql('(1-1.0/(k*2.718281828459045))')}))"


@query("g05_deflated_sharpe_normal", "trial_id dsr:f", f"WITH {TS} SELECT trial_id, {cdf_sql('z')} AS dsr FROM (SELECT trial_id, (sr - {ppf_sql('(1-1.0/k)')}/sqrt(n-1))*sqrt(n-1) AS z FROM ts, vv)")
def g05(v):
    return trial_stats(v).withColumn("dsr", T.deflated_sharpe_normal("sr", "n", "k"))


@query("g06_deflated_sharpe_full", "trial_id sr0:f dsr:f", f"WITH {TS}, a AS (SELECT *, {SR0} AS sr0 FROM ts, vv) SELECT trial_id, sr0, {cdf_sql('z')} AS dsr FROM (SELECT *, (sr-sr0)*sqrt(n-1)/sqrt(1-sk*sr+(ku-1)/4*sr*sr) AS z FROM a)")
def g06(v):
    return trial_stats(v).withColumn("dsr", T.deflated_sharpe_full("sr", "sr0", "n", "sk", "ku"))


@query("g07_hurdle_sharpe", "trial_id hurdle:4", f"""WITH RECURSIVE {TS}, a AS (SELECT *, {SR0} AS sr0 FROM ts, vv),
 it AS (SELECT trial_id, sr0, n, sk, ku, 0 AS i, 0.0::DOUBLE AS lo, 3.0::DOUBLE AS hi FROM a UNION ALL
  SELECT trial_id, sr0, n, sk, ku, i+1, CASE WHEN low THEN (lo+hi)/2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo+hi)/2 END FROM
  (SELECT *, coalesce({cdf_sql('z')} < 0.95, false) AS low FROM (SELECT *, CASE WHEN 1-sk*m+(ku-1)/4*m*m > 0 THEN (m-sr0)*sqrt(n-1)/sqrt(1-sk*m+(ku-1)/4*m*m) END AS z FROM (SELECT *, (lo+hi)/2/sqrt(12) AS m FROM it WHERE i < 60))))
SELECT trial_id, (lo+hi)/2 AS hurdle FROM it WHERE i = 60""")
def g07(v):
    return trial_stats(v).withColumn("hurdle", I.hurdle_sharpe(F.lit(0.95), "sr0", "n", "sk", "ku"))


def excess_pairs(v):
    v.shared("series", "rates")
    ex = P.attach_rate(v.series, v.rates).select("series_id", "month", (F.col("ret") - F.col("rate")).alias("ret"))
    return P.aligned_pairs(ex, pairs_vs(v))


def _boot_sql(kind, reps, seed):
    stat = ("ln(vx)-ln(vy)", "-2*mx/vx", "2*my/vy", "1/vx", "-1/vy") if kind == "variance" else (
        "mx/sqrt(vx)-my/sqrt(vy)", "gx/pow(vx,1.5)", "-gy/pow(vy,1.5)", "-mx/(2*pow(vx,1.5))", "my/(2*pow(vy,1.5))")
    def moments(src, keys):
        return (f"SELECT *, {stat[0]} AS delta, {stat[1]} AS c1, {stat[2]} AS c2, {stat[3]} AS c3, {stat[4]} AS c4 FROM (SELECT {keys}, any_value(n) AS n, avg(x) AS mx, avg(y) AS my, avg(x*x) AS gx, avg(y*y) AS gy, "
                f"avg(x*x)-avg(x)*avg(x) AS vx, avg(y*y)-avg(y)*avg(y) AS vy FROM {src} GROUP BY {keys})")
    def se(src, mom, keys):
        on = " AND ".join(f"s.{k.strip()}=m.{k.strip()}" for k in keys.split(","))
        ks = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
        return (f"SELECT {keys}, any_value(delta) AS delta, any_value(n) AS n, sqrt(avg(b*b)/4/any_value(n)) AS se FROM (SELECT {ks}, s.blk, any_value(m.delta) AS delta, any_value(m.n) AS n, "
                f"sum(c1*(x-mx)+c2*(y-my)+c3*(x*x-gx)+c4*(y*y-gy)) AS b FROM {src} s JOIN {mom} m ON {on} GROUP BY {ks}, s.blk) GROUP BY {keys}")
    cmp = ">=" if kind == "sharpe" else "<="
    return f"""WITH e AS (SELECT series_id, month, ret-rate AS ret FROM series JOIN rates USING (month)),
 r AS (SELECT s.series_id AS a, s.month, s.ret AS x, t.ret AS y FROM e s JOIN e t USING (month) WHERE t.series_id='AUTOMOBILE' AND s.series_id<>'AUTOMOBILE'),
 p AS (SELECT a, x/sc AS x, y/sc AS y, pos, n, pos//4 AS blk FROM (SELECT *, sqrt(avg(x*x) OVER w/2+avg(y*y) OVER w/2) AS sc, CAST(row_number() OVER (PARTITION BY a ORDER BY month)-1 AS BIGINT) AS pos, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY a))),
 m0 AS ({moments('p', 'a')}), b0 AS ({se('p', 'm0', 'a')}),
 d AS (SELECT a, n, rep, blk, {start_sql('(rep*CAST(ceil(n/4.0) AS BIGINT)+blk)', 'n', seed)} AS st FROM (SELECT DISTINCT a, n FROM p), range({reps}) q(rep), range(1000) z(blk) WHERE blk < ceil(n/4.0)),
 x AS (SELECT d.a, rep, d.blk, d.n, x, y FROM d JOIN range(4) o(off) ON d.blk*4+off < d.n JOIN p ON p.a=d.a AND p.pos=(st+off)%d.n),
 m1 AS ({moments('x', 'a, rep')}), b1 AS ({se('x', 'm1', 'a, rep')}),
 f AS (SELECT b1.a, b0.n, b0.delta, b0.se AS se_nat, b0.delta/b0.se AS z, (b1.delta-b0.delta)/b1.se AS zc FROM b1 JOIN b0 USING (a))
SELECT a, 'AUTOMOBILE' AS b, any_value(n) AS n, any_value(delta) AS delta, any_value(se_nat) AS se_nat, any_value(z) AS z, (1+count(*) FILTER (zc {cmp} z))/(1.0+count(*)) AS p_one_sided,
 (1+count(*) FILTER (abs(zc) >= abs(z)))/(1.0+count(*)) AS p_two_sided, count(*) AS reps FROM f GROUP BY a"""


SPEC10 = "a b n:i delta:f se_nat:f z:f p_one_sided:f p_two_sided:f reps:i"


@query("g10_paired_bootstrap_sharpe", SPEC10, _boot_sql("sharpe", 5000, 20260926))
def g10(v):
    return I.paired_bootstrap(excess_pairs(v), ["a", "b"], "month", "sharpe", 4, 5000)


@query("g10_paired_bootstrap_variance", SPEC10, _boot_sql("variance", 4999, 20260926))
def g10v(v):
    return I.paired_bootstrap(excess_pairs(v), ["a", "b"], "month", "variance", 4, 4999)


@query("g11_detectable_gap", "trial_id gap:f p:f", f"WITH s AS (SELECT trial_id, month, ret AS x FROM trial_ret), {NW.format(k='trial_id')} SELECT trial_id, ({ppf_sql('0.95')}+{ppf_sql('0.8')})*se*12 AS gap, 2*(1-{cdf_sql('abs(mean/se)')}) AS p FROM nw")
def g11(v):
    nw = I.newey_west(v.trial_ret, ["trial_id"], "month", "ret", 3)
    return nw.select("trial_id", (I.detectable_gap("se") * 12.0).alias("gap"), I.two_sided_p("nw_t").alias("p"))
