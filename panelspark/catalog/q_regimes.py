"""Verification queries: frontier forecasts, two-state regimes and the books on them, over the category sleeves.

The sleeves are a short literal list, so their matrices are columns of one row: linear systems and equal risk by coordinate
descent run inside expressions, and the oracle solves the same systems in SQL.
"""
from pyspark.sql import Window, functions as F

from panelspark.catalog import q_alloc as QA
from panelspark.catalog.base import query
from panelspark.catalog.book_sql import book_sql, performance_sql
from panelspark.functions.scalar import breakdown_scalar
from panelspark.operators import allocate as A, covariance as V, panel as P, portfolio as L, windows as W
from panelspark.plans import books as B
from panelspark.sources.stage import stage

NAMES = ["C0", "C1", "C2", "C3", "C4"]
DEFENSIVE, CYCLICAL = ("C0", "C1", "C2"), ("C2", "C3", "C4")
N = len(NAMES)
SLV = """slv AS (SELECT category AS key, midx, avg(ret) AS ret FROM (SELECT key, midx, ret, count(ret) OVER (PARTITION BY key ORDER BY midx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ret_s)
 JOIN uni_s USING (key) WHERE prior >= 12 GROUP BY ALL)"""
SCOV = f"{SLV}, {QA.COV.replace('ret_b', 'slv')}"


# ------------------------------------------------------------------ SQL of the small systems
def cell(i, j):
    return f"a_{min(i, j)}_{max(i, j)}"


def wide_sql(name, src, keys, names=NAMES, having=""):
    cells = ", ".join(f"max(CASE WHEN least(k1,k2)='{min(x, y)}' AND greatest(k1,k2)='{max(x, y)}' THEN cov END) AS {cell(i, j)}" for i, x in enumerate(names) for j, y in enumerate(names) if i <= j)
    return f"{name} AS (SELECT {keys}, {cells} FROM {src} GROUP BY {keys} HAVING count(DISTINCT k1||k2) FILTER (k1 IN {tuple(names)} AND k2 IN {tuple(names)}) = {len(names) * (len(names) + 1) // 2}{having})"


def eliminate_sql(src, n, rhs, tag):
    """Elimination and back substitution of a symmetric system; the last table is <tag>x0."""
    out, cur = [], src
    for k in range(n - 1):
        new = [f"{cell(i, j)} - {cell(k, i)}/{cell(k, k)}*{cell(k, j)} AS {cell(i, j)}" for i in range(k + 1, n) for j in range(i, n)]
        new += [f"{r}_{i} - {cell(k, i)}/{cell(k, k)}*{r}_{k} AS {r}_{i}" for r in rhs for i in range(k + 1, n)]
        out.append(f"{tag}{k} AS (SELECT * REPLACE ({', '.join(new)}) FROM {cur})")
        cur = f"{tag}{k}"
    for i in range(n - 1, -1, -1):
        cols = [f"({r}_{i}" + "".join(f" - {cell(i, j)}*{r}x_{j}" for j in range(i + 1, n)) + f")/{cell(i, i)} AS {r}x_{i}" for r in rhs]
        out.append(f"{tag}x{i} AS (SELECT *, {', '.join(cols)} FROM {cur})")
        cur = f"{tag}x{i}"
    return ", ".join(out)


def equal_risk_sql(name, src, keys, names=NAMES, ridge="1e-8", sweeps=100):
    """Coordinate descent, one coordinate a recursion step; (keys, key, weight) in table <name>."""
    n = len(names)
    entry = lambda i, j: f"({cell(i, j)}{f' + {ridge}' if i == j else ''})"
    rows = ", ".join("[" + ", ".join(f"{entry(i, j)}/z" for j in range(n)) + "]" for i in range(n))
    off = "(list_dot_product(c[s % {n} + 1], x) - c[s % {n} + 1][s % {n} + 1]*x[s % {n} + 1])".format(n=n)
    own = f"c[s % {n} + 1][s % {n} + 1]"
    weights = ", ".join(f"x[{i + 1}]/list_sum(x)" for i in range(n))
    return f"""{name}_m AS (SELECT {keys}, [{rows}] AS c FROM (SELECT *, ({' + '.join(entry(i, i) for i in range(n))})/{n} AS z FROM {src})),
 {name}_r AS (SELECT {keys}, c, 0 AS s, [{', '.join(f'1/sqrt(c[{i + 1}][{i + 1}])/{n}' for i in range(n))}] AS x FROM {name}_m
  UNION ALL SELECT {keys}, c, s + 1, list_transform(x, lambda v, i: CASE WHEN i = s % {n} + 1 THEN (sqrt({off}*{off} + 4*{own}/{n}) - {off})/(2*{own}) ELSE v END) FROM {name}_r WHERE s < {n * sweeps}),
 {name} AS (SELECT {keys}, unnest({names}) AS key, unnest([{weights}]) AS weight FROM {name}_r WHERE s = {n * sweeps})"""


# ------------------------------------------------------------------ frontier and its forecast
def sleeves(v):
    v.shared("ret_s")
    return stage(QA.sleeves(v))


def sleeve_cov(s):
    live = P.live_names(s, QA.LB, QA.LB, N)
    return V.linear_shrinkage(live, s, QA.LB)


def sleeve_frontier(s):
    means = s.select("key", "midx", F.avg("ret").over(W.by("key", order="midx").rangeBetween(-QA.LB + 1, 0)).alias("mean"))
    return V.frontier(V.wide_frontier(V.wide_matrix(sleeve_cov(s), ["midx"], NAMES), means, ["midx"], NAMES), ["midx"])


FRONT = f"""{SCOV}, {wide_sql('wd', 'lc', 'midx')}, mm AS (SELECT midx, {', '.join(f"max(CASE WHEN key='{x}' THEN mean END) AS m_{i}" for i, x in enumerate(NAMES))} FROM lv GROUP BY midx),
 sy AS (SELECT *, {', '.join(f'm_{i} AS mean_{i}, 1.0 AS o_{i}' for i in range(N))} FROM wd JOIN mm USING (midx)), {eliminate_sql('sy', N, ['o', 'm'], 'fe')},
 fs AS (SELECT midx, {' + '.join(f'ox_{i}' for i in range(N))} AS a, {' + '.join(f'ox_{i}*mean_{i}' for i in range(N))} AS b, {' + '.join(f'mx_{i}*mean_{i}' for i in range(N))} AS c FROM fex0),
 fr AS (SELECT midx, b/a AS r_mvp, 1/sqrt(a) AS sigma_mvp, (a*c-b*b)/a AS u FROM fs WHERE a > 0 AND (a*c-b*b)/a > 0)"""
TANGENT = "CASE WHEN abs({r}) >= 1e-12 THEN ({r}*{r} + {u}*{s}*{s})/{r} END"


@query("g17_sleeve_frontier", "midx:i r_mvp:8 sigma_mvp:8 u:f r_tp:f sigma_tp:f", f"""WITH {FRONT}, t AS (SELECT *, {TANGENT.format(r='r_mvp', s='sigma_mvp', u='u')} AS r_tp FROM fr)
SELECT midx, r_mvp, sigma_mvp, u, r_tp, sqrt(sigma_mvp*sigma_mvp + pow(r_tp-r_mvp, 2)/u) AS sigma_tp FROM t""")
def g17s(v):
    return sleeve_frontier(sleeves(v)).select("*", *[c.alias(n) for n, c in V.tangency("r_mvp", "sigma_mvp", "u").items()])


COEF = ["r_mvp", "sigma_mvp", "u"]
VAR = f"""vp AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p{i}' for i, c in enumerate(COEF))}, row_number() OVER w - 1 AS bef FROM fr WINDOW w AS (ORDER BY midx)),
 vs AS (SELECT *, {', '.join(f'covar_pop(p{i}, p{j}) OVER f AS {cell(i, j)}' for i in range(3) for j in range(i, 3))}, {', '.join(f'covar_pop(p{i}, {c}) OVER f AS y{q}_{i}' for q, c in enumerate(COEF) for i in range(3))},
  {', '.join(f'avg(p{i}) OVER f AS mx{i}' for i in range(3))}, {', '.join(f'avg({c}) FILTER (p0 IS NOT NULL) OVER f AS my{q}' for q, c in enumerate(COEF))} FROM vp WINDOW f AS (ORDER BY midx ROWS BETWEEN {{lag}} PRECEDING AND 1 PRECEDING)),
 {eliminate_sql('vs', 3, ['y0', 'y1', 'y2'], 've')},
 vf AS (SELECT midx, CAST(least(bef, {{lag}}+1) AS INTEGER) AS rows, {', '.join(f'CASE WHEN bef >= 13 THEN my{q}' + ''.join(f' + y{q}x_{i}*(p{i}-mx{i})' for i in range(3)) + f' ELSE p{q} END AS {c}_hat' for q, c in enumerate(COEF))}, r_mvp FROM vex0 WHERE bef > 0)"""


@query("g18_var_forecast", "midx:i rows:i r_mvp_hat:f sigma_mvp_hat:f u_hat:4", f"WITH {FRONT}, {VAR.format(lag=59)} SELECT * FROM vf")
def g18(v):
    return A.var1_forecast(sleeve_frontier(sleeves(v)), [], "midx", COEF, 60)


@query("b13_frontier_forecast", "midx:i r_tp_hat:f sigma_tp_hat:f r_mvp_hat:f r_mvp:f gap:f", f"""WITH {FRONT}, {VAR.format(lag=23)}, t AS (SELECT *, {TANGENT.format(r='r_mvp_hat', s='sigma_mvp_hat', u='u_hat')} AS r_tp_hat FROM vf)
SELECT midx, r_tp_hat, sqrt(sigma_mvp_hat*sigma_mvp_hat + pow(r_tp_hat-r_mvp_hat, 2)/u_hat) AS sigma_tp_hat, r_mvp_hat, r_mvp, r_mvp_hat-r_mvp AS gap FROM t""")
def b13(v):
    """Coefficients, their forecast from two years, the tangency point on the forecast frontier, and the error."""
    c = stage(sleeve_frontier(sleeves(v)))
    f = A.var1_forecast(c, [], "midx", COEF, 24)
    f = f.select("midx", "r_mvp_hat", *[x.alias(f"{n}_hat") for n, x in V.tangency("r_mvp_hat", "sigma_mvp_hat", "u_hat").items()])
    return f.join(c.select("midx", "r_mvp"), "midx").withColumn("gap", F.col("r_mvp_hat") - F.col("r_mvp"))


# ------------------------------------------------------------------ two states
PAIRS = "pr AS (SELECT a.midx, a.key AS k1, b.key AS k2, a.ret AS x, b.ret AS y FROM slv a JOIN slv b ON a.midx=b.midx AND a.key<b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"
ROLL = "CASE WHEN count(*) OVER w >= {least} AND stddev_samp(x) OVER w > 1e-12 AND stddev_samp(y) OVER w > 1e-12 THEN covar_samp(x,y) OVER w/(stddev_samp(x) OVER w*stddev_samp(y) OVER w) END"
FEATURES = f"""{SLV}, {PAIRS}, mk AS (SELECT midx, avg(ret) AS r, avg(ret) FILTER (key IN ('C0','C1')) - avg(ret) FILTER (key NOT IN ('C0','C1')) AS s FROM slv GROUP BY midx),
 mf AS (SELECT midx, CASE WHEN count(r) OVER w = 6 THEN stddev_samp(r) OVER w*sqrt(12) END AS vol, CASE WHEN count(s) OVER w = 6 THEN avg(s) OVER w END AS spread FROM mk WINDOW w AS (ORDER BY midx ROWS 5 PRECEDING)),
 co AS (SELECT midx, avg(c) AS corr FROM (SELECT midx, {ROLL.format(least=12)} AS c FROM pr WINDOW w AS (PARTITION BY k1,k2 ORDER BY midx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY midx), ft AS (SELECT * FROM mf JOIN co USING (midx))"""


def states_sql(name, cols, least, steps=8, lookback=None):
    """The rounds of the walk-forward two-means, unrolled; table <name> with (midx, stress, rows, settled)."""
    frame = f"(ORDER BY midx {'ROWS UNBOUNDED PRECEDING' if lookback is None else f'RANGE BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW'})"
    near = lambda lo, hi: f"CASE WHEN {' + '.join(f'pow(({c}-{hi(c)})/sd_{c}, 2)' for c in cols)} < {' + '.join(f'pow(({c}-{lo(c)})/sd_{c}, 2)' for c in cols)} THEN 1 ELSE 0 END"
    out = [f"{name}a AS (SELECT midx, {', '.join(cols)}, count(*) OVER f AS rows, " + ", ".join(f"coalesce(nullif(stddev_samp({c}) OVER f, 0), 1) AS sd_{c}, arg_min({c}, vol) OVER f AS lo_{c}, arg_max({c}, vol) OVER f AS hi_{c}" for c in cols)
           + f" FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} WINDOW f AS {frame})",
           f"{name}0 AS (SELECT *, {near(lambda c: f'lo_{c}', lambda c: f'hi_{c}')} AS st, 0 AS was FROM {name}a)"]
    for i in range(1, steps + 1):
        means = ", ".join(f"coalesce(avg({c}) FILTER (st = 0) OVER f, lo_{c}) AS m0_{c}, coalesce(avg({c}) FILTER (st = 1) OVER f, hi_{c}) AS m1_{c}" for c in cols)
        gone = ", ".join(f"m0_{c}, m1_{c}" for c in cols)
        out.append(f"{name}{i} AS (SELECT * EXCLUDE ({gone}) REPLACE ({near(lambda c: f'm0_{c}', lambda c: f'm1_{c}')} AS st, st AS was) FROM (SELECT *, {means} FROM {name}{i - 1} WINDOW f AS {frame}))")
    out.append(f"{name}v AS (SELECT *, avg(vol) FILTER (st = 0) OVER f AS v0, avg(vol) FILTER (st = 1) OVER f AS v1 FROM {name}{steps} WINDOW f AS {frame})")
    out.append(f"{name} AS (SELECT midx, CASE WHEN v1 IS NULL THEN 0 WHEN v0 IS NULL OR v1 >= v0 THEN st ELSE 1 - st END AS stress, rows, st = was AS settled FROM {name}v WHERE rows >= {least})")
    return ", ".join(out)


@query("g19_regime_labels", "midx:i stress:i rows:i settled:b", f"WITH {FEATURES}, {states_sql('lb', ['vol', 'corr', 'spread'], 36)} SELECT * FROM lb")
def g19(v):
    v.shared("ret_s")
    return A.regime_labels(QA.regime_features(v), "midx", ["vol", "corr", "spread"], "vol")


@query("g19_rolling_regime_labels", "midx:i stress:i rows:i", f"WITH {FEATURES}, {states_sql('lb', ['vol', 'corr'], 24, lookback=36)} SELECT midx, stress, rows FROM lb")
def g19r(v):
    """The fit sees the last three years only."""
    v.shared("ret_s")
    return A.regime_labels(QA.regime_features(v), "midx", ["vol", "corr"], "vol", 24, lookback=36)


@query("b09_regime_transitions", "a:i b:i n:i p:f", f"""WITH {FEATURES}, {states_sql('lb', ['vol', 'corr'], 24)}, nx AS (SELECT stress AS a, lead(stress) OVER (ORDER BY midx) AS b FROM lb)
SELECT a, b, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY a) AS p FROM nx WHERE b IS NOT NULL GROUP BY a, b""")
def b09t(v):
    v.shared("ret_s")
    lab = A.regime_labels(QA.regime_features(v), "midx", ["vol", "corr"], "vol", 24)
    d = lab.withColumn("nxt", F.lead("stress").over(Window.orderBy("midx"))).where("nxt is not null")  # one row per month
    g = d.groupBy(F.col("stress").alias("a"), F.col("nxt").alias("b")).agg(F.count("*").alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


# ------------------------------------------------------------------ allocations by state
def by_state(s, labels):
    """Equal weight, inverse volatility and equal risk over the sleeves that each state allows, at every labelled month."""
    d = s.withColumn("sd", F.stddev_samp("ret").over(W.by("key", order="midx").rangeBetween(-QA.LB + 1, 0))).where("sd is not null")
    cov = stage(sleeve_cov(s))
    ok = cov.select("midx").distinct()
    out = None
    for state, names in ((0, CYCLICAL), (1, DEFENSIVE)):
        own = d.where(F.col("key").isin(*names)).join(ok, "midx", "left_semi")
        for alloc, w in (("ew", L.equal_weight(own, ["midx"])), ("ivol", L.inverse_vol(own, ["midx"], "sd")), ("erc", V.wide_equal_risk(V.wide_matrix(cov, ["midx"], list(names)), ["midx"], list(names), 0.0))):
            w = w.select("midx", "key", "weight", F.lit(alloc).alias("allocator"), F.lit(state).alias("state"))
            out = w if out is None else out.unionByName(w)
    return out.join(labels, "midx").where("state = stress")


def _alloc_sql(table, names, state):
    own = f"(SELECT s.midx, s.key, sd FROM sdv s WHERE key IN {names} AND midx IN (SELECT midx FROM cv))"
    return f"""{table}w AS (SELECT midx, {state} AS state, 'ew' AS allocator, key, 1.0/count(*) OVER (PARTITION BY midx) AS weight FROM {own}
 UNION ALL SELECT midx, {state}, 'ivol', key, (1/greatest(sd,1e-8))/sum(1/greatest(sd,1e-8)) OVER (PARTITION BY midx) FROM {own} UNION ALL SELECT midx, {state}, 'erc', key, weight FROM {table}e)"""


STATE_W = f"""{FEATURES}, {QA.COV.replace('ret_b', 'slv')}, sdv AS (SELECT * FROM (SELECT key, midx, stddev_samp(ret) OVER (PARTITION BY key ORDER BY midx RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS sd FROM slv) WHERE sd IS NOT NULL),
 {wide_sql('cwd', 'lc', 'midx', list(CYCLICAL))}, {wide_sql('dwd', 'lc', 'midx', list(DEFENSIVE))}, {equal_risk_sql('cye', 'cwd', 'midx', list(CYCLICAL), '0')}, {equal_risk_sql('dee', 'dwd', 'midx', list(DEFENSIVE), '0')},
 {_alloc_sql('cy', CYCLICAL, 0)}, {_alloc_sql('de', DEFENSIVE, 1)}, sw AS (SELECT * FROM cyw UNION ALL SELECT * FROM dew)"""


@query("l20_regime_allocation", "allocator midx:i key weight:8 stress:i", f"WITH RECURSIVE {STATE_W}, {states_sql('lb', ['vol', 'corr'], 36)} SELECT allocator, midx, key, weight, stress FROM sw JOIN lb USING (midx) WHERE state = stress")
def l20(v):
    """Three allocators over the sleeves that the current state allows."""
    s = sleeves(v)
    return by_state(s, A.regime_labels(QA.regime_features(v), "midx", ["vol", "corr"], "vol").select("midx", "stress"))


SETS = (("vol_corr", ["vol", "corr"]), ("vol_corr_spread", ["vol", "corr", "spread"]))
B09 = f"""{STATE_W}, {', '.join(states_sql(f'l{i}', c, 24) for i, (_, c) in enumerate(SETS))}, {wide_sql('awd', 'lc', 'midx')}, {equal_risk_sql('ale', 'awd', 'midx', NAMES, '0')},
 bw AS ({' UNION ALL '.join(f"SELECT 'dual_{n}_'||allocator AS id, midx, key, weight FROM sw JOIN l{i} USING (midx) WHERE state=stress AND allocator<>'ivol'" for i, (n, _) in enumerate(SETS))}
  UNION ALL SELECT 'unconditional_erc', midx, key, weight FROM ale JOIN l1 USING (midx) UNION ALL SELECT 'unconditional_ew', midx, key, 1.0/{N} FROM ale JOIN l1 USING (midx) UNION ALL SELECT 'always_calm', midx, key, weight FROM sw JOIN l1 USING (midx) WHERE state=0 AND allocator='erc')"""


@query("b09_dual_regime", "trial_id n:i cagr:f vol:f sharpe_rf0:f maxdd:f turnover:f stress_mean:f", f"""WITH RECURSIVE {B09}, {book_sql('bk', 'bw', 'slv', bps=0)}, {performance_sql('pf', 'bk')}, mq AS (SELECT midx-1 AS midx, avg(ret) AS m FROM slv GROUP BY midx), bd AS (SELECT midx FROM mq WHERE m <= (SELECT quantile_cont(m, 0.2) FROM mq)),
 tu AS (SELECT id, avg(turnover) AS turnover, avg(net) FILTER (midx IN (SELECT midx FROM bd)) AS stress_mean FROM bk GROUP BY id) SELECT id AS trial_id, n, cagr, vol, sharpe_rf0, maxdd, turnover, stress_mean FROM pf JOIN tu USING (id)""")
def b09(v):
    """Two feature sets by two allocators, and three nulls on the same months: all sleeves by equal risk and equal weight, always calm."""
    s = sleeves(v)
    feats = stage(QA.regime_features(v))
    lab = {n: stage(A.regime_labels(feats, "midx", c, "vol", 24).select("midx", "stress")) for n, c in SETS}
    out = None
    for name, labels in lab.items():
        w = by_state(s, labels).where("allocator <> 'ivol'").select("midx", "key", "weight", F.concat(F.lit(f"dual_{name}_"), "allocator").alias("trial_id"))
        out = w if out is None else out.unionByName(w)
    months = lab["vol_corr_spread"].select("midx")
    erc = V.wide_equal_risk(V.wide_matrix(sleeve_cov(s), ["midx"], NAMES), ["midx"], NAMES, 0.0).join(months, "midx", "left_semi")
    calm = by_state(s, months.withColumn("stress", F.lit(0))).where("allocator = 'erc'")
    for name, w in (("unconditional_erc", erc), ("unconditional_ew", erc.withColumn("weight", F.lit(1.0 / N))), ("always_calm", calm)):
        out = out.unionByName(w.select("midx", "key", "weight", F.lit(name).alias("trial_id")))
    book = stage(B.run_book(out, s, ["trial_id"], baseline="drifted", cost_bps=0.0))
    # bottom market quintile, after the fact: a diagnostic only; one row per month
    mkt = s.groupBy((F.col("midx") - 1).alias("midx")).agg(F.avg("ret").alias("m"))
    bad = mkt.where(F.col("m") <= mkt.agg(F.percentile("m", F.lit(0.2))).scalar()).select("midx", F.lit(True).alias("bad"))
    st = book.join(bad, "midx", "left").groupBy("trial_id").agg(F.avg("turnover").alias("turnover"), F.avg(F.when(F.col("bad"), F.col("net"))).alias("stress_mean"))
    return B.performance(book, ["trial_id"], "midx", "net").join(st, "trial_id")


# ------------------------------------------------------------------ regime parity and the resilient book
LEAST = 24


def regime_parity(s):
    """(midx, key, weight, regimes): per-regime equal-risk books blended by how often each regime was seen.

    A month's regime is its market volatility against the median up to it; only months with all sleeves count.  The moments of
    a regime are conditional frames on each pair, so no month is copied to later decisions.  A regime with fewer than LEAST
    months has no book: with one regime left its book stands alone, with none the unconditional one does.
    """
    one = Window.orderBy("midx")  # one row per month
    m = s.groupBy("midx").agg(F.avg("ret").alias("r"), F.count("ret").alias("c")).withColumn("vol", W.trailing_vol("r", one, 6, 12.0, min_periods=2)).where("vol is not null")
    m = m.withColumn("regime", (F.col("vol") >= W.expanding_quantile("vol", one, 0.5, 1, prior=False)).cast("int")).where(f"c = {N}").select("midx", "regime")
    p = P.paired(s, ["midx"], "key", "ret", own=True).join(m, "midx")
    f = Window.partitionBy("k1", "k2").orderBy("midx").rowsBetween(Window.unboundedPreceding, 0)
    pools = [(0, F.col("regime") == 0), (1, F.col("regime") == 1), (2, F.lit(True))]
    cells = [F.struct(F.lit(k).alias("pool"), F.covar_pop(F.when(c, F.col("x")), F.when(c, F.col("y"))).over(f).alias("cov"), F.count(F.when(c, 1)).over(f).alias("n")) for k, c in pools]
    e = p.select("midx", "k1", "k2", F.array(*cells).alias("cs")).select("midx", "k1", "k2", F.inline("cs")).where(F.col("n") >= LEAST)
    w = stage(V.wide_equal_risk(V.wide_matrix(e, ["midx", "pool"], NAMES), ["midx", "pool"], NAMES))
    seen = e.where("k1 = k2 and k1 = 'C0'").select("midx", "pool", "n")
    d = w.join(seen, ["midx", "pool"])
    share = d.where("pool < 2 and key = 'C0'").groupBy("midx").agg(F.sum("n").alias("_all"), F.count("*").alias("regimes"))
    d = d.join(share, "midx", "left").withColumn("regimes", F.coalesce("regimes", F.lit(0)))
    part = F.when(F.col("pool") < 2, F.col("n") / F.col("_all")).when(F.col("regimes") == 0, 1.0)
    return d.where(part.isNotNull()).groupBy("midx", "key").agg(F.sum(F.col("weight") * part).alias("weight"), F.max("regimes").alias("regimes"))


PARITY = f"""mo AS (SELECT *, CASE WHEN count(r) OVER w >= 2 THEN stddev_samp(r) OVER w*sqrt(12) END AS vol FROM (SELECT midx, avg(ret) AS r, count(ret) AS c FROM slv GROUP BY midx) WINDOW w AS (ORDER BY midx ROWS 5 PRECEDING)),
 rg AS (SELECT midx, CASE WHEN vol >= quantile_cont(vol, 0.5) OVER (ORDER BY midx ROWS UNBOUNDED PRECEDING) THEN 1 ELSE 0 END AS regime, c FROM mo WHERE vol IS NOT NULL),
 pq AS (SELECT a.midx, regime, a.key AS k1, b.key AS k2, a.ret AS x, b.ret AS y FROM slv a JOIN slv b ON a.midx=b.midx AND a.key<=b.key JOIN rg ON rg.midx=a.midx AND c={N}),
 pe AS ({' UNION ALL '.join(f"SELECT midx, {k} AS pool, k1, k2, covar_pop(x, y) FILTER ({c}) OVER f AS cov, count(*) FILTER ({c}) OVER f AS n FROM pq WINDOW f AS (PARTITION BY k1,k2 ORDER BY midx ROWS UNBOUNDED PRECEDING)" for k, c in ((0, 'regime=0'), (1, 'regime=1'), (2, 'true')))}),
 pn AS (SELECT * FROM pe WHERE n >= {LEAST}), {wide_sql('pw', 'pn', 'midx, pool')}, {equal_risk_sql('er', 'pw', 'midx, pool')},
 ps AS (SELECT er.*, pn.n FROM er JOIN pn ON pn.midx=er.midx AND pn.pool=er.pool AND k1='C0' AND k2='C0'), pa AS (SELECT midx, sum(n) AS total, count(*) AS regimes FROM ps WHERE pool<2 AND key='C0' GROUP BY midx),
 rp AS (SELECT midx, key, sum(weight*CASE WHEN pool<2 THEN n*1.0/total ELSE 1 END) AS weight, coalesce(max(regimes), 0) AS regimes FROM ps LEFT JOIN pa USING (midx) WHERE pool<2 OR regimes IS NULL GROUP BY midx, key)"""


@query("l18_regime_parity", "midx:i key weight:8 regimes:i", f"WITH RECURSIVE {SLV}, {PARITY} SELECT * FROM rp")
def l18(v):
    return regime_parity(sleeves(v))


SSTRESS = QA.STRESS.replace("ret_b", "slv")
RESILIENT = f"""{SSTRESS}, un AS (SELECT midx, a.key AS k1, b.key AS k2, covar_pop(a.ret, b.ret) AS cov FROM br a JOIN br b USING (midx, t) WHERE a.key<=b.key GROUP BY ALL),
 bl AS (SELECT midx, k1, k2, CASE WHEN st.cov IS NULL THEN un.cov ELSE 0.75*un.cov+0.25*st.cov END AS cov FROM un LEFT JOIN st USING (midx, k1, k2)), {wide_sql('bwd', 'bl', 'midx')}, {equal_risk_sql('be', 'bwd', 'midx')},
 {PAIRS}, ac AS (SELECT midx, avg(abs(c)) AS mac FROM (SELECT midx, {ROLL.format(least=6)} AS c FROM pr WINDOW w AS (PARTITION BY k1,k2 ORDER BY midx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY midx),
 sc AS (SELECT midx, CASE WHEN mac > 0.1 THEN greatest(0.5, 1-(mac-0.1)) ELSE 1.0 END AS scalar FROM ac),
 rw AS (SELECT midx, key, weight*scalar AS weight, scalar FROM be JOIN sc USING (midx) UNION ALL SELECT DISTINCT midx, 'CASH', greatest(0, 1-scalar), scalar FROM be JOIN sc USING (midx))"""


def resilient(s):
    """Equal risk on the stress-blended covariance, scaled down where sleeves move together, the rest in cash."""
    cov = QA.blended_cov(s, N)
    w = stage(V.wide_equal_risk(V.wide_matrix(cov, ["midx"], NAMES), ["midx"], NAMES))
    corr = P.mean_abs_corr(P.rolling_pair_corr(P.pair_returns(s, []), [], 60, 6), ["midx"])
    w = w.join(corr.select("midx", breakdown_scalar("mean_abs_corr", F.lit(0.1)).alias("scalar")), "midx")
    return L.scaled_with_cash(w, ["midx"], "scalar", "CASH").join(w.select("midx", "scalar").distinct(), "midx")


@query("l19_resilient_equal_risk", "midx:i key weight:8 scalar:f", f"WITH RECURSIVE {SLV}, {RESILIENT} SELECT * FROM rw")
def l19(v):
    return resilient(sleeves(v))


B14 = f"""{SLV}, {RESILIENT}, {PARITY}, rz AS (SELECT key, midx, ret FROM slv UNION ALL SELECT DISTINCT 'CASH', midx, 0.0 FROM slv), mi AS (SELECT DISTINCT midx FROM rw),
 bw AS (SELECT 'resilient' AS id, midx, key, weight FROM rw UNION ALL SELECT 'regime_parity', midx, key, weight FROM rp WHERE midx IN (SELECT midx FROM mi) UNION ALL SELECT 'null_erc', midx, key, weight FROM ue WHERE midx IN (SELECT midx FROM mi) UNION ALL SELECT 'null_ew', midx, unnest({NAMES}), 1.0/{N} FROM mi)"""
B14 = B14.replace("bw AS (SELECT 'resilient'", f"{wide_sql('uwd', 'un', 'midx')}, {equal_risk_sql('ue', 'uwd', 'midx')}, bw AS (SELECT 'resilient'")


@query("b14_resilient_book", "trial_id n:i cagr:f vol:f maxdd:f mean_cash:f turnover:f", f"""WITH RECURSIVE {B14}, {book_sql('bk', 'bw', 'rz', missing='skip')}, {performance_sql('pf', 'bk')},
 ca AS (SELECT id, avg(coalesce(c, 0)) AS mean_cash FROM (SELECT id, midx, max(CASE WHEN key='CASH' THEN weight END) AS c FROM bw GROUP BY ALL) GROUP BY id) SELECT id AS trial_id, n, cagr, vol, maxdd, mean_cash, turnover FROM pf JOIN ca USING (id) JOIN (SELECT id, avg(turnover) AS turnover FROM bk GROUP BY id) USING (id)""")
def b14(v):
    """The resilient and the regime-parity book with their nulls on the same months: unconditional equal risk and equal weight."""
    s = sleeves(v)
    w = stage(resilient(s).select("midx", "key", "weight", F.lit("resilient").alias("trial_id")))
    months = w.select("midx").distinct()
    erc = V.wide_equal_risk(V.wide_matrix(QA.past_cov(s, N), ["midx"], NAMES), ["midx"], NAMES)
    ew = months.select("midx", F.explode(F.array(*[F.lit(x) for x in NAMES])).alias("key"), F.lit(1.0 / N).alias("weight"))
    for name, x in (("regime_parity", regime_parity(s)), ("null_erc", erc), ("null_ew", ew)):
        w = w.unionByName(x.join(months, "midx", "left_semi").select("midx", "key", "weight", F.lit(name).alias("trial_id")))
    w = stage(w)
    ret = s.select("key", "midx", "ret").unionByName(s.select(F.lit("CASH").alias("key"), "midx", F.lit(0.0).alias("ret")).distinct())
    book = stage(B.run_book(w, ret, ["trial_id"], baseline="drifted", missing="skip"))
    cash = w.groupBy("trial_id", "midx").agg(F.coalesce(F.max(F.when(F.col("key") == "CASH", F.col("weight"))), F.lit(0.0)).alias("c")).groupBy("trial_id").agg(F.avg("c").alias("mean_cash"))
    return B.performance(book, ["trial_id"], "midx", "net").join(cash, "trial_id").join(book.groupBy("trial_id").agg(F.avg("turnover").alias("turnover")), "trial_id")
