"""Oracle SQL of a book's accounting and of performance figures."""


def book_sql(name, w, ret, drift=True, bps=5, missing="null"):
    """Gross, turnover and net of the weights table `w` (id, midx, key, weight): table <name>."""
    total = "sum(weight*n.ret)" if missing == "skip" else "CASE WHEN count(*) = count(n.ret) THEN sum(weight*n.ret) END"
    grown = f"""{name}_c AS (SELECT key, midx, exp(sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY key ORDER BY midx)) AS c FROM {ret}),
 {name}_h AS (SELECT {w}.id, nx AS midx, {w}.key, weight*coalesce(b.c, a.c, 1)/coalesce(a.c, 1) AS g FROM {w} JOIN {name}_x USING (id, midx) LEFT JOIN {name}_c a ON a.key={w}.key AND a.midx={w}.midx LEFT JOIN {name}_c b ON b.key={w}.key AND b.midx=nx WHERE nx IS NOT NULL),
 {name}_p AS (SELECT id, midx, key, g/sum(g) OVER (PARTITION BY id, midx) AS weight FROM {name}_h)""" if drift else f"{name}_p AS (SELECT {w}.id, nx AS midx, key, weight FROM {w} JOIN {name}_x USING (id, midx) WHERE nx IS NOT NULL)"
    return f"""{name}_x AS (SELECT id, midx, lead(midx) OVER (PARTITION BY id ORDER BY midx) AS nx FROM (SELECT DISTINCT id, midx FROM {w})), {grown},
 {name}_g AS (SELECT {w}.id, {w}.midx, {total} AS gross FROM {w} LEFT JOIN {ret} n ON n.key={w}.key AND n.midx={w}.midx+1 WHERE weight <> 0 GROUP BY ALL),
 {name}_t AS (SELECT coalesce(a.id,b.id) AS id, coalesce(a.midx,b.midx) AS midx, 0.5*sum(abs(coalesce(a.weight,0)-coalesce(b.weight,0))) AS turnover FROM {w} a FULL JOIN {name}_p b ON a.id=b.id AND a.midx=b.midx AND a.key=b.key GROUP BY 1,2),
 {name} AS (SELECT id, midx, gross, turnover, gross-turnover*{bps}/10000 AS net FROM {name}_g JOIN {name}_t USING (id, midx))"""


def performance_sql(name, src, keys="id", value="net"):
    return f"""{name}_w AS (SELECT *, exp(sum(ln(1+{value})) OVER (PARTITION BY {keys} ORDER BY midx)) AS wl FROM {src} WHERE {value} IS NOT NULL), {name}_d AS (SELECT *, wl/greatest(1.0, max(wl) OVER (PARTITION BY {keys} ORDER BY midx))-1 AS dd FROM {name}_w),
 {name} AS (SELECT {keys}, count(*) AS n, pow(exp(sum(ln(1+{value}))), 12.0/count(*))-1 AS cagr, stddev_samp({value})*sqrt(12) AS vol, (pow(exp(sum(ln(1+{value}))), 12.0/count(*))-1)/nullif(stddev_samp({value})*sqrt(12), 0) AS sharpe_rf0, min(dd) AS maxdd FROM {name}_d GROUP BY {keys})"""
