"""The canonical views of ``panelspark.plans.views`` as oracle SQL."""
_END = "(SELECT date_trunc('month', CAST(max({0}) AS DATE) + INTERVAL 1 DAY) FROM {1})"
_LINE_END, _ORDER_END = _END.format("l_shipdate", "lineitem"), _END.format("o_orderdate", "orders")
_M = "CAST(date_trunc('month', {}) AS DATE)"
_I = "CAST(year({0})*12+month({0}) AS INTEGER)"


def _px(key, period, name, extra="", idx=True):
    m = period.format("l_shipdate")
    i = f", {_I.format(m)} AS midx" if idx else ""
    return (f"SELECT {key} AS key, {m} AS {name}{i}, SUM(l_extendedprice)/SUM(l_quantity) AS price, SUM(l_quantity) AS volume "
            f"FROM lineitem {extra} WHERE l_shipdate < {_LINE_END} GROUP BY ALL")


def _ret(px):
    return (f"SELECT key, month, midx, CASE WHEN lag(midx) OVER w = midx-1 THEN price/lag(price) OVER w - 1 END AS ret "
            f"FROM {px} WINDOW w AS (PARTITION BY key ORDER BY midx)")


def _tags(src):
    return ("SELECT key, num, name, 'C'||CAST(num%5 AS VARCHAR) AS category, CASE WHEN num%11=0 THEN 'Appendix 3' ELSE 'Core' END AS section, "
            "num%7=0 AS cash_like, num%7=1 AS short_duration, num%7=2 AS near_cash, num%7=3 AS thin, num%7>=4 AS equity_only, "
            "CASE num%3 WHEN 0 THEN 'equity' WHEN 1 THEN 'bond' ELSE 'commodity' END AS asset_class, num%10<>9 AS approved "
            f"FROM ({src})")


def _chg(src, key):
    return (f"SELECT key AS {key}, month, midx, ret FROM (SELECT key, month, midx, CASE WHEN lag(midx) OVER w = midx-1 THEN v/lag(v) OVER w - 1 END AS ret "
            f"FROM ({src}) WINDOW w AS (PARTITION BY key ORDER BY midx)) WHERE ret IS NOT NULL")


_OV = (f"SELECT c_mktsegment, c_nationkey, {_M.format('o_orderdate')} AS month, {_I.format('o_orderdate')} AS midx, o_totalprice AS v "
       f"FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < {_ORDER_END}")

VIEWS = {
    "px_s": _px("'S'||CAST(l_suppkey AS VARCHAR)", _M, "month"),
    "px_b": _px("p_brand", _M, "month", "JOIN part ON l_partkey = p_partkey"),
    "px_d": _px("p_type", "CAST({} AS DATE)", "date", "JOIN part ON l_partkey = p_partkey", idx=False),
    "ret_s": _ret("px_s"),
    "ret_b": _ret("px_b"),
    "ret_d": "SELECT key, date, price, volume, price/lag(price) OVER (PARTITION BY key ORDER BY date) - 1 AS ret FROM px_d",
    "uni_s": _tags("SELECT 'S'||CAST(s_suppkey AS VARCHAR) AS key, s_suppkey AS num, s_name AS name FROM supplier"),
    "uni_b": _tags("SELECT DISTINCT p_brand AS key, CAST(split_part(p_brand,'#',2) AS BIGINT) AS num, p_brand AS name FROM part"),
    "uni_n": _tags("SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS num, n_name AS name FROM nation"),
    "deny_s": "SELECT key FROM uni_s WHERE num%25=3",
    "coverage_s": 'SELECT key, min(month) AS start, max(month) AS "end", count(price) AS n_obs FROM px_s GROUP BY key',
    "rates": (f"SELECT {_M.format('l_shipdate')} AS month, {_I.format(_M.format('l_shipdate'))} AS midx, "
              f"CASE WHEN {_M.format('l_shipdate')} >= DATE '1997-07-01' THEN avg(l_tax)/12 ELSE avg(l_discount)/12 END AS rate, "
              f"CASE WHEN {_M.format('l_shipdate')} >= DATE '1997-07-01' THEN 'own' ELSE 'fallback' END AS source "
              f"FROM lineitem WHERE l_shipdate < {_LINE_END} GROUP BY " + _M.format('l_shipdate')),
    "order_values": _OV,
    "series": _chg("SELECT c_mktsegment AS key, month, midx, SUM(v) AS v FROM order_values GROUP BY ALL", "series_id"),
    "trial_ret": _chg("SELECT c_mktsegment||'_R'||CAST(n_regionkey AS VARCHAR) AS key, month, midx, SUM(v) AS v FROM order_values "
                      "JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL", "trial_id"),
    "weights": ("SELECT strategy, month, midx, key, v/SUM(v) OVER (PARTITION BY strategy, month) AS weight FROM (SELECT c_mktsegment AS strategy, "
                "month, midx, n_name AS key, SUM(v) AS v FROM order_values JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"),
    "nation_ret": ("SELECT key, month, midx, CASE WHEN lag(midx) OVER w = midx-1 THEN v/lag(v) OVER w - 1 END AS ret FROM (SELECT n_name AS key, "
                   "month, midx, SUM(v) AS v FROM order_values JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) "
                   "WINDOW w AS (PARTITION BY key ORDER BY midx)"),
    "constituents": ("SELECT r_name AS sleeve, n_name AS key, 1.0::DOUBLE/COUNT(*) OVER (PARTITION BY r_name) AS within FROM nation "
                     "JOIN region ON n_regionkey = r_regionkey"),
    "events_daily": "SELECT event_type AS key, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL",
}
