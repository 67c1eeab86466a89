"""Pieces of the SQL that the queries are checked against: the adapters' tables and the exponential mean."""

import math


EVENTS = "ev AS (SELECT event_id, event_type AS symbol, ts, user_id AS author, value, props FROM events)"
BARS = """bars AS (SELECT format('S{:02d}', l_suppkey % 20) AS symbol, CAST(l_shipdate AS DATE) AS date,
 round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 4) AS close, round(max(l_extendedprice / l_quantity), 4) AS high,
 round(min(l_extendedprice / l_quantity), 4) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def scores(period: str = "week") -> str:
    return f"""scores AS (SELECT *, round(0.5::double * technical + 0.3::double * social + 0.2::double * catalyst, 4) AS composite FROM (
 SELECT CAST(date_trunc('{period}', o_orderdate) AS DATE) AS run, format('S{{:02d}}', o_custkey % 20) AS symbol,
 round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e5::double, 4) AS technical,
 round(avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0::double ELSE 0.0::double END), 4) AS social,
 round(count(*) / 10.0::double, 4) AS catalyst FROM orders GROUP BY 1, 2))"""


LOG = """log AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS order_id,
 format('S{:02d}', l_suppkey % 20) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
 CASE WHEN l_linestatus = 'O' THEN 'paper' ELSE 'live' END AS mode,
 CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'P' THEN 'PARTIALLY_FILLED' ELSE 'EXPIRED' END AS status,
 CASE WHEN l_linenumber % 2 = 0 THEN 'MARKET' ELSE 'LIMIT' END AS order_type, l_quantity AS qty,
 round(l_extendedprice / l_quantity, 4) AS price, round(l_extendedprice / l_quantity * (1 - l_discount / 10), 4) AS entry,
 round(l_extendedprice * l_tax / 100, 4) AS fee FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ewm(name: str, source: str, x: str, alpha: float, least: int) -> str:
    """CTEs for name(symbol, date, y), the exponential mean of x over source's rows that have one."""
    reach = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    return f"""{name}_n AS (SELECT symbol, date, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {source} WHERE {x} IS NOT NULL),
{name} AS (SELECT a.symbol, a.date, CASE WHEN any_value(a.i) >= {least} THEN sum(CASE WHEN b.i = 1 THEN 1.0::double ELSE {alpha!r}::double END * pow({1 - alpha!r}::double, a.i - b.i) * b.x) END AS y
 FROM {name}_n a JOIN {name}_n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {reach} AND a.i GROUP BY a.symbol, a.date)"""


def ema(name: str, source: str, x: str, span: int) -> str:
    return ewm(name, source, x, 2.0 / (span + 1), max(2, span // 2))
