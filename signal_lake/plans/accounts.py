"""Queries over accounts: portfolio views and what they lack, terms, protective orders, fees, halts with live points, benchmarks, and table scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signal_lake.functions import columns as col
from signal_lake.functions.columns import rounded as r
from signal_lake.operators import book, evaluation, ledger
from signal_lake.plans import sql
from signal_lake.plans.evaluate import _CURVE, _FILLS, _IC, _curve, _forward, _pairs
from signal_lake.plans.ledger import _COST, _FILLED
from signal_lake.plans.registry import registry
from signal_lake.plans.streams import _shared
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()

NOW = "2001-11-10"
#: Terms of a position from its fills before and after a day, and its last price; every so many symbols lack one of them.
_TERMS = """te AS (SELECT symbol, min(ts) AS opened, arg_max(price, (ts, order_id)) AS entry, max(price) AS high FROM f WHERE side = 'BUY' AND {} GROUP BY 1),
 {} AS (SELECT symbol, opened, entry, CASE WHEN CAST(substr(symbol, 2) AS INTEGER) % 4 <> 1 THEN 0.9::double * entry END AS stop, 1.5::double * entry AS target, high FROM te)"""
_LAST = "pz AS (SELECT symbol, arg_max(close, date) AS last FROM bars WHERE CAST(substr(symbol, 2) AS INTEGER) % 7 <> 6 GROUP BY 1)"


def _key():
    return F.substring("symbol", 2, 9).cast("int")


def _terms(log):
    bought = book.fills(log).where("side = 'BUY'")
    g = bought.groupBy("symbol").agg(F.min("ts").alias("opened"), F.max_by("price", F.struct("ts", "order_id")).alias("entry"), F.max("price").alias("high"))
    return g.select("symbol", "opened", "entry", F.when(_key() % 4 != 1, 0.9 * F.col("entry")).alias("stop"), (1.5 * F.col("entry")).alias("target"), "high")


def _last(spark, d):
    return src.daily_bars(spark, d).where(_key() % 7 != 6).groupBy("symbol").agg(F.max_by("close", "date").alias("last"))


def _view(spark, d):
    log = src.order_log(spark, d)
    held = book.net_positions(log).withColumnRenamed("net", "qty")
    terms = _terms(log).where(_key() % 5 != 2).withColumn("age_days", F.datediff(F.lit(NOW).cast("date"), "opened")).select("symbol", "stop", "target", "age_days", "high")
    return ledger.portfolio(held, ledger.average_cost(log), _last(spark, d), terms)


_VIEW = f"""{sql.LOG}, {_FILLED}, {_COST}, {sql.BARS}, {_LAST}, {_TERMS.format('true', 'tt')}, h AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM f GROUP BY 1),
 v AS (SELECT h.symbol, h.qty, CASE WHEN c.avg > 0 AND c.qty >= 0.999 * h.qty THEN c.avg END AS avg, last, h.qty * last AS value, tt.stop, tt.target, CASE WHEN tt.symbol IS NOT NULL THEN DATE '{NOW}' - tt.opened END AS age_days, tt.high
  FROM h LEFT JOIN cost c USING (symbol) LEFT JOIN pz USING (symbol) LEFT JOIN (SELECT * FROM tt WHERE CAST(substr(symbol, 2) AS INTEGER) % 5 <> 2) tt USING (symbol))"""


@query("portfolio_terms", f"""WITH {_VIEW} SELECT symbol, qty, round(avg, 4) AS avg, last, round(value, 2) AS value, round((last - avg) * qty, 2) AS pnl, round((last / avg - 1) * 100, 2) AS pnl_pct, round(100 * coalesce(value, 0) / sum(coalesce(value, 0)) OVER (), 4) AS weight_pct,
 CAST(age_days AS INTEGER) AS age_days, round(stop, 4) AS stop, round(target, 4) AS target, round((last / stop - 1) * 100, 2) AS to_stop_pct, round((target / last - 1) * 100, 2) AS to_target_pct, high FROM v""")
def portfolio_terms(spark, d):
    digits = {"avg": 4, "value": 2, "pnl": 2, "pnl_pct": 2, "weight_pct": 4, "stop": 4, "target": 4, "to_stop_pct": 2, "to_target_pct": 2}
    return _view(spark, d).select("symbol", "qty", "last", "age_days", "high", *[r(c, n).alias(c) for c, n in digits.items()])


@query("portfolio_warnings", f"""WITH {_VIEW}, w AS (SELECT count(*) FILTER (WHERE last IS NULL) AS unpriced, count(*) FILTER (WHERE age_days IS NULL) AS no_terms, count(*) FILTER (WHERE avg IS NULL) AS no_basis, CASE WHEN abs(500 + sum(value) - 1e6) / 1e6 > 0.2 THEN 1 ELSE 0 END AS basis_off FROM v)
 SELECT warning, CAST(n AS BIGINT) AS n FROM (UNPIVOT w ON unpriced, no_terms, no_basis, basis_off INTO NAME warning VALUE n) WHERE n > 0""")
def portfolio_warnings(spark, d):
    return ledger.portfolio_warnings(_view(spark, d), 500.0, 1e6, True)


@query("terms_merge", f"""WITH {sql.LOG}, {_FILLED}, {_TERMS.format("ts < DATE '1998-01-01'", 't1')}, x AS (SELECT * FROM f WHERE side = 'BUY' AND ts >= DATE '1998-01-01' AND CAST(substr(symbol, 2) AS INTEGER) % 3 <> 0),
 n AS (SELECT symbol, min(ts) AS opened, arg_max(price, (ts, order_id)) AS entry, max(price) AS high FROM x GROUP BY 1)
 SELECT symbol, strftime(coalesce(t1.opened, n.opened), '%Y-%m-%d') AS opened, coalesce(n.entry, t1.entry) AS entry, round(CASE WHEN n.entry IS NULL THEN t1.stop WHEN CAST(substr(symbol, 2) AS INTEGER) % 4 <> 1 THEN 0.9::double * n.entry END, 4) AS stop, round(1.5::double * coalesce(n.entry, t1.entry), 4) AS target, greatest(t1.high, n.high) AS high
 FROM t1 FULL JOIN n USING (symbol)""")
def terms_merge(spark, d):
    log = src.order_log(spark, d)
    out = ledger.merged_terms(_terms(log.where("ts < date'1998-01-01'")), _terms(log.where("ts >= date'1998-01-01'").where(_key() % 3 != 0)))
    return out.select("symbol", F.date_format("opened", "yyyy-MM-dd").alias("opened"), "entry", r("stop").alias("stop"), r("target").alias("target"), "high")


_RESTING = "rs AS (SELECT o_orderkey AS id, format('S{:02d}', o_custkey % 20) AS symbol, CASE WHEN o_custkey % 2 = 0 THEN 'oco' ELSE 'stop' END AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 'ALL_DONE' WHEN '2-HIGH' THEN 'REJECT' ELSE 'EXECUTING' END AS list_status FROM orders)"


@query("protection_status", f"""WITH {_RESTING}, lg AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'NEW' WHEN 'A' THEN 'FILLED' ELSE 'CANCELED' END AS status, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS executed FROM lineitem),
 g AS (SELECT id, max(executed) AS e, bool_and(status = 'NEW') AS o FROM lg GROUP BY 1) SELECT id, symbol, kind, CASE WHEN e > 0 THEN 'filled' ELSE 'cancelled' END AS status FROM rs JOIN g USING (id) WHERE CASE WHEN kind = 'oco' THEN list_status <> 'EXECUTING' ELSE NOT o END""")
def protection_status(spark, d):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "ALL_DONE").when(F.col("o_orderpriority") == "2-HIGH", "REJECT").otherwise("EXECUTING")
    resting = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), src.symbol("o_custkey").alias("symbol"), F.when(F.col("o_custkey") % 2 == 0, "oco").otherwise("stop").alias("kind"), state.alias("list_status"))
    filled = F.col("l_returnflag") == "A"
    legs = src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "NEW").when(filled, "FILLED").otherwise("CANCELED").alias("status"), F.when(filled, F.col("l_quantity")).otherwise(0.0).alias("executed"))
    return ledger.protection_status(resting, legs)


@query("stale_terms", f"""WITH {sql.LOG}, {_FILLED}, {sql.BARS}, {_LAST}, {_TERMS.format('true', 'tt')}, h AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) * CASE WHEN CAST(substr(symbol, 2) AS INTEGER) % 3 = 0 THEN 1e-9 ELSE 1 END AS qty FROM f GROUP BY 1)
 SELECT symbol FROM tt LEFT JOIN h USING (symbol) LEFT JOIN pz USING (symbol) WHERE CASE WHEN coalesce(qty, 0) <= 0 THEN 0 ELSE qty * last END < 1""")
def stale_terms(spark, d):
    log = src.order_log(spark, d)
    held = book.net_positions(log).select("symbol", (F.col("net") * F.when(_key() % 3 == 0, 1e-9).otherwise(1.0)).alias("qty"))
    return ledger.stale_terms(_terms(log), held, _last(spark, d))


@query("protection_gaps", f"""WITH {sql.LOG}, {_FILLED}, {sql.BARS}, {_LAST}, {_TERMS.format('true', 'tt')}, h AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM f GROUP BY 1)
 SELECT symbol, coalesce(qty, 0) AS qty, CASE WHEN coalesce(qty, 0) * last < 15 THEN 'small' WHEN stop IS NULL THEN 'no stop' WHEN last <= stop THEN 'through the stop' WHEN last >= target THEN 'past the target' END AS why FROM tt LEFT JOIN h USING (symbol) JOIN pz USING (symbol) WHERE symbol NOT LIKE 'S1%'""")
def protection_gaps(spark, d):
    log = src.order_log(spark, d)
    resting = log.where("symbol like 'S1%'").select("symbol")
    return ledger.protection(_terms(log), book.net_positions(log).withColumnRenamed("net", "qty"), _last(spark, d), resting, 15.0)


_ASSET = "CASE l_linenumber % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN format('S{:02d}', l_suppkey % 20) WHEN 2 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'BNB' ELSE 'USD' END END"


@query("fill_fees", f"""WITH fi AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, format('S{{:02d}}', l_suppkey % 20) AS symbol, round(l_extendedprice / l_quantity, 4) AS price, l_quantity AS qty, l_tax AS fee, {_ASSET} AS fee_asset FROM lineitem),
 g AS (SELECT order_id, symbol, sum(qty) AS qty, sum(price * qty) / sum(qty) AS price, coalesce(sum(fee) FILTER (WHERE fee_asset IN ('USDT', 'USD')), 0) AS usd, coalesce(sum(fee) FILTER (WHERE fee_asset = symbol), 0) AS base, bool_or(coalesce(fee_asset, '') = 'BNB') AS other, count(fee_asset) AS paid FROM fi GROUP BY 1, 2)
 SELECT order_id, symbol, qty, round(price, 4) AS price, round(CASE WHEN paid > 0 AND NOT other THEN usd + base * price END, 4) AS fee FROM g""")
def fill_fees(spark, d):
    n, key = F.col("l_linenumber") % 4, src.symbol("l_suppkey")
    asset = F.when(n == 0, "USDT").when(n == 1, key).when(n == 2, F.when(F.col("l_orderkey") % 3 == 0, "BNB").otherwise("USD"))
    fills = src.read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), key.alias("symbol"), r(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("fee"), asset.alias("fee_asset"))
    return ledger.fill_fees(fills).select("order_id", "symbol", "qty", r("price").alias("price"), r("fee").alias("fee"))


@query("halt_reset", f"""WITH {_CURVE}, c AS (SELECT mode, day, equity FROM curve WHERE day >= DATE '2024-01-11' UNION ALL SELECT mode, DATE '2024-02-02', 0.8::double * arg_max(equity, day) FROM curve WHERE mode <> 'view' GROUP BY 1),
 n AS (SELECT mode, max(day) AS now, max(equity) AS peak, arg_max(equity, day) AS e, arg_min(equity, day) AS o FROM c GROUP BY 1 HAVING count(*) >= 2 AND max(equity) > 0), b AS (SELECT mode, arg_max(equity, day) AS base FROM c JOIN n USING (mode) WHERE day <= now - 7 GROUP BY 1)
 SELECT mode, round(100 * (e / peak - 1), 2) AS drawdown, round(CASE WHEN coalesce(base, o) > 0 THEN 100 * (e / coalesce(base, o) - 1) END, 2) AS window_loss, 100 * (e / peak - 1) <= -15 OR coalesce(100 * (e / coalesce(base, o) - 1) <= -8, false) AS tripped FROM n LEFT JOIN b USING (mode)""")
def halt_reset(spark, d):
    """Judged from a day of resuming on, with today's equity at the end of all curves but one."""
    curve = _curve(spark, d)
    live = curve.where("mode <> 'view'").groupBy("mode").agg((0.8 * F.max_by("equity", "day")).alias("equity")).select("mode", F.lit("2024-02-02").cast("date").alias("day"), "equity")
    return book.halts(curve, reset="2024-01-11", live=live).select("mode", r("drawdown", 2).alias("drawdown"), r("window_loss", 2).alias("window_loss"), "tripped")


@query("equity_versus", f"""WITH {_CURVE}, {sql.BARS}, q AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY mode, equity ORDER BY day) = 1), t AS (SELECT mode, 100 * (arg_max(equity, day) / arg_min(equity, day) - 1) AS total FROM q GROUP BY 1),
 e AS (SELECT mode, min(day) AS a, max(day) AS b FROM curve GROUP BY 1), l AS (SELECT date + 1500 AS d, close FROM bars WHERE symbol = 'S00'), x AS (SELECT e.mode, l.close AS c0, e.b FROM e ASOF LEFT JOIN l ON e.a >= l.d), y AS (SELECT x.mode, c0, l.close AS c1 FROM x ASOF LEFT JOIN l ON x.b >= l.d)
 SELECT mode, round(total, 2) AS total_return, round(100 * (c1 / c0 - 1), 2) AS lead_return, round(total - 100 * (c1 / c0 - 1), 2) AS over_lead FROM t JOIN y USING (mode)""")
def equity_versus(spark, d):
    """Accounts against the lead, whose days are moved to theirs."""
    curve = _curve(spark, d)
    lead = src.daily_bars(spark, d).where("symbol = 'S00'").select(F.date_add("date", 1500).alias("date"), "close")
    out = evaluation.versus(evaluation.equity_stats(curve).select("mode", "total_return"), curve, lead)
    return out.select("mode", *[r(c, 2).alias(c) for c in ("total_return", "lead_return", "over_lead")])


@query("scores_backfilled", f"""WITH {sql.scores()}, c AS (SELECT *, CASE WHEN symbol = 'S03' THEN 'USDC' ELSE symbol END AS s FROM scores) SELECT strftime(run, '%Y-%m-%d') AS run, s AS symbol, CASE WHEN s NOT LIKE 'S1%' OR run < DATE '1998-01-01' THEN social END AS positioning, CASE WHEN run < DATE '1998-01-01' AND s LIKE 'S1%' THEN catalyst END AS events FROM c WHERE s <> 'USDC'""")
def scores_backfilled(spark, d):
    """Runs before 1998 kept their families in JSON; later ones have a column, not for all names."""
    old = F.col("run") < F.lit("1998-01-01").cast("date")
    s = src.scores(spark, d).withColumn("symbol", F.when(F.col("symbol") == "S03", "USDC").otherwise(F.col("symbol")))
    said = F.to_json(F.struct(F.struct(F.col("social").alias("positioning")).alias("positioning"), F.when(F.col("symbol").like("S1%"), F.struct(F.col("catalyst").alias("events"))).alias("events")))
    s = s.select("run", "symbol", F.when(~old & ~F.col("symbol").like("S1%"), F.col("social")).alias("positioning"), F.when(old, said).alias("components"))
    return evaluation.backfilled(s, ["positioning", "events"]).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "positioning", "events")


_GRID = f"""{sql.BARS}, {sql.scores('month')}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC}, g AS (SELECT family, horizon, count(*) AS n, avg(rho) AS m, stddev_samp(rho) AS sd, (max(run) - min(run)) / nullif(count(*) - 1, 0)::double AS gap FROM per WHERE rho IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT *, n / CASE WHEN n < 3 THEN 1.0::double ELSE greatest(1.0::double, horizon / gap) END AS eff FROM g), c AS (SELECT family, horizon, round(m, 4) AS m, round(CASE WHEN eff >= 2 AND sd > 0 THEN m / (sd / sqrt(eff)) END, 2) AS t FROM e)"""


@query("ic_cells", f"""WITH {_GRID}, x AS (SELECT family, horizon, CASE WHEN t IS NULL THEN printf('%+.4f', m) ELSE printf('%+.4f (%+.1f)', m, t) END AS cell FROM c) SELECT family, max(cell) FILTER (WHERE horizon = 7) AS h7, max(cell) FILTER (WHERE horizon = 30) AS h30 FROM x GROUP BY 1""")
def ic_cells(spark, d):
    s = evaluation.ic_summary(_pairs(spark, d, "month")).withColumns({"mean_ic": r("mean_ic"), "t": r("t", 2)})
    return evaluation.ic_grid(s, [7, 30]).select("family", F.col("7").alias("h7"), F.col("30").alias("h30"))


@query("mode_of_modes", f"WITH {sql.LOG}, n AS (SELECT symbol, mode, count(*) AS n FROM log GROUP BY 1, 2) SELECT symbol, mode, CAST(n AS BIGINT) AS n FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, mode) = 1")
def mode_of_modes(spark, d):
    """The mode that most of a symbol's orders have, of equals the first by name."""
    n = src.order_log(spark, d).groupBy("symbol", "mode").agg(F.count("*").alias("n"))
    return n.groupBy("symbol").agg(F.min_by(F.struct("mode", "n"), F.struct(-F.col("n"), "mode")).alias("m")).select("symbol", "m.*")


@query("span_hours", """WITH x AS (SELECT event_type AS symbol, CAST(date_trunc('week', ts) AS DATE) AS week, ts FROM events) SELECT symbol, strftime(week, '%Y-%m-%d') AS week, CAST(count(*) AS BIGINT) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::double, 4) AS hours FROM x GROUP BY 1, 2""")
def span_hours(spark, d):
    """Posts of each week and the hours that they span."""
    x = src.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    return x.groupBy("symbol", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), r(hours).alias("hours"))


# Scans: the predicate and the columns reach the file, the order is the reader's.


@query("scan_mentions", "SELECT event_id, event_type AS symbol, user_id AS author, value FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'signup')")
def scan_mentions(spark, d):
    e = src.read(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("event_type").isin("purchase", "signup"))
    return e.select("event_id", F.col("event_type").alias("symbol"), F.col("user_id").alias("author"), "value").orderBy("event_id")


@query("scan_catalysts", "SELECT event_id, event_type AS symbol, value AS impact FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value >= 200")
def scan_catalysts(spark, d):
    e = src.read(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("value") >= 200))
    return e.select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("impact")).orderBy(F.desc("impact"))


@query("scan_live_orders", f"WITH {sql.LOG} SELECT order_id, symbol, side, qty, price, status FROM log WHERE mode = 'live' AND status IN ('FILLED', 'PARTIALLY_FILLED')")
def scan_live_orders(spark, d):
    return src.order_log(spark, d).where("mode = 'live' and status in ('FILLED', 'PARTIALLY_FILLED')").select("order_id", "symbol", "side", "qty", "price", "status")


@query("scan_orders", f"WITH {sql.LOG} SELECT order_id, strftime(ts, '%Y-%m-%d') AS day, symbol, mode, status FROM log WHERE ts >= DATE '1997-01-01'")
def scan_orders(spark, d):
    return src.order_log(spark, d).where("ts >= date'1997-01-01'").select("order_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "symbol", "mode", "status")


@query("scan_position_meta", f"WITH {sql.LOG}, {_FILLS} SELECT symbol, book, strftime(min(ts), '%Y-%m-%d') AS opened, max(price) AS high FROM fl WHERE side = 'BUY' AND book = 'live' GROUP BY 1, 2")
def scan_position_meta(spark, d):
    x = book.fills(src.order_log(spark, d)).where("side = 'BUY' and book = 'live'")
    return x.groupBy("symbol", "book").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("opened"), F.max("price").alias("high")).orderBy("symbol")


@query("scan_funding", "SELECT o_custkey % 20 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS rate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def scan_funding(spark, d):
    o = src.read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return o.select((F.col("o_custkey") % 20).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("rate"))


@query("scan_ladder", "SELECT p_brand AS series, p_partkey AS ticker, p_retailprice AS strike FROM part WHERE p_size >= 10 AND p_retailprice > 500")
def scan_ladder(spark, d):
    return src.read(spark, d, "part").where("p_size >= 10 and p_retailprice > 500").select(F.col("p_brand").alias("series"), F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("strike")).orderBy("series", "strike")


@query("scan_equity", f"WITH {_CURVE} SELECT mode, strftime(day, '%Y-%m-%d') AS day, equity FROM curve WHERE mode = 'purchase' AND day >= DATE '2024-01-05'")
def scan_equity(spark, d):
    return _curve(spark, d).where("mode = 'purchase' and day >= date'2024-01-05'").select("mode", F.date_format("day", "yyyy-MM-dd").alias("day"), "equity")


@query("paper_book", f"""WITH {sql.LOG}, {_FILLS} SELECT book, round(1e6 - CAST(sum(CAST(CASE WHEN side = 'BUY' THEN qty ELSE -qty END * price AS DECIMAL(28,8))) AS DOUBLE) - CAST(sum(CAST(abs(fee) AS DECIMAL(28,8))) AS DOUBLE), 2) AS cash, round(CAST(sum(CAST(abs(fee) AS DECIMAL(28,8))) AS DOUBLE), 2) AS fees, CAST(count(*) AS BIGINT) AS fills FROM fl GROUP BY 1""")
def paper_book(spark, d):
    return ledger.paper_book(src.order_log(spark, d), 1e6).select("book", r("cash", 2).alias("cash"), r("fees", 2).alias("fees"), "fills")


@query("order_costs", f"""WITH {sql.LOG}, x AS (SELECT *, 6 + 10 * sqrt(qty * price / 1e6) AS bps, floor(CAST(qty / 7 AS DECIMAL(28,10)) / 0.25) * 0.25 AS whole FROM log) SELECT order_id, round(greatest(0, CASE WHEN order_type = 'LIMIT' THEN least(bps, 7) ELSE bps END), 4) AS bps, CAST(CASE WHEN whole >= 1.5 THEN whole ELSE 0 END AS DOUBLE) AS qty FROM x""")
def order_costs(spark, d):
    """What an order would slip, a limit order no further than it may cross, and what of a quantity the exchange takes."""
    x = src.order_log(spark, d)
    bps = col.capped_slippage(col.slippage_bps(F.col("qty") * F.col("price"), F.lit(1e6)), F.col("order_type") == "LIMIT", 7.0)
    return x.select("order_id", r(bps).alias("bps"), col.tradable(F.col("qty") / 7, F.lit(0.25), F.lit(1.5)).alias("qty"))


@query("csv_sink", f"WITH {sql.scores('month')} SELECT strftime(run, '%Y-%m-%d') AS run, symbol, technical, social, catalyst, composite FROM scores")
def csv_sink(spark, d):
    """A frame written as CSV in the shared folder and read back."""
    out = src.csv_sink(src.scores(spark, d, "month"), f"{_shared(spark)}/csv-{uuid.uuid4().hex}")
    return out.select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "technical", "social", "catalyst", "composite")
