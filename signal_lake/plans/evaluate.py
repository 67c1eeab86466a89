"""Queries over scores, returns, trades and the book."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded as r
from signal_lake.operators import asof, book, evaluation, matrix, simulation
from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()
#: Days of a stretch of the as-of joins.
STRETCH = 365
FAMILIES = ["technical", "social", "catalyst", "composite"]


def _forward(name: str, days: int) -> str:
    return f"""x{days} AS (SELECT a.symbol, a.date, a.close, b.close AS exit_close, b.date AS exit_date FROM bars a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.date + {days} <= b.date),
 {name} AS (SELECT s.*, x.date AS entry_date, x.exit_date, CASE WHEN x.close > 0 THEN x.exit_close / x.close - 1 END AS fwd FROM scores s ASOF LEFT JOIN x{days} x ON s.symbol = x.symbol AND s.run < x.date)"""


def _rows(spark, d, days: int = 7, period: str = "week"):
    return asof.forward_returns(src.scores(spark, d, period), src.daily_bars(spark, d), days, stretch=STRETCH)


def _pairs(spark, d, period: str):
    return evaluation.unpivoted(_both(spark, d, period), FAMILIES, {7: "fwd7", 30: "fwd30"})


def _both(spark, d, period: str):
    s, b = src.scores(spark, d, period), src.daily_bars(spark, d)
    out = asof.forward_returns(s, b, 7, stretch=STRETCH).withColumnRenamed("fwd", "fwd7").drop("entry_date", "exit_date")
    return asof.forward_returns(out, b, 30, stretch=STRETCH).withColumnRenamed("fwd", "fwd30")


_IC = """u AS (SELECT run, symbol, family, horizon, score, fwd FROM (SELECT run, symbol, technical, social, catalyst, composite, fwd, 7 AS horizon FROM f7 UNION ALL SELECT run, symbol, technical, social, catalyst, composite, fwd, 30 FROM f30)
  UNPIVOT (score FOR family IN (technical, social, catalyst, composite)) WHERE score IS NOT NULL AND fwd IS NOT NULL),
 rk AS (SELECT *, rank() OVER (PARTITION BY family, horizon, run ORDER BY score) + (count(*) OVER (PARTITION BY family, horizon, run, score) - 1) / 2.0::double AS a,
  rank() OVER (PARTITION BY family, horizon, run ORDER BY fwd) + (count(*) OVER (PARTITION BY family, horizon, run, fwd) - 1) / 2.0::double AS b FROM u),
 per AS (SELECT family, horizon, run, count(*) AS n, CASE WHEN count(*) >= 3 AND min(score) < max(score) AND min(fwd) < max(fwd) THEN corr(a, b) END AS rho FROM rk GROUP BY 1, 2, 3)"""
_SUM = """g AS (SELECT family, horizon, count(*) AS n_runs, avg(rho) AS mean_ic, stddev_samp(rho) AS sd, avg(CASE WHEN rho > 1e-12 THEN 1.0::double ELSE 0.0::double END) AS positive,
  (max(run) - min(run)) / nullif(count(*) - 1, 0)::double AS gap FROM per WHERE rho IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT *, CASE WHEN n_runs < 3 THEN 1.0::double ELSE greatest(1.0::double, horizon / gap) END AS overlap FROM g)
 SELECT family, CAST(horizon AS INTEGER) AS horizon, CAST(n_runs AS BIGINT) AS n_runs, round(mean_ic, 4) AS mean_ic, round(sd, 4) AS sd, round(overlap, 4) AS overlap,
  round(CASE WHEN n_runs / overlap >= 2 AND sd > 0 THEN mean_ic / (sd / sqrt(n_runs / overlap)) END, 4) AS t, round(100 * positive, 4) AS pct_positive FROM e"""


def _summary(df):
    return df.select("family", "horizon", "n_runs", *[r(c).alias(c) for c in ("mean_ic", "sd", "overlap", "t", "pct_positive")])


@query("fwd_returns", f"WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)} SELECT strftime(run, '%Y-%m-%d') AS run, symbol, strftime(entry_date, '%Y-%m-%d') AS entry_date, strftime(exit_date, '%Y-%m-%d') AS exit_date, round(fwd, 4) AS fwd FROM f7")
def fwd_returns(spark, d):
    return _rows(spark, d).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"), F.date_format("exit_date", "yyyy-MM-dd").alias("exit_date"), r("fwd").alias("fwd"))


@query("spearman_ic", f"WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC} SELECT family, CAST(horizon AS INTEGER) AS horizon, strftime(run, '%Y-%m-%d') AS run, CAST(n AS BIGINT) AS n, round(rho, 4) AS rho FROM per")
def spearman_ic(spark, d):
    out = evaluation.spearman(_pairs(spark, d, "week"), ["family", "horizon", "run"])
    return out.select("family", "horizon", F.date_format("run", "yyyy-MM-dd").alias("run"), "n", r("rho").alias("rho"))


@query("ic_summary", f"WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC}, {_SUM}")
def ic_summary(spark, d):
    return _summary(evaluation.ic_summary(_pairs(spark, d, "week")))


@query("ic_monthly", f"WITH {sql.BARS}, {sql.scores('month')}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC}, {_SUM}")
def ic_monthly(spark, d):
    return _summary(evaluation.ic_summary(_pairs(spark, d, "month")))


@query("pivot_ic_grid", f"WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC} SELECT family, round(avg(rho) FILTER (WHERE horizon = 7), 4) AS h7, round(avg(rho) FILTER (WHERE horizon = 30), 4) AS h30 FROM per WHERE rho IS NOT NULL GROUP BY 1")
def pivot_ic_grid(spark, d):
    per = evaluation.spearman(_pairs(spark, d, "week"), ["family", "horizon", "run"]).where("rho is not null")
    return per.groupBy("family").pivot("horizon", [7, 30]).agg(F.avg("rho")).select("family", r(F.col("7")).alias("h7"), r(F.col("30")).alias("h30"))


@query("quantile_spread", f"""WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY composite DESC, symbol) AS u, row_number() OVER (PARTITION BY run ORDER BY composite, symbol DESC) AS dn, count(*) OVER (PARTITION BY run) AS n FROM f7 WHERE fwd IS NOT NULL),
 p AS (SELECT run, avg(fwd) FILTER (WHERE u <= 3) AS top, avg(fwd) FILTER (WHERE dn <= 3) AS bottom FROM k WHERE n >= 6 GROUP BY 1)
 SELECT CAST(count(*) AS BIGINT) AS n_runs, round(avg(top), 4) AS top, round(avg(bottom), 4) AS bottom, round(avg(top) - avg(bottom), 4) AS spread FROM p""")
def quantile_spread(spark, d):
    return evaluation.quantile_spread(_rows(spark, d), "composite", "fwd").select("n_runs", *[r(c).alias(c) for c in ("top", "bottom", "spread")])


@query("hit_rate", f"WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)} SELECT CASE WHEN composite >= 0.9 THEN 'above' ELSE 'below' END AS side, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN fwd > 0 THEN 1.0::double ELSE 0.0::double END), 4) AS hit_rate, round(avg(fwd), 4) AS mean_fwd FROM f7 WHERE fwd IS NOT NULL GROUP BY 1")
def hit_rate(spark, d):
    return evaluation.hit_rate(_rows(spark, d), "composite", "fwd", 0.9).select("side", "n", r("hit_rate").alias("hit_rate"), r("mean_fwd").alias("mean_fwd"))


@query("benchmark", f"""WITH {sql.BARS}, e AS (SELECT symbol, arg_min(close, date) AS a, arg_max(close, date) FILTER (WHERE date <= DATE '1997-01-01') AS m, arg_max(close, date) AS z FROM bars GROUP BY 1)
 SELECT round(avg(m / a - 1), 4) AS basket_mid, round(avg(z / a - 1), 4) AS basket, round(max(CASE WHEN symbol = 'S00' THEN z / a - 1 END), 4) AS lead FROM e""")
def benchmark(spark, d):
    at = F.col("date") <= F.lit("1997-01-01").cast("date")
    e = src.daily_bars(spark, d).groupBy("symbol").agg(F.min_by("close", "date").alias("a"), F.max_by("close", F.when(at, F.col("date"))).alias("m"), F.max_by("close", "date").alias("z"))
    whole = F.col("z") / F.col("a") - 1
    return e.agg(r(F.avg(F.col("m") / F.col("a") - 1)).alias("basket_mid"), r(F.avg(whole)).alias("basket"), r(F.max(F.when(F.col("symbol") == "S00", whole))).alias("lead"))


_CURVE = "curve AS (SELECT symbol AS mode, day, round(10000 + sum(v) OVER (PARTITION BY symbol ORDER BY day), 4) AS equity FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, sum(value - 48) AS v FROM events GROUP BY 1, 2))"


def _curve(spark, d):
    v = src.events(spark, d).groupBy(F.col("symbol").alias("mode"), F.to_date("ts").alias("day")).agg(F.sum(F.col("value") - 48).alias("v"))
    return v.select("mode", "day", r(10000 + F.sum("v").over(Window.partitionBy("mode").orderBy("day"))).alias("equity"))


@query("equity_stats", f"""WITH {_CURVE}, q AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY mode, equity ORDER BY day) = 1),
 s AS (SELECT *, equity / lag(equity) OVER (PARTITION BY mode ORDER BY day) - 1 AS ret, max(equity) OVER (PARTITION BY mode ORDER BY day) AS peak FROM q),
 g AS (SELECT mode, count(ret) AS n, arg_min(equity, day) AS a, arg_max(equity, day) AS b, avg(ret) AS m, stddev_samp(ret) AS sd, max(day) - min(day) AS span, 100 * min(equity / peak - 1) AS mdd FROM s GROUP BY 1)
 SELECT mode, CAST(n AS BIGINT) AS n, round(100 * (b / a - 1), 4) AS total_return, round(CASE WHEN sd > 0 AND span >= 1 THEN m / sd * sqrt(365.0::double / (span / n::double)) END, 4) AS sharpe, round(mdd, 4) AS max_drawdown FROM g""")
def equity_stats(spark, d):
    return evaluation.equity_stats(_curve(spark, d)).select("mode", "n", *[r(c).alias(c) for c in ("total_return", "sharpe", "max_drawdown")])


@query("halt_verdict", f"""WITH {_CURVE}, n AS (SELECT mode, max(day) AS now, max(equity) AS peak, arg_max(equity, day) AS e, arg_min(equity, day) AS o FROM curve GROUP BY 1),
 b AS (SELECT mode, arg_max(equity, day) AS base FROM curve JOIN n USING (mode) WHERE day <= now - 7 GROUP BY 1)
 SELECT mode, round(100 * (e / peak - 1), 4) AS drawdown, round(CASE WHEN coalesce(base, o) > 0 THEN 100 * (e / coalesce(base, o) - 1) END, 4) AS window_loss, 100 * (e / peak - 1) <= -15 OR coalesce(100 * (e / coalesce(base, o) - 1) <= -8, false) AS tripped FROM n LEFT JOIN b USING (mode)""")
def halt_verdict(spark, d):
    return book.halts(_curve(spark, d)).select("mode", r("drawdown").alias("drawdown"), r("window_loss").alias("window_loss"), "tripped")


@query("drawdown_cross", f"""WITH {_CURVE}, x AS (SELECT mode, day, equity / max(equity) OVER (PARTITION BY mode ORDER BY day) - 1 AS dd FROM curve), y AS (SELECT *, lag(dd) OVER (PARTITION BY mode ORDER BY day) AS p FROM x)
 SELECT mode, strftime(day, '%Y-%m-%d') AS day, round(dd, 4) AS dd FROM y WHERE dd <= -0.01 AND coalesce(p, 0) > -0.01""")
def drawdown_cross(spark, d):
    """The days on which a drawdown goes beyond 1 %."""
    o = Window.partitionBy("mode").orderBy("day")
    x = _curve(spark, d).withColumn("dd", F.col("equity") / F.max("equity").over(o) - 1).withColumn("p", F.coalesce(F.lag("dd").over(o), F.lit(0.0)))
    return x.where("dd <= -0.01 and p > -0.01").select("mode", F.date_format("day", "yyyy-MM-dd").alias("day"), r("dd").alias("dd"))


@query("high_water", f"WITH {_CURVE} SELECT mode, strftime(day, '%Y-%m-%d') AS day, max(equity) OVER (PARTITION BY mode ORDER BY day) AS high_water FROM curve")
def high_water(spark, d):
    return _curve(spark, d).select("mode", F.date_format("day", "yyyy-MM-dd").alias("day"), F.max("equity").over(Window.partitionBy("mode").orderBy("day")).alias("high_water"))


_FILLS = "fl AS (SELECT *, CASE WHEN starts_with(coalesce(mode, 'paper'), 'paper') THEN 'paper' ELSE 'live' END AS book FROM log WHERE status IN ('FILLED', 'PARTIALLY_FILLED') AND qty > 0 AND price > 0)"
_LOTS = """c AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) OVER w AS s FROM fl WINDOW w AS (PARTITION BY symbol, book ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)),
 sh AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY symbol, book ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)) AS short FROM c),
 ef AS (SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE qty - (short - coalesce(lag(short) OVER (PARTITION BY symbol, book ORDER BY ts, order_id), 0)) END AS q FROM sh),
 sp AS (SELECT *, sum(q) OVER (PARTITION BY symbol, book, side ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING) AS hi FROM ef WHERE q > 0),
 tr AS (SELECT b.symbol, b.book, b.ts AS open_ts, x.ts AS close_ts, least(b.hi, x.hi) - greatest(b.hi - b.q, x.hi - x.q) AS qty, b.price AS entry, x.price AS exit
  FROM sp b JOIN sp x ON b.symbol = x.symbol AND b.book = x.book AND b.side = 'BUY' AND x.side = 'SELL' AND b.hi > x.hi - x.q AND x.hi > b.hi - b.q)"""


@query("fifo_trades", f"WITH {sql.LOG}, {_FILLS}, {_LOTS} SELECT symbol, book, strftime(open_ts, '%Y-%m-%d') AS open_day, strftime(close_ts, '%Y-%m-%d') AS close_day, qty, entry, exit FROM tr")
def fifo_trades(spark, d):
    """Quantities are whole numbers here, so no lot leaves dust and the join is exact."""
    return book.matched_lots(src.order_log(spark, d)).select("symbol", "book", F.date_format("open_ts", "yyyy-MM-dd").alias("open_day"), F.date_format("close_ts", "yyyy-MM-dd").alias("close_day"), "qty", "entry", "exit")


@query("fifo_fold", f"""WITH {sql.LOG}, {_FILLS}, {_LOTS}, pc AS (SELECT b.symbol, b.book, least(b.hi, x.hi) - greatest(b.hi - b.q, x.hi - x.q) AS m, b.price AS entry, x.price AS exit, b.fee / b.qty AS bf, x.fee / x.qty AS xf
  FROM sp b JOIN sp x ON b.symbol = x.symbol AND b.book = x.book AND b.side = 'BUY' AND x.side = 'SELL' AND b.hi > x.hi - x.q AND x.hi > b.hi - b.q),
 cl AS (SELECT symbol, book, count(*) AS closed, sum(m * (exit - entry)) AS gross, sum(m * (bf + xf)) AS fees FROM pc GROUP BY 1, 2), so AS (SELECT symbol, book, sum(q) AS sold FROM sp WHERE side = 'SELL' GROUP BY 1, 2),
 op AS (SELECT b.symbol, b.book, count(*) AS open, sum(b.fee * least(b.qty, b.hi - coalesce(sold, 0)) / b.qty) AS fees FROM sp b LEFT JOIN so USING (symbol, book) WHERE b.side = 'BUY' AND b.hi > coalesce(sold, 0) GROUP BY 1, 2)
 SELECT symbol, book, CAST(coalesce(closed, 0) AS BIGINT) AS closed, CAST(coalesce(open, 0) AS BIGINT) AS open, round(gross, 2) AS gross, round(coalesce(cl.fees, 0) + coalesce(op.fees, 0), 2) AS fees FROM cl FULL JOIN op USING (symbol, book)""")
def fifo_fold(spark, d):
    """The general fold with fees and dust. Quantities are whole numbers here, so no lot leaves dust and the join of intervals gives the same;
    tests hold the dust rule against hand-made cases."""
    t = book.fifo_trades(src.order_log(spark, d))
    return t.groupBy("symbol", "book").agg(F.count("close_ts").alias("closed"), F.count_if(F.col("close_ts").isNull()).alias("open"), r(F.sum("gross"), 2).alias("gross"), r(F.sum("fees"), 2).alias("fees"))


@query("trade_stats", f"""WITH {sql.LOG}, {_FILLS}, {_LOTS}, n AS (SELECT book, qty * (exit - entry) AS gross, 0.001::double * qty * exit AS fees, qty * (exit - entry) - 0.001::double * qty * exit AS net, close_ts - open_ts AS hold FROM tr),
 g AS (SELECT coalesce(book, 'all') AS book, count(*) AS trades, avg(CASE WHEN net > 0 THEN 1.0::double ELSE 0.0::double END) AS w, coalesce(avg(net) FILTER (WHERE net > 0), 0) AS aw, coalesce(avg(net) FILTER (WHERE net <= 0), 0) AS al, coalesce(sum(net) FILTER (WHERE net > 0), 0) AS won, coalesce(-sum(net) FILTER (WHERE net <= 0), 0) AS lost,
  avg(net) AS ex, sum(net) AS net, sum(fees) AS f, sum(gross) AS gr, avg(hold) AS hold FROM n GROUP BY ROLLUP (book) HAVING count(*) > 0)
 SELECT book, CAST(trades AS BIGINT) AS trades, round(100 * w, 1) AS win_pct, round(aw, 2) AS avg_win, round(al, 2) AS avg_loss, CASE WHEN lost > 0 THEN round(won / lost, 2) ELSE 'inf'::double END AS profit_factor, round(ex, 2) AS expectancy, round(net, 1) AS net, round(f, 1) AS fees, round(CASE WHEN abs(gr) > 1e-9 THEN 100 * f / abs(gr) END, 1) AS fees_pct, round(hold, 1) AS hold_days FROM g""")
def trade_stats(spark, d):
    t = book.matched_lots(src.order_log(spark, d)).select("book", (F.col("qty") * (F.col("exit") - F.col("entry"))).alias("gross"), (0.001 * F.col("qty") * F.col("exit")).alias("fees"), F.datediff("close_ts", "open_ts").alias("hold_days"))
    digits = {"win_pct": 1, "avg_win": 2, "avg_loss": 2, "profit_factor": 2, "expectancy": 2, "net": 1, "fees": 1, "fees_pct": 1, "hold_days": 1}
    return book.trade_stats(t).select("book", "trades", *[r(c, n).alias(c) for c, n in digits.items()])


@query("exec_quality", f"""WITH {sql.LOG} SELECT side, order_type, CAST(count(*) AS BIGINT) AS sent, CAST(count(*) FILTER (WHERE status = 'FILLED') AS BIGINT) AS filled, CAST(count(*) FILTER (WHERE status = 'EXPIRED') AS BIGINT) AS expired,
 round(100 * count(*) FILTER (WHERE status = 'FILLED') / count(*)::double, 4) AS fill_pct, round(avg(slip), 4) AS mean_slip, round(median(slip), 4) AS median_slip, round(avg(fb), 4) AS fee_bps
 FROM (SELECT *, CASE WHEN status = 'FILLED' THEN (price / entry - 1) * 1e4 * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END END AS slip, CASE WHEN status = 'FILLED' THEN fee / (qty * price) * 1e4 END AS fb FROM log) GROUP BY 1, 2""")
def exec_quality(spark, d):
    done = F.col("status") == "FILLED"
    slip = F.when(done, (F.col("price") / F.col("entry") - 1) * 1e4 * F.when(F.col("side") == "BUY", 1).otherwise(-1))
    x = src.order_log(spark, d).withColumn("slip", slip).withColumn("fb", F.when(done, F.col("fee") / (F.col("qty") * F.col("price")) * 1e4))
    return x.groupBy("side", "order_type").agg(
        F.count("*").alias("sent"), F.count_if(done).alias("filled"), F.count_if(F.col("status") == "EXPIRED").alias("expired"), r(100 * F.count_if(done) / F.count("*")).alias("fill_pct"),
        r(F.avg("slip")).alias("mean_slip"), r(F.percentile("slip", F.lit(0.5))).alias("median_slip"), r(F.avg("fb")).alias("fee_bps"),
    )


@query("missed_vs_filled", f"""WITH {sql.LOG}, s AS (SELECT CASE WHEN status = 'FILLED' THEN 'filled' ELSE 'missed' END AS outcome, concat(symbol, strftime(ts, '%Y-%m-%d')) AS setup, count(*) AS n, avg(price / entry - 1) AS m FROM log GROUP BY 1, 2)
 SELECT outcome, CAST(sum(n) AS BIGINT) AS attempts, CAST(count(*) AS BIGINT) AS setups, round(avg(m), 6) AS mean, round(median(m), 6) AS median FROM s GROUP BY 1""")
def missed_vs_filled(spark, d):
    x = src.order_log(spark, d).groupBy(F.when(F.col("status") == "FILLED", "filled").otherwise("missed").alias("outcome"), F.concat("symbol", F.date_format("ts", "yyyy-MM-dd")).alias("setup"))
    s = x.agg(F.count("*").alias("n"), F.avg(F.col("price") / F.col("entry") - 1).alias("m"))
    return s.groupBy("outcome").agg(F.sum("n").alias("attempts"), F.count("*").alias("setups"), r(F.avg("m"), 6).alias("mean"), r(F.percentile("m", F.lit(0.5)), 6).alias("median"))


@query("net_position_drift", f"""WITH {sql.LOG}, {_FILLS}, l AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS net FROM fl GROUP BY 1),
 h AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM fl WHERE book = 'live' GROUP BY 1) SELECT symbol, net, coalesce(qty, 0) AS qty, net - coalesce(qty, 0) AS diff FROM l LEFT JOIN h USING (symbol) WHERE abs(net - coalesce(qty, 0)) > greatest(1e-8, 0.01 * abs(net))""")
def net_position_drift(spark, d):
    log = src.order_log(spark, d)
    return book.drift(book.net_positions(log), book.net_positions(log.where("mode = 'live'")).withColumnRenamed("net", "qty"))


_CORR = """rt AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars),
 co AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr, count(*) AS n FROM rt x JOIN rt y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15)"""


@query("corr_matrix", f"WITH {sql.BARS}, {_CORR} SELECT a, b, round(corr, 4) AS corr, CAST(n AS BIGINT) AS n FROM co")
def corr_matrix(spark, d):
    return matrix.correlations(matrix.daily_returns(src.daily_bars(spark, d))).select("a", "b", r("corr").alias("corr"), "n")


_RISK = "rk AS (SELECT symbol, 100 + 5 * CAST(substr(symbol, 2) AS DOUBLE) AS risk FROM bars GROUP BY 1)"


@query("portfolio_heat", f"""WITH {sql.BARS}, {_CORR}, {_RISK}, o AS (SELECT count(*) AS names, sum(risk * risk) AS own, sum(risk) AS gross FROM rk), x AS (SELECT coalesce(sum(2 * p.risk * q.risk * coalesce(corr, 0.8)), 0) AS cr FROM rk p JOIN rk q ON p.symbol < q.symbol LEFT JOIN co ON a = p.symbol AND b = q.symbol)
 SELECT CAST(names AS BIGINT) AS names, gross, round(sqrt(greatest(own + cr, 0)), 4) AS heat, round(sqrt(greatest(own + cr, 0)) / gross, 4) AS ratio FROM o, x""")
def portfolio_heat(spark, d):
    b = src.daily_bars(spark, d)
    risks = b.groupBy("symbol").agg((100 + 5 * F.first(F.substring("symbol", 2, 9)).cast("double")).alias("risk"))
    return matrix.heat(risks, matrix.correlations(matrix.daily_returns(b))).select("names", "gross", r("heat").alias("heat"), r("ratio").alias("ratio"))


@query("slate_heat", f"""WITH {sql.BARS}, {sql.scores('month')}, {_CORR}, s AS (SELECT run, symbol, 100 * technical AS risk FROM scores WHERE social > 0.5 AND technical > 0), o AS (SELECT run, count(*) AS names, sum(risk) AS gross FROM s GROUP BY 1),
 x AS (SELECT p.run, sum(p.risk * q.risk * CASE WHEN p.symbol = q.symbol THEN 1 ELSE coalesce(corr, 0.8) END) AS v FROM s p JOIN s q USING (run) LEFT JOIN co ON a = least(p.symbol, q.symbol) AND b = greatest(p.symbol, q.symbol) GROUP BY 1)
 SELECT strftime(run, '%Y-%m-%d') AS run, CAST(names AS BIGINT) AS names, round(gross, 4) AS gross, round(CASE WHEN names <= 1 THEN gross ELSE sqrt(greatest(v, 0)) END, 4) AS heat, round(CASE WHEN names <= 1 THEN 1 ELSE sqrt(greatest(v, 0)) / gross END, 4) AS ratio FROM o JOIN x USING (run)""")
def slate_heat(spark, d):
    """The heat of each month's names; some months have one."""
    risks = src.scores(spark, d, "month").where("social > 0.5").select("run", "symbol", (100 * F.col("technical")).alias("risk"))
    out = matrix.heat(risks, matrix.correlations(matrix.daily_returns(src.daily_bars(spark, d))), ["run"])
    return out.select(F.date_format("run", "yyyy-MM-dd").alias("run"), "names", *[r(c).alias(c) for c in ("gross", "heat", "ratio")])


_REG = """m AS (SELECT *, row_number() OVER o AS seen, CASE WHEN count(close) OVER w >= 66 THEN avg(close) OVER w END AS ma, close / max(close) OVER h - 1 AS dd FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), h AS (PARTITION BY symbol ORDER BY date ROWS 179 PRECEDING)),
 rg AS (SELECT *, CASE WHEN seen < 150 OR ma IS NULL THEN 'neutral' WHEN close < ma * 0.98 OR dd <= -0.25 THEN 'risk_off' WHEN close > ma * 1.02 AND ma / lag(ma, 21) OVER (PARTITION BY symbol ORDER BY date) - 1 > 0 THEN 'risk_on' ELSE 'neutral' END AS state FROM m)"""


@query("regime_state", f"WITH {sql.BARS}, {_REG} SELECT symbol, strftime(date, '%Y-%m-%d') AS day, state FROM rg")
def regime_state(spark, d):
    return book.regime(src.daily_bars(spark, d)).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), "state")


@query("regime_effect", f"""WITH {sql.BARS}, {_REG}, {sql.scores()}, {_forward('f7', 7)}, p AS (SELECT run, avg(fwd) AS u FROM f7 WHERE fwd IS NOT NULL GROUP BY 1),
 j AS (SELECT p.run, u, rg.state FROM p ASOF JOIN (SELECT * FROM rg WHERE symbol = 'S00') rg ON p.run >= rg.date) SELECT state, CAST(count(*) AS BIGINT) AS n, round(100 * avg(u), 4) AS mean_pct FROM j GROUP BY 1""")
def regime_effect(spark, d):
    per = _rows(spark, d).where("fwd is not null").groupBy("run").agg(F.avg("fwd").alias("u")).withColumn("symbol", F.lit("S00"))
    states = book.regime(src.daily_bars(spark, d).where("symbol = 'S00'")).select("symbol", "date", "state")
    return asof.asof_backward(per, states, "symbol", "run", "date", ["state"]).where("state is not null").groupBy("state").agg(F.count("*").alias("n"), r(100 * F.avg("u")).alias("mean_pct"))


_EXITS = f"""{sql.BARS}, {sql.scores('month')}, sc AS (SELECT run, symbol, round(composite - 1.5, 1) AS score FROM scores), h0 AS (SELECT s.run, s.symbol, s.score, b.close AS price, CAST(epoch(s.run) AS BIGINT) // 86400 + CAST(substr(s.symbol, 2) AS INTEGER) * 7 AS n FROM sc s ASOF JOIN bars b ON s.symbol = b.symbol AND s.run >= b.date),
 h AS (SELECT *, CASE WHEN n % 6 <> 0 THEN price * (0.8::double + (n % 7) / 10.0::double) END AS entry, n % 45 AS held_days FROM h0), k AS (SELECT *, 0.9::double * entry AS stop, 1.3::double * entry AS target, greatest(entry * (1 + (n % 5) / 20.0::double), price) AS high FROM h),
 f AS (SELECT *, list_filter([CASE WHEN price <= stop THEN 'stop' END, CASE WHEN price >= target THEN 'target' END, CASE WHEN (high / entry - 1) * 100 >= 3 AND (1 - price / high) * 100 >= 8 THEN 'trailing' END, CASE WHEN held_days >= 30 AND entry IS NOT NULL THEN 'horizon' END, CASE WHEN score <= -0.15::double THEN 'reversal' END], lambda x: x IS NOT NULL) AS l FROM k)"""


@query("exit_triggers", f"""WITH {_EXITS} SELECT strftime(run, '%Y-%m-%d') AS run, symbol, l[1] AS trigger, array_to_string(l[2:], ',') AS also, CASE WHEN l[1] = 'target' THEN 50.0::double ELSE 100.0::double END AS sold_pct, round((price / entry - 1) * 100, 2) AS pnl_pct FROM f WHERE len(l) > 0""")
def exit_triggers(spark, d):
    return _exits(spark, d).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "trigger", "also", "sold_pct", r("pnl_pct", 2).alias("pnl_pct"))


def _exits(spark, d):
    """Positions of each month, some of them without entry terms: those can only be reversed."""
    s = src.scores(spark, d, "month").select("run", "symbol", r(F.col("composite") - 1.5, 1).alias("score"))
    h = asof.asof_backward(s, src.daily_bars(spark, d), "symbol", "run", "date", ["close"]).where("close is not null").withColumnRenamed("close", "price")
    n = F.unix_date("run") + F.substring("symbol", 2, 9).cast("int") * 7
    h = h.withColumn("entry", F.when(n % 6 != 0, F.col("price") * (0.8 + (n % 7) / 10.0))).withColumn("held_days", F.when(F.col("entry").isNotNull(), n % 45))
    h = h.withColumns({"stop": 0.9 * F.col("entry"), "target": 1.3 * F.col("entry"), "high": F.col("entry") * (1 + (n % 5) / 20.0)})
    return book.exits(h, target_pct=50.0)


_LABEL = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in book.TRIGGERS.items()) + " END"


@query("exit_reasons", f"""WITH {_EXITS}, x AS (SELECT *, (price / entry - 1) * 100 AS pnl FROM f WHERE len(l) > 0) SELECT strftime(run, '%Y-%m-%d') AS run, symbol, concat_ws(' ', 'Close for: ' || {_LABEL.format('l[1]')} || '.', CASE WHEN len(l) > 1 THEN 'Besides: ' || array_to_string(list_transform(l[2:], lambda t: {_LABEL.format('t')}), ', ') || '.' END,
 CASE WHEN entry IS NOT NULL THEN 'Held ' || held_days || '.0 days.' END, CASE WHEN entry IS NOT NULL THEN format('Open result {{}}{{:,.1f}} per cent.', CASE WHEN pnl >= 0 THEN '+' ELSE '' END, pnl) END, format('Score {{}}{{:,.3f}}.', CASE WHEN score >= 0 THEN '+' ELSE '' END, score),
 CASE WHEN entry IS NULL THEN 'Opened without terms.' END, CASE WHEN l[1] = 'target' THEN 'Sell 50 per cent of it.' END) AS why FROM x""")
def exit_reasons(spark, d):
    return book.described(_exits(spark, d)).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "why")


@query("pit_view_stats", f"""WITH {sql.BARS}, st AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS step FROM bars GROUP BY 1, 2)
 SELECT st.symbol, strftime(step, '%Y-%m-%d') AS step, CAST(count(*) AS BIGINT) AS n, round(avg(close), 6) AS mean FROM st JOIN bars b ON b.symbol = st.symbol AND b.date BETWEEN step - 14 AND step GROUP BY 1, 2""")
def pit_view_stats(spark, d):
    b = src.daily_bars(spark, d)
    steps = b.select("symbol", F.trunc("date", "month").alias("step")).distinct()
    return asof.point_in_time(steps, b, 14).groupBy("symbol", F.date_format("step", "yyyy-MM-dd").alias("step")).agg(F.count("*").alias("n"), r(F.avg("close"), 6).alias("mean"))


#: A state for each weekly run, from how many orders it has; every so many have none.
_GATE = """gt AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS run, count(*) AS n FROM orders GROUP BY 1),
 gs AS (SELECT run, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 5 < 3 THEN 'risk_on' WHEN n % 5 = 3 THEN 'neutral' ELSE 'risk_off' END AS regime_state FROM gt)"""
STRATEGIES = [
    simulation.Strategy("plain", floor=1.0, cost_bps=50.0), simulation.Strategy("buffer 2", floor=1.0, buffer=2, cost_bps=50.0), simulation.Strategy("buffer 5", floor=1.0, buffer=5, cost_bps=50.0),
    simulation.Strategy("gated", floor=1.0, gated=True, cost_bps=50.0), simulation.Strategy("gated, buffer 3", floor=1.0, gated=True, buffer=3, cost_bps=50.0),
    simulation.Strategy("social", "social", top=5, buffer=1, cost_bps=20.0), simulation.Strategy("none", floor=99.0),
]
EVERY, HOLD = 4, 7


def _strategies() -> str:
    rows = ", ".join(f"('{s.name}', '{s.score}', {s.top}, {s.floor if s.score == 'composite' else -1e308}::double, {s.buffer}, {str(s.gated).lower()}, {s.cost_bps}::double)" for s in STRATEGIES)
    return f"sy(strategy, score, top, floor, buffer, gated, bps) AS (VALUES {rows})"


_SIM = f"""{_GATE}, {_strategies()}, rn AS (SELECT run, row_number() OVER (ORDER BY run) - 1 AS p FROM f7 GROUP BY run HAVING count(fwd) > 0),
 hd AS (SELECT f7.run, f7.symbol, f7.fwd / 20.0::double AS fwd, gs.regime_state, sy.*, CASE sy.score WHEN 'social' THEN social ELSE composite END AS value FROM f7 JOIN rn USING (run) LEFT JOIN gs USING (run), sy WHERE p % {EVERY} = 0 AND fwd IS NOT NULL),
 ca AS (SELECT *, row_number() OVER (PARTITION BY strategy, run ORDER BY value DESC, symbol) AS r FROM hd WHERE value IS NOT NULL),
 pe AS (SELECT strategy, run, any_value(top) AS top, any_value(buffer) AS buffer, any_value(bps) AS bps, avg(fwd) AS basket, max(fwd) FILTER (WHERE symbol = 'S00') AS lead, CASE WHEN any_value(gated) THEN any_value(regime_state) END AS state,
  CASE WHEN NOT any_value(gated) THEN 1.0::double ELSE CASE any_value(regime_state) WHEN 'risk_off' THEN 0.0::double WHEN 'neutral' THEN 0.5::double ELSE 1.0::double END END AS scale,
  coalesce(list(symbol ORDER BY r) FILTER (WHERE value > floor AND r <= top + buffer), CAST([] AS VARCHAR[])) AS syms, coalesce(list(fwd ORDER BY r) FILTER (WHERE value > floor AND r <= top + buffer), CAST([] AS DOUBLE[])) AS fwds FROM ca GROUP BY 1, 2),
 pq AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY run) AS i FROM pe),
 si(strategy, i, picks, w, turnover, gross) AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), 0.0::double, 0.0::double, 0.0::double FROM pq UNION ALL
  SELECT strategy, i, picks, w, len(list_filter(held, lambda h: list_contains(picks, h))) * abs(w - before) + len(list_filter(held, lambda h: NOT list_contains(picks, h))) * before + len(list_filter(picks, lambda s: NOT list_contains(held, s))) * w,
   w * coalesce(list_sum(list_transform(picks, lambda s: fwds[list_position(syms, s)])), 0) FROM (
   SELECT strategy, i, syms, fwds, held, before, w, list_filter(syms, lambda s: list_contains(keep, s) OR list_contains(list_filter(syms, lambda t: NOT list_contains(keep, t))[1:top - len(keep)], s)) AS picks FROM (
    SELECT q.strategy, q.i, q.syms, q.fwds, q.top, si.picks AS held, si.w AS before, q.scale / q.top AS w, CASE WHEN q.buffer > 0 THEN list_filter(q.syms, lambda s: list_contains(si.picks, s))[1:q.top] ELSE CAST([] AS VARCHAR[]) END AS keep
    FROM si JOIN pq q ON q.strategy = si.strategy AND q.i = si.i + 1))),
 sm AS (SELECT q.strategy, q.run, si.picks, gross, turnover, turnover * bps / 1e4 AS cost, gross - turnover * bps / 1e4 AS net, w * len(picks) AS exposure, state, lead, basket FROM si JOIN pq q USING (strategy, i))"""


def _gate(spark, d):
    n = F.col("n")
    state = F.when(n % 11 == 0, F.lit(None).cast("string")).when(n % 5 < 3, "risk_on").when(n % 5 == 3, "neutral").otherwise("risk_off")
    return src.read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("run")).agg(F.count("*").alias("n")).select("run", state.alias("regime_state"))


def _periods(spark, d):
    gate = _gate(spark, d)
    scale = F.when(F.col("regime_state") == "risk_on", 1.0).when(F.col("regime_state") == "neutral", 0.5).when(F.col("regime_state") == "risk_off", 0.0)
    # The driver's prices jump about; a twentieth of their returns compounds to numbers that can be compared.
    rows = _rows(spark, d).withColumn("fwd", F.col("fwd") / 20.0).join(gate, "run", "left").withColumn("regime_scale", scale)
    return simulation.simulate(rows, STRATEGIES, "fwd", EVERY, "S00")


@query("simulate_topn", f"""WITH RECURSIVE {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_SIM} SELECT strftime(run, '%Y-%m-%d') AS run, array_to_string(picks, ',') AS picks, round(gross, 4) AS gross, round(turnover, 4) AS turnover, round(cost, 6) AS cost, round(net, 4) AS net, round(basket, 4) AS basket, round(lead, 4) AS lead
 FROM sm WHERE strategy = 'plain'""")
def simulate_topn(spark, d):
    out = _periods(spark, d).where("strategy = 'plain'")
    return out.select(F.date_format("run", "yyyy-MM-dd").alias("run"), F.array_join("picks.symbol", ",").alias("picks"), r("gross").alias("gross"), r("turnover").alias("turnover"), r("cost", 6).alias("cost"), r("net").alias("net"), r("basket").alias("basket"), r("lead").alias("lead"))


@query("simulate_buffer", f"""WITH RECURSIVE {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_SIM} SELECT strategy, strftime(run, '%Y-%m-%d') AS run, array_to_string(picks, ',') AS picks, round(exposure, 4) AS exposure, state, round(gross, 4) AS gross, round(turnover, 4) AS turnover, round(net, 4) AS net FROM sm""")
def simulate_buffer(spark, d):
    """Every strategy's periods: hysteresis, the gate, another score, and one that holds nothing."""
    return _periods(spark, d).select("strategy", F.date_format("run", "yyyy-MM-dd").alias("run"), F.array_join("picks.symbol", ",").alias("picks"), r("exposure").alias("exposure"), "state", r("gross").alias("gross"), r("turnover").alias("turnover"), r("net").alias("net"))


@query("simulate_stats", f"""WITH RECURSIVE {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_SIM}, lg AS (SELECT strategy, run, leg, r FROM (SELECT strategy, run, net, gross, lead, basket FROM sm) UNPIVOT (r FOR leg IN (net, gross, lead, basket))),
 cu AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, leg ORDER BY run)) AS value FROM lg), pk AS (SELECT *, max(value) OVER (PARTITION BY strategy, leg ORDER BY run) AS peak FROM cu)
 SELECT strategy, leg, CAST(count(*) AS BIGINT) AS periods, round(100 * (arg_max(value, run) - 1), 2) AS total, round(100 * (pow(arg_max(value, run), 365 / {HOLD}::double / count(*)) - 1), 2) AS cagr, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(365 / {HOLD}::double) END, 2) AS sharpe, round(100 * min(value / peak - 1), 2) AS max_drawdown FROM pk GROUP BY 1, 2""")
def simulate_stats(spark, d):
    out = simulation.statistics(_periods(spark, d), HOLD)
    return out.select("strategy", "leg", "periods", *[r(c, 2).alias(c) for c in ("total", "cagr", "sharpe", "max_drawdown")])


@query("simulate_habits", f"""WITH RECURSIVE {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_SIM} SELECT strategy, round(avg(exposure), 3) AS exposure, round(avg(turnover), 3) AS turnover, round(100 * sum(cost), 2) AS fee_drag, round(100 * avg(CASE WHEN net > basket THEN 1.0::double ELSE 0.0::double END), 1) AS beat_basket FROM sm GROUP BY 1""")
def simulate_habits(spark, d):
    return simulation.habits(_periods(spark, d)).select("strategy", r("exposure", 3).alias("exposure"), r("turnover", 3).alias("turnover"), r("fee_drag", 2).alias("fee_drag"), r("beat_basket", 1).alias("beat_basket"))


_BATTERY = f"""{_GATE}, ux AS (SELECT u.*, regime_state AS state FROM u LEFT JOIN gs USING (run)), md AS (SELECT run AS middle FROM (SELECT run, row_number() OVER (ORDER BY run) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT run FROM scores)) WHERE i = n // 2),
 rq AS (SELECT *, row_number() OVER (PARTITION BY family, horizon, run ORDER BY score DESC, symbol) AS up, row_number() OVER (PARTITION BY family, horizon, run ORDER BY score, symbol DESC) AS dn FROM ux),
 pr AS (SELECT family, horizon, run, count(*) AS n, avg(fwd) FILTER (WHERE up <= 3) AS top, avg(fwd) FILTER (WHERE dn <= 3) AS bottom, avg(fwd) AS universe, max(fwd) FILTER (WHERE symbol = 'S00') AS lead, coalesce(any_value(state), 'no state') AS state FROM rq GROUP BY 1, 2, 3),
 pj AS (SELECT pr.*, per.rho, CASE WHEN pr.run < middle THEN 'first half' ELSE 'second half' END AS half, pr.n >= 6 AS wide FROM pr JOIN per USING (family, horizon, run), md),
 gr AS (SELECT family, horizon, coalesce(half, state, 'all') AS part, count(rho) AS n_runs, avg(rho) AS mean_ic, stddev_samp(rho) AS sd, 100 * avg(CASE WHEN rho > 1e-12 THEN 1.0::double WHEN rho IS NOT NULL THEN 0.0::double END) AS pos, (max(run) FILTER (WHERE rho IS NOT NULL) - min(run) FILTER (WHERE rho IS NOT NULL)) / nullif(count(rho) - 1, 0)::double AS gap,
  count(*) FILTER (WHERE wide) AS wide_runs, avg(top) FILTER (WHERE wide) AS top, avg(bottom) FILTER (WHERE wide) AS bottom, avg(universe) FILTER (WHERE wide) AS wu, avg(top) AS best, avg(universe) AS universe, avg(lead) AS lead FROM pj GROUP BY GROUPING SETS ((family, horizon), (family, horizon, half), (family, horizon, state))),
 ge AS (SELECT *, n_runs / CASE WHEN n_runs < 3 THEN 1.0::double ELSE greatest(1.0::double, horizon / gap) END AS eff FROM gr)"""


@query("report_battery", f"""WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC}, {_BATTERY} SELECT family, CAST(horizon AS INTEGER) AS horizon, part, CAST(n_runs AS BIGINT) AS n_runs, round(eff, 1) AS runs_eff, round(mean_ic, 4) AS mean_ic, round(CASE WHEN eff >= 2 AND sd > 0 THEN mean_ic / (sd / sqrt(eff)) END, 2) AS t,
 round(pos, 1) AS pct_positive, CAST(wide_runs AS BIGINT) AS wide_runs, round(100 * top, 2) AS top_pct, round(100 * bottom, 2) AS bottom_pct, round(100 * (top - bottom), 2) AS spread_pct, round(100 * (top - wu), 2) AS over_universe_pct, round(100 * best, 2) AS best_pct, round(100 * universe, 2) AS universe_pct, round(100 * lead, 2) AS lead_pct FROM ge""")
def report_battery(spark, d):
    """The report of all families and horizons: the whole window, its halves, and each regime."""
    rows = _both(spark, d, "week").join(_gate(spark, d).withColumnRenamed("regime_state", "state"), "run", "left")
    out = evaluation.battery(evaluation.unpivoted(rows, FAMILIES, {7: "fwd7", 30: "fwd30"}, "state"), src.scores(spark, d), "S00")
    return out.select("family", "horizon", "part", "n_runs", r("runs_eff", 1).alias("runs_eff"), r("mean_ic").alias("mean_ic"), r("t", 2).alias("t"), r("pct_positive", 1).alias("pct_positive"), "wide_runs", *[r(100 * F.col(c), 2).alias(f"{c}_pct") for c in ("top", "bottom", "spread", "over_universe", "best", "universe", "lead")])


@query("pooled_ic", f"""WITH {sql.BARS}, {sql.scores()}, {_forward('f7', 7)}, {_forward('f30', 30)}, {_IC}, gk AS (SELECT family, horizon, rank() OVER (PARTITION BY family, horizon ORDER BY score) + (count(*) OVER (PARTITION BY family, horizon, score) - 1) / 2.0::double AS a,
 rank() OVER (PARTITION BY family, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY family, horizon, fwd) - 1) / 2.0::double AS b FROM u) SELECT family, CAST(horizon AS INTEGER) AS horizon, CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 4) AS pooled FROM gk GROUP BY 1, 2""")
def pooled_ic(spark, d):
    return evaluation.pooled_ic(_pairs(spark, d, "week")).select("family", "horizon", "n", r("pooled").alias("pooled"))


@query("setops", """SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'except', CAST(count(*) AS BIGINT) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def setops(spark, d):
    c, s, n = (src.read(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.union(s).distinct().agg(F.count("*").alias("n")).select(F.lit("union").alias("op"), "n").union(c.intersect(s).agg(F.count("*")).select(F.lit("intersect"), "count(1)")).union(n.subtract(s).agg(F.count("*")).select(F.lit("except"), "count(1)"))
