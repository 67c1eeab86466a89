"""Queries over proposals: the slate of each monthly run, why names are left out of it, and its fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded as r
from signal_lake.operators import asof, book, proposals
from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()
RULES = proposals.Rules()

#: Scores of one digit, so that names tie; holdings that are none, dust or whole; runs whose cash or equity is unknown or zero.
_INPUT = f"""{sql.BARS}, {sql.scores('month')},
 sc AS (SELECT s.run, s.symbol, round(s.composite - 1.5, 1) AS composite, b.close AS price, s.social / 15 AS atr_daily, s.technical / 60 AS atr_week
  FROM scores s ASOF JOIN bars b ON s.symbol = b.symbol AND s.run >= b.date),
 tot AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS run, format('S{{:02d}}', l_suppkey % 20) AS symbol, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2),
 ho AS (SELECT run, symbol, total, CASE total % 4 WHEN 0 THEN 0.0::double WHEN 1 THEN 0.001::double ELSE (total % 40) / 10.0::double END AS held FROM tot),
 ex0 AS (SELECT h.run, h.symbol, h.held, h.total, sc.price, sc.composite, sc.price * (0.8::double + (h.total % 7) / 10.0::double) AS entry FROM ho h JOIN sc USING (run, symbol) WHERE h.held > 0),
 ex1 AS (SELECT *, 0.9::double * entry AS stop, 1.3::double * entry AS target, greatest(entry * (1 + (total % 5) / 20.0::double), price) AS high FROM ex0),
 sg AS (SELECT run, symbol, held AS qty, price AS last, stop, target, composite, CASE WHEN price <= stop THEN 1 WHEN price >= target THEN 2 WHEN high >= 1.03::double * entry AND price <= 0.92::double * high THEN 3
   WHEN total % 45 >= 30 THEN 4 WHEN composite <= -0.15::double THEN 5 END AS seq FROM ex1 WHERE total % 3 = 0),
 sig AS (SELECT * FROM sg WHERE seq IS NOT NULL),
 ru AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run, count(*) AS n FROM orders GROUP BY 1),
 st AS (SELECT run, CASE WHEN n % 7 = 0 THEN NULL ELSE (n % 23) * 400.0::double END AS cash, CASE WHEN n % 11 = 0 THEN 0.0::double WHEN n % 13 = 0 THEN NULL ELSE 3000.0::double + 20 * n END AS equity,
   CASE WHEN n % 5 < 3 THEN 1.0::double WHEN n % 5 = 3 THEN 0.5::double ELSE 0.0::double END AS exposure, n % 5 = 4 AS blocked, n % 17 = 0 AS halted FROM ru)"""

_SLATE = f"""{_INPUT},
 e1 AS (SELECT run, seq, symbol, qty, last, stop, target, composite FROM sig QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq, symbol) <= 3),
 e2 AS (SELECT e1.*, least(e1.qty, ho.held) AS sold FROM e1 JOIN ho USING (run, symbol)), e3 AS (SELECT *, sold * last AS notional FROM e2 WHERE sold * last >= 15),
 pr AS (SELECT run, sum(notional) AS gross FROM e3 GROUP BY 1),
 ba AS (SELECT st.*, CASE WHEN equity >= 0 THEN equity ELSE 10000 END AS basis, cash + coalesce(gross, 0) * 0.99::double AS power FROM st LEFT JOIN pr USING (run)),
 r0 AS (SELECT sc.*, ba.basis, ba.power, ba.blocked, ba.halted, coalesce(ho.held, 0) AS held, sig.symbol IS NOT NULL AS flagged FROM sc JOIN ba USING (run) LEFT JOIN ho USING (run, symbol) LEFT JOIN sig USING (run, symbol)),
 r1 AS (SELECT *, CASE WHEN composite > 0.03 THEN 'BUY' WHEN composite < -0.1 AND held > 0 THEN 'SELL' END AS side,
   least(greatest(1.5::double * CASE WHEN atr_daily <> 0 THEN atr_daily WHEN atr_week <> 0 THEN atr_week ELSE 0.02 END * sqrt(10), 0.03), 0.4) * price AS sd, 0.0092::double * price AS trip FROM r0),
 r2 AS (SELECT *, least(2 * (sd + trip) + trip, 0.6::double * price) AS td, basis * 0.01::double AS budget,
   CASE WHEN side = 'BUY' THEN least(greatest(0, basis * 0.2::double - held * price), coalesce(power, 'infinity'::double)) ELSE basis * 0.2::double END AS most FROM r1),
 r3 AS (SELECT *, CASE WHEN side = 'BUY' THEN least(budget / sd, most / price) ELSE least(budget / sd, most / price, held) END AS qty FROM r2),
 od AS (SELECT *, qty * price AS notional, row_number() OVER (PARTITION BY run ORDER BY composite DESC, symbol) AS i FROM r3),
 fo(run, i, buys, outcome) AS (SELECT DISTINCT run, CAST(0 AS BIGINT), 0, '' FROM sc UNION ALL
  SELECT run, i, buys + CASE WHEN outcome = 'taken' AND side = 'BUY' THEN 1 ELSE 0 END, outcome FROM (
   SELECT od.run, od.i, fo.buys, od.side, CASE WHEN flagged THEN 'flagged_for_exit' WHEN side IS NULL AND composite < -0.03 AND held <= 0 THEN 'bearish_unheld' WHEN side IS NULL THEN 'below_score'
     WHEN side = 'BUY' AND held * price >= 15 THEN 'already_held' WHEN side = 'BUY' AND fo.buys >= 3 THEN 'full' WHEN side = 'BUY' AND halted THEN 'halted' WHEN side = 'BUY' AND blocked THEN 'regime_blocked'
     WHEN notional < 15 OR qty <= 0 THEN 'below_min_notional' ELSE 'taken' END AS outcome FROM fo JOIN od ON od.run = fo.run AND od.i = fo.i + 1))"""

_CAPPED = f"""{_SLATE},
 c0 AS (SELECT run, 0 AS part, row_number() OVER (PARTITION BY run ORDER BY seq, symbol) AS pos, symbol, 'SELL' AS side, 'exit' AS kind, ['stop', 'target', 'trailing', 'horizon', 'reversal'][seq] AS trigger, composite, last AS entry, stop, target,
   sold AS qty, notional, 0.0::double AS risk, notional * 0.004::double AS fee FROM e3
  UNION ALL SELECT od.run, 1, od.i, symbol, side, 'entry', '', composite, price, CASE WHEN side = 'BUY' THEN price - sd ELSE price + sd END, CASE WHEN side = 'BUY' THEN price + td ELSE price - td END, qty, notional, least(budget, notional), notional * 0.004::double
   FROM od JOIN fo ON fo.run = od.run AND fo.i = od.i WHERE outcome = 'taken'),
 c1 AS (SELECT c0.*, basis, cash, least(basis * 0.6::double * exposure, coalesce(power, 'infinity'::double)) AS cap, coalesce(sum(notional) FILTER (WHERE side = 'BUY') OVER (PARTITION BY run), 0) AS buy_total FROM c0 JOIN ba USING (run)),
 c2 AS (SELECT *, CASE WHEN side = 'BUY' AND buy_total > cap AND cap > 0 THEN cap / buy_total ELSE 1 END AS k FROM c1 WHERE side = 'SELL' OR cap > 0),
 c3 AS (SELECT run, part, pos, symbol, side, kind, trigger, composite, entry, stop, target, qty * k AS qty, notional * k AS notional, risk * k AS risk, fee, basis, cash FROM c2 WHERE buy_total <= cap OR cap <= 0 OR notional * k >= 15),
 rt AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars QUALIFY ret IS NOT NULL),
 bu AS (SELECT run, symbol, risk FROM c3 WHERE side = 'BUY'),
 lr AS (SELECT bu.run, bu.symbol, rt.date, rt.ret FROM bu JOIN rt ON rt.symbol = bu.symbol AND rt.date <= bu.run QUALIFY row_number() OVER (PARTITION BY bu.run, bu.symbol ORDER BY rt.date DESC) <= 60),
 ln AS (SELECT run, symbol, count(*) AS n FROM lr GROUP BY 1, 2),
 co AS (SELECT a.run, a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS c, count(*) AS n FROM lr a JOIN lr b ON a.run = b.run AND a.date = b.date AND a.symbol <> b.symbol GROUP BY 1, 2, 3),
 ht AS (SELECT a.run, count(DISTINCT a.symbol) AS buys, sqrt(greatest(0, sum(a.risk * b.risk * CASE WHEN a.symbol = b.symbol THEN 1 WHEN co.n >= 15 AND x.n >= 15 AND y.n >= 15 AND co.c IS NOT NULL THEN co.c ELSE 0.8 END))) AS heat
  FROM bu a JOIN bu b ON a.run = b.run LEFT JOIN co ON co.run = a.run AND co.a = a.symbol AND co.b = b.symbol LEFT JOIN ln x ON x.run = a.run AND x.symbol = a.symbol LEFT JOIN ln y ON y.run = b.run AND y.symbol = b.symbol GROUP BY 1),
 c4 AS (SELECT c3.*, CASE WHEN side = 'BUY' AND buys >= 2 AND heat > basis * 0.025::double AND basis > 0 THEN basis * 0.025::double / heat ELSE 1 END AS k FROM c3 LEFT JOIN ht USING (run)),
 c5 AS (SELECT run, symbol, side, kind, trigger, composite, entry, stop, target, qty * k AS qty, notional * k AS notional, risk * k AS risk, fee * k AS fee, cash, row_number() OVER (PARTITION BY run ORDER BY part, pos) AS rank FROM c4 WHERE side = 'SELL' OR k = 1 OR notional * k >= 15)"""


def _inputs(spark, d):
    """scores, holdings, exit signals and the state of each run."""
    bars = src.daily_bars(spark, d)
    s = src.scores(spark, d, "month").withColumn("composite", r(F.col("composite") - 1.5, 1))
    s = asof.asof_backward(s, bars, "symbol", "run", "date", ["close"]).where("close is not null")
    scores = s.select("run", "symbol", "composite", F.col("close").alias("price"), (F.col("social") / 15).alias("atr_daily"), (F.col("technical") / 60).alias("atr_week"))
    total = F.sum("l_quantity").cast("long").alias("total")
    held = F.when(F.col("total") % 4 == 0, 0.0).when(F.col("total") % 4 == 1, 0.001).otherwise((F.col("total") % 40) / 10.0)
    holdings = src.read(spark, d, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("run"), src.symbol("l_suppkey").alias("symbol")).agg(total).withColumn("held", held)
    h = holdings.where("held > 0 and total % 3 = 0").join(scores, ["run", "symbol"]).withColumn("entry", F.col("price") * (0.8 + (F.col("total") % 7) / 10.0))
    h = h.withColumns({"stop": 0.9 * F.col("entry"), "target": 1.3 * F.col("entry"), "high": F.col("entry") * (1 + (F.col("total") % 5) / 20.0), "held_days": F.col("total") % 45, "score": F.col("composite")})
    order = F.array_position(F.array(*map(F.lit, ("stop", "target", "trailing", "horizon", "reversal"))), F.col("trigger"))
    signals = book.exits(h).select("run", order.alias("seq"), "symbol", F.col("held").alias("qty"), F.col("price").alias("last"), "stop", "target", "composite", "trigger")
    n = F.col("n")
    state = src.read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("run")).agg(F.count("*").alias("n")).select(
        "run", F.when(n % 7 != 0, (n % 23) * 400.0).alias("cash"), F.when(n % 11 == 0, 0.0).when(n % 13 != 0, 3000.0 + 20 * n).alias("equity"),
        F.when(n % 5 < 3, 1.0).when(n % 5 == 3, 0.5).otherwise(0.0).alias("exposure"), (n % 5 == 4).alias("blocked"), (n % 17 == 0).alias("halted"),
    )
    return bars, scores, holdings.select("run", "symbol", "held"), signals, state


def _slates(spark, d):
    bars, scores, holdings, signals, state = _inputs(spark, d)
    return proposals.slates(scores, holdings, signals, state, proposals.trailing_returns(bars, scores, RULES.corr_rows), RULES)


@query("propose", f"""WITH RECURSIVE {_CAPPED} SELECT strftime(run, '%Y-%m-%d') AS run, CAST(rank AS INTEGER) AS rank, symbol, side, kind, trigger, round(composite, 4) AS composite, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target,
 round(qty, 6) AS qty, round(notional, 2) AS notional, round(risk, 2) AS risk_usd, round(fee, 2) AS fee_est, CASE WHEN kind = 'exit' THEN 0 ELSE round(abs(target - entry) / greatest(abs(entry - stop), 1e-9), 2) END AS reward_risk,
 CASE WHEN kind = 'exit' THEN 0 ELSE round(greatest(0, abs(target - entry) - 0.0092::double * entry) / (greatest(abs(entry - stop), 1e-9) + 0.0092::double * entry), 2) END AS reward_risk_net FROM c5""")
def propose(spark, d):
    out = proposals.proposals(_slates(spark, d), RULES)
    return out.select(
        F.date_format("run", "yyyy-MM-dd").alias("run"), "rank", "symbol", "side", "kind", "trigger", *[r(c).alias(c) for c in ("composite", "entry", "stop", "target")], r("qty", 6).alias("qty"), r("notional", 2).alias("notional"),
        r("risk", 2).alias("risk_usd"), r("fee", 2).alias("fee_est"), r("reward_risk", 2).alias("reward_risk"), r("reward_risk_net", 2).alias("reward_risk_net"),
    )


@query("skip_reasons", f"WITH RECURSIVE {_SLATE} SELECT strftime(run, '%Y-%m-%d') AS run, outcome AS reason, CAST(count(*) AS BIGINT) AS n FROM fo WHERE outcome NOT IN ('', 'taken', 'full') GROUP BY ALL")
def skip_reasons(spark, d):
    return proposals.skip_reasons(_slates(spark, d)).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "reason", "n")


@query("paper_fills", f"""WITH RECURSIVE {_CAPPED}, fl AS (SELECT *, entry * CASE WHEN side = 'BUY' THEN 1 + 6 / 1e4::double ELSE 1 - 6 / 1e4::double END AS fill FROM c5 WHERE cash IS NOT NULL),
 cs AS (SELECT *, qty * fill AS gross, qty * fill * 40 / 1e4::double AS comm FROM fl),
 ca(run, rank, symbol, side, fill, fee, status, cash) AS (SELECT DISTINCT run, CAST(0 AS BIGINT), '', '', 0.0::double, 0.0::double, '', cash FROM cs UNION ALL
  SELECT cs.run, cs.rank, cs.symbol, cs.side, cs.fill, CASE WHEN cs.side = 'BUY' AND gross + comm > ca.cash + 1e-9 THEN 0 ELSE comm END, CASE WHEN cs.side = 'BUY' AND gross + comm > ca.cash + 1e-9 THEN 'REJECTED_INSUFFICIENT_CASH' ELSE 'FILLED' END,
   CASE WHEN cs.side = 'BUY' AND gross + comm > ca.cash + 1e-9 THEN ca.cash WHEN cs.side = 'BUY' THEN ca.cash - gross - comm ELSE ca.cash + gross - comm END FROM ca JOIN cs ON cs.run = ca.run AND cs.rank = ca.rank + 1)
 SELECT strftime(run, '%Y-%m-%d') AS run, CAST(rank AS INTEGER) AS rank, symbol, side, round(fill, 4) AS fill, round(fee, 4) AS fee, status, round(cash, 2) AS cash FROM ca WHERE rank > 0""")
def paper_fills(spark, d):
    out = proposals.executed(_slates(spark, d))
    return out.select(F.date_format("run", "yyyy-MM-dd").alias("run"), "rank", "symbol", "side", r("fill").alias("fill"), r("fee").alias("fee"), "status", r("cash", 2).alias("cash"))
