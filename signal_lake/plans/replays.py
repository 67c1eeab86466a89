"""Queries over the point-in-time replay: monthly steps at 13:00 over bars of one, two and seven days."""

from __future__ import annotations

from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded as r
from signal_lake.operators import replay, signals, tables
from signal_lake.plans import sql
from signal_lake.plans.evaluate import _REG
from signal_lake.plans.market import _ENRICH, _TECH
from signal_lake.plans.registry import registry
from signal_lake.plans.signals import social_sql
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()

#: The driver's bars are days apart, so the frames are wider than a market's; a fifth of a short view has to be there.
FRAMES = {"short": replay.Frame(replay.DAY, 60 * replay.DAY, 0.2), "medium": replay.Frame(7 * replay.DAY, 364 * replay.DAY, 0.5), "daily": replay.Frame(2 * replay.DAY, 730 * replay.DAY, 0.0)}
LEAD, BASE, RECENT, HORIZONS = "S00", 28 * replay.DAY, 7 * replay.DAY, (1, 7, 30)
RATES_BACK = 400 * replay.DAY


def _wide(name: str) -> str:
    days = FRAMES[name].width // replay.DAY
    day = f"CAST(epoch(date) AS BIGINT) // {FRAMES[name].width} * {FRAMES[name].width}"
    return f"{name}_bars AS (SELECT symbol, {day} AS open, arg_max(close, date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM bars GROUP BY 1, 2)" if days > 1 else f"{name}_bars AS (SELECT symbol, CAST(epoch(date) AS BIGINT) AS open, close, high, low, volume FROM bars)"


def _seen(name: str) -> str:
    f = FRAMES[name]
    return f"b.open + {f.width} <= st.step AND b.open >= st.step - {f.lookback}"


def _snap(name: str) -> str:
    f = FRAMES[name]
    return f"""{name} AS (WITH bars AS (SELECT concat_ws('|', CAST(st.step AS VARCHAR), b.symbol) AS symbol, b.open AS date, close, high, low, volume FROM st JOIN {name}_bars b ON b.symbol = st.symbol AND {_seen(name)}), {_ENRICH}
  SELECT snap.* FROM snap JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol) WHERE n >= greatest(5, {f.coverage * f.lookback / f.width}))"""


_STEPS = f"""{sql.BARS}, {", ".join(map(_wide, FRAMES))},
 st AS (SELECT DISTINCT symbol, CAST(epoch(date_trunc('month', date)) AS BIGINT) + 46800 AS step FROM bars WHERE date >= DATE '1995-06-01')"""
_RATES = """fr AS (SELECT format('S{:02d}', o_custkey % 20) AS symbol, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS open, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e6 - 0.15::double, 6) AS rate FROM orders GROUP BY 1, 2),
 fz AS (SELECT symbol, open, count(rate) OVER w AS n, CASE WHEN stddev_pop(rate) OVER w > 1e-12 THEN (rate - avg(rate) OVER w) / stddev_pop(rate) OVER w ELSE 0 END AS z FROM fr WINDOW w AS (PARTITION BY symbol ORDER BY open ROWS 99 PRECEDING)),
 ps AS (SELECT st.step, st.symbol, fz.n, CASE WHEN fz.n >= 20 THEN fz.z END AS z, CASE WHEN fz.n >= 20 THEN -tanh(fz.z / 1.5::double) END AS positioning FROM st ASOF LEFT JOIN fz ON st.symbol = fz.symbol AND st.step >= fz.open)"""
_SOCIAL = f"""po AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS open FROM orders),
 mt AS (SELECT format('S{{:02d}}', o_custkey % 20) AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS open, o_orderpriority AS source, nullif(o_custkey % 50, 0) AS author, (o_orderkey % 21 - 10) / 10.0::double AS sentiment, (o_orderkey % 10) / 10.0::double AS confidence,
  1.0::double + o_orderkey % 3 AS weight FROM orders WHERE o_orderpriority <> '5-LOW'),
 ar AS (SELECT s.step, (max(po.open) - min(po.open)) / 3600.0::double AS span FROM (SELECT DISTINCT step FROM st) s JOIN po ON po.open < s.step AND po.open >= s.step - {BASE} GROUP BY 1 HAVING count(*) >= 2),
 m0 AS (SELECT ar.step, mt.* EXCLUDE (open), (ar.step - mt.open) / 3600.0::double AS age, span FROM ar JOIN mt ON mt.open < ar.step AND mt.open >= ar.step - {BASE}), {social_sql('step', RECENT / 3600, BASE / 3600)},
 sl AS (SELECT st.step, st.symbol, round(coalesce(so.social, 0), 4) AS social FROM st JOIN ar USING (step) LEFT JOIN so USING (step, symbol))"""
_TECHNICAL = f"""{_snap('short')}, {_snap('medium')}, {_TECH},
 dy AS (SELECT st.step, st.symbol, b.open, coalesce(close / lag(close, 24) OVER o - 1, 0) AS r24, coalesce(close / lag(close, 72) OVER o - 1, 0) AS r72, count(*) OVER (PARTITION BY st.step, st.symbol) AS n FROM st JOIN daily_bars b ON b.symbol = st.symbol AND {_seen('daily')}
  WINDOW o AS (PARTITION BY st.step, st.symbol ORDER BY b.open) QUALIFY row_number() OVER (PARTITION BY st.step, st.symbol ORDER BY b.open DESC) = 1 AND n >= 5),
 p0 AS (SELECT dy.step, dy.symbol, technical AS technical_raw, trend, momentum, position, rsi_part, volume_part, squeeze, 0.5::double * r24 + 0.5::double * r72 AS raw FROM tech JOIN dy ON tech.symbol = concat_ws('|', CAST(dy.step AS VARCHAR), dy.symbol)),
 p1 AS (SELECT *, CASE WHEN stddev_pop(raw) OVER w < 1e-9 THEN 0 ELSE tanh((raw - avg(raw) OVER w) / stddev_pop(raw) OVER w) END AS xsec FROM p0 WINDOW w AS (PARTITION BY step) QUALIFY count(*) OVER w >= 3),
 p2 AS (SELECT *, least(greatest(0.7::double * technical_raw + 0.3::double * xsec, -1), 1) AS technical FROM p1)"""
_STATE = f"""rv AS (WITH bars AS (SELECT CAST(st.step AS VARCHAR) AS symbol, b.open AS date, close FROM (SELECT DISTINCT step FROM st) st JOIN daily_bars b ON b.symbol = '{LEAD}' AND {_seen('daily')}), {_REG}
  SELECT CAST(symbol AS BIGINT) AS step, arg_max(state, date) AS state FROM rg GROUP BY 1 HAVING count(*) >= 5)"""


def _forward(h: int) -> str:
    return f"""fx{h} AS (SELECT a.symbol, a.at, a.close, b.close AS exit_close FROM cl a ASOF LEFT JOIN cl b ON a.symbol = b.symbol AND a.at + {h * replay.DAY} <= b.at),
 f{h} AS (SELECT st.step, st.symbol, CASE WHEN x.close > 0 THEN x.exit_close / x.close - 1 END AS fwd_{h}d FROM st ASOF LEFT JOIN fx{h} x ON st.symbol = x.symbol AND st.step < x.at)"""


_PANEL = f"""{_STEPS}, {_RATES}, {_SOCIAL}, {_TECHNICAL}, {_STATE}, cl AS (SELECT symbol, open + {replay.DAY} AS at, close FROM short_bars), {", ".join(map(_forward, HORIZONS))},
 pn AS (SELECT p2.*, positioning, (0.5::double * technical + 0.1::double * coalesce(positioning, 0)) / (0.5::double + 0.1::double) AS composite, social, (0.5::double * technical + 0.1::double * coalesce(positioning, 0) + 0.2::double * social) / (0.5::double + 0.1::double + 0.2::double) AS composite_social,
  rv.state AS regime_state, CASE rv.state WHEN 'risk_on' THEN 1.0::double WHEN 'neutral' THEN 0.5::double WHEN 'risk_off' THEN 0.0::double END AS regime_scale, fwd_1d, fwd_7d, fwd_30d
  FROM p2 LEFT JOIN ps USING (step, symbol) LEFT JOIN sl USING (step, symbol) LEFT JOIN rv USING (step) LEFT JOIN f1 USING (step, symbol) LEFT JOIN f7 USING (step, symbol) LEFT JOIN f30 USING (step, symbol))"""
_RUN = "strftime(make_timestamp({} * 1000000), 'bt-%Y%m%dT%H') AS run_id"


def _bars(spark, d):
    """The days' bars, which each view, step and return reads, are made from the order lines once."""
    days = src.written(src.daily_bars(spark, d), "days")

    def wide(frame):
        """Bars of several days: they open on multiples of their width."""
        opened = (F.floor(F.unix_date("date") * replay.DAY / frame.width) * frame.width).alias("open")
        return days.groupBy("symbol", opened).agg(F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))

    return days, {name: wide(f) for name, f in FRAMES.items()}


def _steps(days):
    return days.where("date >= date'1995-06-01'").select("symbol", (F.unix_date(F.trunc("date", "month")).cast("long") * replay.DAY + 46800).alias("step")).distinct()


def _rates(spark, d):
    day = (F.unix_date(F.to_date("o_orderdate")).cast("long") * replay.DAY).alias("open")
    return src.read(spark, d, "orders").groupBy(src.symbol("o_custkey").alias("symbol"), day).agg(r(src.exact_sum("o_totalprice") / F.count("*") / 1e6 - 0.15, 6).alias("rate"))


def _mentions(spark, d):
    """posts and mentions."""
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("open")
    o = src.read(spark, d, "orders")
    m = o.where("o_orderpriority <> '5-LOW'").select(
        src.symbol("o_custkey").alias("symbol"), at, F.col("o_orderpriority").alias("source"), F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("author"), ((F.col("o_orderkey") % 21 - 10) / 10.0).alias("sentiment"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), (1.0 + F.col("o_orderkey") % 3).alias("weight"),
    )
    return o.select(at), m


def _panel(spark, d):
    days, bars = _bars(spark, d)
    posts, mentions = _mentions(spark, d)
    return replay.panel(_steps(days), bars, FRAMES, _rates(spark, d), LEAD, HORIZONS, "short", posts, mentions, BASE, RECENT)


def _run(step: str = "step"):
    return F.date_format(F.timestamp_seconds(step), "'bt-'yyyyMMdd'T'HH").alias("run_id")


_ROUNDED = "technical_raw xsec technical positioning composite social composite_social fwd_1d fwd_7d fwd_30d".split()


@query("replay_panel", f"""WITH {_PANEL} SELECT {_RUN.format('step')}, symbol, {", ".join(f"round({c}, 4) AS {c}" for c in _ROUNDED)}, trend AS tc_trend, momentum AS tc_momentum, position AS tc_position, rsi_part AS tc_rsi, volume_part AS tc_volume, squeeze AS tc_squeeze,
 regime_state, regime_scale FROM pn""")
def replay_panel(spark, d):
    parts = {"trend": "tc_trend", "momentum": "tc_momentum", "position": "tc_position", "rsi_part": "tc_rsi", "volume_part": "tc_volume", "squeeze": "tc_squeeze"}
    return _panel(spark, d).select(_run(), "symbol", *[r(c).alias(c) for c in _ROUNDED], *[F.col(k).alias(v) for k, v in parts.items()], "regime_state", "regime_scale")


@query("replay_report", f"""WITH {_PANEL}, j AS (SELECT step, symbol, composite AS score, fwd_30d AS fwd, regime_state AS state FROM pn WHERE fwd_30d IS NOT NULL AND regime_state IS NOT NULL),
 q AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, symbol) AS p FROM j), s AS (SELECT step, state, avg(fwd) AS u, avg(fwd) FILTER (WHERE p <= 3) AS t, avg(fwd) FILTER (WHERE symbol = '{LEAD}') AS l FROM q GROUP BY 1, 2)
 SELECT state, CAST(count(*) AS BIGINT) AS steps, round(100 * avg(u), 2) AS universe, round(100 * avg(t), 2) AS top, round(100 * avg(l), 2) AS lead FROM s GROUP BY 1""")
def replay_report(spark, d):
    """What the replayed gate separates: mean returns of all, the top three and the lead by the step's regime."""
    rows = _panel(spark, d).select(F.col("step").alias("run"), "symbol", F.col("composite").alias("score"), F.col("fwd_30d").alias("fwd"), F.col("regime_state").alias("state"))
    out = tables.state_table(rows, LEAD)
    return out.select("state", "steps", *[r(100 * F.col(c), 2).alias(c) for c in ("universe", "top", "lead")])


@query("positioning_asof", f"WITH {_STEPS}, {_RATES} SELECT {_RUN.format('step')}, symbol, CAST(n AS BIGINT) AS n, round(z, 4) AS z, round(positioning, 4) AS positioning FROM ps")
def positioning_asof(spark, d):
    days, _ = _bars(spark, d)
    return replay.positioning_at(_steps(days), _rates(spark, d)).select(_run(), "symbol", "n", r("z").alias("z"), r("positioning").alias("positioning"))


@query("social_asof", f"WITH {_STEPS}, {_SOCIAL} SELECT {_RUN.format('step')}, symbol, social FROM sl")
def social_asof(spark, d):
    days, _ = _bars(spark, d)
    posts, mentions = _mentions(spark, d)
    return replay.social_at(_steps(days), posts, mentions, RECENT, BASE).select(_run(), "symbol", "social")


def faulty(at):
    """A plug-in that fails wherever a symbol is as even as its name says, and else gives what is no number."""
    return 1.0 / (int(at.symbol[1:]) % 2) - float("inf")


@query("signal_lab", f"""WITH {_STEPS}, {_RATES}, lm AS (SELECT st.step, st.symbol, close, row_number() OVER (PARTITION BY st.step, st.symbol ORDER BY b.open DESC) AS i FROM st JOIN medium_bars b ON b.symbol = st.symbol AND {_seen('medium')}),
 ld AS (SELECT st.step, st.symbol, close, close / lag(close) OVER (PARTITION BY st.step, st.symbol ORDER BY b.open) - 1 AS ret, row_number() OVER (PARTITION BY st.step, st.symbol ORDER BY b.open DESC) AS i FROM st JOIN daily_bars b ON b.symbol = st.symbol AND {_seen('daily')}),
 lf AS (SELECT st.step, st.symbol, rate, row_number() OVER (PARTITION BY st.step, st.symbol ORDER BY fr.open DESC) AS i FROM st JOIN fr ON fr.symbol = st.symbol AND fr.open <= st.step AND fr.open >= st.step - {RATES_BACK}),
 a AS (SELECT step, symbol, max(close) FILTER (WHERE i = 1) / max(close) FILTER (WHERE i = 25) - 1 AS m FROM lm GROUP BY 1, 2),
 b AS (SELECT step, symbol, max(close) FILTER (WHERE i = 1) AS c, max(close) FILTER (WHERE i = 4) AS c3, max(close) FILTER (WHERE i = 31) AS c30, count(ret) FILTER (WHERE i <= 30) AS n, stddev_samp(ret) FILTER (WHERE i <= 30) AS sd FROM ld GROUP BY 1, 2),
 f AS (SELECT step, symbol, count(*) AS n, avg(rate) FILTER (WHERE i <= 9) AS m FROM lf GROUP BY 1, 2)
 SELECT {_RUN.format('step')}, symbol, round(-a.m, 4) AS reversal_1d, round(-(c / c3 - 1), 4) AS reversal_3d, round(c / c30 - 1, 4) AS momentum, round(CASE WHEN b.n >= 10 THEN -sd END, 4) AS low_vol, round(CASE WHEN f.n >= 3 THEN -f.m END, 10) AS funding_level, NULL::DOUBLE AS faulty
 FROM a FULL JOIN b USING (step, symbol) LEFT JOIN f USING (step, symbol)""")
def signal_lab(spark, d):
    days, bars = _bars(spark, d)
    steps = _steps(days)
    plugins = signals.resolve("reversal_1d, reversal_3d, momentum=momentum_30d, low_vol, funding_level, signal_lake.plans.replays:faulty")
    views = {name: replay.view(steps, bars[name], FRAMES[name]) for name in ("medium", "daily")}
    rates = replay.view(steps, _rates(spark, d), replay.Frame(0, RATES_BACK, 0.0))
    out = signals.lab(views, rates, plugins)
    return out.select(_run(), "symbol", *[r(c).alias(c) for c in ("reversal_1d", "reversal_3d", "momentum", "low_vol")], r("funding_level", 10).alias("funding_level"), "faulty")
