"""Queries over bars and indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_lake.functions.rolling import ema, sma
from signal_lake.operators import indicators as ind
from signal_lake.operators import blocks, families, merge
from signal_lake.functions.columns import rounded as r
from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()


@query("ohlcv_daily", f"""WITH {sql.EVENTS} SELECT symbol, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS BIGINT) AS volume FROM ev GROUP BY 1, 2""")
def ohlcv_daily(spark, d):
    e = src.events(spark, d)
    return e.groupBy("symbol", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )


@query("ohlcv_4h", f"""WITH {sql.EVENTS} SELECT symbol, strftime(time_bucket(INTERVAL '4 hours', ts), '%Y-%m-%d %H:%M') AS bin, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS BIGINT) AS volume FROM ev GROUP BY 1, 2""")
def ohlcv_4h(spark, d):
    e = src.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("symbol", F.window("ts", "4 hours").alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bin"), "open", "high", "low", "close", "volume")


@query("daily_close_vwap", f"""WITH {sql.BARS} SELECT symbol, strftime(date, '%Y-%m-%d') AS day, close FROM bars WHERE date < (SELECT max(date) FROM bars)""")
def daily_close_vwap(spark, d):
    """The newest day is still forming and is left out."""
    b = src.daily_bars(spark, d)
    newest = src.read(spark, d, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("newest"))  # one row
    return b.join(F.broadcast(newest), F.col("date") < F.col("newest")).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), "close")


@query("coverage", f"""WITH {sql.BARS} SELECT symbol, CAST(count(*) AS BIGINT) AS n, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM bars GROUP BY 1""")
def coverage(spark, d):
    return src.daily_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"))


@query("latest_per_key", f"WITH {sql.EVENTS} SELECT symbol, author, arg_max(value, ts) AS value, CAST(max(ts) AS VARCHAR) AS ts FROM ev GROUP BY 1, 2")
def latest_per_key(spark, d):
    out = merge.replace(src.events(spark, d).select("symbol", "author", "ts", "value"), ["symbol", "author"], ["ts"])
    return out.select("symbol", "author", "value", F.col("ts").cast("string").alias("ts"))


@query("upsert_partial", """WITH log AS (SELECT user_id, event_type, arg_min(value, ts) AS confidence, arg_max(value, ts) AS sentiment, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2)
 SELECT user_id, event_type, event_id, confidence, sentiment FROM log""")
def upsert_partial(spark, d):
    """sentiment follows the last arrival, everything else keeps the first."""
    e = src.read(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.col("value").alias("confidence"), F.col("value").alias("sentiment"))
    return merge.upsert(e, ["user_id", "event_type"], ["ts"], ["sentiment"]).select("user_id", "event_type", "event_id", "confidence", "sentiment")


@query("upsert_provisional", """WITH log AS (SELECT event_type AS symbol, date_trunc('day', ts) AS day, ts, value, hour(ts) >= 20 AS final FROM events)
 SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CASE WHEN bool_or(final) THEN arg_min(value, ts) FILTER (WHERE final) ELSE arg_max(value, ts) END AS close, bool_or(final) AS is_final FROM log GROUP BY symbol, day""")
def upsert_provisional(spark, d):
    """A close that came late in its day is final and freezes; before that the newest counts."""
    e = src.events(spark, d).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", F.col("value").alias("close"))
    return merge.upsert_until_final(e, ["symbol", "day"], ["ts"], "close", F.hour("ts") >= 20)


@query("dedupe_keep_last", """SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2""")
def dedupe_keep_last(spark, d):
    e = src.read(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return merge.keep_last(e, ["user_id", "hour"], ["ts"]).select("user_id", "hour", "event_id", "value")


@query("insert_or_ignore", """SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-03' AND NOT EXISTS
 (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-03' AND s.user_id = e.user_id AND s.event_type = e.event_type)) GROUP BY 1""")
def insert_or_ignore(spark, d):
    """How many keys of the later days are new."""
    e, at = src.read(spark, d, "events"), F.lit("2024-01-03").cast("timestamp_ntz")
    new = merge.new_keys(e.where(F.col("ts") < at), e.where(F.col("ts") >= at), ["user_id", "event_type"])
    return new.groupBy("user_id").agg(F.count("*").alias("n"))


@query("source_fallback", f"""WITH {sql.EVENTS}, s AS (SELECT author, value, CASE symbol WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS priority FROM ev),
 ok AS (SELECT author, min(priority) AS priority FROM (SELECT author, priority FROM s GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1)
 SELECT author, CAST(priority AS INTEGER) AS priority, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM s JOIN ok USING (author, priority) GROUP BY 1, 2""")
def source_fallback(spark, d):
    e = src.events(spark, d).select("author", "symbol", "value")
    rows = src.first_source([e.where("symbol = 'purchase'"), e.where("symbol = 'signup'"), e.where("symbol not in ('purchase', 'signup')")], "author")
    return rows.groupBy("author", "priority").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("cache_gaps", f"""WITH {sql.BARS}, h AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1)
 SELECT symbol, '1995-01-01' AS "from", strftime(lo, '%Y-%m-%d') AS "to" FROM h WHERE DATE '1995-01-01' < lo UNION ALL SELECT symbol, strftime(hi, '%Y-%m-%d'), '2001-12-31' FROM h WHERE DATE '2001-12-31' > hi""")
def cache_gaps(spark, d):
    b = src.daily_bars(spark, d)
    wanted = b.select("symbol").distinct().withColumn("start", F.lit("1995-01-01").cast("date")).withColumn("end", F.lit("2001-12-31").cast("date"))
    return merge.gaps(b, wanted, ["symbol"], "date").select("symbol", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


@query("live_pairs", f"WITH {sql.BARS} SELECT symbol, sum(volume) AS volume FROM bars WHERE date > (SELECT max(date) - 7 FROM bars) GROUP BY 1 HAVING sum(volume) > 0")
def live_pairs(spark, d):
    line = src.read(spark, d, "lineitem")
    newest = line.agg(F.date_sub(F.to_date(F.max("l_shipdate")), 7).alias("since"))  # one row
    return src.daily_bars(spark, d).join(F.broadcast(newest), F.col("date") > F.col("since")).groupBy("symbol").agg(F.sum("volume").alias("volume")).where("volume > 0")


_W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
W19 = _W.format(19)
DAY = "strftime(date, '%Y-%m-%d') AS day"
_BOLL = f"""boll AS (SELECT *, mid + 2 * dev AS upper, mid - 2 * dev AS lower, nullif((mid + 2 * dev) - (mid - 2 * dev), 0) AS span FROM (
 SELECT *, CASE WHEN count(close) {W19} >= 10 THEN avg(close) {W19} END AS mid, CASE WHEN count(close) {W19} >= 10 THEN stddev_pop(close) {W19} END AS dev FROM bars)),
 b2 AS (SELECT *, (close - lower) / span AS pctb, span / mid AS width FROM boll)"""
_TR = "tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars))"


def _series(spark, d, f):
    """f over the daily bars in blocks of rows, so that a long series is many tasks."""
    return blocks.in_blocks(src.daily_bars(spark, d), f)


def day(df, *columns):
    return df.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), *columns)


@query("sma_guarded", f"WITH {sql.BARS} SELECT symbol, {DAY}, round(CASE WHEN count(close) {W19} >= 10 THEN avg(close) {W19} END, 6) AS sma20 FROM bars")
def sma_guarded(spark, d):
    return day(src.daily_bars(spark, d), r(sma(F.col("close"), 20), 6).alias("sma20"))


@query("bollinger", f"WITH {sql.BARS}, {_BOLL} SELECT symbol, {DAY}, round(mid, 6) AS mid, round(upper, 6) AS upper, round(lower, 6) AS lower, round(pctb, 6) AS pctb, round(width, 6) AS width FROM b2")
def bollinger(spark, d):
    return day(_series(spark, d, ind.bollinger), *[r(c, 6).alias(c) for c in ("mid", "upper", "lower", "pctb", "width")])


@query("donchian", f"WITH {sql.BARS} SELECT symbol, {DAY}, CASE WHEN count(high) {W19} >= 2 THEN max(high) {W19} END AS upper, CASE WHEN count(low) {W19} >= 2 THEN min(low) {W19} END AS lower FROM bars")
def donchian(spark, d):
    return day(_series(spark, d, ind.donchian), "upper", "lower")


_VZ = f"""vz AS (SELECT symbol, date, coalesce((volume - CASE WHEN count(volume) {W19} >= 10 THEN avg(volume) {W19} END) / nullif(CASE WHEN count(volume) {W19} >= 10 THEN stddev_pop(volume) {W19} END, 0), 0) AS vol_z FROM bars)"""


@query("zscore_volume", f"WITH {sql.BARS}, {_VZ} SELECT symbol, {DAY}, round(vol_z, 4) AS vol_z FROM vz")
def zscore_volume(spark, d):
    return day(_series(spark, d, ind.volume_z), r("vol_z").alias("vol_z"))


@query("true_range_atr", f"WITH {sql.BARS}, {_TR}, {sql.ewm('a', 'tr', 'tr', 1 / 14, 14)} SELECT symbol, {DAY}, round(tr, 4) AS tr, round(y, 4) AS atr FROM tr JOIN a USING (symbol, date)")
def true_range_atr(spark, d):
    return day(_series(spark, d, ind.atr), r("tr").alias("tr"), r("atr").alias("atr"))


@query("ema_span12", f"WITH {sql.BARS}, {sql.ema('e', 'bars', 'close', 12)} SELECT symbol, {DAY}, round(y, 4) AS ema12 FROM e")
def ema_span12(spark, d):
    return day(_series(spark, d, lambda b: ema(b, "close", "ema12", 12)), r("ema12").alias("ema12"))


_MACD = f"""{sql.ema('f', 'bars', 'close', 12)}, {sql.ema('s', 'bars', 'close', 26)},
 m AS (SELECT symbol, date, f.y - s.y AS macd FROM f JOIN s USING (symbol, date)), {sql.ema('g', 'm', 'macd', 9)},
 mh AS (SELECT symbol, date, macd, g.y AS macd_signal, macd - g.y AS macd_hist FROM m LEFT JOIN g USING (symbol, date))"""


@query("macd", f"WITH {sql.BARS}, {_MACD} SELECT symbol, {DAY}, round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal, round(macd_hist, 4) AS macd_hist FROM mh")
def macd(spark, d):
    return day(_series(spark, d, ind.macd), *[r(c).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


_RSI = f"""dl AS (SELECT symbol, date, d, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM bars)),
 {sql.ewm('gn', 'dl', 'up', 1 / 14, 14)}, {sql.ewm('ls', 'dl', 'down', 1 / 14, 14)},
 rsi AS (SELECT symbol, date, coalesce(100 - 100 / (1 + gn.y / nullif(ls.y, 0)), 50) AS rsi FROM dl LEFT JOIN gn USING (symbol, date) LEFT JOIN ls USING (symbol, date))"""


@query("rsi14", f"WITH {sql.BARS}, {_RSI} SELECT symbol, {DAY}, round(rsi, 4) AS rsi FROM rsi")
def rsi14(spark, d):
    return day(_series(spark, d, ind.rsi), r("rsi").alias("rsi"))


@query("keltner", f"""WITH {sql.BARS}, {_TR}, {sql.ewm('a', 'tr', 'tr', 1 / 20, 20)}, {sql.ema('e', 'bars', 'close', 20)}
 SELECT symbol, {DAY}, round(e.y, 4) AS mid, round(e.y + 2 * a.y, 4) AS upper, round(e.y - 2 * a.y, 4) AS lower FROM e JOIN a USING (symbol, date)""")
def keltner(spark, d):
    return day(_series(spark, d, ind.keltner), *[r(c).alias(c) for c in ("mid", "upper", "lower")])


_W99 = _W.format(99)


@query("squeeze_flag", f"""WITH {sql.BARS}, {_BOLL}, w AS (SELECT * FROM b2 WHERE width IS NOT NULL)
 SELECT symbol, {DAY}, count(width) {_W99} >= 20 AND width <= quantile_cont(width, 0.2) {_W99} AS squeeze FROM w""")
def squeeze_flag(spark, d):
    return day(_series(spark, d, ind.squeeze), "squeeze")


def _lagret(n: int) -> str:
    return f"coalesce(close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1, 0)"


_ENRICH = f"""{_BOLL}, {_TR}, {sql.ewm('a', 'tr', 'tr', 1 / 14, 14)}, {_MACD}, {_RSI}, {_VZ},
 sq AS (SELECT symbol, date, width IS NOT NULL AND count(width) {_W99} >= 20 AND coalesce(width <= quantile_cont(width, 0.2) {_W99}, false) AS squeeze FROM b2),
 en AS (SELECT bars.symbol, bars.date, bars.close, b2.pctb, sq.squeeze, a.y AS atr, mh.macd_hist, rsi.rsi, vz.vol_z,
  coalesce(bars.close / (CASE WHEN count(bars.close) OVER w20 >= 10 THEN avg(bars.close) OVER w20 END) - 1, 0) AS dist20,
  coalesce(bars.close / (CASE WHEN count(bars.close) OVER w50 >= 25 THEN avg(bars.close) OVER w50 END) - 1, 0) AS dist50,
  coalesce(bars.close / lag(bars.close, 24) OVER o - 1, 0) AS ret_24b, coalesce(bars.close / lag(bars.close, 72) OVER o - 1, 0) AS ret_72b
  FROM bars JOIN b2 USING (symbol, date) JOIN a USING (symbol, date) LEFT JOIN mh USING (symbol, date) JOIN rsi USING (symbol, date) JOIN vz USING (symbol, date) JOIN sq USING (symbol, date)
  WINDOW o AS (PARTITION BY bars.symbol ORDER BY bars.date), w20 AS (PARTITION BY bars.symbol ORDER BY bars.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w50 AS (PARTITION BY bars.symbol ORDER BY bars.date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
 snap AS (SELECT symbol, date, close, coalesce(atr / close, 0.02) AS atr_pct, coalesce(pctb, 0.5) AS pctb, coalesce(macd_hist, 0) AS macd_hist, rsi, vol_z, dist20, dist50, ret_24b, ret_72b, squeeze
  FROM en QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""


@query("snapshot_last", f"WITH {sql.BARS}, {_ENRICH} SELECT symbol, {DAY}, close, round(atr_pct, 4) AS atr_pct, round(pctb, 4) AS pctb, round(macd_hist, 4) AS macd_hist, round(rsi, 4) AS rsi, round(vol_z, 4) AS vol_z, round(dist20, 4) AS dist20, round(ret_24b, 4) AS ret_24b FROM snap")
def snapshot_last(spark, d):
    s = ind.snapshot(ind.enrich(src.daily_bars(spark, d)))
    return day(s, "close", *[r(c).alias(c) for c in ("atr_pct", "pctb", "macd_hist", "rsi", "vol_z", "dist20", "ret_24b")])


#: The snapshots of daily and of weekly bars, each a query of its own names.
_FRAMES = f"""short AS (WITH {_ENRICH} SELECT * FROM snap), medium AS (WITH bars AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS date, arg_max(close, date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM bars_of_days GROUP BY 1, 2), {_ENRICH} SELECT * FROM snap)"""
_DAYS = f"{sql.BARS}, bars_of_days AS (SELECT * FROM bars)"
_TECH = """t0 AS (SELECT m.*, s.close AS s_close, greatest(s.atr_pct, 1e-6) AS sa, s.macd_hist AS s_macd, s.vol_z AS s_vol, greatest(m.atr_pct, 1e-6) AS a FROM medium m JOIN short s USING (symbol)),
 t1 AS (SELECT *, least(greatest(0.6 * tanh(dist20 / a / 3) + 0.4 * tanh(dist50 / a / 5), -1), 1) AS tr_, least(greatest(0.45 * tanh(s_macd / (s_close * sa) / 0.8) + 0.55 * tanh(macd_hist / (close * a) / 0.8), -1), 1) AS mo_, least(greatest(2 * (pctb - 0.5), -1), 1) AS c_ FROM t0),
 t2 AS (SELECT *, round(tr_, 4) AS trend, round(mo_, 4) AS momentum,
  round(least(greatest(c_ * least(1, abs(tr_) / 0.5) - 0.8 * c_ * (1 - least(1, abs(tr_) / 0.5)), -1), 1), 4) AS position,
  round(0.6 * least(greatest((50 - rsi) / 25, -1), 1), 4) AS rsi_part, round(tanh(s_vol / 2) * CASE WHEN mo_ < 0 THEN -1 ELSE 1 END, 4) AS volume_part FROM t1),
 tech AS (SELECT symbol, trend, momentum, position, rsi_part, volume_part, squeeze,
  least(greatest((0.32::double * trend + 0.30::double * momentum + 0.18::double * position + 0.10::double * rsi_part + 0.10::double * volume_part) * CASE WHEN squeeze THEN 1.15::double ELSE 1 END, -1), 1) AS technical FROM t2)"""


def _technical(bars):
    return ind.technical_score(ind.snapshot(ind.enrich(bars)), ind.snapshot(ind.enrich(src.weekly_bars(bars))))


@query("technical_score", f"WITH {_DAYS}, {_FRAMES}, {_TECH} SELECT * EXCLUDE (technical), round(technical, 4) AS technical FROM tech")
def technical_score(spark, d):
    return _technical(src.daily_bars(spark, d)).withColumn("technical", r("technical"))


_X = """x0 AS (SELECT symbol, 0.5 * ret_24b + 0.5 * ret_72b AS raw FROM snap), xs AS (SELECT symbol, CASE WHEN stddev_pop(raw) OVER () < 1e-9 THEN 0 ELSE tanh((raw - avg(raw) OVER ()) / stddev_pop(raw) OVER ()) END AS xsec FROM x0)"""


@query("xsec_momentum", f"WITH {sql.BARS}, {_ENRICH}, {_X} SELECT symbol, round(xsec, 4) AS xsec FROM xs")
def xsec_momentum(spark, d):
    s = ind.snapshot(ind.enrich(src.daily_bars(spark, d))).withColumn("run", F.lit(0))
    return ind.cross_section(s, ["run"]).select("symbol", r("xsec").alias("xsec"))


@query("composite_rank", f"""WITH {_DAYS}, {sql.scores('month')}, {_FRAMES}, {_TECH}, snap AS (SELECT * FROM short), {_X},
 fam AS (SELECT symbol, arg_max(social, run) AS social, arg_max(catalyst, run) AS catalyst FROM scores GROUP BY 1),
 c0 AS (SELECT symbol, least(greatest(0.7::double * round(technical, 4) + 0.3::double * xsec, -1), 1) AS t, coalesce(social, 0) AS social, coalesce(catalyst, 0) AS catalyst FROM tech JOIN xs USING (symbol) LEFT JOIN fam USING (symbol)),
 co AS (SELECT symbol, round(t, 4) AS technical, social, catalyst, round(0.5::double * t, 4) AS w_technical, round(0.2::double * social, 4) AS w_social, round(0.3::double * catalyst, 4) AS w_catalyst, round(0.5::double * t + 0.2::double * social + 0.3::double * catalyst, 4) AS composite FROM c0)
 SELECT *, CAST(row_number() OVER (ORDER BY composite DESC, symbol) AS INTEGER) AS rank FROM co""")
def composite_rank(spark, d):
    """Weights .5 technical (7:3 with the cross-section), .2 social, .3 catalyst, with what each contributes; a family that is missing is 0."""
    b = src.daily_bars(spark, d)
    daily = ind.snapshot(ind.enrich(b))
    fam = src.scores(spark, d, "month").groupBy("symbol").agg(F.max_by("social", "run").alias("social"), F.max_by("catalyst", "run").alias("catalyst"))
    parts = {"technical": 0.5, "social": 0.2, "catalyst": 0.3}
    tech = _scored(daily, ind.snapshot(ind.enrich(src.weekly_bars(b))), daily, F.lit(False))
    out = families.composite(tech.join(fam, "symbol", "left"), parts)
    shown = out.select("symbol", "technical", "social", "catalyst", *[f"w_{f}" for f in parts], "composite")
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "symbol")))  # one row a symbol of the universe


def _scored(short, medium, daily, held_only):
    """symbol, technical_raw, xsec, held_only and price, from the snapshots of three frames."""
    tech = ind.technical_score(short, medium).select("symbol", F.col("technical").alias("technical_raw"))
    returns = daily.select("symbol", "ret_24b", "ret_72b", held_only.alias("held_only"), F.lit(0).alias("run"))
    x = ind.cross_section(returns, ["run"]).select("symbol", "xsec", "held_only")
    return tech.join(x, "symbol").join(medium.select("symbol", F.col("close").alias("price")), "symbol")


#: Names from this number on are held but outside the universe; the weights of six families.
_HELD_FROM = 15
_SIX = {"technical": 0.5, "social": 0.2, "catalyst": 0.3, "positioning": 0.1, "events": 0.15, "ladder": 0.1}
_W6 = sum(_SIX.values())


@query("composite_families", f"""WITH {_DAYS}, {sql.scores('month')}, {_FRAMES}, {_TECH}, sn AS (SELECT symbol, 0.5 * ret_24b + 0.5 * ret_72b AS raw, CAST(substr(symbol, 2) AS INTEGER) >= {_HELD_FROM} AS held_only FROM short),
 ref AS (SELECT avg(raw) AS m, stddev_pop(raw) AS s FROM sn WHERE NOT held_only OR (SELECT count(*) FROM sn WHERE NOT held_only) < 3),
 xs AS (SELECT symbol, held_only, CASE WHEN (SELECT count(*) FROM sn) < 3 OR s < 1e-9 THEN 0 ELSE tanh((raw - m) / s) END AS xsec FROM sn, ref),
 fam AS (SELECT symbol, arg_max(social, run) AS social, arg_max(catalyst, run) AS catalyst FROM scores GROUP BY 1),
 fr AS (SELECT format('S{{:02d}}', o_custkey % 20) AS symbol, CAST(date_trunc('day', o_orderdate) AS DATE) AS ts, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e6 - 0.15::double, 6) AS rate FROM orders GROUP BY 1, 2),
 fl AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100),
 ps AS (SELECT symbol, CASE WHEN count(*) < 20 OR stddev_pop(rate) = 0 THEN 0 ELSE -tanh((arg_max(rate, ts) - avg(rate)) / stddev_pop(rate) / 1.5::double) END AS positioning FROM fl GROUP BY 1),
 te AS (SELECT format('S{{:02d}}', o_custkey % 20) AS symbol, CAST(o_orderkey % 200 - 100 AS INTEGER) AS days, o_totalprice / 1e7::double AS magnitude, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction FROM orders),
 tw AS (SELECT *, CASE WHEN days > 30 OR days < -3 THEN NULL ELSE greatest(0, least(1, CASE WHEN days > 7 THEN (30 - days) / 23.0::double WHEN days >= 0 THEN 1 ELSE 1 + days / 3.0::double END)) END AS w FROM te),
 ev AS (SELECT symbol, tanh(sum(direction * magnitude * w)) AS events FROM tw WHERE w IS NOT NULL GROUP BY 1),
 lq AS (SELECT format('S{{:02d}}', l_suppkey % 20) AS symbol, round(l_extendedprice / l_quantity / 200) * 200 AS strike, avg(1 - l_tax * 10) AS p FROM lineitem GROUP BY 1, 2),
 lg AS (SELECT lq.symbol, count(*) AS n, any_value(close) AS spot, max(strike) FILTER (WHERE strike <= close) AS x0, arg_max(p, strike) FILTER (WHERE strike <= close) AS p0, min(strike) FILTER (WHERE strike >= close) AS x1, arg_min(p, strike) FILTER (WHERE strike >= close) AS p1 FROM lq JOIN medium USING (symbol) GROUP BY 1),
 la AS (SELECT symbol, CASE WHEN n >= 2 AND x0 IS NOT NULL AND x1 IS NOT NULL THEN 2 * (CASE WHEN x0 = x1 THEN p0 ELSE p0 + (p1 - p0) * (spot - x0) / (x1 - x0) END - 0.5::double) ELSE 0 END AS ladder FROM lg),
 c0 AS (SELECT symbol, held_only, medium.close AS price, round(tech.technical, 4) AS technical_raw, xsec, least(greatest(0.7::double * round(tech.technical, 4) + 0.3::double * xsec, -1), 1) AS t, coalesce(social, 0) AS social, coalesce(catalyst, 0) AS catalyst,
  round(coalesce(positioning, 0), 4) AS positioning, round(coalesce(events, 0), 4) AS events, round(coalesce(ladder, 0), 4) AS ladder FROM tech JOIN xs USING (symbol) JOIN medium USING (symbol) LEFT JOIN fam USING (symbol) LEFT JOIN ps USING (symbol) LEFT JOIN ev USING (symbol) LEFT JOIN la USING (symbol)),
 c1 AS (SELECT symbol, held_only, round(price, 6) AS price, technical_raw, round(xsec, 4) AS xsec, round(t, 4) AS technical, social, catalyst, positioning, events, ladder, {", ".join(f"round({w!r}::double / {_W6!r}::double * {'t' if f == 'technical' else f}, 4) AS w_{f}" for f, w in _SIX.items())},
  round({" + ".join(f"{w!r}::double / {_W6!r}::double * {'t' if f == 'technical' else f}" for f, w in _SIX.items())}, 4) AS composite FROM c0)
 SELECT *, CAST(row_number() OVER (ORDER BY composite DESC, symbol) AS INTEGER) AS rank FROM c1""")
def composite_families(spark, d):
    """All six families, the ladder at the medium frame's close; names that are only held are scored but do not set the cross-section's scale."""
    b = src.daily_bars(spark, d)
    daily, medium = ind.snapshot(ind.enrich(b)), ind.snapshot(ind.enrich(src.weekly_bars(b)))
    scored = _scored(daily, medium, daily, F.substring("symbol", 2, 9).cast("int") >= _HELD_FROM)
    fam = src.scores(spark, d, "month").groupBy("symbol").agg(F.max_by("social", "run").alias("social"), F.max_by("catalyst", "run").alias("catalyst"))
    o = src.read(spark, d, "orders").withColumn("symbol", src.symbol("o_custkey"))
    rates = o.groupBy("symbol", F.to_date("o_orderdate").alias("ts")).agg(r(src.exact_sum("o_totalprice") / F.count("*") / 1e6 - 0.15, 6).alias("rate"))
    dated = o.select("symbol", (F.col("o_orderkey") % 200 - 100).cast("int").alias("days"), (F.col("o_totalprice") / 1e7).alias("magnitude"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("direction"), F.lit(1.0).alias("weight"), F.col("o_orderkey").alias("event"))
    quotes = src.read(spark, d, "lineitem").select(src.symbol("l_suppkey").alias("symbol"), (r(F.col("l_extendedprice") / F.col("l_quantity") / 200, 0) * 200).alias("strike"), (1 - F.col("l_tax") * 10).alias("probability"))
    own = {
        "positioning": families.positioning(rates), "events": families.dated_events(dated), "ladder": families.ladder(quotes, scored.select("symbol", F.col("price").alias("spot"))),
    }
    for name, scores in own.items():
        fam = fam.join(scores.select("symbol", F.col("score").alias(name)), "symbol", "full")
    out = families.composite(scored.join(fam, "symbol", "left"), _SIX)
    shown = out.select("symbol", "held_only", r("price", 6).alias("price"), "technical_raw", "xsec", "technical", *[f for f in _SIX if f != "technical"], *[f"w_{f}" for f in _SIX], "composite")
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "symbol")))  # one row a symbol of the universe
