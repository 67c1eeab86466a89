"""Queries over texts, score families and slates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_lake.functions import columns as col
from signal_lake.functions import text as tx
from signal_lake.functions.columns import rounded as r
from signal_lake.operators import families
from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()

#: The driver's texts are invented prose, so its queries add frequent words of it to the domain's lexicon and taxonomy.
TONES = tx.LEXICON | {"the": 0.5, "and": 0.3, "worthless": -2.2, "stupid": -1.5, "trash": -1.7, "of the": 0.7}
ASSETS = [tx.Asset("THE", ("thon", "erst")), tx.Asset("ON", ("onion", "onthe"), ambiguous=True), tx.Asset("ER", ("heer", "ered"))]
EVENTS = tx.TAXONOMY + [tx.Event("exploit", "(^|[^a-z0-9])(disgusting|trash)([^a-z0-9]|$)", 0.95, -1), tx.Event("listing", "(^|[^a-z0-9])(thon|heer)([^a-z0-9]|$)", 0.70, 1, True), tx.Event("release", "(^|[^a-z0-9])the([^a-z0-9]|$)", 0.30, 1)]
FORWARD, DENIAL = "(^|[^a-z0-9])(will|for)([^a-z0-9]|$)", "(^|[^a-z0-9])(denied|not)([^a-z0-9]|$)"
NOW = "2024-01-30 00:00:00"


def _docs(spark, d):
    return src.read(spark, d, "documents").select("doc_id", "text", "source")


_NEG = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.NEGATORS)
_INT = ", ".join(f"'{w}'" for w in tx.INTENSIFIERS)
_INTV = "CASE x " + " ".join(f"WHEN '{k}' THEN {v!r}::double" for k, v in tx.INTENSIFIERS.items()) + " END"
_PHRASES = [(k, v) for k, v in TONES.items() if " " in k]
_EMOJI = [f"least((length(t) - length(replace(t, '{k}', ''))) // {len(k)}, 4)" for k in tx.EMOJI]
_VAL = "CASE w " + " ".join(f"WHEN '{k}' THEN {v!r}::double" for k, v in TONES.items() if " " not in k) + " END"


def _sent(lex: str = _VAL) -> str:
    steps = ", ".join(f"q{i} AS (SELECT doc_id, t, replace(low, '{p}', ' ') AS low, tot + {v!r}::double * ((length(low) - length(replace(low, '{p}', ''))) // {len(p)}) AS tot, ph + (length(low) - length(replace(low, '{p}', ''))) // {len(p)} AS ph FROM q{i - 1})" for i, (p, v) in enumerate(_PHRASES, 1))
    return f"""q0 AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(lower(coalesce(text, '')), 'https?://[^ \\t\\n\\r]+', ' ', 'g') AS low, 0::double AS tot, 0 AS ph FROM documents), {steps},
 l1 AS (SELECT doc_id, tot + {" + ".join(f"{v!r}::double * {n}" for n, v in zip(_EMOJI, tx.EMOJI.values()))} AS tot, ph + {" + ".join(_EMOJI)} AS ph, regexp_extract_all(low, '[a-z0-9'']+') AS ts FROM q{len(_PHRASES)}),
 l2 AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i, ts FROM l1),
 l3 AS (SELECT doc_id, {lex} AS v, ts[greatest(i - 3, 1):i - 1] AS b FROM l2 WHERE w IN ({", ".join(f"'{k}'" for k in TONES if " " not in k)})),
 l4 AS (SELECT doc_id, v * CASE WHEN list_has_any(b, [{_NEG}]) THEN -0.75::double ELSE 1 END * coalesce(list_transform(list_filter(b, lambda x: x IN ({_INT})), lambda x: {_INTV})[1], 1) AS v FROM l3),
 l5 AS (SELECT doc_id, sum(v) AS t, count(*) AS n FROM l4 GROUP BY 1),
 se AS (SELECT l1.doc_id, coalesce(t, 0) + tot AS total, coalesce(n, 0) + ph AS hits FROM l1 LEFT JOIN l5 ON l5.doc_id = l1.doc_id),
 st AS (SELECT doc_id, CASE WHEN hits > 0 THEN tanh(total / (2.5::double * sqrt(hits))) ELSE 0 END AS pol, least(1, hits / 6.0::double) AS conf FROM se)"""


@query("sentiment", f"WITH {_sent()} SELECT doc_id, round(pol, 4) AS polarity, round(conf, 4) AS confidence FROM st")
def sentiment(spark, d):
    out = _docs(spark, d).select("doc_id", tx.sentiment(F.col("text"), TONES).alias("s"))
    return out.select("doc_id", "s.polarity", "s.confidence")


_MENTIONS = """mn AS (SELECT doc_id, 'THE' AS symbol, CASE WHEN regexp_matches(t, '(?i)[$]THE([^a-z0-9]|$)') THEN 'cashtag' WHEN regexp_matches(lower(t), '(^|[^a-z0-9])(thon|erst)([^a-z0-9]|$)') THEN 'name' WHEN regexp_matches(t, '(^|[^A-Za-z0-9])THE([^A-Za-z0-9]|$)') THEN 'ticker' END AS rule FROM d
 UNION ALL SELECT doc_id, 'ON', CASE WHEN regexp_matches(t, '(?i)[$]ON([^a-z0-9]|$)') THEN 'cashtag' WHEN regexp_matches(lower(t), '(^|[^a-z0-9])(onion|onthe)([^a-z0-9]|$)') THEN 'name' END FROM d
 UNION ALL SELECT doc_id, 'ER', CASE WHEN regexp_matches(t, '(?i)[$]ER([^a-z0-9]|$)') THEN 'cashtag' WHEN regexp_matches(lower(t), '(^|[^a-z0-9])(heer|ered)([^a-z0-9]|$)') THEN 'name' WHEN regexp_matches(t, '(^|[^A-Za-z0-9])ER([^A-Za-z0-9]|$)') THEN 'ticker' END FROM d)"""


@query("mentions_explode", f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_MENTIONS} SELECT doc_id, symbol, rule FROM mn WHERE rule IS NOT NULL")
def mentions_explode(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.mentions(F.col("text"), ASSETS)).alias("m")).select("doc_id", "m.symbol", "m.rule")


_CLASS = f"""k AS (SELECT d.doc_id, pol, conf, lower(t) AS low, (CASE WHEN regexp_matches(lower(t), '{DENIAL}') THEN 0.35::double ELSE 1 END) * (CASE WHEN regexp_matches(lower(t), '{FORWARD}') THEN 1.25::double ELSE 1 END) AS sc,
  round(conf, 4) >= 0.15 AND abs(round(pol, 4)) >= 0.20 AS has, abs(round(pol, 4)) >= 0.30 AS strong, CASE WHEN pol > 0 THEN 1 ELSE -1 END AS sg FROM d JOIN st ON st.doc_id = d.doc_id),
 cl AS (SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(low, '{e.pattern}') THEN {i}" for i, e in enumerate(EVENTS))} ELSE -1 END AS e, sc, has, strong, sg FROM k),
 ty(e, event, base, dir, toned) AS (VALUES {", ".join(f"({i}, '{e.name}', {e.impact!r}::double, {e.direction}, {str(e.tone_driven).lower()})" for i, e in enumerate(EVENTS))})"""


@query("classify_headlines", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_sent()}, {_CLASS}
 SELECT doc_id, coalesce(event, '') AS event, CASE WHEN event IS NULL THEN 0 ELSE round(least(1, base * sc * CASE WHEN toned THEN CASE WHEN has THEN 1 ELSE 0.45::double END WHEN has AND strong AND sg <> dir THEN CASE WHEN base < 0.6 THEN 0.85::double ELSE 0.55::double END ELSE 1 END), 4) END AS impact,
  CAST(coalesce(CASE WHEN toned THEN CASE WHEN has THEN sg ELSE dir END WHEN has AND strong AND sg <> dir AND base < 0.6 THEN sg ELSE dir END, 0) AS INTEGER) AS direction FROM cl LEFT JOIN ty USING (e)""")
def classify_headlines(spark, d):
    x = _docs(spark, d).withColumn("tone", tx.sentiment(F.col("text"), TONES)).select("doc_id", tx.classify(F.col("text"), F.col("tone"), EVENTS, FORWARD, DENIAL).alias("c"))
    return x.select("doc_id", "c.event", "c.impact", "c.direction")


@query("html_strip", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM pages""")
def html_strip(spark, d):
    return src.read(spark, d, "pages").select("page_id", F.md5(col.strip_html(F.col("html"))).alias("digest"))


_AGE = f"epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)"


#: The social score of the mentions m (and of each run, whose columns `by` names), as of hours `age`, with the span of their window.
def social_sql(by: str = "", recent: float = 24, base: float = 168) -> str:
    k = f"{by}, " if by else ""
    on = f"USING ({k}source)"
    return f"""bi AS (SELECT {k}source, avg(sentiment) * least(1, count(*) / 30.0::double) AS bias FROM m0 GROUP BY ALL), m AS (SELECT m0.*, least(greatest(sentiment - bias, -1), 1) AS s FROM m0 JOIN bi {on}),
 g AS (SELECT {k}symbol, count(*) FILTER (WHERE age <= {recent}) AS rec, count(*) FILTER (WHERE age > {recent}) AS old, max(span) AS span, sum(s * weight * confidence) FILTER (WHERE age <= {recent}) AS num,
  sum(weight * confidence) FILTER (WHERE age <= {recent}) AS den, count(DISTINCT author) FILTER (WHERE age <= {recent}) AS au, count(author) FILTER (WHERE age <= {recent}) AS att, coalesce(avg(confidence) FILTER (WHERE age <= {recent}), 0) AS conf FROM m GROUP BY ALL),
 v AS (SELECT {k}symbol, CASE WHEN old > 0 THEN log2((rec / {recent}::double + 1e-9) / (old / greatest(1, least(span, {base}) - {recent}) + 1e-9)) WHEN rec >= 3 THEN 0.5 ELSE 0 END AS velocity,
  CASE WHEN den > 0 THEN num / den ELSE 0 END AS tone, CASE WHEN att > 0 THEN least(1, au / greatest(3, 0.5::double * att)) ELSE 0 END AS div, conf FROM g),
 so AS (SELECT {k}symbol, velocity, tone, div, least(greatest(tanh(greatest(0, velocity) / 2) * tone * (0.4::double + 0.6::double * div) * (0.3::double + 0.7::double * conf), -1), 1) AS social FROM v)"""


@query("social_velocity", f"""WITH {sql.EVENTS}, a0 AS (SELECT symbol, 'k' || event_id % 3 AS source, author, ({_AGE}) / 3.6e9 AS age, value / 500 AS sentiment, 0.2 + (event_id % 5) / 10.0::double AS confidence, 1 + value / 100 AS weight FROM ev),
 m0 AS (SELECT *, max(age) OVER () - min(age) OVER () AS span FROM a0 WHERE age BETWEEN 0 AND 168), {social_sql()}
 SELECT symbol, round(velocity, 4) AS velocity, round(tone, 4) AS tone, round(div, 4) AS diversity, round(social, 5) AS social FROM so""")
def social_velocity(spark, d):
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    e = src.events(spark, d).select("symbol", F.concat(F.lit("k"), F.col("event_id") % 3).alias("source"), "author", age.alias("age"), (F.col("value") / 500).alias("sentiment"), (0.2 + (F.col("event_id") % 5) / 10.0).alias("confidence"), (1 + F.col("value") / 100).alias("weight"))
    seen = e.where("age between 0 and 168")
    span = seen.agg((F.max("age") - F.min("age")).alias("span"))  # one row
    return families.social(seen.join(F.broadcast(span))).select("symbol", r("velocity").alias("velocity"), r("tone").alias("tone"), r("diversity").alias("diversity"), r("social", 5).alias("social"))


@query("source_rank", f"""WITH p AS (SELECT 'u' || user_id % 7 AS source, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span, count(DISTINCT event_id) FILTER (WHERE event_type IN ('purchase', 'signup')) AS hit, count(DISTINCT event_type) FILTER (WHERE event_type IN ('purchase', 'signup')) AS assets, avg(value / 500) FILTER (WHERE event_type IN ('purchase', 'signup')) AS tone FROM events GROUP BY 1),
 v AS (SELECT source, n, least(100, n / span * 8) * (hit / n::double) * (ln(1 + assets) / ln(21)) * (0.4::double + 0.6::double * least(tone, 1)) AS value FROM p)
 SELECT source, CAST(n AS BIGINT) AS n, round(value, 4) AS value, CAST(row_number() OVER (ORDER BY floor(value * 1e6) DESC, source) AS INTEGER) AS rank FROM v""")
def source_rank(spark, d):
    e = src.read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("post_id"), F.col("event_type").alias("symbol"), (F.col("value") / 500).alias("confidence"))
    return families.source_rank(e, e.where("symbol in ('purchase', 'signup')"), 20).select("source", "n", r("value").alias("value"), "rank")


@query("catalyst_score", f"""WITH {sql.EVENTS}, c AS (SELECT symbol, pow(0.5::double, ({_AGE}) / 8.64e10 / 5) * 0.01::double AS impact, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS direction, 'e' || event_id AS event FROM ev)
 SELECT symbol, round(tanh(sum(impact * direction) / 1.5::double), 4) AS score, arg_max(event, impact) AS top, CAST(count(*) FILTER (WHERE direction > 0) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE direction < 0) AS BIGINT) AS bad FROM c GROUP BY 1""")
def catalyst_score(spark, d):
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 8.64e10
    e = src.events(spark, d).select("symbol", (F.pow(F.lit(0.5), age / 5) * 0.01).alias("impact"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("direction"), F.concat(F.lit("e"), "event_id").alias("event"))
    return families.catalyst(e).select("symbol", r("score").alias("score"), "top", "good", "bad")


@query("events_tent", f"""WITH e AS (SELECT event_type AS symbol, CAST(event_id % 50 - 10 AS INTEGER) AS days, value / 5000 AS magnitude, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction, event_id AS event FROM events),
 t AS (SELECT *, CASE WHEN days > 30 OR days < -3 THEN NULL ELSE greatest(0, least(1, CASE WHEN days > 7 THEN (30 - days) / 23.0::double WHEN days >= 0 THEN 1 ELSE 1 + days / 3.0::double END)) END AS w FROM e)
 SELECT symbol, round(tanh(sum(direction * magnitude * w)), 4) AS score, coalesce(arg_min(event, (days, event)) FILTER (WHERE days >= 0), arg_max(event, (days, event))) AS nearest, CAST(count(*) AS BIGINT) AS n FROM t WHERE w IS NOT NULL GROUP BY 1""")
def events_tent(spark, d):
    e = src.events(spark, d).select("symbol", (F.col("event_id") % 50 - 10).cast("int").alias("days"), (F.col("value") / 5000).alias("magnitude"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"), F.lit(1.0).alias("weight"), F.col("event_id").alias("event"))
    return families.dated_events(e).select("symbol", r("score").alias("score"), "nearest", "n")


@query("funding_z", f"""WITH {sql.EVENTS}, l AS (SELECT symbol, ts, value / 1e4 AS rate FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100),
 g AS (SELECT symbol, count(*) AS n, (arg_max(rate, ts) - avg(rate)) / stddev_pop(rate) AS z FROM l GROUP BY 1) SELECT symbol, CAST(n AS BIGINT) AS n, round(z, 4) AS z, round(-tanh(z / 1.5::double), 4) AS score FROM g""")
def funding_z(spark, d):
    e = src.events(spark, d).select("symbol", "ts", (F.col("value") / 1e4).alias("rate"))
    return families.positioning(e).select("symbol", "n", r("z").alias("z"), r("score").alias("score"))


@query("ladder_interp", """WITH q AS (SELECT p_brand AS symbol, p_retailprice AS strike, avg(1 - p_size / 60.0::double) AS p FROM part GROUP BY 1, 2), sp AS (SELECT p_brand AS symbol, avg(p_retailprice) AS spot FROM part GROUP BY 1),
 g AS (SELECT q.symbol, count(*) AS n, any_value(spot) AS spot, max(strike) FILTER (WHERE strike <= spot) AS x0, arg_max(p, strike) FILTER (WHERE strike <= spot) AS p0, min(strike) FILTER (WHERE strike >= spot) AS x1, arg_min(p, strike) FILTER (WHERE strike >= spot) AS p1 FROM q JOIN sp USING (symbol) GROUP BY 1),
 h AS (SELECT symbol, n, CASE WHEN x0 = x1 THEN p0 ELSE p0 + (p1 - p0) * (spot - x0) / (x1 - x0) END AS p FROM g)
 SELECT symbol, CAST(n AS BIGINT) AS n_strikes, round(p, 4) AS p, round(2 * (p - 0.5::double), 4) AS score FROM h""")
def ladder_interp(spark, d):
    p = src.read(spark, d, "part")
    q = p.select(F.col("p_brand").alias("symbol"), F.col("p_retailprice").alias("strike"), (1 - F.col("p_size") / 60.0).alias("probability"))
    out = families.ladder(q, p.groupBy(F.col("p_brand").alias("symbol")).agg(F.avg("p_retailprice").alias("spot")))
    return out.select("symbol", F.col("n_strikes").cast("long").alias("n_strikes"), r("p").alias("p"), r("score").alias("score"))


@query("macro_blend", """WITH q AS (SELECT event_type AS series, CAST(ts AS DATE) AS fetched, value / 1000 AS probability, 0.05::double AS baseline, CAST(length(event_type) AS DOUBLE) AS weight, length(event_type) % 3 - 1 AS direction, length(event_type) % 2 = 0 AS exclusive FROM events),
 n AS (SELECT * FROM q QUALIFY fetched = max(fetched) OVER (PARTITION BY series)), s AS (SELECT series, CASE WHEN bool_and(exclusive) THEN least(1, sum(probability)) ELSE avg(probability) END AS p, any_value(baseline) AS b, any_value(weight) AS w, any_value(direction) AS d, count(*) AS m FROM n GROUP BY 1),
 e AS (SELECT series, w, m, round(-least(1, CASE WHEN d = 0 THEN CASE WHEN p >= b THEN (p - b) / (1 - b) ELSE (b - p) / b END WHEN d > 0 THEN greatest(0, ((1 - p) - (1 - b)) / (1 - (1 - b))) ELSE greatest(0, (p - b) / (1 - b)) END) * w, 4) AS c FROM s)
 SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS markets, round(least(greatest(sum(c) / sum(w), -1), 0), 4) AS score, arg_min(series, (c, series)) AS top, min(c) AS worst FROM e""")
def macro_blend(spark, d):
    q = src.events(spark, d).select(
        F.col("symbol").alias("series"), F.to_date("ts").alias("fetched"), (F.col("value") / 1000).alias("probability"), F.lit(0.05).alias("baseline"), F.length("symbol").cast("double").alias("weight"), (F.length("symbol") % 3 - 1).alias("direction"),
        (F.length("symbol") % 2 == 0).alias("exclusive"),
    )
    return families.macro(q).select("n", "markets", r("score").alias("score"), "top", "worst")


@query("slate", f"""WITH {sql.scores('month')}, k AS (SELECT run, symbol, composite, 100 + CAST(substr(symbol, 2) AS DOUBLE) AS price, 0.01::double + technical / 100 AS atr FROM scores WHERE composite >= 0.1),
 t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY composite DESC, symbol) AS rank FROM k), s AS (SELECT *, least(greatest(1.5::double * atr * sqrt(10), 0.03::double), 0.4::double) * price AS sd FROM t WHERE rank <= 3),
 n AS (SELECT *, least(2 * sd, 0.6::double * price) AS td, least(100 / sd * price, 2000) AS nl FROM s), c AS (SELECT *, nl * least(1, 6000 / sum(nl) OVER (PARTITION BY run)) AS notional FROM n WHERE nl >= 15)
 SELECT strftime(run, '%Y-%m-%d') AS run, symbol, CAST(rank AS INTEGER) AS rank, round(price - sd, 4) AS stop, round(price + td, 4) AS target, round(notional / price, 4) AS qty, round(notional, 4) AS notional FROM c WHERE notional >= 15""")
def slate(spark, d):
    s = src.scores(spark, d, "month").select("run", "symbol", "composite", (100 + F.substring("symbol", 2, 9).cast("double")).alias("price"), (0.01 + F.col("technical") / 100).alias("atr_pct"))
    return families.slate(s).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "rank", r("stop").alias("stop"), r("target").alias("target"), r("qty").alias("qty"), r("notional").alias("notional"))


@query("replay_signals", f"""WITH {sql.BARS}, x AS (SELECT symbol, date, close, lag(close, 3) OVER o AS c3, lag(close, 30) OVER o AS c30, close / lag(close) OVER o - 1 AS ret FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY date))
 SELECT symbol, strftime(date, '%Y-%m-%d') AS day, round(-(close / c3 - 1), 4) AS reversal_3d, round(close / c30 - 1, 4) AS momentum_30d,
 round(CASE WHEN count(ret) OVER w >= 10 THEN -stddev_samp(ret) OVER w END, 4) AS low_vol FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)""")
def replay_signals(spark, d):
    from signal_lake.operators import signals

    out = signals.apply(src.daily_bars(spark, d), ["reversal_3d", "momentum_30d", "low_vol"])
    return out.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), *[r(c).alias(c) for c in ("reversal_3d", "momentum_30d", "low_vol")])


@query("scalar_math", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round(floor(CAST(l_quantity / 3 AS DECIMAL(28,10)) / 0.5) * 0.5, 2) AS stepped, round(l_extendedprice * 40 / 1e4, 4) AS fee,
 round(6 + 10 * sqrt(l_extendedprice / 1e6), 4) AS slip, round(pow(0.5::double, l_quantity / 10), 4) AS decayed FROM lineitem""")
def scalar_math(spark, d):
    x = src.read(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", r(col.floor_step(F.col("l_quantity") / 3, F.lit(0.5)), 2).alias("stepped"), r(col.commission(F.col("l_extendedprice"), F.lit(True))).alias("fee"),
        r(col.slippage_bps(F.col("l_extendedprice"), F.lit(1e6))).alias("slip"), r(col.decay(F.col("l_quantity"), 10.0)).alias("decayed"),
    )


@query("fill_vwap", f"""WITH {sql.LOG} SELECT symbol, mode, CAST(count(*) AS BIGINT) AS n, sum(qty) AS qty, round(sum(price * qty) / sum(qty), 4) AS vwap, strftime(min(ts), '%Y-%m-%d') AS first_day, mode(status) IS NOT NULL AS has_status FROM log WHERE status = 'FILLED' GROUP BY 1, 2""")
def fill_vwap(spark, d):
    x = src.order_log(spark, d).where("status = 'FILLED'").groupBy("symbol", "mode")
    return x.agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), r(F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("vwap"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.mode("status").isNotNull().alias("has_status"))


@query("regime_flips", """WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, CASE WHEN avg(value) > 48 THEN 'on' ELSE 'off' END AS state FROM events GROUP BY 1, 2), l AS (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY day) AS before FROM d)
 SELECT symbol, strftime(day, '%Y-%m-%d') AS day, before, state FROM l WHERE before <> state""")
def regime_flips(spark, d):
    x = src.events(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.when(F.avg("value") > 48, "on").otherwise("off").alias("state"))
    return x.withColumn("before", F.lag("state").over(Window.partitionBy("symbol").orderBy("day"))).where("before <> state").select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "before", "state")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def json_props(spark, d):
    return src.read(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
