"""Queries over saved feed responses: the event stream written as responses of each feed, read back to the common row shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded as r
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src
from signal_lake.sources import feeds

QUERIES, SQL, query = registry()

_TIME = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"


def _events(spark, d):
    return src.events(spark, d).withColumn("at", F.date_trunc("second", "ts"))


def _json(*columns):
    return F.to_json(F.struct(*columns))


def _shown(df, *columns: str):
    return df.select(*columns, F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("feed_forum", f"SELECT 't3_' || event_id AS post_id, event_type AS channel, CAST(user_id AS VARCHAR) AS author, CAST(trunc(value) AS BIGINT) AS score, 'on ' || event_type AS title, 'https://reddit.com/r/' || event_id AS link, {_TIME} AS created FROM events")
def feed_forum(spark, d):
    """Half of the responses are listings, half the archive's."""
    e = _events(spark, d)
    item = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("author").cast("string").alias("author"), F.unix_timestamp("at").alias("created_utc"), "value", F.col("value").alias("score"),
        F.concat(F.lit("on "), "symbol").alias("title"), F.concat(F.lit("/r/"), F.col("event_id").cast("string")).alias("permalink"),
    )
    listing = _json(F.struct(F.array(F.struct(item.alias("data"))).alias("children")).alias("data"))
    archive = _json(F.array(item).alias("data"))
    raw = e.select(F.col("symbol").alias("channel"), F.when(F.col("event_id") % 2 == 0, listing).otherwise(archive).alias("raw"))
    return _shown(feeds.forum(raw), "post_id", "channel", "author", "score", "title", "link")


@query("feed_messages", f"""SELECT 'st_' || event_id AS post_id, event_type AS symbol, CASE WHEN value > 100 THEN 1.0::double WHEN value < 20 THEN -1.0::double ELSE 0 END AS sentiment,
 CASE WHEN value > 100 OR value < 20 THEN 0.9::double ELSE 0 END AS confidence, CASE WHEN value > 100 OR value < 20 THEN 'cashtag_label' ELSE 'cashtag' END AS matched_on, {_TIME} AS created FROM events""")
def feed_messages(spark, d):
    """The author's label, where there is one, stands for the tone."""
    label = F.when(F.col("value") > 100, "Bullish").when(F.col("value") < 20, "Bearish")
    raw = _events(spark, d).select(F.concat("symbol", F.lit(".X")).alias("channel"), _json(F.array(F.struct(
        F.col("event_id").cast("string").alias("id"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.struct(label.alias("basic")).alias("sentiment")).alias("entities"),
    )).alias("messages")).alias("raw"))
    return _shown(feeds.ticker_messages(raw), "post_id", "symbol", "sentiment", "confidence", "matched_on")


@query("feed_statuses", f"SELECT 'md_' || event_id AS post_id, '#' || event_type AS channel, CAST(user_id AS VARCHAR) AS author, 'seen ' || event_type AS body, {_TIME} AS created FROM events WHERE event_id % 5 <> 0")
def feed_statuses(spark, d):
    """Statuses without text are left out."""
    e = _events(spark, d)
    html = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("<p>seen  <b>"), "symbol", F.lit("</b></p>"))).otherwise(F.lit("<p> </p>"))
    status = F.struct(F.col("event_id").cast("string").alias("id"), html.alias("content"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.col("author").cast("string").alias("acct")).alias("account"))
    raw = e.select(F.concat(F.lit("#"), "symbol").alias("channel"), F.to_json(F.array(status)).alias("raw"))
    return _shown(feeds.statuses(raw), "post_id", "channel", "author", "body")


@query("feed_board", f"""SELECT '4c_' || (event_id + 1) AS post_id, 'topic ' || event_type AS body, 'https://boards.4chan.org/biz/thread/' || (event_id + 1) AS link, {_TIME} AS created FROM events
 UNION ALL SELECT '4c_r' || (event_id + 1), 'no to ' || event_type, 'https://boards.4chan.org/biz/thread/' || (event_id + 1), {_TIME} FROM events WHERE event_id % 3 = 0""")
def feed_board(spark, d):
    """First posts, and the replies that the catalogue holds, without back links."""
    no = (F.col("event_id") + 1).cast("string")  # a thread has no number 0
    when = F.unix_timestamp("at").alias("time")
    reply = F.struct(F.concat(F.lit("r"), no).alias("no"), F.concat(F.lit("&gt;&gt;"), no, F.lit("<br>no to "), "symbol").alias("com"), when, no.alias("resto"))
    thread = F.struct(no.alias("no"), F.lit("topic").alias("sub"), F.col("symbol").alias("com"), when, F.lit("0").alias("resto"), F.when(F.col("event_id") % 3 == 0, F.array(reply)).alias("last_replies"))
    raw = _events(spark, d).select(F.lit("/biz/").alias("channel"), F.to_json(F.array(F.struct(F.array(thread).alias("threads")))).alias("raw"))
    return _shown(feeds.board(raw), "post_id", "body", "link")


@query("feed_news", """SELECT event_type AS channel, CAST(place AS INTEGER) AS place, 'item ' || (event_id * 10 + place) AS title, 'about ' || event_type AS summary FROM events, (SELECT unnest([0, 1]) AS place)""")
def feed_news(spark, d):
    """The first two items of each feed of three; feeds in RSS and in Atom."""
    number = [(F.col("event_id") * 10 + i).cast("string") for i in range(3)]
    rss = [F.concat(F.lit("<item><title>item "), n, F.lit("</title><link>x</link><description>&lt;p&gt;about "), "symbol", F.lit("&lt;/p&gt;</description></item>")) for n in number]
    atom = [F.concat(F.lit('<entry><title>item '), n, F.lit('</title><link href="x"/><updated>2024-01-01T00:00:00Z</updated><summary>about '), "symbol", F.lit("</summary></entry>")) for n in number]
    whole = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<rss><channel><title>f</title>"), *rss, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), *atom, F.lit("</feed>")))
    raw = _events(spark, d).select(F.col("symbol").alias("channel"), whole.alias("raw"))
    return feeds.news(raw, 2).select("channel", "place", "title", "summary")


@query("feed_unlocks", """SELECT upper(event_type) AS symbol, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS percent, 'from unlock feed' AS note FROM events WHERE event_id % 7 <> 0""")
def feed_unlocks(spark, d):
    """A list, or one under `data` or `results`; rows whose percent is no number are left out."""
    e = _events(spark, d)
    row = F.array(F.struct(
        F.when(F.col("event_id") % 2 == 0, F.col("symbol")).alias("symbol"), F.col("symbol").alias("ticker"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("unlock_date"),
        F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 3 == 0, "0").otherwise(F.col("value").cast("string")).alias("percent"),
    ))
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(row)).when(F.col("event_id") % 3 == 1, _json(row.alias("data"))).otherwise(_json(row.alias("results")))
    known = e.select(F.upper("symbol").alias("symbol"))
    return feeds.unlocks(e.select(raw.alias("raw")), known)


_NOW = "2024-01-30 00:00:00"
#: Of every five releases one is before the final one; titles by the rest of three.
_KINDS = ("'v' || event_id", "'Audited build ' || event_id", "'Testnet ' || event_id || ' is expected'")


@query("feed_releases", f"""WITH x AS (SELECT event_id, event_type, date_trunc('second', ts) AS at_s, event_id % 3 AS k, event_id % 5 = 0 AS pre FROM events WHERE event_id % 7 <> 0),
 y AS (SELECT *, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(at_s) AS age, least(1, CASE k WHEN 0 THEN 0.30::double WHEN 1 THEN 0.30::double ELSE 0.35::double * 1.25::double END) AS impact FROM x WHERE at_s >= TIMESTAMP '{_NOW}' - INTERVAL 20 DAY)
 SELECT event_type AS channel, CASE k WHEN 0 THEN 'release' WHEN 1 THEN 'audit' ELSE 'testnet' END AS event, '[release] ' || CASE k WHEN 0 THEN {_KINDS[0]} WHEN 1 THEN {_KINDS[1]} ELSE {_KINDS[2]} END AS title, round(round(impact, 4) * CASE WHEN pre THEN 0.6::double ELSE 1 END * pow(0.5::double, greatest(floor(age / 8.64e10::double), 0) / 14.0::double), 4) AS impact, CAST(1 AS INTEGER) AS direction FROM y""")
def feed_releases(spark, d):
    """Releases of the last twenty days, with what their titles say; some give no time."""
    e = _events(spark, d)
    title = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("v"), "event_id")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Audited build "), "event_id")).otherwise(F.concat(F.lit("Testnet "), "event_id", F.lit(" is expected")))
    at = F.when(F.col("event_id") % 7 != 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    release = F.struct(F.when(F.col("event_id") % 2 == 0, title).alias("name"), title.alias("tag_name"), F.lit("").alias("body"), F.when(F.col("event_id") % 4 != 0, at).alias("published_at"), at.alias("created_at"), (F.col("event_id") % 5 == 0).alias("prerelease"))
    raw = e.select(F.col("symbol").alias("channel"), F.to_json(F.array(release)).alias("raw"))
    return feeds.releases(raw, F.lit(_NOW).cast("timestamp"), 20).select("channel", "event", "title", "impact", "direction")


@query("feed_funding", "SELECT event_type AS channel, epoch_us(date_trunc('second', ts)) // 1000 AS time, value / 1e6 AS rate FROM events WHERE event_id % 6 <> 0")
def feed_funding(spark, d):
    """Rates are realised or else announced; an entry without either is left out."""
    e = _events(spark, d)
    rate = (F.col("value") / 1e6).cast("string")
    entry = F.struct((F.unix_timestamp("at") * 1000).cast("string").alias("fundingTime"), F.when(F.col("event_id") % 6 == 1, rate).when(F.col("event_id") % 6 == 2, F.lit("")).alias("realizedRate"), F.when(F.col("event_id") % 6 > 1, rate).alias("fundingRate"))
    raw = e.select(F.col("symbol").alias("channel"), _json(F.array(entry).alias("data")).alias("raw"))
    return feeds.funding(raw)


@query("feed_markets", """WITH x AS (SELECT event_id AS i, event_type, value, round(value / 500, 2) AS p FROM events)
 SELECT event_type AS channel, 'm' || i AS ticker, CAST(CASE WHEN i % 4 = 0 THEN 100000 + i ELSE 1250.5 END AS DOUBLE) AS strike, round(CASE WHEN i % 3 = 0 THEN (p + p + 0.02::double) / 2 WHEN i % 3 = 1 THEN p ELSE floor(value / 5) / 100 END, 4) AS probability, CAST(floor(value) AS BIGINT) AS volume FROM x WHERE value >= 20 AND i % 5 <> 0 AND i % 4 <> 3""")
def feed_markets(spark, d):
    """Quotes in dollars, a last trade, or cents; strikes as listed or in the title; ranges and markets without a strike or volume are left out."""
    i, value = F.col("event_id"), F.col("value")
    p = r(value / 500, 2)
    market = F.struct(
        F.concat(F.lit("m"), i.cast("string")).alias("ticker"), F.when(i % 5 == 0, "between").otherwise("greater").alias("strike_type"), F.when(i % 4 == 0, (100000 + i).cast("string")).alias("floor_strike"), F.when(i % 4 == 1, "$1,250.50 or above").otherwise("").alias("subtitle"),
        F.when(i % 4 == 2, "Above $1,250.5 on Friday").otherwise("no amount").alias("title"), F.when(i % 3 == 0, p.cast("string")).alias("yes_bid_dollars"), F.when(i % 3 == 0, (p + 0.02).cast("string")).otherwise("").alias("yes_ask_dollars"),
        F.when(i % 3 == 1, p.cast("string")).alias("last_price_dollars"), F.lit("0").alias("yes_bid"), F.lit("0").alias("yes_ask"), F.floor(value / 5).cast("string").alias("last_price"), F.when(i % 2 == 0, value.cast("string")).alias("volume_fp"), F.floor(value).cast("string").alias("volume"),
    )
    raw = _events(spark, d).select(F.col("symbol").alias("channel"), _json(F.array(market).alias("markets")).alias("raw"))
    return feeds.ladder_markets(raw, 20).select("channel", "ticker", "strike", "probability", "volume")
