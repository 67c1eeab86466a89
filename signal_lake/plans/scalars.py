"""Queries over scalar expressions that tables are made with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_lake.functions import columns as col
from signal_lake.functions import text as tx
from signal_lake.functions.columns import rounded as r
from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.sources import adapters as src

QUERIES, SQL, query = registry()


@query("mention_weights", """SELECT event_id, round((1 + ln(1 + greatest(value - 50, 0)) + 0.5::double * ln(1 + greatest(user_id % 9 - 2, 0))) * CASE WHEN event_id % 4 = 0 THEN 0.6::double ELSE 1 END * CASE event_id % 3 WHEN 0 THEN 1.0::double WHEN 1 THEN 0.85::double ELSE 0.8::double END, 4) AS weight FROM events""")
def mention_weights(spark, d):
    """Votes and answers of a post, its kind, and how its symbol was matched."""
    e = src.read(spark, d, "events")
    rule = F.element_at(F.array(F.lit("cashtag"), F.lit("ticker"), F.lit("name")), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 4 == 0, "comment").otherwise("post")
    return e.select("event_id", col.mention_weight(F.col("value") - 50, F.col("user_id") % 9 - 2, kind, rule).alias("weight"))


@query("fill_states", f"""WITH {sql.LOG} SELECT order_id, CASE WHEN status = 'EXPIRED' AND qty > 25 THEN 'validated' WHEN status = 'EXPIRED' THEN 'none' WHEN status = 'PARTIALLY_FILLED' AND qty > 10 THEN 'partial' ELSE 'filled' END AS state, CASE WHEN side = 'BUY' THEN price * (1 + qty / 1e4) ELSE price * (1 - qty / 1e4) END AS fill FROM log""")
def fill_states(spark, d):
    """What of an order was filled, and the price that slippage of its size would leave."""
    log = src.order_log(spark, d)
    status = F.when((F.col("status") == "EXPIRED") & (F.col("qty") > 25), "VALIDATED").otherwise(F.col("status"))
    filled = F.when(F.col("status") == "PARTIALLY_FILLED", F.when(F.col("qty") > 10, F.col("qty") / 2).otherwise(F.col("qty") * 0.9995)).when(F.col("status") == "FILLED", F.col("qty"))
    return log.select("order_id", col.fill_state(status, F.col("qty"), filled).alias("state"), col.adverse(F.col("price"), F.col("side"), F.col("qty")).alias("fill"))


_SECOND = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"


@query("text_dates", f"""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE {_SECOND} END AS at, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(CASE WHEN event_id % 5 = 4 THEN NULL ELSE date_trunc('second', ts) END)) / 8.64e10::double, 4) AS age FROM events""".replace("AS at,", 'AS "at",'))
def text_dates(spark, d):
    """Times as feeds write them: with a weekday and an offset or a zone's name, by the standard, and what is none."""
    e = src.events(spark, d).withColumn("s", F.date_trunc("second", "ts").cast("timestamp"))
    texts = F.when(F.col("event_id") % 5 == 0, F.date_format("s", "EEE, d MMM yyyy HH:mm:ss '+0000'")).when(F.col("event_id") % 5 == 1, F.date_format("s", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    texts = texts.when(F.col("event_id") % 5 == 2, F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 3, F.date_format("s", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))
    at = col.parse_date(texts)
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), r(col.age_days(F.lit("2024-02-01").cast("timestamp"), at)).alias("age"))


@query("news_weights", """WITH x AS (SELECT event_id, event_type, date_trunc('second', ts) AS at_s, event_id % 3 AS k FROM events), y AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(at_s)) / 8.64e10::double AS age, round(least(1, CASE k WHEN 0 THEN 0.35::double * 1.25::double WHEN 1 THEN 0.35::double WHEN 2 THEN 0.35::double * 0.35::double END), 4) AS impact FROM x)
 SELECT event_id, 'testnet' AS event, round(impact * pow(0.5::double, greatest(age, 0) / CASE k WHEN 0 THEN 6.0::double ELSE 1.5::double END), 4) AS weight FROM y""")
def news_weights(spark, d):
    """Headlines of what is ahead, of what is there and of what is denied: the first fade slower."""
    e = src.events(spark, d).withColumn("s", F.date_trunc("second", "ts").cast("timestamp"))
    title = F.element_at(F.array(F.lit("Testnet is scheduled"), F.lit("Testnet is live"), F.lit("Testnet date denied")), (F.col("event_id") % 3 + 1).cast("int"))
    x = e.withColumn("title", title).withColumn("found", tx.classify(F.col("title"), tx.sentiment(F.col("title"))))
    weight = tx.news(F.col("found"), F.col("title"), col.age_days(F.lit("2024-02-01").cast("timestamp"), F.col("s")))
    return x.select("event_id", "found.event", r(weight).alias("weight"))


@query("score_series", f"""WITH {sql.scores()}, c AS (SELECT run, symbol, unnest(['technical', 'social', 'catalyst']) AS family, unnest([0.5::double * technical, 0.3::double * social, 0.2::double * catalyst]) AS part FROM scores WHERE symbol IN ('S01', 'S02'))
 SELECT strftime(run, '%Y-%m-%d') AS run, symbol, family, round(part, 4) AS part, round(sum(part) OVER (PARTITION BY run, symbol ORDER BY family), 4) AS top, round(part - lag(part) OVER (PARTITION BY symbol, family ORDER BY run), 4) AS change FROM c""")
def score_series(spark, d):
    """What charts stack: each family's part of two names' scores, where it ends, and how it moved."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), (w * F.col(k)).alias("part")) for k, w in (("technical", 0.5), ("social", 0.3), ("catalyst", 0.2))])).alias("p")
    x = src.scores(spark, d).where("symbol in ('S01', 'S02')").select("run", "symbol", parts).select("run", "symbol", "p.*")
    top = F.sum("part").over(Window.partitionBy("run", "symbol").orderBy("family"))
    change = F.col("part") - F.lag("part").over(Window.partitionBy("symbol", "family").orderBy("run"))
    return x.select(F.date_format("run", "yyyy-MM-dd").alias("run"), "symbol", "family", r("part").alias("part"), r(top).alias("top"), r(change).alias("change"))
