"""Queries that run a stream over all files that are there, and give what its sink holds then."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded as r
from signal_lake.plans.registry import registry
from signal_lake.streaming import state, streams

QUERIES, SQL, query = registry()


def _shared(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='signal-lake-')}").rstrip("/")


def drained(stream: DataFrame, mode: str, every: bool = False) -> DataFrame:
    """What the stream has written once all its input is read: in append mode (or if `every` batch is asked for, by its number) all
    batches, else the last one."""
    spark, path = stream.sparkSession, f"{_shared(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    last = []

    def sink(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number)) if every else batch).write.mode("overwrite").parquet(f"{path}/out-{number}")
        last.append(number)

    run = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema if every else stream.schema
    return spark.read.schema(schema).parquet(f"{path}/out-{'*' if every or mode == 'append' else max(last)}")


@query("stream_tumbling", """SELECT event_type AS symbol, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close, CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    out = drained(streams.bars(streams.read_events(spark, d)), "complete")
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("stream_high_water", """SELECT event_type AS symbol, round(max(value), 4) AS high, round(arg_max(value, ts), 4) AS last, round(arg_max(value, ts) / max(value) - 1, 4) AS drawdown, arg_max(value, ts) / max(value) - 1 <= -0.15::double AS crossed FROM events GROUP BY 1""")
def stream_high_water(spark, d):
    """One file is one batch, so the update that the sink holds has every symbol."""
    out = drained(streams.high_water(streams.read_events(spark, d)), "update")
    return out.select("symbol", r("high").alias("high"), r("last").alias("last"), r("drawdown").alias("drawdown"), "crossed")


@query("stream_dedupe", "SELECT event_type AS symbol, user_id AS author, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY 1, 2")
def stream_dedupe(spark, d):
    out = drained(streams.once(streams.read_events(spark, d), ["event_id"], "60 days"), "append")
    return out.groupBy("symbol", "author").agg(F.count("*").alias("n"))


#: Rows that the watermark passes: all but the last day's.
_TICKS = """tk AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS at_ms, CAST(event_id AS VARCHAR) AS id, value, CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CAST(event_id % 5 + 1 AS DOUBLE) AS qty FROM events),
 wm AS (SELECT max(at_ms) - 86400000 AS until FROM tk), du AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY at_ms, id) AS i FROM tk, wm WHERE at_ms <= until)"""


def _ticks(spark, d):
    state.rocks(spark)
    e = streams.read_events(spark, d)
    return e.select("symbol", "ts", F.col("event_id").alias("id"), "value", F.when(F.col("event_id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), (F.col("event_id") % 5 + 1).cast("double").alias("qty"), F.col("value").alias("price"))


@query("stream_closes", f"""WITH {_TICKS}, c AS (SELECT symbol, at_ms // 86400000 AS day, arg_max(value, (at_ms, id)) AS close FROM tk GROUP BY 1, 2) SELECT symbol, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day, close, (day + 1) * 86400000 <= until AS is_final FROM c, wm""")
def stream_closes(spark, d):
    """The newest close of each day, and whether its day is over and it has frozen."""
    out = drained(state.kept(_ticks(spark, d), state.Closes()), "update", every=True)
    newest = out.groupBy("symbol", "day").agg(F.max_by(F.struct("close", "is_final"), F.struct("is_final", "batch")).alias("x"))
    return newest.select("symbol", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "x.close", "x.is_final")


@query("stream_positions", f"""WITH RECURSIVE {_TICKS}, po(symbol, i, at_ms, id, qty, avg, opened, entry, high) AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', 0.0::double, 0.0::double, CAST(0 AS BIGINT), 0.0::double, 0.0::double FROM du UNION ALL
 SELECT d.symbol, d.i, d.at_ms, d.id, CASE WHEN d.side = 'BUY' THEN po.qty + d.qty WHEN po.qty - d.qty > 1e-12 THEN po.qty - d.qty ELSE 0 END, CASE WHEN d.side = 'BUY' THEN (po.qty * po.avg + d.qty * d.value) / (po.qty + d.qty) WHEN po.qty - d.qty > 1e-12 THEN po.avg ELSE 0 END,
  CASE WHEN d.side = 'BUY' THEN CASE WHEN po.qty <= 0 THEN d.at_ms ELSE po.opened END WHEN po.qty - d.qty > 1e-12 THEN po.opened ELSE 0 END, CASE WHEN d.side = 'BUY' THEN d.value WHEN po.qty - d.qty > 1e-12 THEN po.entry ELSE 0 END,
  CASE WHEN d.side = 'BUY' THEN CASE WHEN po.qty <= 0 THEN d.value ELSE greatest(po.high, d.value) END WHEN po.qty - d.qty > 1e-12 THEN greatest(po.high, d.value) ELSE 0 END FROM po JOIN du d ON d.symbol = po.symbol AND d.i = po.i + 1)
 SELECT symbol, at_ms, id, qty, round(avg, 6) AS avg, opened, entry, high FROM po WHERE i > 0""")
def stream_positions(spark, d):
    """What each fill leaves of its position: quantity, average cost and terms."""
    out = drained(state.kept(_ticks(spark, d), state.Positions()), "update", every=True)
    return out.select("symbol", F.col("at").alias("at_ms"), "id", "qty", r("avg", 6).alias("avg"), "opened", "entry", "high")


@query("stream_halts", f"""WITH {_TICKS}, e AS (SELECT symbol, i, at_ms, 10000 + sum(value - 100) OVER (PARTITION BY symbol ORDER BY i) AS equity FROM du), l AS (SELECT symbol, at_ms, arg_max(equity, i) AS base FROM e GROUP BY 1, 2), f AS (SELECT symbol, arg_min(equity, i) AS first FROM e GROUP BY 1),
 x AS (SELECT e.*, max(equity) OVER (PARTITION BY e.symbol ORDER BY i) AS peak, coalesce(l.base, f.first) AS base FROM e JOIN f ON f.symbol = e.symbol ASOF LEFT JOIN l ON l.symbol = e.symbol AND e.at_ms - 604800000 >= l.at_ms),
 y AS (SELECT *, 100 * (equity / peak - 1) AS drawdown, 100 * (equity / base - 1) AS loss FROM x), z AS (SELECT *, drawdown <= -6 OR loss <= -4 AS tripped FROM y), q AS (SELECT *, coalesce(lag(tripped) OVER (PARTITION BY symbol ORDER BY i), false) AS before FROM z)
 SELECT symbol, at_ms, round(equity, 4) AS equity, round(drawdown, 4) AS drawdown, round(loss, 4) AS loss, tripped FROM q WHERE tripped <> before""")
def stream_halts(spark, d):
    """The moments at which an account's halt trips or is over."""
    out = drained(state.kept(_ticks(spark, d).withColumn("value", F.col("value") - 100), state.Halts(10_000.0, 6.0, 4.0, 7)), "update", every=True).where("crossed")
    return out.select("symbol", F.col("at").alias("at_ms"), r("equity").alias("equity"), r("drawdown").alias("drawdown"), r("loss").alias("loss"), "tripped")
