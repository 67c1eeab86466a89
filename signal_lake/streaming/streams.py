"""Structured Streaming forms of the stateful operators.

Every function takes a streaming DataFrame and gives one; the caller starts the query with a checkpoint, which is what
makes a run resumable and keeps two runs from overlapping. Event times are cast to timestamp, as watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """symbol, ts, author, value, event_id from new files of the event table's folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    return raw.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("author"), "value")


def bars(ticks: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """OHLCV of (symbol, ts, value) in tumbling windows; in append mode a bar appears once, when its time is over."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    out = g.agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"),
    )
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of an author's events that are less than `gap` apart."""
    g = ticks.withWatermark("ts", late).groupBy("author", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("author", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def velocity(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each symbol in sliding weeks, and in the last day of each."""
    recent = F.count_if(F.col("ts") >= F.col("__until") - F.expr("INTERVAL 1 DAY"))
    timed = ticks.withWatermark("ts", late).withColumn("__w", F.window("ts", "7 days", "1 day")).withColumn("__until", F.col("__w.end"))
    return timed.groupBy("symbol", "__w", "__until").agg(F.count("*").alias("n"), recent.alias("recent")).select("symbol", F.col("__until").alias("until"), "n", "recent")


def once(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat within the watermark is dropped."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


HIGH = "symbol string, high double, last double, drawdown double, crossed boolean"


def high_water(ticks: DataFrame, drop: float = 0.15) -> DataFrame:
    """For each batch and symbol: the highest value so far, the newest one, the drawdown, and whether it went beyond `drop` in this batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, last, at, below = state.get if state.exists else (float("-inf"), 0.0, 0, False)
        for p in parts:
            high = max(high, float(p["value"].max()))
            newest = p.loc[p["ts"].idxmax()]
            if newest["ts"].value >= at:
                last, at = float(newest["value"]), newest["ts"].value
        drawdown = last / high - 1 if high > 0 else 0.0
        now = drawdown <= -drop
        state.update((high, last, at, now))
        yield pd.DataFrame({"symbol": [key[0]], "high": [high], "last": [last], "drawdown": [drawdown], "crossed": [now and not below]})

    grouped = ticks.select("symbol", "ts", "value").groupBy("symbol")
    return grouped.applyInPandasWithState(step, HIGH, "high double, last double, at long, below boolean", "update", GroupStateTimeout.NoTimeout)


def merge_into(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the table at path/<batch> is the merge of the one before with the batch, so that a batch that
    is run again writes the same table."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = merge(spark.read.parquet(f"{path}/{number - 1}"), batch)
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    return sink
