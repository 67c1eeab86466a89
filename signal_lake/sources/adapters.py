"""The domain's tables, derived from the star schema and the event stream, and readers for feeds on disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import rounded

#: Assets in the universe that the adapters make.
SYMBOLS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key: str):
    return F.format_string("S%02d", F.col(key) % SYMBOLS)


def by_symbol():
    return Window.partitionBy("symbol")


def by_day():
    return by_symbol().orderBy("date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, author, value for each event."""
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("user_id").alias("author"), "value", "props")


def exact_sum(column: str, digits: int = 2):
    """A sum of amounts that no order of adding changes."""
    return F.sum(F.col(column).cast(f"decimal(18,{digits})")).cast("double")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close (volume-weighted), high, low, volume."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % SYMBOLS).alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(
            rounded(exact_sum("l_extendedprice") / exact_sum("l_quantity")).alias("close"),
            rounded(F.max(unit)).alias("high"),
            rounded(F.min(unit)).alias("low"),
            F.sum("l_quantity").alias("volume"),
        )
        .withColumn("symbol", symbol("symbol"))  # a name a bar, not a line
    )


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what many branches of a plan read: it is worked out once."""
    base = (df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='signal-lake-')}").rstrip("/")
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def weekly_bars(daily: DataFrame) -> DataFrame:
    """Daily bars in weeks: the last close, the highest high, the lowest low and all volume."""
    week = F.to_date(F.date_trunc("week", "date"))
    return daily.groupBy("symbol", week.alias("__w")).agg(F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")).withColumnRenamed("__w", "date")


def scores(spark: SparkSession, sf_dir: str, period: str = "week") -> DataFrame:
    """run (date), symbol and the score families, one row a run and symbol."""
    late = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")
    return (
        read(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc(period, "o_orderdate")).alias("run"), symbol("o_custkey").alias("symbol"))
        .agg(
            rounded(exact_sum("o_totalprice") / F.count("*") / 1e5).alias("technical"),
            rounded(F.avg(late)).alias("social"),
            rounded(F.count("*") / 10.0).alias("catalyst"),
        )
        .withColumn("composite", rounded(0.5 * F.col("technical") + 0.3 * F.col("social") + 0.2 * F.col("catalyst")))
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: ids, ts, symbol, side, mode, status, type, qty, price and proposed entry; exact repeats fall together.

    An order's key begins its lines' ids, so repeats are looked for where the join has dealt the keys, without another shuffle."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = line.select(
        F.col("l_orderkey").alias("__key"),
        F.to_date("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("order_id"),
        symbol("l_suppkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("l_linestatus") == "O", "paper").otherwise("live").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "PARTIALLY_FILLED").otherwise("EXPIRED").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, "MARKET").otherwise("LIMIT").alias("order_type"),
        F.col("l_quantity").alias("qty"),
        rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        rounded(F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount") / 10)).alias("entry"),
        rounded(F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fee"),
    )
    return rows.distinct().drop("__key")


def first_source(sources: list[DataFrame], key: str, least: int = 5) -> DataFrame:
    """For each key, the rows of the first source that has at least `least` of them."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    counts = rows.groupBy(key, "priority").count().where(F.col("count") >= least)
    return rows.join(counts.groupBy(key).agg(F.min("priority").alias("priority")), [key, "priority"], "left_semi")


def csv_sink(df: DataFrame, path: str) -> DataFrame:
    """df written as CSV with a header, and read back with its own types."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
