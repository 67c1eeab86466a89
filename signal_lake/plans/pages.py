"""Queries over saved pages: daily bars written as the pages of three venues, some of them broken, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signal_lake.plans import sql
from signal_lake.plans.registry import registry
from signal_lake.plans.streams import _shared
from signal_lake.sources import adapters as src
from signal_lake.sources import paged

QUERIES, SQL, query = registry()

DAY, LIMIT, WINDOW = 86_400, 400, 300
START, END = 789_004_800, 1_004_832_000  # 1995-01-02 and 2001-11-04
#: What is wrong with a symbol's pages: binance's USDT quote has a page that is cut, or none at all, or all of its quotes are broken in
#: their second page; coinbase lacks a window; kraken reports an error. One is known to kraken under another name.
CUT, ABSENT, SECOND, GAP, REFUSED, RENAMED = "S03", "S04", "S05", "S06", "S07", "S08"
ALIAS = '{"S08": "XS8"}'


def _page(df, *keys, row, start):
    """One row a page: its rows, joined in order of time."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("open_s", row.alias("r")))), lambda x: x["r"]), ",").alias("rows"), start.alias("cursor"))


def _saved(spark, d) -> str:
    """Pages of all venues in the shared folder."""
    b = src.daily_bars(spark, d).withColumn("open_s", F.unix_date("date").cast("long") * DAY).where((F.col("open_s") >= START) & (F.col("open_s") < END))
    text = {c: F.col(c).cast("string") for c in ("open_s", "close", "high", "low", "volume")}
    o = F.row_number().over(src.by_day())
    numbered = b.withColumn("page", F.floor((o - 1) / LIMIT).cast("long")).withColumn("before", F.lag("open_s").over(src.by_day()))
    quoted = F.concat(F.lit('["'), F.concat_ws('","', text["close"], text["high"], text["low"], text["close"], text["volume"]), F.lit('"]'))
    kline = F.concat(F.lit("["), text["open_s"], F.lit("000,"), F.substring(quoted, 2, 10_000))
    pages = _page(numbered, "symbol", "page", row=kline, start=F.min_by(F.when(F.col("page") == 0, F.lit(START * 1000)).otherwise(F.col("before") * 1000 + 1), "open_s"))
    quotes = F.when(F.col("symbol") == CUT, F.array(F.lit("USDT"), F.lit("USD"))).when(F.col("symbol") == ABSENT, F.array(F.lit("USDC"))).when(F.col("symbol") == SECOND, F.array(F.lit("USDT"), F.lit("USD"), F.lit("USDC"))).otherwise(F.array(F.lit("USDT")))
    pages = pages.withColumn("quote", F.explode(quotes))
    broken = ((F.col("symbol") == CUT) & (F.col("quote") == "USDT") & (F.col("page") == 0)) | ((F.col("symbol") == SECOND) & (F.col("page") == F.least(F.lit(1), F.max("page").over(src.by_symbol()))))
    binance = pages.select(F.lit("binance").alias("venue"), F.concat("symbol", "quote").alias("pair"), F.col("cursor").cast("string").alias("cursor"), F.concat(F.lit("["), "rows", F.when(broken, "").otherwise("]")).alias("raw"))
    candle = F.concat(F.lit("["), F.concat_ws(",", text["open_s"], text["low"], text["high"], text["close"], text["close"], text["volume"]), F.lit("]"))
    window = F.floor((F.col("open_s") - START) / (WINDOW * DAY)).cast("long")
    all_windows = b.select("symbol").distinct().withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((END - START - 1) // (WINDOW * DAY)).cast("long"))))
    held = _page(b.withColumn("w", window), "symbol", "w", row=candle, start=F.first("w"))
    coinbase = all_windows.join(held, ["symbol", "w"], "left").where(~((F.col("symbol") == GAP) & (F.col("w") == 1)))
    coinbase = coinbase.select(F.lit("coinbase"), F.concat("symbol", F.lit("-USD")), (START + F.col("w") * WINDOW * DAY).cast("string"), F.concat(F.lit("["), F.coalesce("rows", F.lit("")), F.lit("]")))
    ohlc = F.concat(F.lit("["), text["open_s"], F.lit(',"'), F.concat_ws('","', text["close"], text["high"], text["low"], text["close"], F.lit("0"), text["volume"]), F.lit('",1]'))
    kraken = _page(b, "symbol", row=ohlc, start=F.lit(START))
    name = F.when(F.col("symbol") == RENAMED, "XS8").otherwise(F.col("symbol"))
    answer = F.when(F.col("symbol") == REFUSED, F.lit('{"error":["EQuery:Unknown asset pair"]}')).otherwise(F.concat(F.lit('{"error":[],"result":{"'), name, F.lit('USD":['), "rows", F.lit('],"last":0}}')))
    kraken = kraken.select(F.lit("kraken"), F.concat(name, F.lit("USD")), F.lit(str(START)), answer)
    path = f"{_shared(spark)}/pages-{uuid.uuid4().hex}"
    binance.union(coinbase).union(kraken).write.partitionBy("venue", "pair", "cursor").text(path)
    return path


def _read(spark, path: str, venue: str):
    paged.register(spark)
    names = ",".join(f"S{i:02d}" for i in range(src.SYMBOLS))
    options = {"path": path, "venue": venue, "symbols": names, "start": START, "end": END, "width": DAY, "alias": ALIAS} | ({"limit": LIMIT} if venue == "binance" else {})
    return spark.read.format("saved_pages").options(**options).load()


_SHOWN = "SELECT symbol, CAST(epoch(date) AS BIGINT) AS time, close, high, low, volume FROM bars"
_SPAN = f"epoch(date) >= {START} AND epoch(date) < {END}"


@query("pages_binance", f"""WITH {sql.BARS}, n AS (SELECT symbol, count(*) AS n FROM bars WHERE {_SPAN} GROUP BY 1) SELECT symbol, symbol || CASE symbol WHEN '{CUT}' THEN 'USD' WHEN '{ABSENT}' THEN 'USDC' ELSE 'USDT' END AS pair, CAST(epoch(date) AS BIGINT) AS time, close, high, low, volume FROM bars
 WHERE {_SPAN} AND symbol <> '{SECOND}'""")
def pages_binance(spark, d):
    """Pages follow each other by the last opening; a quote that is broken or missing gives way to the next one."""
    return _read(spark, _saved(spark, d), "binance").where("error is null").select("symbol", "pair", "time", "close", "high", "low", "volume")


@query("pages_errors", f"""WITH {sql.BARS}, s AS (SELECT DISTINCT symbol FROM bars WHERE {_SPAN}) SELECT 'binance' AS venue, symbol FROM s WHERE symbol = '{SECOND}' UNION ALL SELECT 'coinbase', symbol FROM s WHERE symbol = '{GAP}' UNION ALL SELECT 'kraken', symbol FROM s WHERE symbol = '{REFUSED}'
 UNION ALL SELECT venue, x FROM (VALUES ('binance'), ('coinbase'), ('kraken')) v(venue), (SELECT format('S{{:02d}}', i) AS x FROM range({src.SYMBOLS}) r(i)) WHERE x NOT IN (SELECT symbol FROM s)""")
def pages_errors(spark, d):
    """Sources that failed, each by itself."""
    path = _saved(spark, d)
    out = _read(spark, path, "binance")
    for venue in ("coinbase", "kraken"):
        out = out.unionByName(_read(spark, path, venue))
    return out.where("error is not null").select("venue", "symbol")


@query("pages_first_source", f"""WITH {sql.BARS} SELECT symbol, CAST(CASE symbol WHEN '{SECOND}' THEN 1 ELSE 0 END AS INTEGER) AS priority, CAST(epoch(date) AS BIGINT) AS time, close FROM bars WHERE {_SPAN}""")
def pages_first_source(spark, d):
    """Of each symbol the first venue that has candles of it; a failed one leaves its symbol to the next."""
    path = _saved(spark, d)
    venues = [_read(spark, path, venue).where("error is null").drop("error") for venue in ("binance", "coinbase", "kraken")]
    return src.first_source(venues, "symbol", 1).select("symbol", "priority", "time", "close")


@query("pages_since", f"""WITH {sql.BARS} SELECT venue, symbol, CAST(epoch(date) AS BIGINT) AS time, close FROM bars, (VALUES ('coinbase'), ('kraken')) v(venue) WHERE {_SPAN} AND date >= DATE '2000-01-01' AND symbol IN ('S01', '{RENAMED}')""")
def pages_since(spark, d):
    """Filters that reach the reader: two symbols are two partitions, and windows before the time are not opened."""
    path = _saved(spark, d)
    both = _read(spark, path, "coinbase").unionByName(_read(spark, path, "kraken"))
    return both.where(F.col("symbol").isin("S01", RENAMED) & (F.col("time") >= 946_684_800)).select("venue", "symbol", "time", "close")
