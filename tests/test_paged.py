"""Saved pages: cursors, quotes, aliases, broken pages, filters that reach the reader, and streams of new pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from signal_lake.sources import paged


def save(root, venue, pair, cursor, payload):
    at = root / f"venue={venue}" / f"pair={pair}" / f"cursor={cursor}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(payload if isinstance(payload, str) else json.dumps(payload))
    (at / "_SUCCESS").write_text("")


def kline(t, close):
    return [t * 1000, "1", "2", "0.5", str(close), "10", 0]


def read(spark, root, venue, symbols, **options):
    paged.register(spark)
    return spark.read.format("saved_pages").options(path=f"file://{root}", venue=venue, symbols=symbols, **options).load()


def shown(df, *columns):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)


@pytest.fixture
def root(tmp_path):
    return tmp_path


def test_pages_follow_their_cursors(spark, root):
    save(root, "binance", "AUSDT", "0", [kline(10, 1), kline(20, 2)])
    save(root, "binance", "AUSDT", "20001", [kline(30, 3), kline(30, 4)])
    save(root, "binance", "AUSDT", "30001", [kline(40, "x"), kline(50, 5)][1:])
    got = read(spark, root, "binance", "A", limit=2)
    assert shown(got, "pair", "time", "close", "error") == [("AUSDT", 10, 1.0, None), ("AUSDT", 20, 2.0, None), ("AUSDT", 30, 4.0, None), ("AUSDT", 50, 5.0, None)]


def test_a_broken_page_leaves_the_next_quote_and_the_other_symbols(spark, root):
    save(root, "binance", "AUSDT", "0", [kline(10, 1), kline(20, 2)])
    save(root, "binance", "AUSDT", "20001", '[[30000,"1"')  # cut
    save(root, "binance", "AUSD", "0", [kline(10, 7)])
    save(root, "binance", "BUSDT", "0", [])
    save(root, "binance", "BUSDC", "0", [kline(10, 8), kline(11, None)])
    save(root, "binance", "BUSDC", "11001", [])
    save(root, "binance", "CUSDT", "0", {"code": -1121, "msg": "Invalid symbol."})
    save(root, "binance", "EUSDT", "0", [[1]])
    got = read(spark, root, "binance", "A,B,C,D,E", limit=2)
    assert shown(got.where("error is null"), "symbol", "pair", "time", "close") == [("A", "AUSD", 10, 7.0), ("B", "BUSDC", 10, 8.0)]
    assert [x.symbol for x in got.where("error is not null").orderBy("symbol").collect()] == ["C", "D", "E"]


def test_windows_aliases_and_reported_errors(spark, root):
    save(root, "coinbase", "A-USD", "0", [[20, 1, 4, 2, 3, 9], [10, 1, 4, 2, 3.5, 9]])
    save(root, "coinbase", "A-USD", "30", [])
    save(root, "coinbase", "A-USD", "60", [[70, 1, 4, 2, 5, 9]])
    save(root, "coinbase", "B-USD", "0", [])
    got = read(spark, root, "coinbase", "A,B", limit=3, width=10, end=90)
    assert shown(got.where("error is null"), "time", "open", "high", "low", "close") == [(10, 2.0, 4.0, 1.0, 3.5), (20, 2.0, 4.0, 1.0, 3.0), (70, 2.0, 4.0, 1.0, 5.0)]
    assert [x.symbol for x in got.where("error is not null").collect()] == ["B"]  # its second window is missing
    save(root, "kraken", "XBTUSD", "0", {"error": [], "result": {"XXBTZUSD": [[10, "1", "2", "0", "1.5", "1", "7", 3]], "last": 10}})
    save(root, "kraken", "ETHUSD", "0", {"error": ["EQuery:Unknown asset pair"]})
    save(root, "kraken", "SOLUSD", "0", {"error": [], "result": {"last": 10}})
    got = read(spark, root, "kraken", "BTC,ETH,SOL")
    assert shown(got.where("error is null"), "symbol", "pair", "close", "volume") == [("BTC", "XBTUSD", 1.5, 7.0)]
    assert {x.symbol: x.error for x in got.where("error is not null").collect()} == {"ETH": "['EQuery:Unknown asset pair']", "SOL": "no rows"}


def test_markets_name_their_next_page(spark, root):
    save(root, "markets", "KXFED", "first", {"markets": [{"close": 100, "strike": 4.5, "bid": 0.4, "ask": 0.5, "last": 0.45, "volume_fp": "12.5"}], "cursor": "abc"})
    save(root, "markets", "KXFED", "abc", {"markets": [{"close": 200, "last": "0.5", "volume": 3}, {"close": None, "last": None}], "cursor": ""})
    got = read(spark, root, "markets", "KXFED")
    assert shown(got, "time", "open", "close", "volume") == [(100, 4.5, 0.45, 12.5), (200, None, 0.5, 3.0)]


def test_what_is_before_the_start_is_left_out(spark, root):
    save(root, "binance", "AUSDT", "15000", [kline(10, 1), kline(20, 2)])
    assert shown(read(spark, root, "binance", "A", start=15), "time") == [(20,)]


def test_filters_choose_partitions_and_windows(spark, root):
    options = {"path": f"file://{root}", "venue": "coinbase", "symbols": "A,B,C", "start": "0", "end": "1000", "width": "10", "limit": "3"}
    reader = paged.PagedReader(options)
    left = list(reader.pushFilters([EqualTo(("symbol",), "B"), GreaterThanOrEqual(("time",), 75), IsNotNull(("time",))]))
    assert [type(f).__name__ for f in left] == ["GreaterThanOrEqual", "IsNotNull"]
    assert [(p.symbol, p.start) for p in reader.partitions()] == [("B", 60)]
    reader = paged.PagedReader(options)
    assert list(reader.pushFilters([In(("symbol",), ("A", "C", "Z")), EqualTo(("symbol",), "C")])) == [] and [p.symbol for p in reader.partitions()] == ["C"]
    save(root, "coinbase", "B-USD", "60", [[70, 1, 1, 1, 1, 1], [80, 1, 1, 1, 2, 1]])  # the windows before it are not there: they are not opened
    got = read(spark, root, "coinbase", "A,B", start=0, end=90, width=10, limit=3).where("symbol = 'B' and time >= 75")
    assert shown(got, "time", "close") == [(80, 2.0)]


def test_a_stream_reads_each_page_once(spark, root):
    paged.register(spark)
    out = []

    def run():
        pages = spark.readStream.format("saved_pages").options(path=f"file://{root}/p", venue="binance", symbols="A,B", limit=2).load()
        sink = lambda batch, number: out.append(shown(batch, "symbol", "time", "close", "error"))
        pages.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    save(root / "p", "binance", "AUSDT", "0", [kline(10, 1), kline(20, 2)])
    run()
    save(root / "p", "binance", "AUSDT", "20001", [kline(30, 3)])
    save(root / "p", "binance", "BUSDT", "0", "[")
    run()
    assert out[0] == [("A", 10, 1.0, None), ("A", 20, 2.0, None)]
    assert out[1][0] == ("A", 30, 3.0, None) and out[1][1][:3] == ("B", None, None) and "BUSDT" in out[1][1][3] and len(out) == 2
