"""Average cost and the FIFO fold against plain loops over hand-made and random logs."""

from __future__ import annotations

import datetime
import random

import pandas as pd

from signal_lake.operators import book, ledger

SCHEMA = "symbol string, ts date, order_id string, side string, mode string, status string, qty double, price double, fee double"
DAY = datetime.date(2024, 1, 1)


def entry(symbol, day, side, qty, price, fee=0.0, mode="paper", status="FILLED"):
    return (symbol, DAY + datetime.timedelta(days=day), f"{day:05d}", side, mode, status, float(qty), float(price), float(fee))


def test_average_cost_of_bought_sold_and_emptied_positions(spark):
    r = random.Random(1)
    log = [entry("A", 0, "BUY", 2, 100), entry("A", 1, "BUY", 2, 110), entry("A", 2, "SELL", 1, 120), entry("B", 0, "BUY", 1, 5), entry("B", 1, "SELL", 9, 5), entry("B", 2, "BUY", 4, 7)]
    log += [entry("C", i, r.choice(["BUY", "BUY", "SELL", "SELL"]), r.randrange(1, 9), 50 + r.random() * 9) for i in range(400)]
    log.append(entry("A", 9, "BUY", 5, 1, status="EXPIRED"))
    want: dict = {}
    for symbol, _, _, side, _, status, qty, price, _ in log:
        if status != "FILLED":
            continue
        held, avg = want.get(symbol, (0.0, 0.0))
        if side == "BUY":
            avg = (held * avg + qty * price) / (held + qty)
            held += qty
        else:
            held = max(0.0, held - qty)
        want[symbol] = (held, avg if held > 0 else 0.0)
    got = {x.symbol: (x.qty, x.avg or 0.0) for x in ledger.average_cost(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert got["A"] == (3.0, 105.0)


def test_fifo_round_trips_dust_and_partial_sales(spark):
    log = [
        entry("A", 0, "BUY", 10, 100, 4), entry("A", 7, "SELL", 10, 120, 4.8), entry("D", 0, "BUY", 130.18, 0.83, 0.45), entry("D", 1, "SELL", 130.15, 0.82, 0.45),
        entry("P", 0, "BUY", 10, 100), entry("P", 1, "BUY", 10, 110), entry("P", 2, "SELL", 15, 130), entry("P", 0, "BUY", 2, 100, mode="binance-live"), entry("N", 0, "SELL", 5, 10),
    ]
    got = book.fifo_trades(spark.createDataFrame(log, SCHEMA)).collect()
    closed = {(t.symbol, t.entry): t for t in got if t.close_ts is not None}
    assert closed["A", 100.0].gross == 200.0 and abs(closed["A", 100.0].fees - 8.8) < 1e-9
    assert abs(closed["D", 0.83].fees - 0.90) < 1e-9 and not [t for t in got if t.symbol == "D" and t.close_ts is None]
    assert (closed["P", 100.0].gross, closed["P", 110.0].gross) == (300.0, 100.0)
    assert sorted((t.symbol, t.book, t.qty) for t in got if t.close_ts is None) == [("P", "live", 2.0), ("P", "paper", 5.0)]


def test_no_orders(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ledger.average_cost(none).collect() == [] and book.fifo_trades(none).collect() == []


def test_fold_holds_open_lots_alone_and_keys_apart():
    fills = [("A", "live", i, "BUY" if i % 2 == 0 else "SELL", 2.0, 100.0 + i, 0.5) for i in range(40_000)]
    fills += [("B", "live", i, "BUY", 1.0, 50.0, 0.25) for i in range(15_000)] + [("B", "paper", 0, "SELL", 1.0, 50.0, 0.25)]
    names = ["symbol", "book", "ts", "side", "qty", "price", "fee"]
    frames = (pd.DataFrame(fills[k : k + 999], columns=names) for k in range(0, len(fills), 999))
    got = book._folded(frames)
    first = next(got)
    assert len(first) == book.PIECE and set(first["symbol"]) == {"A"} and next(frames)["symbol"].iloc[0] == "A"  # given before the rest is read
    frames = (pd.DataFrame(fills[k : k + 999], columns=names) for k in range(0, len(fills), 999))
    out = [x for f in book._folded(frames) for x in f.itertuples(index=False)]
    assert [(x.open_ts, x.close_ts, x.qty, x.gross, x.fees) for x in out if x.symbol == "A"] == [(i, i + 1, 2.0, 2.0, 1.0) for i in range(0, 40_000, 2)]
    left = [x for x in out if x.symbol == "B"]
    assert len(left) == 15_000 and {(x.book, x.qty, x.fees) for x in left} == {("live", 1.0, 0.25)} and all(pd.isna(x.close_ts) for x in left)


def test_order_log_is_shuffled_for_its_join_alone(spark, sf_dir):
    from signal_lake.sources import adapters

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapters.order_log(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 2
