"""Values worked out by hand: as-of returns, coefficients, exits, halts, regimes, macro readings, ladders, trades, labels and rounding."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from signal_lake.functions import columns as col
from signal_lake.functions.registered import register
from signal_lake.operators import asof, book, evaluation, families, ledger, tables
from signal_lake.operators import indicators as ind

DAY = datetime.date(2026, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_a_forward_return_is_entered_after_its_run(spark):
    bars = spark.createDataFrame([("A", day(i), 100.0 + i) for i in range(6)], "symbol string, date date, close double")
    runs = spark.createDataFrame([("A", day(1)), ("A", day(5)), ("B", day(1))], "symbol string, run date")
    got = {(x.symbol, x.run): x.fwd for x in asof.forward_returns(runs, bars, 1).collect()}
    assert got == {("A", day(1)): pytest.approx(103 / 102 - 1), ("A", day(5)): None, ("B", day(1)): None}
    assert {x.fwd for x in asof.forward_returns(runs, bars, 30).collect()} == {None}


def pairs(spark, rows):
    return spark.createDataFrame(rows, "run date, symbol string, family string, horizon int, score double, fwd double, state string")


def test_coefficients_of_scores_in_the_order_of_returns(spark):
    rows = [(day(r), s, "f", 7, k + r / 10, k * 0.01 * (r + 1), "on" if r else None) for r in range(2) for k, s in enumerate("ABCDE")]
    (got,) = evaluation.ic_summary(pairs(spark, rows)).collect()
    assert (got.n_runs, got.mean_ic, got.pct_positive) == (2, pytest.approx(1.0), 100.0)
    runs = spark.createDataFrame([(day(0),), (day(1),)], "run date")
    out = {x.part: x for x in evaluation.battery(pairs(spark, rows), runs, "C", n=2).collect()}
    assert set(out) == {"all", "first half", "second half", "on", "no state"} and out["all"].mean_ic == pytest.approx(1.0) and out["on"].n_runs == 1
    assert out["first half"].top == pytest.approx(0.035) and out["first half"].bottom == pytest.approx(0.005) and out["first half"].lead == pytest.approx(0.02)
    (pooled,) = evaluation.pooled_ic(pairs(spark, rows)).collect()
    scores, returns = [r[4] for r in rows], [r[5] for r in rows]
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    a, b = rank([round(x, 9) for x in scores]), rank([round(x, 9) for x in returns])
    mean = sum(a) / len(a)
    want = sum((x - mean) * (y - mean) for x, y in zip(a, b)) / math.sqrt(sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b))
    assert (pooled.n, pooled.pooled) == (10, pytest.approx(want))


def test_equity_by_mode(spark):
    curve = spark.createDataFrame([("paper", day(0), 10_000.0), ("paper", day(2), 10_100.0), ("live", day(0), 500.0), ("live", day(1), 450.0), ("live", day(2), 480.0)], "mode string, day date, equity double")
    got = {x.mode: (round(x.total_return, 6), round(x.max_drawdown, 6)) for x in evaluation.equity_stats(curve).collect()}
    assert got == {"paper": (1.0, 0.0), "live": (-4.0, -10.0)}


@pytest.mark.parametrize(
    "price, high, days, score, part, want",
    [
        (89.0, 100.0, 1, 0.2, 100.0, ("stop", "", 100.0, -11.0)), (131.0, 131.0, 1, 0.2, 50.0, ("target", "", 50.0, 31.0)), (93.0, 102.0, 1, 0.2, 100.0, None),
        (110.0, 120.0, 1, 0.2, 100.0, ("trailing", "", 100.0, 10.0)), (85.0, 100.0, 40, -0.5, 100.0, ("stop", "horizon,reversal", 100.0, -15.0)),
    ],
)
def test_exits_of_a_position(spark, price, high, days, score, part, want):
    held = spark.createDataFrame([("SOL", price, 100.0, 90.0, 130.0, high, days, score)], "symbol string, price double, entry double, stop double, target double, high double, held_days int, score double")
    got = [(x.trigger, x.also, x.sold_pct, round(x.pnl_pct, 6)) for x in book.exits(held, target_pct=part).collect()]
    assert got == ([want] if want else [])


def test_a_position_without_terms_can_only_be_reversed(spark):
    held = spark.createDataFrame([("A", 5.0, None, None, None, None, None, -0.2), ("B", 5.0, None, None, None, None, None, 0.9)], "symbol string, price double, entry double, stop double, target double, high double, held_days int, score double")
    got = book.described(book.exits(held)).collect()
    assert [(x.symbol, x.trigger, x.why) for x in got] == [("A", "reversal", "Close for: score reversed. Score -0.200. Opened without terms.")]


def halted(spark, points, **options):
    return {x.mode: x for x in book.halts(spark.createDataFrame(points, "mode string, day date, equity double"), **options).collect()}


def test_halts(spark):
    got = halted(spark, [("d", day(0), 100.0), ("d", day(1), 120.0), ("d", day(2), 100.0), ("w", day(0), 100.0), ("w", day(4), 100.0), ("w", day(10), 91.0), ("one", day(0), 5.0)])
    assert (round(got["d"].drawdown, 2), got["d"].tripped) == (-16.67, True) and "one" not in got
    assert (round(got["w"].window_loss, 2), got["w"].tripped) == (-9.0, True)
    points = [("d", day(0), 200.0), ("d", day(5), 100.0), ("d", day(6), 99.0)]
    assert halted(spark, points)["d"].tripped and not halted(spark, points, reset=str(day(5)))["d"].tripped and not halted(spark, points, drawdown=0.0, loss=0.0)["d"].tripped
    live = spark.createDataFrame([("d", day(7), 80.0)], "mode string, day date, equity double")
    assert halted(spark, points, reset=str(day(5)), live=live)["d"].drawdown == pytest.approx(-20.0)


@pytest.mark.parametrize("first, last, n, want", [(100.0, 360.0, 260, "risk_on"), (360.0, 100.0, 260, "risk_off"), (100.0, 120.0, 50, "neutral")])
def test_regimes_of_straight_lines(spark, first, last, n, want):
    bars = spark.createDataFrame([("A", day(i), first + (last - first) * i / (n - 1)) for i in range(n)], "symbol string, date date, close double")
    assert book.regime(bars).orderBy(F.desc("date")).first().state == want


@pytest.mark.parametrize("state, scale, score, want", [("risk_on", 1.0, -0.3, ("risk_on", 0.7)), ("neutral", 0.5, -0.9, ("risk_off", 0.0)), ("neutral", 0.5, 0.8, ("neutral", 0.5))])
def test_a_macro_score_only_dampens(spark, state, scale, score, want):
    x = spark.range(1).select(ledger.dampened(F.lit(state), F.lit(scale), F.lit(score)).alias("d")).first().d
    assert (x.state, pytest.approx(x.scale)) == want


def macro(spark, rows):
    return families.macro(spark.createDataFrame(rows, "series string, fetched int, probability double, baseline double, weight double, direction int, exclusive boolean")).first()


def test_macro_readings(spark):
    assert macro(spark, [("a", 1, 0.575, 0.15, 1.0, -1, False), ("b", 1, 0.10, 0.20, 2.0, -1, False)]).score == pytest.approx(-0.5 / 3)
    assert macro(spark, [("a", 1, 0.60, 0.5, 1.0, -1, True), ("a", 1, 0.15, 0.5, 1.0, -1, True)]).score == pytest.approx(-0.5)
    assert macro(spark, [("a", 1, 0.24, 0.60, 1.0, 1, False)]).score == pytest.approx(-0.6)
    assert macro(spark, [("a", 1, 0.99, 0.5, 1.0, -1, True), ("a", 2, 0.5, 0.5, 1.0, -1, True)]).score == 0.0  # the newest fetch alone
    assert macro(spark, [("a", 1, 0.9, 0.5, 1.0, -1, False), ("a", 1, 0.5, 0.5, 1.0, -1, False)]).score == pytest.approx(-0.4)


@pytest.mark.parametrize("spot, p, score", [(110_000.0, 0.45, -0.10), (90_000.0, None, 0.0), (130_000.0, None, 0.0), (120_000.0, 0.20, -0.6)])
def test_ladders(spark, spot, p, score):
    quotes = spark.createDataFrame([("BTC", 100_000.0, 0.70), ("BTC", 120_000.0, 0.20)], "symbol string, strike double, probability double")
    x = families.ladder(quotes, spark.createDataFrame([("BTC", spot)], "symbol string, spot double")).first()
    assert x.p == (None if p is None else pytest.approx(p)) and x.score == pytest.approx(score)


def test_names_that_are_only_held_do_not_set_the_scale(spark):
    rows = [("r", s, x, x, held) for s, x, held in [("A", 0.1, False), ("B", 0.2, False), ("C", 0.3, False), ("Z", 9.0, True)]]
    got = {x.symbol: x.xsec for x in ind.cross_section(spark.createDataFrame(rows, "run string, symbol string, ret_24b double, ret_72b double, held_only boolean"), ["run"]).collect()}
    sd = math.sqrt(((0.1) ** 2 * 2) / 3)
    assert got["B"] == pytest.approx(0.0, abs=1e-9) and got["C"] == pytest.approx(math.tanh(0.1 / sd)) and got["Z"] == pytest.approx(1.0)
    few = ind.cross_section(spark.createDataFrame(rows[:2], "run string, symbol string, ret_24b double, ret_72b double, held_only boolean"), ["run"])
    assert {x.xsec for x in few.collect()} == {0.0}


def test_trades_without_losses(spark):
    t = spark.createDataFrame([("paper", 200.0, 8.8, 7), ("paper", None, 1.0, None)], "book string, gross double, fees double, hold_days int")
    got = {x.book: x for x in book.trade_stats(t).collect()}
    assert set(got) == {"all", "paper"} and got["all"].profit_factor == math.inf and (got["paper"].net, got["paper"].avg_loss, got["paper"].hold_days) == (pytest.approx(191.2), 0.0, 7.0)


def test_labels_and_books(spark):
    x = [(1234.5, "1,234.50"), (2.5, "2.5000"), (0.5, "0.500000"), (0.001, "0.00100000"), (0.00001, "0.0000100000"), (-1234.5, "-1,234.50")]
    got = spark.createDataFrame(x, "x double, want string").select("want", tables.label_price(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    d = [(0.5, "up to 1 day"), (7.0, "1-7 days"), (30.0, "up to 30 days")]
    got = spark.createDataFrame(d, "x double, want string").select("want", tables.label_horizon(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    modes = spark.createDataFrame([("paper",), ("paper-x",), (None,), ("binance-live",), ("not-paper",)], "mode string").select(col.book_of(F.col("mode")).alias("b")).collect()
    assert [m.b for m in modes] == ["paper", "paper", "paper", "live", "live"]


def test_rounding(spark):
    x = [(0.00005, 0.0001), (-0.00005, -0.0001), (1e15, 1e15), (-3e300, -3e300), (2.0**60 + 4096, 2.0**60 + 4096), (None, None), (123456789.12345, 123456789.1235)]
    df = spark.createDataFrame(x, "x double, want double")
    register(spark)
    df.createOrReplaceTempView("rounding_values")
    assert [r.got for r in df.select(col.rounded("x").alias("got")).collect()] == [w for _, w in x]
    assert [r.got for r in spark.sql("SELECT sl_rounded(x, 4) AS got FROM rounding_values").collect()] == [w for _, w in x]


def test_what_a_portfolio_does_not_know(spark):
    held = spark.createDataFrame([("A", 2.0), ("B", 3.0), ("C", 1.0)], "symbol string, qty double")
    basis = spark.createDataFrame([("A", 2.0, 10.0), ("B", 1.0, 5.0)], "symbol string, qty double, avg double")
    prices = spark.createDataFrame([("A", 11.0), ("B", 6.0)], "symbol string, last double")
    terms = spark.createDataFrame([("A", 9.9, 0.0, 4, 12.0)], "symbol string, stop double, target double, age_days int, high double")
    view = ledger.portfolio(held, basis, prices, terms)
    got = {x.symbol: x for x in view.collect()}
    assert (got["A"].pnl, got["A"].pnl_pct, got["A"].to_target_pct) == (pytest.approx(2.0), pytest.approx(10.0), None) and got["A"].to_stop_pct == pytest.approx(100 * (11 / 9.9 - 1))
    assert got["B"].pnl is None and got["C"].value is None and got["A"].weight_pct == pytest.approx(55.0)
    warned = lambda *a: {x.warning: x.n for x in ledger.portfolio_warnings(view, *a).collect()}
    assert warned(60.0, 100.0, True) == {"unpriced": 1, "no_terms": 2, "no_basis": 2} and warned(None, 100.0, False) == {"unpriced": 1, "no_terms": 2, "no_balance": 1}
    assert warned(1000.0, 100.0, False)["basis_off"] == 1


def test_protection_and_fees(spark):
    resting = spark.createDataFrame([(1, "A", "oco", "ALL_DONE"), (2, "B", "oco", "EXECUTING"), (3, "C", "stop", None), (4, "D", "stop", None), (5, "E", "oco", "REJECT"), (6, "F", "stop", None)], "id int, symbol string, kind string, list_status string")
    legs = spark.createDataFrame([(1, "FILLED", 2.0), (1, "CANCELED", 0.0), (2, "NEW", 0.0), (3, "CANCELED", 0.0), (4, "NEW", 0.0), (5, "REJECTED", None)], "id int, status string, executed double")
    assert {(x.id, x.status) for x in ledger.protection_status(resting, legs).collect()} == {(1, "filled"), (3, "cancelled"), (5, "cancelled")}
    f = [("a", "BTC", 100.0, 1.0, 0.5, "USDT"), ("a", "BTC", 200.0, 1.0, 0.001, "BTC"), ("b", "BTC", 1.0, 1.0, 0.1, "BNB"), ("b", "BTC", 1.0, 1.0, 0.1, "USD"), ("c", "BTC", 1.0, 2.0, None, None)]
    got = {x.order_id: (x.price, x.fee) for x in ledger.fill_fees(spark.createDataFrame(f, "order_id string, symbol string, price double, qty double, fee double, fee_asset string")).collect()}
    assert got == {"a": (150.0, pytest.approx(0.65)), "b": (1.0, None), "c": (1.0, None)}


def test_families_from_json_and_no_stablecoins(spark):
    rows = [("A", None, '{"events": {"events": 0.4}, "positioning": {"other": 1}}'), ("USDC", 1.0, None), ("B", 0.2, '{"positioning": {"positioning": 0.9}}'), ("C", None, "not json")]
    got = {x.symbol: (x.positioning, x.events) for x in evaluation.backfilled(spark.createDataFrame(rows, "symbol string, positioning double, components string"), ["positioning", "events"]).collect()}
    assert got == {"A": (None, 0.4), "B": (0.2, None), "C": (None, None)}
