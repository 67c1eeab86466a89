"""The slate of a run against values worked out by hand; the queries are held against recursive SQL."""

from __future__ import annotations

import datetime
import math

import pytest

from signal_lake.operators.proposals import Rules, executed, proposals, skip_reasons, slates

RUN = datetime.date(2024, 3, 1)
PLAIN = Rules(horizon_scaling=False, position_pct=50.0, deployed_pct=90.0, correlation_sizing=False, fee_adjust=False)


def score(symbol="AAA", composite=0.5, price=100.0, daily=0.04, week=0.04):
    return (RUN, symbol, composite, price, daily, week)


def slate(spark, rules=PLAIN, scores=(score(),), held=(), signals=(), cash=None, equity=None, exposure=1.0, blocked=False, halted=False, returns=()):
    return slates(
        spark.createDataFrame(list(scores), "run date, symbol string, composite double, price double, atr_daily double, atr_week double"),
        spark.createDataFrame([(RUN, *h) for h in held], "run date, symbol string, held double"),
        spark.createDataFrame([(RUN, *s) for s in signals], "run date, seq int, symbol string, qty double, last double, stop double, target double, composite double, trigger string"),
        spark.createDataFrame([(RUN, cash, equity, exposure, blocked, halted)], "run date, cash double, equity double, exposure double, blocked boolean, halted boolean"),
        spark.createDataFrame([(RUN, s, r) for s, r in returns], "run date, symbol string, returns array<struct<date:date,ret:double>>"),
        rules,
    )


def rows(spark, rules=PLAIN, **given):
    return proposals(slate(spark, rules, **given), rules).orderBy("rank").collect()


def reasons(spark, rules=PLAIN, **given):
    return {x.reason: x.n for x in skip_reasons(slate(spark, rules, **given)).collect()}


def test_a_stop_out_costs_the_risk_of_a_trade(spark):
    (p,) = rows(spark)
    assert (p.side, p.entry - p.stop, p.reward_risk) == ("BUY", pytest.approx(6.0), pytest.approx(2.0))
    assert (p.entry - p.stop) * p.qty == pytest.approx(100.0) and p.risk == pytest.approx(100.0)


def test_zero_equity_is_a_basis_and_unknown_equity_is_not(spark):
    assert rows(spark, equity=0.0) == [] and reasons(spark, equity=0.0) == {"below_min_notional": 1}
    assert rows(spark, equity=None)[0].risk == pytest.approx(100.0) and rows(spark, equity=500.0)[0].risk == pytest.approx(5.0)


def test_targets_earn_their_fees_and_are_capped(spark):
    fees = Rules(**{**PLAIN.__dict__, "fee_adjust": True})
    (p,) = rows(spark, fees)
    assert p.reward_risk > 2.0 and p.reward_risk_net == pytest.approx(2.0)
    (p,) = rows(spark, Rules(**{**PLAIN.__dict__, "target_cap_pct": 10.0}), scores=[score(daily=0.10)])
    assert p.target - p.entry == pytest.approx(10.0) and p.reward_risk < 2.0


def test_names_below_the_floor_held_or_bearish_are_skipped(spark):
    assert reasons(spark, scores=[score(composite=0.001)]) == {"below_score": 1}
    assert reasons(spark, scores=[score(composite=-0.5)]) == {"bearish_unheld": 1}
    assert reasons(spark, scores=[score(composite=-0.05)], held=[("AAA", 5.0)]) == {"below_score": 1}
    one = Rules(**{**PLAIN.__dict__, "top": 1})
    both = [score("AAA", 0.6), score("BBB", 0.4)]
    assert [p.symbol for p in rows(spark, one, scores=both, held=[("AAA", 5.0)])] == ["BBB"]
    assert reasons(spark, one, scores=both[:1], held=[("AAA", 5.0)]) == {"already_held": 1}
    assert [p.symbol for p in rows(spark, held=[("AAA", 0.01)])] == ["AAA"]  # a dollar's worth is not held


def test_an_addition_fills_the_whole_position_up(spark):
    add = Rules(**{**PLAIN.__dict__, "add": True, "position_pct": 20.0})
    assert rows(spark, add, scores=[score(daily=0.01)], held=[("AAA", 15.0)])[0].notional == pytest.approx(500.0)


def test_slots_ties_and_trims(spark):
    scores = [score(s, 0.4) for s in "DCBA"] + [score("E", -0.3), score("F", 0.6)]
    got = rows(spark, scores=scores, held=[("E", 2.0)])
    assert [(p.symbol, p.side) for p in got] == [("F", "BUY"), ("A", "BUY"), ("B", "BUY"), ("E", "SELL")]
    assert (got[3].qty, got[3].stop, got[3].target) == (2.0, pytest.approx(106.0), pytest.approx(88.0))
    absolute = Rules(**{**PLAIN.__dict__, "relative": False})
    assert [p.symbol for p in rows(spark, absolute, scores=[score("A", 0.2), score("B", -0.5), score("C", 0.05)], held=[("B", 1.0)])] == ["B", "A"]
    assert reasons(spark, scores=scores, halted=True) == {"halted": 5, "bearish_unheld": 1}
    assert reasons(spark, scores=scores, blocked=True) == {"regime_blocked": 5, "bearish_unheld": 1}
    assert reasons(spark, scores=scores) == {"bearish_unheld": 1}  # a full slate is no reason


def test_exits_come_first_free_cash_and_are_not_bought_back(spark):
    exits = [(1, "X", 10.0, 50.0, 55.0, 90.0, -0.2, "stop"), (2, "DUST", 0.1, 20.0, None, None, None, "target"), (3, "GONE", 5.0, 10.0, None, None, None, "horizon"), (4, "LATE", 9.0, 9.0, None, None, None, "horizon")]
    given = dict(scores=[score("X", 0.9), score("DUST", 0.8), score("AAA", 0.5, daily=0.01)], held=[("X", 4.0), ("DUST", 0.1), ("LATE", 9.0)], signals=exits, cash=100.0)
    x, p = rows(spark, **given)
    assert (x.symbol, x.kind, x.qty, x.notional, x.stop, x.reward_risk, x.trigger) == ("X", "exit", 4.0, 200.0, 55.0, 0.0, "stop")
    assert p.symbol == "AAA" and p.notional == pytest.approx(100 + 0.99 * 200)
    assert reasons(spark, **given) == {"flagged_for_exit": 2}


def test_purchases_share_what_may_be_deployed(spark):
    three = [score(s, 0.5, daily=0.01) for s in "ABC"]
    assert [p.notional for p in rows(spark, scores=three)] == [pytest.approx(3000.0)] * 3
    assert [p.notional for p in rows(spark, scores=three, exposure=0.5)] == [pytest.approx(1500.0)] * 3
    assert [p.notional for p in rows(spark, scores=three, cash=600.0)] == [pytest.approx(200.0)] * 3
    assert rows(spark, scores=three, cash=30.0) == [] and rows(spark, scores=three, exposure=0.0) == []


@pytest.mark.parametrize("corr, heat", [(1.0, 200.0), (0.0, 141.4213562373), (-0.5, 100.0), (None, math.sqrt(2 * 100**2 * 1.8))])
def test_heat_scales_a_slate_of_the_same_bet(spark, corr, heat):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(40)]
    x, z = [math.sin(2 * math.pi * i / 8) for i in range(40)], [math.cos(2 * math.pi * i / 8) for i in range(40)]
    series = {"A": x, "B": x if corr is None else [corr * a + math.sqrt(1 - corr**2) * b for a, b in zip(x, z)]}
    given = [(s, list(zip(days, v if corr is not None else v[:14]))) for s, v in series.items()]
    got = rows(spark, Rules(**{**PLAIN.__dict__, "correlation_sizing": True, "heat_pct": 0.5}), scores=[score("A"), score("B", 0.4)], returns=given)
    assert [p.risk for p in got] == [pytest.approx(100 * 50 / heat)] * 2


def test_fills_stop_where_the_cash_ends(spark):
    made = slate(spark, scores=[score(s, 0.5, daily=0.01) for s in "ABC"], cash=900.0)
    got = executed(made).orderBy("rank").collect()
    assert [g.status for g in got] == ["FILLED", "FILLED", "REJECTED_INSUFFICIENT_CASH"]
    cost = 3.0 * 100 * 1.0006 * 1.004
    assert [g.cash for g in got] == [pytest.approx(900 - cost), pytest.approx(900 - 2 * cost), pytest.approx(900 - 2 * cost)]
    assert executed(slate(spark, cash=None)).count() == 0
