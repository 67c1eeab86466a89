"""The simulation against cases worked out by hand, and against a plain loop over random scores."""

from __future__ import annotations

import datetime
import math
import random
import statistics

import pytest

from signal_lake.operators.simulation import Strategy, habits, simulate
from signal_lake.operators.simulation import statistics as stats

DAY = datetime.date(2024, 1, 1)
SCHEMA = "run date, symbol string, composite double, other double, fwd double, regime_state string, regime_scale double"


def rows(*periods, state=None):
    """One dict a run: symbol to (score, return)."""
    scale = {"risk_on": 1.0, "neutral": 0.5, "risk_off": 0.0}
    out = []
    for i, names in enumerate(periods):
        s = state[i] if state else None
        out += [(DAY + datetime.timedelta(days=i), symbol, score, score, fwd, s, scale.get(s)) for symbol, (score, fwd) in names.items()]
    return out


def run(spark, data, *strategies, every=1):
    got = simulate(spark.createDataFrame(data, SCHEMA).repartition(3), list(strategies), "fwd", every, "BTC")
    out: dict = {}
    for x in got.orderBy("strategy", "run").collect():
        out.setdefault(x.strategy, []).append(x)
    return out if len(strategies) > 1 else out.get(strategies[0].name, [])


def names(periods):
    return ["".join(p.symbol for p in x.picks) for x in periods]


def test_costs_are_paid_on_what_changes(spark):
    got = run(spark, rows(*[{"BTC": (0.9, 0.01), "X": (0.1, 0.0)}] * 3), Strategy("s", top=1, cost_bps=50.0))
    assert [x.turnover for x in got] == [1.0, 0.0, 0.0] and got[0].cost == pytest.approx(0.005) and got[1].net == pytest.approx(0.01)


def test_an_empty_slot_is_cash_and_the_floor_is_not_enough(spark):
    (got,) = run(spark, rows({"X": (0.5, 0.10), "BTC": (0.03, 0.05), "Y": (None, 9.0)}), Strategy("s", top=2, floor=0.03))
    assert (got.gross, got.basket, got.lead, got.exposure) == (pytest.approx(0.05), pytest.approx(0.075), pytest.approx(0.05), 0.5)


def test_the_gate_scales_what_is_held(spark):
    data = rows(*[{"A": (0.9, 0.10)}] * 4, state=["risk_on", "neutral", "risk_off", None])
    got = run(spark, data, Strategy("g", top=1, gated=True, cost_bps=0.0), Strategy("p", top=1, cost_bps=0.0))
    assert [x.exposure for x in got["g"]] == [1.0, 0.5, 0.0, 1.0] and [x.gross for x in got["g"]] == pytest.approx([0.10, 0.05, 0.0, 0.10])
    assert [x.state for x in got["g"]] == ["risk_on", "neutral", "risk_off", None] and [x.state for x in got["p"]] == [None] * 4


def test_a_buffer_keeps_what_still_ranks(spark):
    moves = rows({"A": (0.9, 0.0), "B": (0.1, 0.0)}, {"A": (0.5, 0.0), "B": (0.6, 0.0)}, {"A": (0.5, 0.0), "B": (0.6, 0.0)})
    got = run(spark, moves, Strategy("plain", top=1), Strategy("buffer", top=1, buffer=1))
    assert names(got["plain"]) == ["A", "B", "B"] and names(got["buffer"]) == ["A", "A", "A"]
    falls = rows({"A": (0.9, 0.0), "B": (0.2, 0.0), "C": (0.1, 0.0)}, {"A": (0.1, 0.0), "B": (0.9, 0.0), "C": (0.5, 0.0)})
    assert names(run(spark, falls, Strategy("buffer", top=1, buffer=1))) == ["A", "B"]


def test_the_floor_counts_for_the_composite_alone(spark):
    data = rows({"A": (-0.5, 0.1), "B": (-0.6, 0.2)})
    got = run(spark, data, Strategy("c", top=1), Strategy("o", "other", top=1))
    assert names(got["c"]) == [""] and names(got["o"]) == ["A"]


def loop(data, s, every):
    """The same by definition, run after run."""
    runs = sorted({r[0] for r in data if r[4] is not None})[::every]
    held, out = {}, []
    for day in runs:
        score = 2 if s.score == "composite" else 3
        g = [r for r in data if r[0] == day and r[4] is not None and r[score] is not None]
        if not g:
            continue
        floor = s.floor if s.score == "composite" else -math.inf
        ranked = [r[1] for r in sorted(g, key=lambda r: (-r[score], r[1])) if r[score] > floor]
        keep = [x for x in ranked[: s.top + s.buffer] if x in held][: s.top] if s.buffer and held else []
        picks = keep + [x for x in ranked if x not in keep][: s.top - len(keep)]
        scale = 1.0 if not s.gated or g[0][6] is None else 0.0 if g[0][5] == "risk_off" else g[0][6]
        now = dict.fromkeys(picks, scale / s.top)
        turnover = sum(abs(now.get(x, 0.0) - held.get(x, 0.0)) for x in {*now, *held})
        fwd = {r[1]: r[4] for r in g}
        gross = sum(w * fwd[x] for x, w in now.items())
        out.append((day, sorted(picks), gross, turnover, gross - turnover * s.cost_bps / 1e4, sum(now.values()), sum(fwd.values()) / len(fwd), fwd.get("BTC")))
        held = now
    return out


def test_strategies_equal_a_loop_over_runs(spark):
    r = random.Random(2)
    states = [r.choice(["risk_on", "neutral", "risk_off", None]) for _ in range(60)]
    data = rows(*[{s: (r.choice([None, round(r.uniform(-0.3, 1), 1)]), r.choice([None, r.gauss(0, 0.1)])) for s in ["BTC", *"ABCDEFGH"] if r.random() < 0.8} for _ in range(60)], state=states)
    plans = [Strategy(f"{score}-{buffer}-{gated}", score, 3, 0.2, buffer, gated, 30.0) for score in ("composite", "other") for buffer in (0, 1, 4) for gated in (False, True)]
    got = run(spark, data, *plans, every=2)
    for s in plans:
        want = loop(data, s, 2)
        assert [x.run.date() for x in got[s.name]] == [w[0] for w in want]
        for x, w in zip(got[s.name], want):
            assert sorted(p.symbol for p in x.picks) == w[1]
            assert [x.gross, x.turnover, x.net, x.exposure, x.basket] == pytest.approx(list(w[2:7])) and x.lead == w[7]


def test_statistics_and_habits_of_periods(spark):
    data = rows(*[{"A": (0.9, f), "BTC": (0.0, None)} for f in (0.10, -0.20, 0.05, 0.02)])
    made = simulate(spark.createDataFrame(data, SCHEMA), [Strategy("s", top=1, cost_bps=0.0)], "fwd", 1, "BTC")
    got = {x.leg: x for x in stats(made, 7).collect()}
    value = 1.1 * 0.8 * 1.05 * 1.02
    fwd = [0.10, -0.20, 0.05, 0.02]
    assert set(got) == {"net", "gross", "basket"}  # the lead has no returns
    assert (got["net"].total, got["net"].max_drawdown) == (pytest.approx(100 * (value - 1)), pytest.approx(-20.0))
    assert got["net"].cagr == pytest.approx(100 * (value ** (365 / 7 / 4) - 1))
    assert got["net"].sharpe == pytest.approx(statistics.mean(fwd) / statistics.stdev(fwd) * math.sqrt(365 / 7))
    (h,) = habits(made).collect()
    assert (h.exposure, h.turnover, h.fee_drag, h.beat_basket) == (1.0, 0.25, 0.0, 0.0)
