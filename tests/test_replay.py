"""The replay: nothing after a step changes its scores, bars that have not closed are not seen, thin views are left out, and plug-ins may fail."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from signal_lake.operators import replay, signals
from signal_lake.operators.replay import DAY, Frame
from signal_lake.plans import catalogue

FRAMES = {"short": Frame(DAY // 4, 20 * DAY, 0.5), "medium": Frame(DAY, 60 * DAY, 0.5), "daily": Frame(2 * DAY, 240 * DAY, 0.0)}
SYMBOLS, DAYS = ("A", "B", "C", "D"), 200
NOW = 150 * DAY + 46800
SEEN = ["technical_raw", "xsec", "technical", "positioning", "composite", "social", "composite_social", "regime_state", "regime_scale", "trend", "momentum"]


def series(width: int, late: float = 1.0, gap=()):
    """Random walks; closes after NOW are multiplied by `late`, and one symbol has no bars in a stretch."""
    out = []
    for k, s in enumerate(SYMBOLS):
        r, price = random.Random(10 * k + width), 100.0
        for at in range(0, DAYS * DAY, width):
            price *= 1 + r.gauss(0, 0.01)
            shown = price * (late if at + width > NOW else 1.0)
            if not (s in gap and NOW - 18 * DAY < at <= NOW):
                out.append((s, at, shown, shown * 1.01, shown * 0.99, 1000.0 * r.random()))
    return out


def made(spark, late: float = 1.0, gap=()):
    bars = {n: spark.createDataFrame(series(f.width, late, gap), "symbol string, open long, close double, high double, low double, volume double") for n, f in FRAMES.items()}
    rates = [(s, at, 1e-4 * math.sin(at / DAY + k) * (late if at > NOW else 1.0)) for k, s in enumerate(SYMBOLS) for at in range(0, DAYS * DAY, DAY // 3)]
    r = random.Random(3)
    mentions = [(r.choice(SYMBOLS), at, "s", str(r.randrange(40)), r.uniform(-1, 1) * (late if at >= NOW else 1.0), r.random(), 1.0) for at in range(0, DAYS * DAY, 3600 * 5)]
    steps = spark.createDataFrame([(s, NOW + k * DAY) for s in SYMBOLS for k in (-30, 0, 20)], "symbol string, step long")
    m = spark.createDataFrame(mentions, "symbol string, open long, source string, author string, sentiment double, confidence double, weight double")
    return replay.panel(steps, bars, FRAMES, spark.createDataFrame(rates, "symbol string, open long, rate double"), "A", (1, 7), "medium", m.select("open"), m)


def test_what_comes_after_a_step_changes_its_returns_alone(spark):
    plain, moved = ({(x.step, x.symbol): x for x in made(spark, late).collect()} for late in (1.0, 3.0))
    assert len(plain) == 12 and plain.keys() == moved.keys()
    for key, x in plain.items():
        if key[0] <= NOW:
            assert [x[c] for c in SEEN] == [moved[key][c] for c in SEEN]
    later = [k for k in plain if k[0] > NOW]
    assert any(plain[k].positioning != moved[k].positioning for k in later) and any(plain[k].social != moved[k].social for k in later)
    at = [k for k in plain if k[0] == NOW]
    assert all(plain[k].fwd_1d is not None for k in at)
    before = [k for k in plain if k[0] < NOW]
    assert all(plain[k].fwd_7d == moved[k].fwd_7d for k in before)


def test_a_thin_view_leaves_its_symbol_out(spark):
    got = {(x.step, x.symbol) for x in made(spark, gap=("D",)).select("step", "symbol").collect()}
    assert (NOW, "D") not in got and (NOW, "C") in got and (NOW - 30 * DAY, "D") in got


def test_a_bar_is_seen_once_it_has_closed(spark):
    bars = spark.createDataFrame([("A", at, float(at)) for at in range(0, 20 * DAY, DAY)], "symbol string, open long, close double")
    steps = spark.createDataFrame([("A", 10 * DAY + 5), ("A", 10 * DAY)], "symbol string, step long")
    got = replay.view(steps, bars, Frame(DAY, 3 * DAY)).groupBy("step").agg({"open": "min", "close": "max", "*": "count"}).collect()
    assert {(x.step, x["min(open)"], x["max(close)"], x["count(1)"]) for x in got} == {(10 * DAY, 7 * DAY, 9.0 * DAY, 3), (10 * DAY + 5, 8 * DAY, 9.0 * DAY, 2)}


def test_positioning_needs_enough_rates(spark):
    rates = spark.createDataFrame([("A", k, float(k % 7)) for k in range(130)] + [("B", k, 1.0) for k in range(40)], "symbol string, open long, rate double")
    steps = spark.createDataFrame([("A", 18), ("A", 19), ("A", 129), ("B", 39), ("C", 5)], "symbol string, step long")
    got = {(x.symbol, x.step): x.positioning for x in replay.positioning_at(steps, rates).collect()}
    last = np.array([k % 7 for k in range(30, 130)], float)
    assert got["A", 18] is None and got["C", 5] is None and got["B", 39] == 0.0
    assert got["A", 129] == pytest.approx(-math.tanh((last[-1] - last.mean()) / last.std() / 1.5))


@pytest.mark.parametrize("name", ["replay_panel", "replay_report", "signal_lab"])
def test_order_lines_are_read_once(spark, sf_dir, name):
    """Views, steps and returns share the days' bars: no branch of the plan goes back to the order lines."""
    assert not [f for f in catalogue.QUERIES[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_posts_of_one_time_all_count(spark):
    m = spark.createDataFrame([("A", DAY, "s", "a", 0.5, 0.5, 1.0)], "symbol string, open long, source string, author string, sentiment double, confidence double, weight double")
    steps = spark.createDataFrame([("A", DAY + 60)], "symbol string, step long")
    one = m.select("open")
    assert replay.social_at(steps, one.union(one), m).count() == 1 and replay.social_at(steps, one, m).count() == 0


def test_a_spike_of_chatter_scores_from_when_it_came(spark):
    hourly = [("BTC", h * 3600, "s", f"a{h % 20}", 0.4, 0.8, 1.0) for h in range(24 * 8)]
    spike = [("SOL", 24 * 7 * 3600 + 60 * k, "s", f"b{k}", 0.9, 0.9, 1.0) for k in range(60)] + [("SOL", h * 3600, "s", "c", 0.1, 0.5, 1.0) for h in range(0, 24 * 7, 24)]
    m = spark.createDataFrame(hourly + spike, "symbol string, open long, source string, author string, sentiment double, confidence double, weight double")
    steps = spark.createDataFrame([(s, t * 3600) for s in ("SOL", "BTC", "ETH") for t in (24 * 7, 24 * 8, 24 * 40)], "symbol string, step long")
    got = {(x.symbol, x.step // 3600): x.social for x in replay.social_at(steps, m.select("open"), m).collect()}
    assert got["SOL", 192] > 0 and got["SOL", 168] < got["SOL", 192] and got["ETH", 192] == 0.0
    assert ("SOL", 24 * 40) not in got  # the archive does not reach there


def test_built_in_signals(spark):
    close = pd.Series(np.linspace(100, 110, 48))
    at = signals.Context("A", 0, {"medium": pd.DataFrame({"close": close}), "daily": pd.DataFrame({"close": close[:9]})}, np.array([1.0, 2.0]))
    assert signals.reversal_1d(at) == pytest.approx(-(110 / close.iloc[-25] - 1))
    assert signals.reversal_3d(at) == pytest.approx(-(close[8] / close[5] - 1))
    assert math.isnan(signals.momentum_30d(at)) and math.isnan(signals.low_vol(at)) and math.isnan(signals.funding_level(at))


def test_specs_of_signals():
    assert signals.resolve(None) == signals.resolve("builtin") == signals.BUILTIN and signals.resolve("none") == signals.resolve("") == {}
    assert signals.resolve("x=low_vol, math:sqrt, y = math:exp") == {"x": signals.low_vol, "sqrt": math.sqrt, "y": math.exp}
    for wrong in ("nothing", "math:pi"):
        with pytest.raises(ValueError):
            signals.resolve(wrong)


def test_plug_ins_that_fail_have_no_opinion(spark):
    bars = spark.createDataFrame([("A", t, 5, 1.0 + t, 1.0, 1.0, 1.0) for t in range(5)] + [("B", 1, 5, 7.0, 1.0, 1.0, 1.0)], "symbol string, open long, step long, close double, high double, low double, volume double")
    rates = spark.createDataFrame([("A", 2, 5, 0.5), ("A", 1, 5, 0.25), ("Z", 1, 5, 1.0)], "symbol string, open long, step long, rate double")
    plugins = {"bars": lambda c: len(c.frames["daily"]), "rate": lambda c: c.rates[-1], "none": lambda c: float("inf"), "order": lambda c: c.frames["daily"]["close"].iloc[-1]}
    got = {x.symbol: tuple(x)[2:] for x in signals.lab({"daily": bars}, rates, plugins).collect()}
    assert got == {"A": (5.0, 0.5, None, 5.0), "B": (1.0, None, None, 7.0)}
