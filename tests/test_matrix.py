"""Pair matrices in cells against numpy, and the heat of slates against values worked out by hand."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest

from signal_lake.operators import matrix

DAY = datetime.date(2020, 1, 1)


def returns(symbols=11, days=400):
    r = random.Random(9)
    out = [(f"S{k:02d}", DAY + datetime.timedelta(days=t), r.gauss(0, 0.02) + 0.01 * math.sin(t / 9) * (k % 3)) for k in range(symbols) for t in range(days) if r.random() < (0.9 if k else 0.03)]
    return out + [("flat", DAY + datetime.timedelta(days=t), 0.0) for t in range(60)] + [("new", DAY + datetime.timedelta(days=days - 1), 0.5)]


@pytest.mark.parametrize("bands, days", [(1, 1000), (3, 50), (5, 7)])
def test_correlations_in_cells_equal_those_of_whole_series(spark, bands, days):
    data = returns()
    by: dict = {}
    for s, d, x in data:
        by.setdefault(s, {})[d] = x
    want = {}
    for a in by:
        for b in by:
            both = sorted(by[a].keys() & by[b].keys())
            if a < b and len(both) >= 15:
                x, y = np.array([by[a][d] for d in both]), np.array([by[b][d] for d in both])
                want[a, b] = (len(both), None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1])
    got = {(x.a, x.b): (x.n, x["corr"]) for x in matrix.correlations(spark.createDataFrame(data, "symbol string, date date, ret double").repartition(4), 15, bands, days).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == (None if want[k][1] is None else pytest.approx(want[k][1], abs=1e-9))


@pytest.mark.parametrize("corr, heat", [(1.0, 200.0), (0.0, math.sqrt(2e4)), (-0.5, 100.0), (None, math.sqrt(2 * 100**2 * 1.8))])
def test_heat_of_two_names(spark, corr, heat):
    risks = spark.createDataFrame([("A", 100.0), ("B", 100.0), ("C", 0.0), ("D", None)], "symbol string, risk double")
    known = spark.createDataFrame([("A", "B", corr), ("A", "C", 0.9)], "a string, b string, corr double")
    (got,) = matrix.heat(risks, known).collect()
    assert (got.names, got.gross) == (2, 200.0) and got.heat == pytest.approx(heat) and got.ratio == pytest.approx(heat / 200)


def test_slates_are_apart_and_one_name_is_its_own_heat(spark):
    risks = spark.createDataFrame([(1, "A", 30.0), (1, "B", 40.0), (2, "B", 7.0), (3, "A", 1.0), (3, "C", 1.0)], "run int, symbol string, risk double")
    known = spark.createDataFrame([("A", "B", 0.0)], "a string, b string, corr double")
    got = {x.run: (x.names, x.heat, x.ratio) for x in matrix.heat(risks, known, ["run"]).collect()}
    assert got == {1: (2, pytest.approx(50.0), pytest.approx(50 / 70)), 2: (1, 7.0, 1.0), 3: (2, pytest.approx(math.sqrt(3.6)), pytest.approx(math.sqrt(3.6) / 2))}


def test_returns_begin_with_the_second_day(spark):
    bars = spark.createDataFrame([("A", DAY, 100.0), ("A", DAY + datetime.timedelta(days=3), 110.0)], "symbol string, date date, close double")
    (got,) = matrix.daily_returns(bars).collect()
    assert got.ret == pytest.approx(0.1)
