"""Tone and headlines against what their rules give by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from signal_lake.functions import text as tx


def tone(total: float, hits: int) -> tuple[float, float]:
    return round(math.tanh(total / (2.5 * math.sqrt(hits))), 4), round(min(1.0, hits / 6), 4)


CASES = [
    (None, (0.0, 0.0)),
    ("", (0.0, 0.0)),
    ("nothing to see", (0.0, 0.0)),
    ("bullish", tone(2.0, 1)),
    ("not really bullish", tone(2.0 * -0.75 * 1.2, 1)),
    ("dont buy", tone(1.2 * -0.75, 1)),
    ("no one two three four buy", tone(1.2, 1)),
    ("very so bullish", tone(2.0 * 1.4, 1)),
    ("golden cross golden cross moon", tone(1.9 * 2 + 2.0, 3)),
    ("\U0001F680" * 6 + " dump", tone(2.0 * 4 - 1.7, 5)),
    ("\u26b0\ufe0f \U0001F4C9", tone(-1.7 - 1.4, 2)),
    ("see https://x.example/bullish/moon", (0.0, 0.0)),
    ("MOON " * 9, tone(2.0 * 9, 9)),
]


def test_tone(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: (r.s.polarity, r.s.confidence) for r in rows.select("i", tx.sentiment(F.col("text")).alias("s")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == pytest.approx(want, abs=1e-9), text


@pytest.mark.parametrize(
    "text, want",
    [
        ("Bridge drained of funds", ("exploit", 0.95, -1)),
        ("Spot ETF sees inflows", ("etf", 0.95, 1)),
        ("An ETF", ("etf", 0.4275, 1)),
        ("ETFs hit as price drops and falls", ("etf", 0.95, -1)),
        ("Rumor: mainnet in question", ("mainnet", 0.2625, 1)),
        ("Mainnet upgrade scheduled", ("mainnet", 0.9375, 1)),
        ("Testnet dump, crash and scam", ("testnet", 0.2975, -1)),
        ("Indicted by the court", ("lawsuit", 0.75, -1)),
        ("second sector", ("", 0.0, 0)),
    ],
)
def test_headlines(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").withColumn("tone", tx.sentiment(F.col("text"))).select(tx.classify(F.col("text"), F.col("tone")).alias("c")).first().c
    assert (row.event, row.direction) == (want[0], want[2])
    assert row.impact == pytest.approx(want[1], abs=1e-4)


AWKWARD = ["", "drained", "undrained", "drained_", "drained\n", "x drained", "\U0001F680drainedK", "exploited exploits", "exploit", "de-pegged depeg", "lost peg lost its peg", "suesd sues", "v2 launch v2.1\nlaunch", "list on listed on", "q4 2024 will", "hard  fork hardfork softforks", "secs sec", "in the coming weeks", "the", "The lathe", "no plans", "on january"]


def test_searches_by_literals_find_what_the_patterns_find(spark):
    rows = spark.createDataFrame([(t,) for t in AWKWARD], "t string")
    patterns = [e.pattern for e in tx.TAXONOMY] + [tx.word(tx.AHEAD, False), tx.word(tx.DENIED), "(^|[^a-z0-9])the([^a-z0-9]|$)", "(^|[^a-z])((a)?|b)([^a-z]|$)", "(^|[^a-z])a|sec([^a-z]|$)", "e+x", "(^|[^a-z])(\\w+)([^a-z]|$)"]
    for p in patterns:
        assert [tuple(r) for r in rows.select(F.col("t").rlike(p), tx.found(F.col("t"), p)).collect() if r[0] != r[1]] == [], p
    assert tx.starts("(list(ed|ing)? on|new listing|go[- ]live|buy ?back)") == ["list", "new listing", "go", "buy"]
    assert tx.starts("a|(b)?c") is None and tx.starts(".x") is None
