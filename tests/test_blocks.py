"""One long series in many tasks: blocks give what the whole series gives, and as-of joins in two phases what one pass gives."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from signal_lake.operators import asof, blocks
from signal_lake.operators import indicators as ind
from tests.conftest import rows

DAY = datetime.date(2000, 1, 1)


def bars(spark, sizes=(("A", 1500), ("B", 130), ("C", 3), ("D", 1))):
    r, out = random.Random(4), []
    for symbol, n in sizes:
        at, price = DAY, 100.0
        for _ in range(n):
            at += datetime.timedelta(days=r.choice([1, 1, 1, 2, 9]))
            price *= 1 + r.gauss(0, 0.02)
            out.append((symbol, at, price, price * (1 + r.random() / 50), price * (1 - r.random() / 50), float(r.randrange(1, 99))))
    return spark.createDataFrame(out, "symbol string, date date, close double, high double, low double, volume double")


def test_rows_are_numbered_over_stretches(spark):
    got = blocks.numbered(bars(spark), days=50).orderBy("symbol", "date").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "__i"))).alias("x")).collect()
    assert {g.symbol: [i for _, i in g.x] for g in got} == {"A": list(range(1500)), "B": list(range(130)), "C": [0, 1, 2], "D": [0]}


@pytest.mark.parametrize("name", ["bollinger", "donchian", "volume_z", "atr", "rsi", "macd", "keltner"])
def test_indicators_in_blocks_equal_those_of_the_series(spark, name):
    data, f = bars(spark), getattr(ind, name)
    whole = f(data)
    got = blocks.in_blocks(data, f, rows=800, halo=720, days=90).select(whole.columns)
    assert rows(whole.columns, got.collect()) == rows(whole.columns, whole.collect())


def test_one_key_takes_many_tasks(spark):
    got = blocks.in_blocks(bars(spark, [("A", 1500)]), lambda x: x.withColumn("first", F.lag("close", 30).over(ind.by_date())), rows=100, halo=50, days=30)
    assert got.where("first is null").count() == 30
    named = blocks.in_blocks(bars(spark, [("A", 1500)]), lambda x: x.withColumn("block", F.col("symbol.block")), rows=100, halo=50, days=30)
    sizes = {x.block: x["count"] for x in named.groupBy("block").count().collect()}
    assert sizes == dict.fromkeys(range(15), 100)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("kind", ["date", "timestamp", "bigint"])
def test_as_of_in_two_phases(spark, ahead, strict, kind):
    r = random.Random(7)
    cast = (lambda c: F.unix_date(c).cast("long") * 86400) if kind == "bigint" else (lambda c: c.cast(kind))
    at = lambda: DAY + datetime.timedelta(days=r.randrange(4000))
    left = spark.createDataFrame([(r.choice("AABC"), at(), i) for i in range(400)] + [("Z", DAY, -1), ("A", None, -2)], "k string, t date, i int").withColumn("t", cast(F.col("t")))
    right = {(k, d): v for k, d, v in ((r.choice("AAABD"), at(), float(i)) for i in range(150))}
    right = spark.createDataFrame([(k, d, v) for (k, d), v in right.items()] + [("B", DAY + datetime.timedelta(days=10), None)], "k string, u date, v double").withColumn("u", cast(F.col("u")))
    join = asof.asof_forward if ahead else asof.asof_backward
    one, two = (join(left, right, "k", "t", "u", ["v"], strict=strict, days=days).where("t is not null") for days in (None, 60))
    assert one.where("v is not null").count() > 100
    assert rows(one.columns, two.collect()) == rows(one.columns, one.collect())


def test_forward_returns_in_two_phases(spark):
    data = bars(spark)
    scores = data.select("symbol", F.date_add("date", 1).alias("run")).where("dayofmonth(run) % 3 = 0")
    one, two = (asof.forward_returns(scores, data, 7, stretch=s) for s in (None, 45))
    assert rows(one.columns, two.collect()) == rows(one.columns, one.collect())
