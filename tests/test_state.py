"""Keyed streaming state over several batches, late rows and restarts, against a plain fold over all rows in order."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signal_lake.streaming import state, streams

START = datetime.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, id long, value double, side string, qty double, price double"
HOUR = 3_600_000


def batches():
    """Rows of three symbols over 20 days in four files; within a file and between files some come up to 20 hours late."""
    r, rows = random.Random(6), []
    for i in range(240):
        at = START + datetime.timedelta(hours=2 * i, milliseconds=r.randrange(1000))
        rows.append((r.choice("AABC"), at, i, r.gauss(0, 30), r.choice(["BUY", "BUY", "SELL"]), float(r.randrange(1, 6)), 100 + 20 * r.random()))
    rows.append((rows[-1][0], rows[-1][1], 999, 5.0, "BUY", 1.0, 50.0))  # a tie in time
    late = sorted(rows, key=lambda x: x[1] + datetime.timedelta(hours=r.choice([0, 0, 0, 10, 20])))
    return [late[k : k + 61] for k in range(0, len(late), 61)]


def millis(at):
    return int((at - datetime.datetime(1970, 1, 1)).total_seconds() * 1000 + 0.5)


def streamed(spark, folder, processor, parts):
    """All that the processor gives: one file a run, each run begun anew from the checkpoint of the one before."""
    state.rocks(spark)
    out = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        sink = lambda batch, number: out.extend((k, number, *x) for x in batch.collect())  # noqa: B023, E731  each run has its own
        query = state.kept(rows, processor()).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def due(parts):
    rows = [x for p in parts for x in p]
    until = max(millis(x[1]) for x in rows) - 24 * HOUR
    return sorted((x for x in rows if millis(x[1]) <= until), key=lambda x: (x[0], millis(x[1]), str(x[2]))), until


def test_positions_do_not_depend_on_batches(spark, tmp_path):
    parts = batches()
    got = streamed(spark, tmp_path, state.Positions, parts)
    want, held = [], {}
    for symbol, ts, i, _, side, qty, price in due(parts)[0]:
        q, avg, opened, entry, high = held.get(symbol, (0.0, 0.0, 0, 0.0, 0.0))
        if side == "BUY":
            opened, high = (millis(ts), price) if q == 0 else (opened, max(high, price))
            avg, q, entry = (q * avg + qty * price) / (q + qty), q + qty, price
        else:
            q = max(0.0, q - qty)
            avg, opened, entry, high = (avg, opened, entry, max(high, price)) if q else (0.0, 0, 0.0, 0.0)
        held[symbol] = (q, avg, opened, entry, high)
        want.append((symbol, millis(ts), str(i), *held[symbol]))
    shown = sorted(x[2:] for x in got)
    assert [x[:4] for x in shown] == [x[:4] for x in sorted(want)] and len({x[0] for x in got}) > 2
    for a, b in zip(shown, sorted(want)):
        assert a[4:] == pytest.approx(b[4:])


def test_halts_trip_and_come_back_across_restarts(spark, tmp_path):
    parts = batches()
    got = streamed(spark, tmp_path, lambda: state.Halts(1000.0, 15.0, 8.0, 3), parts)
    want, curves = [], {}
    for symbol, ts, *_, value in [(x[0], x[1], x[3]) for x in due(parts)[0]]:
        curve = curves.setdefault(symbol, [])
        curve.append((millis(ts), (curve[-1][1] if curve else 1000.0) + value, False))
        at, equity, _ = curve[-1]
        by_time = dict((t, e) for t, e, _ in curve)
        old = [t for t in by_time if t <= at - 72 * HOUR]
        base = by_time[max(old)] if old else by_time[min(by_time)]
        trip = equity / max(e for _, e, _ in curve) - 1 <= -0.15 or equity / base - 1 <= -0.08
        curve[-1] = (at, equity, trip)
        want.append((symbol, at, round(equity, 6), trip, trip != (curve[-2][2] if len(curve) > 1 else False)))
    shown = sorted((x[2], x[3], round(x[4], 6), x[7], x[8]) for x in got)
    assert shown == sorted(want) and sum(x[4] for x in want) > 3


def test_closes_freeze_when_their_day_is_over(spark, tmp_path):
    parts = batches()
    got = streamed(spark, tmp_path, state.Closes, parts)
    rows, until = [x for p in parts for x in p], due(parts)[1]
    want = {}
    for symbol, ts, i, value, *_ in sorted(rows, key=lambda x: (millis(x[1]), str(x[2]))):
        want[symbol, millis(ts) // (24 * HOUR)] = value
    final = {(x[2], x[3]): x[4] for x in got if x[5]}
    assert final == {k: v for k, v in want.items() if (k[1] + 1) * 24 * HOUR <= until}
    assert len([x for x in got if x[5]]) == len(final)  # frozen once
    newest = {}
    for run, number, symbol, day, close, is_final in sorted(got):
        newest[symbol, day] = close
    assert newest == want  # what is not final yet is the newest value
    order = [(x[2], x[3], x[5]) for x in sorted(got, key=lambda x: x[:2])]
    for key in final:
        assert [f for *k, f in order if tuple(k) == key][-1]  # nothing after the final one


def test_high_water_tells_when_it_is_crossed(spark, tmp_path):
    for k, values in enumerate([[100.0, 90.0], [80.0], [70.0], [99.0], [60.0]]):
        rows = [("A", START + datetime.timedelta(hours=k, minutes=i), k, v, "", 0.0, 0.0) for i, v in enumerate(values)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = []
    for k in range(5):
        spark.read.parquet(f"{tmp_path}/in{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
        ticks = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/all")
        sink = lambda batch, number: out.extend(batch.select("drawdown", "crossed").collect())
        streams.high_water(ticks).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    assert [x.crossed for x in out] == [False, True, False, False, True]


def test_sessions_velocity_and_merge(spark, tmp_path):
    rows = [("A", START + datetime.timedelta(hours=h), i, 1.0, "", 0.0, 0.0) for i, h in enumerate([0, 1, 2, 5, 30, 31])]
    data = spark.createDataFrame(rows, SCHEMA).withColumn("author", F.lit("x"))
    got = streams.sessions(data).orderBy("start").collect()
    assert [(x.n, (x.end - x.start).total_seconds() / 3600) for x in got] == [(3, 4.0), (1, 2.0), (2, 3.0)]
    week = {x.until: (x.n, x.recent) for x in streams.velocity(data).collect()}
    assert week[START + datetime.timedelta(days=1)] == (4, 4) and week[START + datetime.timedelta(days=2)] == (6, 2) and week[START + datetime.timedelta(days=8)] == (2, 0)
    keep = lambda old, new: old.unionByName(new).groupBy("symbol").agg(F.sum("value").alias("value"))
    sink = streams.merge_into(str(tmp_path / "m"), keep)
    for number in (0, 1, 1):  # a batch that is run again writes the same
        sink(data.select("symbol", "value"), number)
    assert [x.value for x in spark.read.parquet(f"{tmp_path}/m/1").collect()] == [12.0]


class _Map(dict):
    """A map or a value of the state store, which counts what is asked of it."""

    calls = 0

    def updateValue(self, k, v):  # noqa: N802  Spark's names
        self.calls += 1
        self[k] = v

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self[k]

    def removeKey(self, k):  # noqa: N802
        self.calls += 1
        del self[k]

    def exists(self):
        return 0 in self

    def update(self, v):
        self[0] = v

    def get(self, k=0):
        return self[k]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, _Map())

    getValueState = getMapState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def _fed(processor, rows, until):
    """What the processor gives of rows in two parts, the watermark moving in three steps; and its handle."""
    handle, out = _Handle(), []
    processor.init(handle)
    for part in (rows[::2], rows[1::2]):
        processor.handleInputRows(("A",), iter([pd.DataFrame(part)]), None)
    for at in until:
        for frame in processor.handleExpiredTimer(("A",), _Watermark(at), None):
            out += frame.itertuples(index=False, name=None)
    return out, handle


def test_calls_to_the_store_grow_with_hours_not_rows():
    rows = [{"at": i * 1000, "id": str(i), "side": "BUY", "qty": 1.0, "price": float(i % 7)} for i in range(20_000)]
    out, handle = _fed(state.Positions(), rows, [HOUR + 500, 3 * HOUR, 20 * HOUR])
    assert [x[2] for x in out] == [str(i) for i in range(20_000)] and out[-1][3] == 20_000
    assert handle.states["waiting"].calls < 100 and not handle.states["waiting"]


def test_window_of_halts_is_kept_by_the_hour():
    r = random.Random(4)
    rows = [{"at": i * 60_000 + r.randrange(3) * 20_000, "id": f"{i:06d}", "value": r.gauss(0, 5)} for i in range(6000)]
    rows += [dict(rows[-1], id="999999", value=3.0)]
    out, handle = _fed(state.Halts(1000.0, 10.0, 5.0, 1), rows, [40 * HOUR + 7, 41 * HOUR, 10_000 * HOUR])
    values, equity = [], 1000.0
    for x, row in zip(out, sorted(rows, key=lambda x: (x["at"], x["id"]))):
        equity += row["value"]
        values = [v for v in values if v[0] != row["at"]] + [(row["at"], equity)]
        before = [v for v in values if v[0] <= row["at"] - state.DAY_MS]
        values = values[max(0, len(before) - 1) :]
        assert x[1:3] == (row["at"], equity) and x[4] == 100 * (equity / values[0][1] - 1)
    assert len(out) == len(rows) and handle.states["window"].calls < 1000 and len(handle.states["window"]) < 30
