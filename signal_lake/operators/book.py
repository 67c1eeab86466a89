"""The book: trades, positions, exits, halts, risk."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import book_of

FILLED = ("FILLED", "PARTIALLY_FILLED", "SENT")
#: A remainder worth less than this is folded into the trade that left it.
DUST = 1.0


def fills(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(*FILLED) & (F.col("qty") > 0) & (F.col("price") > 0)).withColumn("book", book_of(F.col("mode")))


TRADE = "symbol string, book string, open_ts date, close_ts date, qty double, entry double, exit double, gross double, fees double"


#: Trades of a frame that the fold gives, at most.
PIECE = 10_000


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The trades of fills that come key by key and in order. Only the lots that are open are in memory, and a piece of the trades."""
    columns = [f.split()[0] for f in TRADE.split(", ")]
    key, lots, out = None, deque(), []

    def pieces(least: int) -> Iterator[pd.DataFrame]:
        nonlocal out
        while len(out) >= least and out:
            yield pd.DataFrame(out[:PIECE], columns=columns)
            out = out[PIECE:]

    def left_open() -> Iterator[pd.DataFrame]:
        while lots:
            held, price, ts, fee = lots.popleft()
            out.append((*key, ts, None, held, price, None, None, fee))
            yield from pieces(PIECE)

    for g in frames:
        for symbol, book, ts, side, qty, price, fee in zip(g["symbol"], g["book"], g["ts"], g["side"], g["qty"], g["price"], g["fee"]):
            if (symbol, book) != key:
                yield from left_open()
                key = (symbol, book)
            if side == "BUY":
                lots.append([qty, price, ts, fee])
                continue
            left = qty
            while left > 1e-12 and lots:
                lot = lots[0]
                take = min(left, lot[0])
                share = lot[3] * take / lot[0]
                fees = share + fee * take / qty
                lot[0] -= take
                lot[3] -= share
                left -= take
                if lot[0] <= 1e-12 or lot[0] * lot[1] < DUST:
                    fees += lot[3] if lot[0] > 1e-12 else 0.0
                    lots.popleft()
                out.append((symbol, book, lot[2], ts, take, lot[1], price, take * (price - lot[1]), fees))
        yield from pieces(PIECE)
    yield from left_open()
    yield from pieces(1)


def fifo_trades(log: DataFrame) -> DataFrame:
    """Round trips, first in first out, per symbol and book, in order of (ts, order_id); a sale beyond what is held is ignored, a lot left
    with under DUST goes with its trade, and lots still open have no close. The fold needs a key's fills in order, so Spark
    sorts them; a key is one symbol in one book."""
    cols = ["symbol", "book", "ts", "order_id", "side", "qty", "price", "fee"]
    dealt = fills(log).select(*cols).repartition("symbol", "book").sortWithinPartitions("symbol", "book", "ts", "order_id")
    return dealt.mapInPandas(_folded, TRADE)


def matched_lots(log: DataFrame) -> DataFrame:
    """The same matching without the dust rule, as a join: lots and sales take intervals of the cumulated quantity, and a sale
    meets the lots that its interval overlaps. Sales beyond what is held are cut by reflection. Intervals are spread over the
    cells of a grid, so the join is on (symbol, book, cell)."""
    o = Window.partitionBy("symbol", "book").orderBy("ts", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    s = fills(log).withColumn("__s", F.sum(signed).over(o)).withColumn("__short", F.greatest(F.lit(0.0), -F.min("__s").over(o)))
    before = F.coalesce(F.lag("__short").over(Window.partitionBy("symbol", "book").orderBy("ts", "order_id")), F.lit(0.0))
    q = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(F.col("qty") - (F.col("__short") - before))
    eff = s.withColumn("q", q).where("q > 0")
    side = Window.partitionBy("symbol", "book", "side").orderBy("ts", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = eff.withColumn("hi", F.sum("q").over(side)).withColumn("lo", F.col("hi") - F.col("q"))
    cell = 64.0
    spread = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    b, x = spread.where("side = 'BUY'").alias("b"), spread.where("side = 'SELL'").alias("x")
    lo, hi = F.greatest("b.lo", "x.lo"), F.least("b.hi", "x.hi")
    on = (F.col("b.symbol") == F.col("x.symbol")) & (F.col("b.book") == F.col("x.book")) & (F.col("b.cell") == F.col("x.cell")) & (lo < hi) & (F.floor(lo / cell) == F.col("b.cell"))
    return b.join(x, on).select("b.symbol", "b.book", F.col("b.ts").alias("open_ts"), F.col("x.ts").alias("close_ts"), (hi - lo).alias("qty"), F.col("b.price").alias("entry"), F.col("x.price").alias("exit"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Of closed trades with known result (book, gross, fees, hold_days): per book and for all. A mean over no trades is 0, and the profit factor
    where nothing was lost is infinite; the share of fees is NULL where the gross result is 0."""
    net = trades.where("gross is not null").withColumn("net", F.col("gross") - F.col("fees"))
    win, loss, none = F.col("net") > 0, F.col("net") <= 0, F.lit(0.0)
    g = net.rollup("book").agg(
        F.count("*").alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("net"))), none).alias("avg_win"), F.coalesce(F.avg(F.when(loss, F.col("net"))), none).alias("avg_loss"),
        F.coalesce(F.sum(F.when(win, F.col("net"))), none).alias("won"), F.coalesce(F.sum(F.when(loss, -F.col("net"))), none).alias("lost"), F.avg("net").alias("expectancy"), F.sum("net").alias("net"),
        F.sum("fees").alias("fees"), F.sum("gross").alias("gross"), F.avg("hold_days").alias("hold_days"),
    ).where("trades > 0")
    factor = F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).otherwise(F.lit(float("inf")))
    share = F.when(F.abs("gross") > 1e-9, 100 * F.col("fees") / F.abs("gross"))
    return g.select(F.coalesce("book", F.lit("all")).alias("book"), "trades", (100 * F.col("win_rate")).alias("win_pct"), "avg_win", "avg_loss", factor.alias("profit_factor"), "expectancy", "net", "fees", share.alias("fees_pct"), "hold_days")


def net_positions(log: DataFrame) -> DataFrame:
    return fills(log).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("net"))


def drift(local: DataFrame, held: DataFrame) -> DataFrame:
    """Local symbols (symbol, net) whose holdings (symbol, qty; none is 0) differ by over 1 %."""
    out = local.join(held, "symbol", "left").withColumn("qty", F.coalesce("qty", F.lit(0.0))).withColumn("diff", F.col("net") - F.col("qty"))
    return out.where(F.abs("diff") > F.greatest(F.lit(1e-8), 0.01 * F.abs("net")))


#: What closes a position, in the order in which it counts, and how reports call it. Fixed values.
TRIGGERS = {"stop": "stop loss", "target": "take profit", "trailing": "trailing stop", "horizon": "horizon expired", "reversal": "score reversed"}


def exits(holdings: DataFrame, target_pct: float = 100.0, trail: float = 8.0, armed: float = 3.0, days: float = 30.0, reversal: float = -0.15) -> DataFrame:
    """The trigger of each holding (price, entry, stop, target, high, held_days, score, any of them NULL where it is not known) and what else
    fired: stop, target, trailing (armed by a gain of 3 % from the entry, fired by giving back 8 % of the highest price, today's
    included), horizon (30 days), reversal (-0.15), in this order; with what share of the position is sold (a target may be
    partial) and the result in per cent."""
    high = F.greatest("high", "price")
    gain, back = (high / F.col("entry") - 1) * 100, (1 - F.col("price") / high) * 100
    fired = F.array_compact(F.array(
        F.when(F.col("price") <= F.col("stop"), "stop"),
        F.when(F.col("price") >= F.col("target"), "target"),
        F.when((gain >= armed) & (back >= trail), "trailing"),
        F.when(F.col("held_days") >= days, "horizon"),
        F.when(F.col("score") <= reversal, "reversal"),
    ))
    out = holdings.withColumn("__f", fired).where(F.size("__f") > 0).withColumn("trigger", F.col("__f")[0]).withColumn("also", F.array_join(F.slice("__f", 2, 5), ","))
    sold = F.when(F.col("trigger") == "target", F.lit(min(100.0, max(0.0, target_pct)))).otherwise(F.lit(100.0))
    return out.withColumn("sold_pct", sold).withColumn("pnl_pct", (F.col("price") / F.col("entry") - 1) * 100).drop("__f")


def described(fired: DataFrame) -> DataFrame:
    """exits() with a line that says why a position is closed: the trigger, what else fired, how long it was held, the result and the score,
    each where it is known."""
    label = F.create_map(*[F.lit(x) for kv in TRIGGERS.items() for x in kv])
    also = F.array_join(F.transform(F.split("also", ","), lambda t: F.element_at(label, t)), ", ")
    bits = F.array_compact(F.array(
        F.concat(F.lit("Close for: "), F.element_at(label, F.col("trigger")), F.lit(".")), F.when(F.col("also") != "", F.concat(F.lit("Besides: "), also, F.lit("."))), F.when(F.col("held_days").isNotNull(), F.concat(F.lit("Held "), F.format_number(F.col("held_days").cast("double"), 1), F.lit(" days."))),
        F.when(F.col("pnl_pct").isNotNull(), F.concat(F.lit("Open result "), F.when(F.col("pnl_pct") >= 0, "+").otherwise(""), F.format_number("pnl_pct", 1), F.lit(" per cent."))), F.when(F.col("score").isNotNull(), F.concat(F.lit("Score "), F.when(F.col("score") >= 0, "+").otherwise(""), F.format_number("score", 3), F.lit("."))),
        F.when(F.col("entry").isNull(), F.lit("Opened without terms.")), F.when(F.col("sold_pct") < 100, F.concat(F.lit("Sell "), F.format_number("sold_pct", 0), F.lit(" per cent of it."))),
    ))
    return fired.withColumn("why", F.array_join(bits, " "))


def halts(curve: DataFrame, drawdown: float = 15.0, loss: float = 8.0, days: int = 7, reset: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """For each mode of (mode, day, equity): the newest drawdown from the peak and loss against the last value at or before `days` ago (or
    else the oldest), and whether either trips (a limit of 0 never does). `live` points end the curves; what is before `reset` does not
    count, and a mode with fewer than two points then, or none above 0, is not judged."""
    curve = curve.unionByName(live) if live is not None else curve
    curve = curve.where("equity is not null")
    curve = curve.where(F.col("day") >= F.lit(reset).cast("date")) if reset else curve
    newest = curve.groupBy("mode").agg(
        F.max("day").alias("now"), F.max("equity").alias("peak"), F.max_by("equity", "day").alias("equity"), F.min_by("equity", "day").alias("oldest"), F.count("*").alias("n")
    ).where("n >= 2 and peak > 0")
    base = curve.join(F.broadcast(newest.select("mode", "now")), "mode").where(F.col("day") <= F.date_sub("now", days)).groupBy("mode").agg(F.max_by("equity", "day").alias("base"))  # one row a mode
    out = newest.join(base, "mode", "left").withColumn("base", F.coalesce("base", "oldest"))
    dd, wl = 100 * (F.col("equity") / F.col("peak") - 1), F.when(F.col("base") > 0, 100 * (F.col("equity") / F.col("base") - 1))
    trips = (F.lit(drawdown > 0) & (dd <= -drawdown)) | (F.lit(loss > 0) & F.coalesce(wl <= -loss, F.lit(False)))
    return out.select("mode", dd.alias("drawdown"), wl.alias("window_loss"), trips.alias("tripped"))


def regime(bars: DataFrame, n: int = 200, band: float = 0.02, fall: float = 0.25) -> DataFrame:
    """The state of each bar: off below the band under the mean or far under the 180-bar high, on above it while the mean rises, else neutral."""
    o = Window.partitionBy("symbol").orderBy("date")
    x = bars.withColumn("ma", F.when(F.count("close").over(o.rowsBetween(-(n - 1), 0)) >= max(5, n // 3), F.avg("close").over(o.rowsBetween(-(n - 1), 0))))
    x = x.withColumn("slope", F.col("ma") / F.lag("ma", 21).over(o) - 1).withColumn("dd", F.col("close") / F.max("close").over(o.rowsBetween(-179, 0)) - 1).withColumn("seen", F.row_number().over(o))
    state = F.when((F.col("seen") < 150) | F.col("ma").isNull(), "neutral").when((F.col("close") < F.col("ma") * (1 - band)) | (F.col("dd") <= -fall), "risk_off")
    state = state.when((F.col("close") > F.col("ma") * (1 + band)) & (F.col("slope") > 0), "risk_on").otherwise("neutral")
    return x.withColumn("state", state).drop("seen")
