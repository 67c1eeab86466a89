"""Point-in-time replay: at each step every symbol is scored from what could be seen then, and nothing else.

Times are seconds. A bar is seen once it has closed (its opening and its width are at or before the step) and if it opened
within the frame's look-back. Frames of any widths are dealt in the same way: time is cut into stretches of the look-back,
of which a step sees two, so steps meet bars on (symbol, stretch) and no bar is copied for each step. Indicators are
worked out inside each view, so exponential means begin anew in each: the key of all windows is (step, symbol), which is
also what the work is dealt by. Rates and posts are picked as of the step in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import clip, rounded
from signal_lake.operators import asof, book, families
from signal_lake.operators import indicators as ind

DAY = 86_400


@dataclass(frozen=True)
class Frame:
    """Bars of one width: how far a view of them reaches back, and the share of its bars that has to be there (0: any five)."""

    width: int
    lookback: int
    coverage: float = 0.5


#: A view with fewer bars than this is not scored, whatever its frame; nor is a step with fewer symbols. Fixed values.
LEAST_BARS, LEAST_SYMBOLS = 5, 3
#: What a regime lets a slate deploy. Fixed values.
EXPOSURE = {"risk_on": 1.0, "neutral": 0.5, "risk_off": 0.0}


def view(steps: DataFrame, bars: DataFrame, frame: Frame) -> DataFrame:
    """The bars (symbol, open, ...) that each step (step, symbol) sees, with `step`."""
    width = frame.lookback + 1
    until = F.floor(F.col("step") / width)
    both = steps.select("step", "symbol", F.explode(F.array(until - 1, until)).alias("__b")).join(bars.withColumn("__b", F.floor(F.col("open") / width)), ["symbol", "__b"])
    return both.where((F.col("open") + frame.width <= F.col("step")) & (F.col("open") >= F.col("step") - frame.lookback)).drop("__b")


def keyed(seen: DataFrame) -> DataFrame:
    """A view under one key of step and symbol, with `date` as the order, as indicators take it."""
    return seen.withColumn("symbol", F.concat_ws("|", F.col("step").cast("string"), "symbol")).drop("step").withColumnRenamed("open", "date")


def parted(df: DataFrame) -> DataFrame:
    """df with step and symbol again."""
    both = F.split("symbol", "[|]")
    return df.withColumn("step", both[0].cast("long")).withColumn("symbol", both[1])


def covered(frame: Frame, bars: Column) -> Column:
    return (bars >= LEAST_BARS) & (bars >= frame.coverage * (frame.lookback / frame.width))


def positioning_at(steps: DataFrame, rates: DataFrame, periods: int = 100, least: int = 20, scale: float = 1.5) -> DataFrame:
    """steps (step, symbol) with positioning, z and n from the last `periods` rates (symbol, open, rate) at or before the step: minus tanh
    of the newest one's z-score. NULL with fewer than `least`. Each rate is scored once, in one ordering, and steps pick one."""
    last = Window.partitionBy("symbol").orderBy("open").rowsBetween(-(periods - 1), 0)
    x = rates.withColumns({"n": F.count("rate").over(last), "__m": F.avg("rate").over(last), "__s": F.stddev_pop("rate").over(last)})
    z = F.when(F.col("__s") > 1e-12, (F.col("rate") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    x = x.select("symbol", "open", "n", F.when(F.col("n") >= least, z).alias("z")).withColumn("positioning", -F.tanh(F.col("z") / scale))
    return asof.asof_backward(steps.select("step", "symbol"), x, "symbol", "step", "open", ["positioning", "z", "n"]).drop("match_ts")


def regime_at(steps: DataFrame, bars: DataFrame, frame: Frame, lead: str) -> DataFrame:
    """step, regime_state, regime_scale: the lead's regime from its own view at each step; a step that can't see it has none."""
    seen = view(steps.select("step").distinct().withColumn("symbol", F.lit(lead)), bars.where(F.col("symbol") == lead).select("symbol", "open", "close"), frame)
    states = book.regime(keyed(seen)).groupBy("symbol").agg(F.max_by("state", "date").alias("regime_state"), F.count("*").alias("__n")).where(F.col("__n") >= LEAST_BARS)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in EXPOSURE.items() for x in kv]), F.col("regime_state"))
    return parted(states).select("step", "regime_state", scale.alias("regime_scale"))


def social_at(steps: DataFrame, posts: DataFrame, mentions: DataFrame, recent: int = DAY, base: int = 7 * DAY) -> DataFrame:
    """step, symbol, social: as families.social() would have scored the mentions (symbol, open, source, ...) before each step.

    NULL (no row) where the archive has fewer than two posts (open) in the window, or none that mention the symbol's step; a
    symbol without mentions at a step that is covered scores 0."""
    times = steps.select("step").distinct().withColumn("symbol", F.lit(""))
    frame = Frame(0, base, 0.0)
    counted = posts.groupBy("open").agg(F.count("*").alias("__c")).select(F.lit("").alias("symbol"), "open", "__c")
    archive = view(times, counted, frame).where("open < step").groupBy("step").agg(F.sum("__c").alias("__p"), ((F.max("open") - F.min("open")) / 3600).alias("span")).where(F.col("__p") >= 2)
    stretch = F.floor(F.col("step") / (base + 1))
    near = F.broadcast(times.join(archive.select("step", "span"), "step").select("step", "span", F.explode(F.array(stretch - 1, stretch)).alias("__b")))  # two rows a step
    seen = mentions.withColumn("__b", F.floor(F.col("open") / (base + 1))).join(near, "__b").where((F.col("open") < F.col("step")) & (F.col("open") >= F.col("step") - base)).drop("__b")
    aged = seen.withColumn("age", (F.col("step") - F.col("open")) / 3600)
    scored = families.social(aged, recent / 3600, base / 3600, ["step"]).select("step", "symbol", rounded("social").alias("social"))  # as a live score is kept
    return steps.select("step", "symbol").join(archive.select("step"), "step").join(scored, ["step", "symbol"], "left").fillna(0.0, ["social"])


def forward_at(steps: DataFrame, bars: DataFrame, width: int, days: int) -> DataFrame:
    """step, symbol, fwd: from the first close after the step to the first close `days` days after that one or later, by closing times."""
    closes = bars.select("symbol", (F.col("open") + width).alias("at"), "close")
    due = closes.withColumn("due", F.col("at") + days * DAY)
    exits = asof.asof_forward(due, closes.select("symbol", F.col("at").alias("__at"), F.col("close").alias("__exit")), "symbol", "due", "__at", ["__exit"]).select("symbol", "at", "close", "__exit")
    out = asof.asof_forward(steps.select("step", "symbol"), exits, "symbol", "step", "at", ["close", "__exit"], strict=True)
    return out.select("step", "symbol", F.when(F.col("close") > 0, F.col("__exit") / F.col("close") - 1).alias("fwd"))


def technical_at(steps: DataFrame, bars: dict[str, DataFrame], frames: dict[str, Frame], blend: float = 0.3) -> DataFrame:
    """step, symbol, technical_raw, xsec, technical (none rounded) and the parts, where all three views are there and a step has enough symbols."""
    snaps = {}
    for name in ("short", "medium"):
        snap = ind.snapshot(ind.enrich(keyed(view(steps, bars[name], frames[name]))))
        snaps[name] = snap.where(covered(frames[name], F.col("bars")))
    scored = parted(ind.technical_score(snaps["short"], snaps["medium"]).withColumnRenamed("technical", "technical_raw"))
    order = Window.partitionBy("step", "symbol").orderBy("open")
    daily = view(steps, bars["daily"].select("symbol", "open", "close"), frames["daily"])
    returns = daily.withColumns({f"ret_{n}b": F.coalesce(F.col("close") / F.lag("close", n).over(order) - 1, F.lit(0.0)) for n in (24, 72)})
    last = returns.groupBy("step", "symbol").agg(F.max_by(F.struct("ret_24b", "ret_72b"), "open").alias("l"), F.count("*").alias("__n")).where(covered(frames["daily"], F.col("__n"))).select("step", "symbol", "l.*")
    both = scored.join(last, ["step", "symbol"])
    enough = both.withColumn("__n", F.count("*").over(Window.partitionBy("step"))).where(F.col("__n") >= LEAST_SYMBOLS).drop("__n")
    return ind.cross_section(enough, ["step"]).withColumn("technical", clip((1 - blend) * F.col("technical_raw") + blend * F.col("xsec"))).drop("ret_24b", "ret_72b")


def panel(
    steps: DataFrame, bars: dict[str, DataFrame], frames: dict[str, Frame], rates: DataFrame, lead: str, horizons: tuple[int, ...] = (1, 7, 30),
    priced: str = "medium", posts: DataFrame | None = None, mentions: DataFrame | None = None, base: int = 7 * DAY, recent: int = DAY, weights: dict[str, float] | None = None,
) -> DataFrame:
    """One row a step and symbol: the families, the parts, the regime, what followed (by the closes of the frame `priced`), and, with an
    archive of posts, social and the composite with it. bars (symbol, open, close, high, low, volume) by frame: short, medium, daily. Only social is rounded."""
    w = weights or {"technical": 0.5, "positioning": 0.1, "social": 0.2}
    out = technical_at(steps, bars, frames).join(positioning_at(steps, rates).select("step", "symbol", "positioning"), ["step", "symbol"], "left")
    price = w["technical"] * F.col("technical") + w["positioning"] * F.coalesce("positioning", F.lit(0.0))
    out = out.withColumn("composite", price / (w["technical"] + w["positioning"]))
    if mentions is not None:
        out = out.join(social_at(steps, posts, mentions, recent, base), ["step", "symbol"], "left")
        out = out.withColumn("composite_social", (price + w["social"] * F.col("social")) / sum(w.values()))
    out = out.join(regime_at(steps, bars["daily"], frames["daily"], lead), "step", "left")
    for h in horizons:
        out = out.join(forward_at(steps, bars[priced], frames[priced].width, h).withColumnRenamed("fwd", f"fwd_{h}d"), ["step", "symbol"], "left")
    return out
