"""The score families that are aggregates: social, sources, catalysts, dated events, positioning, ladders, macro quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import clip, rounded, tent


def social(mentions: DataFrame, recent_hours: float = 24, base_hours: float = 168, run: list[str] = []) -> DataFrame:
    """mentions (symbol, source, author, age in hours, span, sentiment, confidence, weight) of the last base_hours, scored for each run: how much
    the recent ones outpace the symbol's own older ones, the recent ones' tone net of each source's bias (shrunk under 30 mentions),
    their authors' diversity, and the product of all. `span` is the hours of posts that the run's window covers."""
    m = mentions.where((F.col("age") >= 0) & (F.col("age") <= base_hours))
    bias = m.groupBy(*run, "source").agg((F.avg("sentiment") * F.least(F.lit(1.0), F.count("*") / 30.0)).alias("__bias"))
    m = m.join(bias, [*run, "source"], "left").withColumn("s", clip(F.col("sentiment") - F.coalesce("__bias", F.lit(0.0))))
    new = F.col("age") <= recent_hours

    def late(x: Column) -> Column:
        return F.when(new, x)

    wc = F.col("weight") * F.col("confidence")
    g = m.groupBy(*run, "symbol").agg(
        F.count_if(new).alias("recent"), F.count_if(~new).alias("old"), F.max("span").alias("span"), F.sum(late(F.col("s") * wc)).alias("num"), F.sum(late(wc)).alias("den"),
        F.countDistinct(late(F.col("author"))).alias("authors"), F.count(late(F.col("author"))).alias("attributed"), F.coalesce(F.avg(late(F.col("confidence"))), F.lit(0.0)).alias("confidence"),
    )
    older = F.greatest(F.lit(1.0), F.least(F.col("span"), F.lit(float(base_hours))) - recent_hours)
    rr, br = F.col("recent") / max(1.0, recent_hours), F.col("old") / older
    velocity = F.when(F.col("old") > 0, F.log2((rr + 1e-9) / (br + 1e-9))).when(F.col("recent") >= 3, F.lit(0.5)).otherwise(F.lit(0.0))
    tone = F.when(F.col("den") > 0, F.try_divide(F.col("num"), F.col("den"))).otherwise(F.lit(0.0))
    diversity = F.when(F.col("attributed") > 0, F.least(F.lit(1.0), F.col("authors") / F.greatest(F.lit(3.0), 0.5 * F.col("attributed")))).otherwise(F.lit(0.0))
    out = g.withColumns({"velocity": velocity, "tone": tone, "diversity": diversity})
    score = F.tanh(F.greatest(F.lit(0.0), F.col("velocity")) / 2.0) * F.col("tone") * (0.4 + 0.6 * F.col("diversity")) * (0.3 + 0.7 * F.col("confidence"))
    return out.select(*run, "symbol", "recent", "velocity", "tone", "diversity", "confidence", clip(score).alias("social"))


def source_rank(posts: DataFrame, mentions: DataFrame, universe: int, cadence: float = 8.0, page: float = 100.0) -> DataFrame:
    """Value of each source: items a pass, share of posts that mention an asset, breadth and tone; rank 1 is best."""
    p = posts.groupBy("source").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span"))
    m = mentions.groupBy("source").agg(F.countDistinct("post_id").alias("hit"), F.countDistinct("symbol").alias("assets"), F.avg("confidence").alias("tone"))
    x = p.join(m, "source", "left").fillna(0, ["hit", "assets", "tone"])
    iph = F.when(F.col("span") <= 0.5, F.col("n").cast("double")).otherwise(F.try_divide(F.col("n").cast("double"), F.col("span")))
    value = F.least(F.lit(page), iph * cadence) * (F.col("hit") / F.col("n")) * (F.log1p("assets") / F.log1p(F.lit(max(universe, 2)))) * (0.4 + 0.6 * F.least("tone", F.lit(1.0)))
    out = x.withColumn("value", value)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.floor(F.col("value") * 1e6)), "source")))  # one row a source


def catalyst(events: DataFrame) -> DataFrame:
    """(symbol, impact, direction, event): tanh of the signed sum, the strongest event, and counts."""
    return events.groupBy("symbol").agg(
        F.tanh(F.sum(F.col("impact") * F.col("direction")) / 1.5).alias("score"), F.max_by("event", F.struct("impact", "event")).alias("top"), F.count_if(F.col("direction") > 0).alias("good"), F.count_if(F.col("direction") < 0).alias("bad")
    )


def dated_events(events: DataFrame) -> DataFrame:
    """(symbol, days, magnitude, direction, weight, event): tanh of the weighted sum under the tent, and the next event, or else the last."""
    x = events.withColumn("w", tent(F.col("days").cast("double"))).where("w is not null")
    nxt, past = F.min_by("event", F.when(F.col("days") >= 0, F.struct("days", "event"))), F.max_by("event", F.struct("days", "event"))
    return x.groupBy("symbol").agg(F.tanh(F.sum(F.col("direction") * F.col("magnitude") * F.col("w") * F.col("weight"))).alias("score"), F.coalesce(nxt, past).alias("nearest"), F.count("*").alias("n"))


def positioning(rates: DataFrame, periods: int = 100, least: int = 20, scale: float = 1.5) -> DataFrame:
    """(symbol, ts, rate): minus tanh of the z-score of the newest rate among its last `periods`; 0 with too few."""
    last = rates.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__n") <= periods)
    g = last.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("rate", "ts").alias("last"), F.avg("rate").alias("m"), F.stddev_pop("rate").alias("sd"))
    z = F.try_divide(F.col("last") - F.col("m"), F.col("sd"))
    return g.select("symbol", "n", z.alias("z"), F.when((F.col("n") < least) | F.col("sd").isNull() | (F.col("sd") == 0), F.lit(0.0)).otherwise(-F.tanh(z / scale)).alias("score"))


def ladder(quotes: DataFrame, spots: DataFrame) -> DataFrame:
    """quotes (symbol, strike, probability) and spots (symbol, spot): the probability at the spot, by line between the strikes round it,
    and 2 (p - 1/2); no opinion outside the strikes or with fewer than two."""
    q = quotes.groupBy("symbol", "strike").agg(F.avg("probability").alias("p")).join(spots, "symbol")
    low, high = F.when(F.col("strike") <= F.col("spot"), F.col("strike")), F.when(F.col("strike") >= F.col("spot"), F.col("strike"))
    g = q.groupBy("symbol").agg(F.count("*").alias("n"), F.first("spot").alias("spot"), F.max(low).alias("x0"), F.max_by("p", low).alias("p0"), F.min(high).alias("x1"), F.min_by("p", high).alias("p1"))
    p = F.when(F.col("x0") == F.col("x1"), F.col("p0")).otherwise(F.col("p0") + (F.col("p1") - F.col("p0")) * F.try_divide(F.col("spot") - F.col("x0"), F.col("x1") - F.col("x0")))
    ok = (F.col("n") >= 2) & F.col("x0").isNotNull() & F.col("x1").isNotNull()
    return g.select("symbol", F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("n_strikes"), F.when(ok, p).alias("p"), F.when(ok, 2 * (p - 0.5)).otherwise(F.lit(0.0)).alias("score"))


def macro(quotes: DataFrame) -> DataFrame:
    """quotes (series, fetched, probability, baseline, weight, direction and, if there is one, exclusive) of each series' newest fetch: the probability is the sum
    of exclusive outcomes, at most 1, else their mean; its excess over the baseline on the bad side (on either, without a
    direction), weighted, in -1..0, to four digits, and the weighted mean of all."""
    newest = quotes.withColumn("__m", F.max("fetched").over(Window.partitionBy("series"))).where("fetched = __m")
    exclusive = F.coalesce(F.col("exclusive"), F.lit(True)) if "exclusive" in quotes.columns else F.lit(True)
    per = newest.withColumn("__x", exclusive).groupBy("series").agg(
        F.when(F.bool_and("__x"), F.least(F.lit(1.0), F.sum("probability"))).otherwise(F.avg("probability")).alias("p"), F.first("baseline").alias("b"), F.first("weight").alias("w"), F.first("direction").alias("d"), F.count("*").alias("m")
    )
    bad, base = F.when(F.col("d") > 0, 1 - F.col("p")).otherwise(F.col("p")), F.when(F.col("d") > 0, 1 - F.col("b")).otherwise(F.col("b"))
    either = F.when(F.col("p") >= F.col("b"), (F.col("p") - F.col("b")) / (1 - F.col("b"))).otherwise((F.col("b") - F.col("p")) / F.col("b"))
    e = F.when(F.col("d") == 0, either).otherwise(F.greatest(F.lit(0.0), (bad - base) / (1 - base)))
    part = per.withColumn("c", rounded(-F.least(F.lit(1.0), e) * F.col("w")))
    return part.agg(F.count("*").alias("n"), F.sum("m").alias("markets"), clip(F.try_divide(F.sum("c"), F.sum("w")), -1.0, 0.0).alias("score"), F.min_by("series", F.struct("c", "series")).alias("top"), F.min("c").alias("worst"))


def composite(rows: DataFrame, weights: dict[str, float], blend: float = 0.3) -> DataFrame:
    """rows (technical_raw, xsec and the other families of `weights`; a missing one is 0) with technical, the composite and what each family
    contributes. Family scores count as they are kept, to four digits; the blend of technical_raw and xsec is rounded only where it is shown."""
    total = sum(weights.values())
    others = [f for f in weights if f != "technical"]
    x = rows.withColumns({f: rounded(F.coalesce(f, F.lit(0.0))) for f in others} | {"technical_raw": rounded("technical_raw")})
    tech = clip((1 - blend) * F.col("technical_raw") + blend * F.coalesce("xsec", F.lit(0.0)))
    parts = {f: weights[f] / total * (tech if f == "technical" else F.col(f)) for f in weights}
    shown = {f"w_{f}": rounded(p) for f, p in parts.items()} | {"composite": rounded(sum(parts.values())), "technical": rounded(tech), "xsec": rounded("xsec")}
    return x.withColumns(shown)


def slate(scores: DataFrame, equity: float = 10_000.0, risk: float = 0.01, most: float = 0.2, deployed: float = 0.6, top: int = 3, floor: float = 0.1, rr: float = 2.0, least: float = 15.0) -> DataFrame:
    """(run, symbol, composite, price, atr_pct): for each run the `top` best above the floor, with stop, target, quantity and
    notional; held to their share of equity, scaled together to what may be deployed, and left out under the least notional."""
    w = Window.partitionBy("run")
    ranked = scores.where(F.col("composite") >= floor).withColumn("rank", F.row_number().over(w.orderBy(F.desc("composite"), "symbol"))).where(F.col("rank") <= top)
    stop = F.least(F.greatest(1.5 * F.col("atr_pct") * F.sqrt(F.lit(10.0)), F.lit(0.03)), F.lit(0.40))
    x = ranked.withColumn("stop_d", stop * F.col("price")).withColumn("target_d", F.least(rr * F.col("stop_d"), 0.6 * F.col("price")))
    x = x.withColumn("notional", F.least(equity * risk / F.col("stop_d") * F.col("price"), F.lit(equity * most))).where(F.col("notional") >= least)
    scale = F.least(F.lit(1.0), F.lit(equity * deployed) / F.sum("notional").over(w))
    x = x.withColumn("notional", F.col("notional") * scale).where(F.col("notional") >= least)
    return x.select("run", "symbol", "rank", (F.col("price") - F.col("stop_d")).alias("stop"), (F.col("price") + F.col("target_d")).alias("target"), (F.col("notional") / F.col("price")).alias("qty"), "notional")
