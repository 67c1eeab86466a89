"""The top-N simulation for many strategies at once, with a rank buffer, a regime gate and statistics.

What is held depends on what was held before, so each strategy is a fold over its periods; strategies are independent rows
of one plan. Before the fold every run is cut to the candidates that its strategy could hold (the top N and the buffer), so the
fold's array is bounded by the number of periods, however large the universe is.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    """Hold the `top` best by `score` above `floor` with 1 / top each. A name that is held stays while it ranks in the top + buffer.
    With `gated` the regime scales what is held, and risk_off holds nothing. The floor counts for the composite alone, as other
    scores have no scale."""

    name: str
    score: str = "composite"
    top: int = 3
    floor: float = 0.03
    buffer: int = 0
    gated: bool = False
    cost_bps: float = 46.0


PICK = "struct<symbol:string,weight:double>"
PERIOD = f"struct<run:timestamp,picks:array<{PICK}>,gross:double,turnover:double,cost:double,net:double,exposure:double,state:string,lead:double,basket:double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def rebalance_runs(rows: DataFrame, fwd: str, every: int) -> DataFrame:
    """Every h-th of the runs that have any return, the first one included."""
    runs = rows.groupBy("run").agg(F.count(fwd).alias("n")).where("n > 0")
    return runs.withColumn("at", F.row_number().over(Window.orderBy("run")) - 1).where(F.col("at") % every == 0).select("run")  # one row a run


def candidates(rows: DataFrame, strategies: list[Strategy], fwd: str, every: int, lead: str) -> DataFrame:
    """A row for each strategy and run that has a known score and return: the run's best names for it, in order, the regime, the lead and the basket."""
    # A strategy is a struct in an array of the row: rows are not joined to strategies, and each is read once.
    many = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items() if k != "score"], F.col(s.score).alias("value")) for s in strategies])
    kept = [c for c in ("regime_state", "regime_scale") if c in rows.columns]
    x = rows.where(F.col(fwd).isNotNull()).join(F.broadcast(rebalance_runs(rows, fwd, every)), "run", "left_semi")  # one row a run
    x = x.select("run", "symbol", F.col(fwd).alias("fwd"), *kept, F.explode(many).alias("s")).where("s.value is not null")
    floor = F.when(F.col("s.name").isin([s.name for s in strategies if s.score == "composite"]), F.col("s.value") > F.col("s.floor")).otherwise(F.lit(True))
    rank = F.row_number().over(Window.partitionBy("run", "s.name").orderBy(F.desc("s.value"), "symbol"))
    x = x.withColumn("above", floor).withColumn("rank", rank)
    pick = F.when(F.col("above") & (F.col("rank") <= F.col("s.top") + F.col("s.buffer")), F.struct("rank", "symbol", "fwd"))
    state = F.first("regime_state", ignorenulls=True) if "regime_state" in kept else F.lit(None).cast("string")
    scale = F.first("regime_scale", ignorenulls=True) if "regime_scale" in kept else F.lit(None).cast("double")
    per = x.groupBy("run", F.col("s.name").alias("strategy")).agg(
        F.array_sort(F.collect_list(pick)).alias("names"), F.avg("fwd").alias("basket"), F.max(F.when(F.col("symbol") == lead, F.col("fwd"))).alias("lead"),
        state.alias("state"), scale.alias("scale"), *[F.first(f"s.{k}").alias(k) for k in ("top", "buffer", "gated", "cost_bps")],
    )
    gate = F.when(~F.col("gated"), 1.0).when(F.col("state") == "risk_off", 0.0).otherwise(F.coalesce("scale", F.lit(1.0)))
    return per.withColumn("scale", gate).withColumn("state", F.when(F.col("gated"), F.col("state")))


def _step(held: Column, p: Column) -> Column:
    """What the period p holds after `held`, and what that brings and costs."""

    def symbols(x: Column) -> Column:
        return F.transform(x, lambda n: n["symbol"])

    def among(x: Column, of: Column) -> Column:
        return F.filter(x, lambda n: F.array_contains(of, n["symbol"]))

    def beyond(x: Column, of: Column) -> Column:
        return F.filter(x, lambda n: ~F.array_contains(of, n["symbol"]))

    kept = F.when(p["buffer"] > 0, F.slice(symbols(among(p["names"], symbols(held))), 1, p["top"])).otherwise(F.array().cast("array<string>"))
    weight = p["scale"] / p["top"]

    def result(picks: Column) -> Column:
        now = F.transform(picks, lambda n: F.struct(n["symbol"].alias("symbol"), weight.alias("weight")).cast(PICK))

        def total(x: Column, f) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda s, n: s + f(n))

        changed = total(among(held, symbols(picks)), lambda h: F.abs(weight - h["weight"])) + total(beyond(held, symbols(picks)), lambda h: F.abs(h["weight"]))
        turnover = changed + weight * F.size(beyond(picks, symbols(held)))
        gross = total(picks, lambda n: weight * n["fwd"])
        return _let(F.struct(gross.alias("g"), turnover.alias("t")), lambda v: F.struct(
            p["run"].alias("run"), now.alias("picks"), v["g"].alias("gross"), v["t"].alias("turnover"), (v["t"] * p["cost_bps"] / 1e4).alias("cost"), (v["g"] - v["t"] * p["cost_bps"] / 1e4).alias("net"),
            (weight * F.size(picks)).alias("exposure"), p["state"].alias("state"), p["lead"].alias("lead"), p["basket"].alias("basket"),
        ).cast(PERIOD))

    # The new names are the best of those that are not kept; a run's candidates reach far enough for all of them.
    def picked(keep: Column) -> Column:
        fresh = F.slice(symbols(beyond(p["names"], keep)), 1, p["top"] - F.size(keep))
        return _let(F.concat(keep, fresh), lambda chosen: _let(among(p["names"], chosen), result))

    return _let(kept, picked)


def simulate(rows: DataFrame, strategies: list[Strategy], fwd: str, every: int, lead: str) -> DataFrame:
    """strategy, run, picks, gross, turnover, cost, net, exposure, state, lead, basket: one row a strategy and period, of rows (run, symbol, the scores, fwd,
    regime_state, regime_scale). A run without known scores is no period; what was held goes on through it. Ties go by symbol."""
    per = candidates(rows, strategies, fwd, every, lead)
    fields = ("run", "names", "basket", "lead", "state", "scale", "top", "buffer", "cost_bps")
    ordered = per.withColumn("run", F.col("run").cast("timestamp")).groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("periods"))
    none = F.array().cast(f"array<{PERIOD}>")

    def add(done: Column, p: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["picks"], F.array().cast(f"array<{PICK}>"))
        return F.array_append(done, _let(before, lambda held: _step(held, p)))

    return ordered.select("strategy", F.explode(F.aggregate("periods", none, add)).alias("p")).select("strategy", "p.*")


LEGS = ("net", "gross", "lead", "basket")


def statistics(periods: DataFrame, hold_days: float) -> DataFrame:
    """For each strategy and leg: periods, total and yearly return, Sharpe ratio (over the deviation of a sample) and largest drawdown of the
    compounded returns, in per cent. A leg without returns has none."""
    legs = F.explode(F.array(*[F.struct(F.lit(leg).alias("leg"), F.col(leg).alias("r")) for leg in LEGS])).alias("l")
    x = periods.select("strategy", "run", legs).select("strategy", "run", "l.*").where("r is not null")
    g = x.groupBy("strategy", "leg").agg(F.sort_array(F.collect_list(F.struct("run", "r"))).alias("x"), F.count("*").alias("periods"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))

    def step(s: Column, x: Column) -> Column:
        return _let(s["value"] * (1 + x["r"]), lambda v: _let(F.greatest(s["peak"], v), lambda top: F.struct(v.alias("value"), top.alias("peak"), F.least(s["fall"], v / top - 1).alias("fall"))))

    # The peak begins with the first value, not with 1.
    curve = F.aggregate("x", F.struct(F.lit(1.0).alias("value"), F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("fall")), step)
    per_year = 365.0 / hold_days
    g = g.withColumn("c", curve)
    sharpe = F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * F.sqrt(F.lit(per_year)))
    cagr = 100 * (F.pow(F.col("c.value"), per_year / F.col("periods")) - 1)
    return g.select("strategy", "leg", "periods", (100 * (F.col("c.value") - 1)).alias("total"), cagr.alias("cagr"), sharpe.alias("sharpe"), (100 * F.col("c.fall")).alias("max_drawdown"))


def habits(periods: DataFrame) -> DataFrame:
    """For each strategy: mean exposure and turnover, fees in all in per cent, and the share of periods that beat the basket."""
    return periods.groupBy("strategy").agg(F.avg("exposure").alias("exposure"), F.avg("turnover").alias("turnover"), (100 * F.sum("cost")).alias("fee_drag"), (100 * F.avg((F.col("net") > F.col("basket")).cast("double"))).alias("beat_basket"))
