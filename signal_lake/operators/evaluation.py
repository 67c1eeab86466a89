"""Scores against realised returns: rank information coefficients, spreads, hit rates, equity and the top-N simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.rolling import average_rank, correlation
from signal_lake.operators import asof


def unpivoted(rows: DataFrame, families: list[str], horizons: dict[int, str], *others: str) -> DataFrame:
    """(run, symbol, family, horizon, score, fwd and the others) for pairs where both are known."""
    fam = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("score")) for f in families])).alias("f")
    hor = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("fwd")) for h, c in horizons.items()])).alias("h")
    return rows.select("run", "symbol", *others, fam, *horizons.values()).select("run", "symbol", *others, "f.*", hor).select("run", "symbol", *others, "family", "score", "h.*").where("score is not null and fwd is not null")


#: Names that have no return to rank. Fixed values.
STABLECOINS = ("USDT", "USDC", "USD", "BUSD", "DAI", "TUSD", "FDUSD")


def backfilled(scores: DataFrame, families: list[str], components: str = "components", stable: tuple[str, ...] = STABLECOINS) -> DataFrame:
    """Scores without stablecoins, whose missing families (rows from before they had a column) come from the JSON of their components, `family.family`."""
    def said(f: str) -> Column:
        return F.get_json_object(components, f"$.{f}.{f}").try_cast("double")

    return scores.where(~F.col("symbol").isin(*stable)).withColumns({f: F.coalesce(F.col(f), said(f)) if f in scores.columns else said(f) for f in families})


def ic_grid(summary: DataFrame, horizons: list[int]) -> DataFrame:
    """family and a cell a horizon: the mean IC and its t, as text; a dash where there is no IC."""
    def signed(x: str, digits: int) -> Column:
        return F.concat(F.when(F.col(x) >= 0, "+").otherwise(""), F.format_number(x, digits))

    cell = F.when(F.col("mean_ic").isNull(), F.lit("\u2014")).when(F.col("t").isNull(), signed("mean_ic", 4)).otherwise(F.concat(signed("mean_ic", 4), F.lit(" ("), signed("t", 1), F.lit(")")))
    return summary.groupBy("family").pivot("horizon", horizons).agg(F.first(cell))


def versus(stats: DataFrame, curve: DataFrame, lead: DataFrame) -> DataFrame:
    """stats (mode, total_return) with what the lead (date, close) brought from the mode's first day to its last, at the closes as of them, and the difference."""
    ends = curve.groupBy("mode").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("mode", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("day")), F.struct(F.lit("b").alias("end"), F.col("b").alias("day")))).alias("e")).select(F.lit(1).alias("k"), "mode", "e.*")
    at = asof.asof_backward(days, lead.select(F.lit(1).alias("k"), "date", "close"), "k", "day", "date", ["close"])  # two rows a mode
    held = at.groupBy("mode").agg(F.max(F.when(F.col("end") == "a", F.col("close"))).alias("c0"), F.max(F.when(F.col("end") == "b", F.col("close"))).alias("c1"))
    back = F.when(F.col("c0") > 0, 100 * (F.col("c1") / F.col("c0") - 1))
    return stats.join(held.select("mode", back.alias("lead_return")), "mode", "left").withColumn("over_lead", F.col("total_return") - F.col("lead_return"))


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    """rho and n for each group: NULL under three pairs or where a side has one value only."""
    ranked = pairs.withColumn("__a", average_rank(F.col("score"), by)).withColumn("__b", average_rank(F.col("fwd"), by))
    g = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("__a", "__b").alias("rho"), F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("fwd").alias("f0"), F.max("fwd").alias("f1"))
    ok = (F.col("n") >= 3) & (F.col("s0") < F.col("s1")) & (F.col("f0") < F.col("f1"))
    return g.select(*by, F.when(ok, F.col("rho")).alias("rho"), "n")


def ic_summary(pairs: DataFrame) -> DataFrame:
    """For each family and horizon (days): runs, mean, deviation, overlap, t (deflated by overlapping horizons), share above 0."""
    per = spearman(pairs, ["family", "horizon", "run"]).where("rho is not null")
    g = per.groupBy("family", "horizon").agg(
        F.count("*").alias("n_runs"), F.avg("rho").alias("mean_ic"), F.stddev_samp("rho").alias("sd"), F.avg((F.col("rho") > 1e-12).cast("double")).alias("positive"),
        (F.datediff(F.max("run"), F.min("run")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("gap"),
    )
    overlap = F.when(F.col("n_runs") < 3, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.try_divide(F.col("horizon"), F.col("gap"))))
    eff = g.withColumn("overlap", overlap).withColumn("n_eff", F.col("n_runs") / F.col("overlap"))
    t = F.when((F.col("n_eff") >= 2) & (F.col("sd") > 0), F.col("mean_ic") / (F.col("sd") / F.sqrt("n_eff")))
    return eff.select("family", "horizon", "n_runs", "mean_ic", "sd", "overlap", t.alias("t"), (100 * F.col("positive")).alias("pct_positive"))


def quantile_spread(rows: DataFrame, score: str, fwd: str, n: int = 3) -> DataFrame:
    """Mean over runs (with 2n rows or more) of the mean return of the n best, the n worst, and their difference."""
    known = rows.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    w = Window.partitionBy("run")
    r = known.withColumn("__up", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("__down", F.row_number().over(w.orderBy(F.asc(score), F.desc("symbol")))).withColumn("__n", F.count("*").over(w))
    per = r.where(F.col("__n") >= 2 * n).groupBy("run").agg(F.avg(F.when(F.col("__up") <= n, F.col(fwd))).alias("top"), F.avg(F.when(F.col("__down") <= n, F.col(fwd))).alias("bottom"))
    return per.agg(F.count("*").alias("n_runs"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), (F.avg("top") - F.avg("bottom")).alias("spread"))


def battery(pairs: DataFrame, runs: DataFrame, lead: str, n: int = 3) -> DataFrame:
    """The whole report over one long panel of pairs (run, symbol, family, horizon, score, fwd, state): for each family and horizon, of all
    runs (`part` all), of either half of `runs` and of the runs in each state, the rank information coefficient with its
    t-statistic, the spread between the n best and the n worst, and what the universe, the best and the lead brought.

    A run is summed up once; the parts are grouping sets over runs, not a plan each. The second half begins with the middle run."""
    middle = runs.select("run").distinct().agg(F.sort_array(F.collect_set("run")).alias("r")).select(F.col("r")[F.floor(F.size("r") / 2).cast("int")].alias("middle"))  # one row
    by = ["family", "horizon", "run"]
    w = Window.partitionBy(*by)
    x = pairs.withColumns({
        "__a": average_rank(F.col("score"), by), "__b": average_rank(F.col("fwd"), by),
        "__up": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "__down": F.row_number().over(w.orderBy(F.asc("score"), F.desc("symbol"))),
    })
    fwd = F.col("fwd")
    per = x.groupBy(*by).agg(
        F.count("*").alias("n"), correlation("__a", "__b").alias("rho"), (F.min("score") < F.max("score")).alias("__s"), (F.min("fwd") < F.max("fwd")).alias("__f"), F.avg(F.when(F.col("__up") <= n, fwd)).alias("top"),
        F.avg(F.when(F.col("__down") <= n, fwd)).alias("bottom"), F.avg("fwd").alias("universe"), F.max(F.when(F.col("symbol") == lead, fwd)).alias("lead"), F.first("state", ignorenulls=True).alias("state"),
    )
    per = per.join(F.broadcast(middle)).withColumns({
        "rho": F.when((F.col("n") >= 3) & F.col("__s") & F.col("__f"), F.col("rho")), "half": F.when(F.col("run") < F.col("middle"), "first half").otherwise("second half"),
        "wide": F.col("n") >= 2 * n, "state": F.coalesce("state", F.lit("no state")),
    })
    known, wide = F.col("rho").isNotNull(), F.col("wide")
    g = per.groupingSets([["family", "horizon"], ["family", "horizon", "half"], ["family", "horizon", "state"]], "family", "horizon", "half", "state").agg(
        F.count("rho").alias("n_runs"), F.avg("rho").alias("mean_ic"), F.stddev_samp("rho").alias("sd"), (100 * F.avg(F.when(known, (F.col("rho") > 1e-12).cast("double")))).alias("pct_positive"),
        (F.datediff(F.max(F.when(known, F.col("run"))), F.min(F.when(known, F.col("run")))) / F.nullif(F.count("rho") - 1, F.lit(0))).alias("gap"), F.count_if(wide).alias("wide_runs"), F.avg(F.when(wide, F.col("top"))).alias("top"),
        F.avg(F.when(wide, F.col("bottom"))).alias("bottom"), F.avg(F.when(wide, F.col("universe"))).alias("wide_universe"), F.avg("top").alias("best"), F.avg("universe").alias("universe"), F.avg("lead").alias("lead"),
    )
    overlap = F.when(F.col("n_runs") < 3, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.try_divide(F.col("horizon"), F.col("gap"))))
    g = g.withColumn("runs_eff", F.col("n_runs") / overlap)
    t = F.when((F.col("runs_eff") >= 2) & (F.col("sd") > 0), F.col("mean_ic") / (F.col("sd") / F.sqrt("runs_eff")))
    part = F.coalesce("half", "state", F.lit("all"))
    return g.select("family", "horizon", part.alias("part"), "n_runs", "runs_eff", "mean_ic", t.alias("t"), "pct_positive", "wide_runs", "top", "bottom", (F.col("top") - F.col("bottom")).alias("spread"), (F.col("top") - F.col("wide_universe")).alias("over_universe"), "best", "universe", "lead")


def _global_rank(values: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """by, value and its rank among all of its group, ties sharing their mean: values are counted, their counts are summed up inside cells
    of `width` and then over the cells, so that no task has a group's values together."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("__c")).withColumn("__cell", F.floor(F.col(value) / width).cast("long"))
    inside = Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*by, "__cell").agg(F.sum("__c").alias("__n")).select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = counts.withColumn("__r", F.sum("__c").over(inside))
    return local.join(cells, [*by, "__cell"]).select(*by, value, (F.col("__o") + F.col("__r") - (F.col("__c") - 1) / 2.0).alias(f"rank_{value}"))


def pooled_ic(pairs: DataFrame, width: float = 0.01) -> DataFrame:
    """For each family and horizon the rank correlation over all rows of all runs, NULL under three rows or where a side has one value only."""
    by = ["family", "horizon"]
    # Zeros of either sign are one value to ranks; adding 0 makes them one to hashes too.
    x = pairs.select(*by, (F.col("score") + 0.0).alias("score"), (F.col("fwd") + 0.0).alias("fwd"))
    ranked = x.join(_global_rank(x, by, "score", width), [*by, "score"]).join(_global_rank(x, by, "fwd", width), [*by, "fwd"])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, correlation("rank_score", "rank_fwd")).alias("pooled"))


def hit_rate(rows: DataFrame, score: str, fwd: str, floor: float) -> DataFrame:
    known = rows.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    side = F.when(F.col(score) >= floor, "above").otherwise("below").alias("side")
    return known.groupBy(side).agg(F.count("*").alias("n"), F.avg((F.col(fwd) > 0).cast("double")).alias("hit_rate"), F.avg(fwd).alias("mean_fwd"))


def equity_stats(curve: DataFrame) -> DataFrame:
    """For each mode of (mode, day, equity): total return, Sharpe ratio and largest drawdown, in per cent. A row whose equity was
    seen before anywhere in its mode is left out."""
    first = curve.withColumn("__n", F.row_number().over(Window.partitionBy("mode", "equity").orderBy("day"))).where("__n = 1")
    o = Window.partitionBy("mode").orderBy("day")
    r = first.withColumn("ret", F.col("equity") / F.lag("equity").over(o) - 1).withColumn("peak", F.max("equity").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy("mode").agg(
        F.count("ret").alias("n"), F.min_by("equity", "day").alias("a"), F.max_by("equity", "day").alias("b"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"),
        F.datediff(F.max("day"), F.min("day")).alias("span"), (100 * F.min(F.col("equity") / F.col("peak") - 1)).alias("max_drawdown"),
    )
    sharpe = F.when((F.col("sd") > 0) & (F.col("span") >= 1), F.col("m") / F.col("sd") * F.sqrt(365.0 / (F.col("span") / F.col("n"))))
    return g.select("mode", "n", (100 * (F.col("b") / F.col("a") - 1)).alias("total_return"), sharpe.alias("sharpe"), "max_drawdown")
