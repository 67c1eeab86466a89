"""Ordered windows: guarded rolling statistics and exponentially weighted means, all without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def back(n: int, by: str | list[str] = "symbol", order: str = "date"):
    """The last n rows, this one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def guarded(x: Column, value: Column, n: int, least: int, by="symbol", order: str = "date") -> Column:
    """value over the last n rows, where at least `least` of them have an x."""
    w = back(n, by, order)
    return F.when(F.count(x).over(w) >= least, value.over(w))


def sma(x: Column, n: int, least: int | None = None, by="symbol", order: str = "date") -> Column:
    return guarded(x, F.avg(x), n, max(2, n // 2) if least is None else least, by, order)


def std(x: Column, n: int, least: int | None = None, by="symbol", order: str = "date") -> Column:
    """Population deviation."""
    return guarded(x, F.stddev_pop(x), n, max(2, n // 2) if least is None else least, by, order)


def ewm(df: DataFrame, x: str, out: str, alpha: float, least: int, by: str = "symbol", order: str = "date") -> DataFrame:
    """df with out = the recursion y = (1 - alpha) y + alpha x, begun with the first x, NULL before `least` values.

    The rows that have an x are numbered and cut into blocks of B rows with (1 - alpha)^B below 1e-16. Inside a
    block the recursion is a running sum of scaled values that cannot overflow, and what the blocks before the last one
    leave in it is below the precision of doubles. The input is read once: all windows are on the same key.
    """
    beta = 1.0 - alpha
    size = max(2, math.ceil(math.log(1e-16) / math.log(beta)))
    sofar = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = df.withColumn("__i", F.greatest(F.count(x).over(sofar) - 1, F.lit(0)))
    at = at.withColumn("__b", F.floor(F.col("__i") / size)).withColumn("__k", F.col("__i") % size)
    weight = F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    scaled = weight * F.col(x) * F.pow(F.lit(beta), -F.col("__k"))
    local = at.withColumn("__y", F.sum(scaled).over(inside) * F.pow(F.lit(beta), F.col("__k")))
    ends = F.last(F.when(F.col(x).isNotNull() & (F.col("__k") == size - 1), F.col("__y")), ignorenulls=True).over(before)
    y = F.col("__y") + F.coalesce(F.col("__end") * F.pow(F.lit(beta), F.col("__k") + 1), F.lit(0.0))
    done = local.withColumn("__end", ends).withColumn(out, F.when(F.col(x).isNotNull() & (F.col("__i") + 1 >= least), y))
    return done.drop("__i", "__b", "__k", "__y", "__end")


def ewms(df: DataFrame, means: dict[str, tuple[str, float, int]], by: str = "symbol", order: str = "date") -> DataFrame:
    """df with each mean out: (x, alpha, least), as ewm() gives it, for x that are NULL only before their first value.

    As nulls only lead, rows can be cut into blocks by their number alone, one size for all means, so that together they take two
    orderings of the rows; a block that nulls shorten is the first, which nothing comes before."""
    slowest, fastest = (f(a for _, a, _ in means.values()) for f in (min, max))
    size = max(2, math.ceil(math.log(1e-16) / math.log(1.0 - slowest)))
    if -size * math.log10(1.0 - fastest) > 250:
        raise ValueError("the means are too unlike to share their blocks")
    sofar = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = df.withColumns({"__i": F.count(F.lit(1)).over(sofar) - 1} | {f"__n{x}": F.count(x).over(sofar) for x in {m[0] for m in means.values()}})
    at = at.withColumns({"__b": F.floor(F.col("__i") / size), "__k": F.col("__i") % size})

    def power(alpha: float, k: Column) -> Column:
        return F.pow(F.lit(1.0 - alpha), k)

    local = at.withColumns({
        f"__y{out}": F.sum(F.when(F.col(f"__n{x}") == 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.col(x) * power(alpha, -F.col("__k"))).over(inside) * power(alpha, F.col("__k"))
        for out, (x, alpha, _) in means.items()
    })
    ends = F.last(F.when(F.col("__k") == size - 1, F.struct(*[F.col(f"__y{out}") for out in means])), ignorenulls=True).over(before)
    done = local.withColumn("__end", ends).withColumns({
        out: F.when(F.col(x).isNotNull() & (F.col(f"__n{x}") >= least), F.col(f"__y{out}") + F.coalesce(F.col(f"__end.__y{out}") * power(alpha, F.col("__k") + 1), F.lit(0.0)))
        for out, (x, alpha, least) in means.items()
    })
    return done.drop("__i", "__b", "__k", "__end", *[f"__y{out}" for out in means], *{f"__n{m[0]}" for m in means.values()})


def ema(df: DataFrame, x: str, out: str, span: int, by: str = "symbol", order: str = "date") -> DataFrame:
    return ewm(df, x, out, 2.0 / (span + 1), max(2, span // 2), by, order)


def average_rank(value: Column, parts: list[Column | str]) -> Column:
    """Rank with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*parts).orderBy(value)) + (F.count("*").over(Window.partitionBy(*parts, value)) - 1) / 2.0


def correlation(a: str, b: str) -> Column:
    """Pearson's, as an aggregate; NULL where a side does not vary (corr itself divides by zero there)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
