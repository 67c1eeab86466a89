"""Pair matrices in cells: correlations of all pairs of symbols, and the risk of a slate under them.

Symbols are dealt into bands and dates into stretches; a task has two bands over one stretch and gives the moments of their pairs, which
add up over stretches. No day's pairs are made as rows, and what a task holds is bounded by the bands and the stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import clip
from signal_lake.operators import blocks

#: Bands of symbols, and days of a stretch.
BANDS, DAYS = 4, 730
MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def daily_returns(bars: DataFrame) -> DataFrame:
    """symbol, date, ret, without each symbol's first day."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return bars.select("symbol", "date", (F.col("close") / before - 1).alias("ret")).where("ret is not null")


def _cell(g: pd.DataFrame) -> pd.DataFrame:
    """The moments of each pair of a left and a right symbol over the days that both have."""
    days = {d: i for i, d in enumerate(sorted(g["date"].unique()))}

    def side(s: int):
        rows = g[g["side"] == s]
        names = sorted(rows["symbol"].unique())
        at = {n: i for i, n in enumerate(names)}
        x, known = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        where = rows["date"].map(days).to_numpy(), rows["symbol"].map(at).to_numpy()
        x[where], known[where] = rows["ret"].to_numpy(), 1.0
        return np.array(names, object), x, known

    (a, x, kx), (b, y, ky) = side(0), side(1)
    made = {"n": kx.T @ ky, "x": x.T @ ky, "y": kx.T @ y, "xx": (x * x).T @ ky, "yy": kx.T @ (y * y), "xy": x.T @ y}
    first, second = np.repeat(a, len(b)), np.tile(b, len(a))
    out = pd.DataFrame({"a": first, "b": second} | {k: v.ravel() for k, v in made.items()})
    out = out[(out["n"] > 0) & (out["a"] != out["b"])]
    swap = out["a"] > out["b"]
    if g["i"].iloc[0] == g["j"].iloc[0]:  # a band with itself has each pair twice
        return out[~swap]
    turned = out[swap].rename(columns={"a": "b", "b": "a", "x": "y", "y": "x", "xx": "yy", "yy": "xx"})
    return pd.concat([out[~swap], turned[out.columns]])


def moments(returns: DataFrame, bands: int = BANDS, days: float = DAYS) -> DataFrame:
    """a, b and the summed moments of each pair a < b of returns (symbol, date, ret; one a symbol and date) over the days that both have."""
    band, other = F.pmod(F.xxhash64("symbol"), F.lit(bands)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    x = returns.select("symbol", "date", "ret", band.alias("own"), blocks.stretch(returns, "date", days).alias("stretch"), other.alias("other"))
    left, right = F.struct(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side")), F.struct(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    cells = F.when(F.col("own") < F.col("other"), F.array(left)).when(F.col("own") > F.col("other"), F.array(right)).otherwise(F.array(left, right))
    dealt = x.select("symbol", "date", "ret", "stretch", F.explode(cells).alias("c")).select("symbol", "date", "ret", "stretch", "c.*")
    parts = dealt.groupBy("i", "j", "stretch").applyInPandas(_cell, "a string, b string" + "".join(f", {m} double" for m in MOMENTS))
    return parts.groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlations(returns: DataFrame, least: int = 15, bands: int = BANDS, days: float = DAYS) -> DataFrame:
    """a, b, corr, n of the pairs with `least` days in common; NULL where a side does not vary."""
    m = moments(returns, bands, days).where(F.col("n") >= least)
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    varied = (vx > 1e-15 * F.col("xx")) & (vy > 1e-15 * F.col("yy"))
    corr = F.when(varied, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy))
    return m.select("a", "b", clip(corr).alias("corr"), F.col("n").cast("long").alias("n"))


def heat(risks: DataFrame, corr: DataFrame, by: list[str] = [], default: float = 0.8) -> DataFrame:
    """For each slate (of `by`) of risks (symbol, risk): names, gross, heat = sqrt(r'Cr) and their ratio. A pair without a correlation counts as
    `default`; one name alone is its own heat; names without risk are left out.

    All pairs at the default are known from two sums, so only the known pairs are looked up, each by its two names."""
    r = risks.where("risk > 0")
    sums = r.groupBy(*by).agg(F.count("*").alias("names"), F.sum("risk").alias("gross"), F.sum(F.col("risk") * F.col("risk")).alias("own"))
    known = corr.where("corr is not null").select("a", "b", "corr")
    one = r.select(*by, F.col("symbol").alias("a"), F.col("risk").alias("ra"))
    two = r.select(*[F.col(c).alias(c) for c in by], F.col("symbol").alias("b"), F.col("risk").alias("rb"))
    off = known.join(one, "a").join(two, [*by, "b"]).groupBy(*by).agg(F.sum(2 * F.col("ra") * F.col("rb") * (F.col("corr") - default)).alias("off"))
    x = sums.join(off, by, "left") if by else sums.join(F.broadcast(off))  # one row each
    square = F.col("own") + default * (F.col("gross") * F.col("gross") - F.col("own")) + F.coalesce("off", F.lit(0.0))
    value = F.when(F.col("names") <= 1, F.col("gross")).otherwise(F.sqrt(F.greatest(square, F.lit(0.0))))
    return x.select(*by, "names", "gross", value.alias("heat"), (value / F.col("gross")).alias("ratio"))
