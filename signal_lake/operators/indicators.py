"""Technical indicators over (symbol, date, close, high, low, volume), as window expressions and exponential means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import clip, rounded, squash
from signal_lake.functions.rolling import back, ema, ewm, ewms, guarded, sma, std


def by_date():
    return Window.partitionBy("symbol").orderBy("date")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = sma(F.col("close"), n), std(F.col("close"), n)
    out = bars.withColumn("mid", mid).withColumn("dev", dev).withColumn("upper", F.col("mid") + k * F.col("dev")).withColumn("lower", F.col("mid") - k * F.col("dev"))
    span = F.nullif(F.col("upper") - F.col("lower"), F.lit(0.0))
    return out.withColumn("pctb", (F.col("close") - F.col("lower")) / span).withColumn("width", span / F.col("mid")).drop("dev")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("upper", guarded(F.col("high"), F.max("high"), n, 2)).withColumn("lower", guarded(F.col("low"), F.min("low"), n, 2))


def volume_z(bars: DataFrame, n: int = 20) -> DataFrame:
    m, s = sma(F.col("volume"), n), std(F.col("volume"), n)
    return bars.withColumn("__m", m).withColumn("__s", s).withColumn("vol_z", F.coalesce((F.col("volume") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), F.lit(0.0))).drop("__m", "__s")


def true_range(bars: DataFrame) -> DataFrame:
    """The first row's is high - low: greatest skips what has no previous close."""
    pc = F.lag("close").over(by_date())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return ewm(true_range(bars), "tr", "atr", 1.0 / n, n)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """50 while warming up, and where nothing was lost."""
    d = F.col("close") - F.lag("close").over(by_date())
    out = bars.withColumn("__d", d).withColumn("__up", F.greatest(F.col("__d"), F.lit(0.0))).withColumn("__down", F.greatest(-F.col("__d"), F.lit(0.0)))
    out = out.withColumn("__up", F.when(F.col("__d").isNotNull(), F.col("__up"))).withColumn("__down", F.when(F.col("__d").isNotNull(), F.col("__down")))
    out = ewm(ewm(out, "__up", "__g", 1.0 / n, n), "__down", "__l", 1.0 / n, n)
    value = 100.0 - 100.0 / (1.0 + F.col("__g") / F.nullif(F.col("__l"), F.lit(0.0)))
    return out.withColumn("rsi", F.coalesce(value, F.lit(50.0))).drop("__d", "__up", "__down", "__g", "__l")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = ema(ema(bars, "close", "__f", fast), "close", "__s", slow).withColumn("macd", F.col("__f") - F.col("__s"))
    return ema(out, "macd", "macd_signal", signal).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__f", "__s")


def keltner(bars: DataFrame, n: int = 20, m: float = 2.0) -> DataFrame:
    out = ema(atr(bars, n), "close", "mid", n)
    return out.withColumn("upper", F.col("mid") + m * F.col("atr")).withColumn("lower", F.col("mid") - m * F.col("atr"))


def with_squeeze(banded: DataFrame, n: int = 100, share: float = 0.2, least: int = 20) -> DataFrame:
    """Bands with whether each is among the narrowest of the last n."""
    last = back(n)
    q = F.percentile("width", F.lit(share)).over(last)
    return banded.withColumn("squeeze", F.col("width").isNotNull() & (F.count("width").over(last) >= least) & F.coalesce(F.col("width") <= q, F.lit(False)))


def squeeze(bars: DataFrame) -> DataFrame:
    return with_squeeze(bollinger(bars).where("width is not null"))


def lag_return(n: int):
    return F.coalesce(F.col("close") / F.lag("close", n).over(by_date()) - 1, F.lit(0.0))


#: Bars that a squeeze is told from: the share of them that may be narrower, and how many have to be known. Fixed values.
SQUEEZE_BARS, SQUEEZE_SHARE, SQUEEZE_LEAST = 100, 0.2, 20


def enrich(bars: DataFrame) -> DataFrame:
    """Every indicator that the snapshot needs but the squeeze: what looks back over rows in one pass, the means in two more orderings."""
    close, o, rows = F.col("close"), by_date(), Window.partitionBy("symbol")
    out = bars.withColumns(
        {"mid": sma(close, 20), "__dev": std(close, 20), "__vm": sma(F.col("volume"), 20), "__vs": std(F.col("volume"), 20), "__pc": F.lag("close").over(o), "left": F.count(F.lit(1)).over(rows) - F.row_number().over(o)}
        | {f"dist{n}": F.coalesce(close / sma(close, n) - 1, F.lit(0.0)) for n in (20, 50)}
        | {f"ret_{n}b": lag_return(n) for n in (6, 24, 72)}
    )
    span = F.nullif((F.col("mid") + 2.0 * F.col("__dev")) - (F.col("mid") - 2.0 * F.col("__dev")), F.lit(0.0))
    d = close - F.col("__pc")
    out = out.withColumns({
        "pctb": (close - (F.col("mid") - 2.0 * F.col("__dev"))) / span, "width": span / F.col("mid"), "vol_z": F.coalesce((F.col("volume") - F.col("__vm")) / F.nullif("__vs", F.lit(0.0)), F.lit(0.0)),
        "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__pc")), F.abs(F.col("low") - F.col("__pc"))),
        "__up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
    })
    means = {"atr": ("__tr", 1 / 14, 14), "__f": ("close", 2 / 13, 6), "__s": ("close", 2 / 27, 13), "__g": ("__up", 1 / 14, 14), "__l": ("__down", 1 / 14, 14)}
    out = ewms(out, means).withColumn("macd", F.col("__f") - F.col("__s"))
    out = ewms(out, {"macd_signal": ("macd", 2 / 10, 4)})
    rsi14 = F.coalesce(100.0 - 100.0 / (1.0 + F.col("__g") / F.nullif("__l", F.lit(0.0))), F.lit(50.0))
    return out.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "rsi": rsi14}).drop("__dev", "__vm", "__vs", "__pc", "__tr", "__up", "__down", "__f", "__s", "__g", "__l")


def snapshot(enriched: DataFrame) -> DataFrame:
    """The last row of each symbol, with neutral values for what is not known yet, whether it is a squeeze, and `bars`, how many there are."""
    width = F.when(F.col("left") < SQUEEZE_BARS, F.col("width"))
    last = enriched.groupBy("symbol").agg(
        F.max_by(F.struct(*[c for c in enriched.columns if c != "symbol"]), "date").alias("r"), F.percentile(width, F.lit(SQUEEZE_SHARE)).alias("__q"), F.count(width).alias("__n"), F.count("*").alias("bars")
    ).select("symbol", "r.*", "__q", "__n", "bars")
    return last.withColumns({
        "atr_pct": F.coalesce(F.col("atr") / F.col("close"), F.lit(0.02)),
        "pctb": F.coalesce("pctb", F.lit(0.5)),
        "macd_hist": F.coalesce("macd_hist", F.lit(0.0)),
        "squeeze": (F.col("__n") >= SQUEEZE_LEAST) & F.coalesce(F.col("width") <= F.col("__q"), F.lit(False)),
    }).drop("__q", "__n", "left")


#: What each part weighs in the score, and what a squeeze does to it. Fixed values.
PARTS = {"trend": 0.32, "momentum": 0.30, "position": 0.18, "rsi_part": 0.10, "volume_part": 0.10}
SQUEEZE = 1.15


def technical_score(short: DataFrame, medium: DataFrame) -> DataFrame:
    """symbol, the parts (rounded first), whether there is a squeeze, and the weighted score (not rounded), from a short and a medium snapshot.

    Momentum is taken from both frames, each by its own volatility; trend, band and rsi from the medium one, volume from the short one.
    """
    s = short.select("symbol", F.col("close").alias("s_close"), F.col("atr_pct").alias("s_atr"), F.col("macd_hist").alias("s_macd"), F.col("vol_z").alias("s_vol"))
    snap = medium.join(s, "symbol")
    a, sa = F.greatest(F.col("atr_pct"), F.lit(1e-6)), F.greatest(F.col("s_atr"), F.lit(1e-6))
    trend = clip(0.6 * squash(F.col("dist20") / a, 3) + 0.4 * squash(F.col("dist50") / a, 5))
    momentum = clip(0.45 * squash(F.col("s_macd") / (F.col("s_close") * sa), 0.8) + 0.55 * squash(F.col("macd_hist") / (F.col("close") * a), 0.8))
    out = snap.withColumn("__t", trend).withColumn("__m", momentum)
    strength = F.least(F.lit(1.0), F.abs("__t") / 0.5)
    c = clip(2 * (F.col("pctb") - 0.5))
    out = out.withColumns({
        "trend": rounded("__t"),
        "momentum": rounded("__m"),
        "position": rounded(clip(c * strength - 0.8 * c * (1 - strength))),
        "rsi_part": rounded(0.6 * clip((50 - F.col("rsi")) / 25)),
        "volume_part": rounded(clip(squash(F.col("s_vol"), 2)) * F.when(F.col("__m") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))),
    })
    score = sum(w * F.col(k) for k, w in PARTS.items())
    score = F.when(F.col("squeeze"), score * SQUEEZE).otherwise(score)
    return out.select("symbol", *PARTS, "squeeze", clip(score).alias("technical"))


def cross_section(snap: DataFrame, run: list[str], least: int = 3) -> DataFrame:
    """xsec: tanh of the z-score, within a run, of half the 24-bar and half the 72-bar return; 0 where they do not differ.

    Names that are only held (a column `held_only`, if there is one) get a score but do not set the scale, unless the
    universe has fewer than `least` names; where the run has fewer, all are 0."""
    w = Window.partitionBy(*run)
    raw = 0.5 * F.coalesce("ret_24b", F.lit(0.0)) + 0.5 * F.coalesce("ret_72b", F.lit(0.0))
    own = F.coalesce(~F.col("held_only"), F.lit(True)) if "held_only" in snap.columns else F.lit(True)
    out = snap.withColumn("__raw", raw).withColumn("__own", own).withColumns({"__n": F.count("*").over(w), "__u": F.count_if("__own").over(w)})
    ref = F.when(F.col("__own") | (F.col("__u") < least), F.col("__raw"))
    out = out.withColumn("__ref", ref).withColumns({"__m": F.avg("__ref").over(w), "__s": F.stddev_pop("__ref").over(w)})
    flat = (F.col("__n") < least) | (F.col("__s") < 1e-9)
    return out.withColumn("xsec", F.when(flat, F.lit(0.0)).otherwise(F.tanh((F.col("__raw") - F.col("__m")) / F.col("__s")))).drop("__raw", "__own", "__n", "__u", "__ref", "__m", "__s")
