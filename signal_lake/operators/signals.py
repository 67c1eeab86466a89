"""Signals: a registry of native column expressions over bars, and the lab, where plug-ins score what each step could see."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATIVE: dict[str, Callable[[], Column]] = {}


def _back(n: int) -> Column:
    return F.lag("close", n).over(Window.partitionBy("symbol").orderBy("date"))


def native(name: str):
    def add(f):
        NATIVE[name] = f
        return f

    return add


@native("reversal_1d")
def _reversal_1d():
    return -(F.col("close") / _back(1) - 1)


@native("reversal_3d")
def _reversal_3d():
    return -(F.col("close") / _back(3) - 1)


@native("momentum_30d")
def _momentum_30d():
    return F.col("close") / _back(30) - 1


@native("low_vol")
def _low_vol():
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-29, 0)
    return F.when(F.count("__ret").over(w) >= 10, -F.stddev_samp("__ret").over(w))


def apply(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with a column for each native signal; NULL is no opinion."""
    with_ret = bars.withColumn("__ret", F.col("close") / _back(1) - 1)
    return with_ret.withColumns({n: NATIVE[n]() for n in names}).drop("__ret")


@dataclass
class Context:
    """What a plug-in may look at: a symbol's bars by frame and its rates, in order, none of them after the step."""

    symbol: str
    step: int
    frames: dict[str, pd.DataFrame]
    rates: np.ndarray


Signal = Callable[[Context], float]


def _change(close: pd.Series, bars: int) -> float:
    return close.iloc[-1] / close.iloc[-1 - bars] - 1.0 if len(close) > bars and close.iloc[-1 - bars] else float("nan")


def reversal_1d(at: Context) -> float:
    """Minus the change over the last 24 bars of the medium frame."""
    return -_change(at.frames["medium"]["close"], 24)


def reversal_3d(at: Context) -> float:
    return -_change(at.frames["daily"]["close"], 3)


def momentum_30d(at: Context) -> float:
    return _change(at.frames["daily"]["close"], 30)


def low_vol(at: Context) -> float:
    """Minus the deviation of the last 30 daily changes, if there are ten."""
    changes = at.frames["daily"]["close"].pct_change().dropna().tail(30)
    return -float(changes.std(ddof=1)) if len(changes) >= 10 else float("nan")


def funding_level(at: Context) -> float:
    """Minus the mean of the last nine rates, if there are three."""
    return -float(at.rates[-9:].mean()) if len(at.rates) >= 3 else float("nan")


BUILTIN: dict[str, Signal] = {f.__name__: f for f in (reversal_1d, reversal_3d, momentum_30d, low_vol, funding_level)}


def resolve(spec: str | None) -> dict[str, Signal]:
    """The signals of a spec: names, `module:function` and `label=` before either, comma-joined; `builtin` (or no spec) is all of these, `none` nothing."""
    found: dict[str, Signal] = {}
    for part in map(str.strip, (spec if spec is not None else "builtin").split(",")):
        label, _, target = part.rpartition("=")
        if target == "builtin":
            found |= BUILTIN
        elif target in BUILTIN:
            found[label.strip() or target] = BUILTIN[target]
        elif ":" in target:
            module, _, function = target.strip().partition(":")
            plugin = getattr(importlib.import_module(module), function)
            if not callable(plugin):
                raise ValueError(f"{target} can't be called")
            found[label.strip() or function] = plugin
        elif target not in ("", "none"):
            raise ValueError(f"no signal named {target}")
    return found


def lab(views: dict[str, DataFrame], rates: DataFrame, plugins: dict[str, Signal]) -> DataFrame:
    """step, symbol and a column for each plug-in, from views (step, symbol, open, close, ...) by frame and rates (step, symbol, open, rate)
    as of each step. A plug-in that fails, or whose value is not finite, has no opinion (NULL). One group is what one step sees
    of one symbol, which the frames' look-backs bound."""
    tagged = [df.select("step", "symbol", F.lit(name).alias("frame"), "open", *[F.col(c) for c in ("close", "high", "low", "volume")]) for name, df in views.items()]
    bars = tagged[0]
    for df in tagged[1:]:
        bars = bars.unionByName(df)
    names = list(views)

    def run(key: tuple, seen: pd.DataFrame, paid: pd.DataFrame) -> pd.DataFrame:
        if seen.empty:
            kinds = {"step": "int64", "symbol": "object"} | dict.fromkeys(plugins, "float64")
            return pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in kinds.items()})
        seen = seen.sort_values("open")
        frames = {name: seen[seen["frame"] == name].reset_index(drop=True) for name in names}
        at = Context(key[1], int(key[0]), frames, paid.sort_values("open")["rate"].to_numpy(dtype=float))
        row: dict = {"step": [at.step], "symbol": [at.symbol]}
        for name, plugin in plugins.items():
            try:
                value = float(plugin(at))
            except Exception:  # noqa: BLE001  a faulty plug-in has no opinion
                value = float("nan")
            row[name] = [value if np.isfinite(value) else None]
        return pd.DataFrame(row)

    schema = "step long, symbol string" + "".join(f", `{name}` double" for name in plugins)
    # New names for the columns: both sides may come from the same steps.
    paid = rates.select(F.col("step").alias("at"), F.col("symbol").alias("of"), F.col("open").alias("open"), F.col("rate").alias("rate"))
    return bars.groupBy("step", "symbol").cogroup(paid.groupBy("at", "of")).applyInPandas(run, schema)
