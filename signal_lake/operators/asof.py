"""As-of joins by one sorted pass: both sides are put into one ordered window per key, with no pairwise matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.operators import blocks


def _stacked(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], right_first: bool) -> DataFrame:
    l = left.withColumn("__ts", F.col(left_ts)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.select(F.struct(right_ts, *values).alias("s")).schema["s"].dataType))
    r = right.select(F.col(key), F.col(right_ts).alias("__ts"), F.lit(0 if right_first else 2).alias("__side"), F.struct(right_ts, *values).alias("__v"))
    return l.unionByName(r, allowMissingColumns=True)


def _scanned(stacked: DataFrame, key: str, days: float | None, ahead: bool) -> DataFrame:
    """stacked with __m, the last value so far (the next one, if ahead). With `days`, in two phases: inside stretches of so many days, and by a
    scan over the one value that each stretch hands on; what a task holds then grows with a stretch, not with a key."""
    order = [F.desc("__ts"), F.desc("__side")] if ahead else ["__ts", "__side"]
    sofar = (Window.unboundedPreceding, 0)
    if days is None:
        # read from the end, what is last so far comes first: a frame that only grows, where one that shrinks is summed up anew for each row
        return stacked.withColumn("__m", F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(*sofar)))
    parts = stacked.withColumn("__st", blocks.stretch(stacked, "__ts", days)).repartition(key, "__st")  # dealt once, for both phases
    local = parts.withColumn("__l", F.last("__v", ignorenulls=True).over(Window.partitionBy(key, "__st").orderBy(*order).rowsBetween(*sofar)))
    # A stretch hands on its last value, or its first one to those that look ahead.
    at = F.when(F.col("__v").isNotNull(), F.struct("__ts", "__side"))
    handed = parts.groupBy(key, "__st").agg((F.min_by if ahead else F.max_by)("__v", at).alias("__h"))
    carried = F.last("__h", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("__st") if ahead else F.asc("__st")).rowsBetween(Window.unboundedPreceding, -1))
    return local.join(handed.select(key, "__st", carried.alias("__c")), [key, "__st"], "left").withColumn("__m", F.coalesce("__l", "__c"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], strict: bool = False, days: float | None = None) -> DataFrame:
    """left with the last row of right that is at or before its time (before it, if strict); in two phases if `days` are given."""
    return _picked(_scanned(_stacked(left, right, key, left_ts, right_ts, values, right_first=not strict), key, days, ahead=False), left, right_ts, values)


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], strict: bool = False, days: float | None = None) -> DataFrame:
    """left with the first row of right that is at or after its time (after it, if strict); in two phases if `days` are given."""
    # looking ahead, equal times count if the right row sorts after the left one
    return _picked(_scanned(_stacked(left, right, key, left_ts, right_ts, values, right_first=strict), key, days, ahead=True), left, right_ts, values)


def _picked(out: DataFrame, left: DataFrame, right_ts: str, values: list[str]) -> DataFrame:
    return out.where("__side = 1").select(*left.columns, F.col(f"__m.{right_ts}").alias("match_ts"), *[F.col(f"__m.{v}").alias(v) for v in values])


def forward_returns(scores: DataFrame, bars: DataFrame, days: int, run: str = "run", ts: str = "date", stretch: float | None = None) -> DataFrame:
    """scores with entry_date, exit_date and fwd: enter at the first bar strictly after the run, leave at the first bar at
    or after `days` later; NULL where either is missing or the entry price is not positive.

    With `stretch`, as-of joins go in two phases over stretches of so many days. The exit of every bar is found once, so the second as-of join has the bars on both sides, not the scores.
    """
    price = bars.select("symbol", ts, "close")
    due = price.withColumn("__due", F.date_add(ts, days))
    exits = asof_forward(due, price.select("symbol", F.col(ts).alias("__xd"), F.col("close").alias("__xc")), "symbol", "__due", "__xd", ["__xc"], days=stretch)
    exits = exits.select("symbol", ts, "close", F.col("match_ts").alias("exit_date"), F.col("__xc").alias("exit_close"))
    out = asof_forward(scores, exits, "symbol", run, ts, ["close", "exit_date", "exit_close"], strict=True, days=stretch)
    return out.withColumn("fwd", F.when(F.col("close") > 0, F.col("exit_close") / F.col("close") - 1)).withColumnRenamed("match_ts", "entry_date").drop("close", "exit_close")


def point_in_time(steps: DataFrame, bars: DataFrame, lookback_days: int, step: str = "step", ts: str = "date") -> DataFrame:
    """bars seen from each step: at or before it, and at most lookback_days old. Time is cut into stretches of the look-back, of
    which a step sees two: steps meet the bars of those on (symbol, stretch), so bars are not copied, and no key holds more
    than a stretch of bars."""
    width = lookback_days + 1
    at = F.floor(F.unix_date(ts) / width)
    until = F.floor(F.unix_date(step) / width)
    both = steps.withColumn("__b", F.explode(F.array(until - 1, until))).join(bars.withColumn("__b", at), ["symbol", "__b"])
    return both.where((F.col(ts) <= F.col(step)) & (F.col(ts) >= F.date_sub(step, lookback_days))).drop("__b")
