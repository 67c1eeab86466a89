"""Tables of the domain: scans, overwrites, point updates, migrations, events that close soonest, and what reports say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import book_of, rounded

#: Order and protective states that still rest in the market. Fixed values.
RESTING = ("NEW", "PARTIALLY_FILLED")
#: Regimes in the order of reports. Fixed values.
STATES = ("risk_on", "neutral", "risk_off")


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """The table at path holds df and nothing of what it held before. df must not read that path: its files go before df is written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def updated(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """df with the given columns set where `when` holds (NULL counts as no)."""
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def migrated(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """df with NULL columns for those of `added` (name: type) that it lacks, and the book that the mode tells; no mode is paper."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in added.items() if c not in df.columns})
    return out.withColumn("book", book_of(F.col("mode")))


def nearest_event(markets: DataFrame) -> DataFrame:
    """Of each series the markets of the event that closes first; an event without a closing time comes last, equal ones by name."""
    event = F.coalesce("event", "ticker", F.lit(""))
    first = F.min(F.coalesce(F.col("close_time").cast("string"), F.lit("~"))).over(Window.partitionBy("series", "__event"))
    out = markets.withColumn("__event", event).withColumn("__close", first)
    place = F.dense_rank().over(Window.partitionBy("series").orderBy("__close", "__event"))
    return out.withColumn("__place", place).where("__place = 1").drop("__event", "__close", "__place")


def has_outcome(ticker: Column, outcomes: list[str]) -> Column:
    """Whether the ticker ends in one of the outcomes; any does where there are none."""
    return F.exists(F.array(*map(F.lit, outcomes)), lambda o: ticker.endswith(F.concat(F.lit("-"), o))) if outcomes else F.lit(True)


def fresh(markets: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Of each series its newest fetch within `hours`, without markets that have closed; an unknown closing time is kept."""
    young = markets.where(F.col("fetched_at") >= as_of - F.make_interval(hours=F.lit(hours)))
    newest = F.max("fetched_at").over(Window.partitionBy("series"))
    return young.withColumn("__new", newest).where("fetched_at = __new").where(F.col("close_time").isNull() | (F.col("close_time") > as_of)).drop("__new")


def spliced(ranked: DataFrame, configured: DataFrame, head: int) -> DataFrame:
    """name and place: the first `head` of ranked (name, rank from 0), the configured names that have no rank, then the rest.

    Both are lists of sources, some hundreds at most.
    """
    new = configured.join(ranked, "name", "left_anti").select("name", F.lit(None).cast("int").alias("rank"))
    behind = F.row_number().over(Window.partitionBy("__new").orderBy("name")) - 1
    both = ranked.select("name", F.col("rank").cast("int")).unionByName(new).withColumn("__new", F.col("rank").isNull())
    both = both.withColumns({"__behind": behind, "__n": F.count_if("__new").over(Window.partitionBy())})  # one row a source
    first = F.lit(max(1, head))
    place = F.when(F.col("__new"), first + F.col("__behind")).when(F.col("rank") >= first, F.col("rank") + F.col("__n")).otherwise(F.col("rank"))
    return both.select("name", place.cast("int").alias("place"))


def fee(row_fee: Column, response: Column, notional: Column, bps: float) -> Column:
    """The fee that was booked, else the one in the exchange's answer (JSON), else the modelled one."""
    return F.coalesce(F.when(row_fee > 0, F.abs(row_fee)), F.abs(F.get_json_object(response, "$.fee").try_cast("double")), notional * bps / 1e4)


def label_price(x: Column) -> Column:
    """A price with more digits the smaller it is, and commas between thousands."""
    size = F.abs(x)
    tiny = F.regexp_replace(F.format_number(x, 10), ",", "")
    return F.when(size >= 1000, F.format_number(x, 2)).when(size >= 1, F.format_number(x, 4)).when(size >= 0.01, F.format_number(x, 6)).when(size >= 0.0001, F.format_number(x, 8)).otherwise(tiny)


def label_quantity(x: Column) -> Column:
    return F.when(F.abs(x) >= 1000, F.format_number(x, 2)).otherwise(F.format_number(x, 6))


def label_horizon(days: Column) -> Column:
    """How long a trade is meant to be held."""
    whole = F.format_string("%.0f", F.rint(days))
    return F.when(days <= 1, "up to 1 day").when(days <= 7, F.concat(F.lit("1-"), whole, F.lit(" days"))).otherwise(F.concat(F.lit("up to "), whole, F.lit(" days")))


def drivers(parts: dict[str, Column], most: int = 3, digits: int = 2) -> Column:
    """The strongest parts as `name +0.12`, by size, those of equal size by name."""
    rows = F.array(*[F.struct((-F.abs(v)).alias("size"), F.lit(k).alias("name"), v.alias("value")) for k, v in sorted(parts.items())])
    return F.array_join(F.transform(F.slice(F.array_sort(F.filter(rows, lambda p: p["value"].isNotNull())), 1, most), lambda p: F.concat(p["name"], F.lit(" "), F.format_string(f"%+.{digits}f", rounded(p["value"], digits)))), ", ")


def normalised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with `weight`, each value's share of its group's sum; equal shares where all are zero."""
    w = Window.partitionBy(*by)
    total = F.sum(F.coalesce(value, F.lit(0.0))).over(w)
    return rows.withColumn("weight", F.when(total != 0, F.coalesce(value, F.lit(0.0)) / total).otherwise(1.0 / F.count("*").over(w)))


def curve(returns: DataFrame, by: str, order: str, r: str = "ret") -> DataFrame:
    """returns with equity, the running product of 1 + r within `by`: logarithms are summed, and a loss of all or more ends at zero."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.max((F.col(r) <= -1).cast("int")).over(w) == 1
    return returns.withColumn("equity", F.when(ruined, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(F.col(r) > -1, F.log1p(r))).over(w))))


def funding_level(rates: DataFrame, by: str = "symbol", order: str = "ts", x: str = "rate") -> DataFrame:
    """The mean of the last nine rates where there are three at least."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-8, 0)
    return rates.withColumn("level", F.when(F.count(x).over(w) >= 3, F.avg(x).over(w)))


def step_grid(first: Column, last: Column, hour: int = 13) -> Column:
    """A step for each day from first to last (dates), at the hour."""
    return F.sequence(F.timestamp_add("HOUR", F.lit(hour), first.cast("timestamp_ntz")), F.timestamp_add("HOUR", F.lit(hour), last.cast("timestamp_ntz")), F.expr("interval 1 day"))


def state_table(rows: DataFrame, lead: str, top: int = 3) -> DataFrame:
    """rows (run, state, symbol, score, fwd): by state the number of runs and the mean return of all, of the top by score, and of the lead."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "symbol"))
    per = rows.where("fwd is not null and state is not null").withColumn("__p", place).groupBy("run", "state").agg(
        F.avg("fwd").alias("u"), F.avg(F.when(F.col("__p") <= top, F.col("fwd"))).alias("t"), F.avg(F.when(F.col("symbol") == lead, F.col("fwd"))).alias("l")
    )
    return per.groupBy("state").agg(F.count("*").alias("steps"), F.avg("u").alias("universe"), F.avg("t").alias("top"), F.avg("l").alias("lead"))


def with_live_point(points: DataFrame, live: DataFrame) -> DataFrame:
    """The curve with today's point at its end."""
    return points.unionByName(live)


def window_mentions(steps: DataFrame, posts: DataFrame, days: int, step: str = "step", ts: str = "ts") -> DataFrame:
    """Posts in [step - days, step) for each (symbol, step): joined on buckets of the window's length, of which a window meets two."""
    width = days * 86400
    at = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width)
    until = F.floor((F.unix_seconds(F.col(step).cast("timestamp"))) / width)
    both = steps.withColumn("__b", F.explode(F.array(until - 1, until))).join(posts.withColumn("__b", at), ["symbol", "__b"])
    return both.where((F.col(ts) < F.col(step)) & (F.col(ts) >= F.col(step) - F.make_interval(days=F.lit(days)))).drop("__b")
