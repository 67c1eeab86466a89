"""Proposals: each run's scores become a sized slate, exits first, and the slate becomes fills while there is cash.

What a candidate would cost is a projection of its own row. What depends on the candidates before it (the slots, the
caps on the whole slate, the cash at its turn) is folded in the run's order, so a run is one row whose arrays are
bounded by the universe, and runs are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.functions.columns import adverse, commission


@dataclass(frozen=True)
class Rules:
    """How a slate is sized; percentages are of the risk basis unless said otherwise."""

    equity: float = 10_000.0  # the basis where live equity is unknown
    risk_pct: float = 1.0
    position_pct: float = 20.0
    deployed_pct: float = 60.0
    heat_pct: float = 2.5
    atr_mult: float = 1.5
    horizon_days: float = 10.0
    horizon_scaling: bool = True
    stop_min_pct: float = 3.0  # of the entry, as are the next two
    stop_max_pct: float = 40.0
    target_cap_pct: float = 60.0
    reward_risk: float = 2.0
    fee_adjust: bool = True
    round_trip_bps: float = 92.0
    fee_bps: float = 40.0
    relative: bool = True
    floor: float = 0.03  # of the composite where the order is relative
    least_score: float = 0.10  # where it is absolute
    trim: float = 0.10
    least: float = 15.0  # notional of a trade
    top: int = 3
    exits: int = 3
    haircut_pct: float = 1.0
    add: bool = False
    correlation_sizing: bool = True
    corr_rows: int = 60
    corr_least: int = 15
    corr_default: float = 0.8

    @property
    def entry_floor(self) -> float:
        return self.floor if self.relative else self.least_score


def trailing_returns(bars: DataFrame, at: DataFrame, rows: int) -> DataFrame:
    """(run, symbol) of `at` with `returns`: the (date, ret) of the last `rows` daily returns up to the run."""
    o = Window.partitionBy("symbol").orderBy("date")
    ret = bars.withColumn("ret", F.col("close") / F.lag("close").over(o) - 1).where("ret is not null").select("symbol", F.col("date").alias("on"), F.struct("date", "ret").alias("x"))
    stacked = ret.withColumn("run", F.lit(None).cast("date")).unionByName(at.select("symbol", "run", F.col("run").alias("on")).distinct(), allowMissingColumns=True)
    # Nulls are not collected, so the rows of the runs take no place in the frame: frames are numbered by returns.
    seen = Window.partitionBy("symbol").orderBy("on", F.col("run").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = stacked.withColumn("n", F.count("x").over(seen))
    last = Window.partitionBy("symbol").orderBy("n").rangeBetween(-(rows - 1), 0)
    return numbered.withColumn("returns", F.collect_list("x").over(last)).where("run is not null").select("run", "symbol", "returns")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once; what a lambda names from outside is worked out at each of its rows."""
    return F.transform(F.array(value), body)[0]


def _correlation(a: Column, b: Column, rules: Rules) -> Column:
    """Of two arrays of (date, ret) over the dates they share; the default where they share too few or one does not move."""
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])

    def add(s: Column, x: Column, y: Column) -> Column:
        more = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        return F.when(y.isNull(), s).otherwise(F.struct(*[(s[k] + v).alias(k) for k, v in more.items()]))

    def moments(at: Column) -> Column:
        return F.aggregate(F.transform(a, lambda x: F.struct(x["ret"].alias("x"), F.try_element_at(at, x["date"]).alias("y"))), none, lambda s, p: add(s, p["x"], p["y"]))

    def value(m: Column) -> Column:
        vx, vy = m["xx"] - m["x"] * m["x"] / m["n"], m["yy"] - m["y"] * m["y"] / m["n"]
        known = (F.size(a) >= rules.corr_least) & (F.size(b) >= rules.corr_least) & (m["n"] >= rules.corr_least) & (vx > 0) & (vy > 0)
        return F.when(known, F.least(F.greatest((m["xy"] - m["x"] * m["y"] / m["n"]) / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(rules.corr_default))

    return _let(F.map_from_entries(b), lambda at: _let(moments(at), value))


def _sized(rows: DataFrame, rules: Rules) -> DataFrame:
    """Each scored row (joined to its holding, its exit flag and its run) with side, levels, quantity and what it comes to
    apart from slots: 'taken', or why it is skipped."""
    price, held, composite = F.col("price"), F.coalesce("held", F.lit(0.0)), F.col("composite")
    floor, trim = rules.entry_floor, max(rules.trim, rules.entry_floor)
    side = F.when(composite > floor, "BUY").when((composite < -trim) & (held > 0), "SELL")
    buy = F.coalesce(side == "BUY", F.lit(False))
    atr = F.coalesce(F.when(F.col("atr_daily") != 0, F.col("atr_daily")), F.when(F.col("atr_week") != 0, F.col("atr_week")), F.lit(0.02))
    stop_pct = rules.atr_mult * atr * (max(1.0, rules.horizon_days) ** 0.5 if rules.horizon_scaling else 1.0)
    stop_d = F.least(F.greatest(stop_pct, F.lit(rules.stop_min_pct / 100)), F.lit(rules.stop_max_pct / 100)) * price
    trip = rules.round_trip_bps / 1e4 * price
    target_d = rules.reward_risk * (stop_d + trip) + trip if rules.fee_adjust else rules.reward_risk * stop_d
    target_d = F.least(target_d, rules.target_cap_pct / 100 * price)
    budget = F.col("basis") * (rules.risk_pct / 100)
    most = F.col("basis") * (rules.position_pct / 100)
    most = F.when(buy, F.least(F.greatest(F.lit(0.0), most - held * price), F.coalesce("power", F.lit(float("inf"))))).otherwise(most)
    qty = F.least(budget / stop_d, most / price)
    qty = F.when(buy, qty).otherwise(F.least(qty, held))
    x = rows.withColumns({"side": side, "stop_d": stop_d, "target_d": target_d, "budget": budget, "qty": qty, "held_value": held * price}).withColumn("notional", F.col("qty") * price)
    verdict = (
        F.when(F.col("flagged"), "flagged_for_exit")
        .when(F.col("side").isNull() & (composite < -floor) & (held <= 0), "bearish_unheld")
        .when(F.col("side").isNull(), "below_score")
        .when(F.lit(not rules.add) & buy & (F.col("held_value") >= rules.least), "already_held")
        .when(buy & F.col("halted"), "halted")
        .when(buy & F.col("blocked"), "regime_blocked")
        .when((F.col("notional") < rules.least) | (F.col("qty") <= 0), "below_min_notional")
        .otherwise("taken")
    )
    return x.withColumn("verdict", verdict)


CANDIDATE = "struct<symbol:string,side:string,kind:string,trigger:string,composite:double,entry:double,stop:double,target:double,qty:double,notional:double,risk:double,fee:double,returns:array<struct<date:date,ret:double>>>"


def _exits(signals: DataFrame, scores: DataFrame, holdings: DataFrame, rules: Rules) -> DataFrame:
    """run, exits: the first signals of each run that can be sold, in their order."""
    first = signals.withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("seq", "symbol"))).where(F.col("seq") <= rules.exits)
    x = first.join(holdings.select("run", "symbol", "held"), ["run", "symbol"], "left").join(scores.select("run", "symbol", F.col("price").alias("scored")), ["run", "symbol"], "left")
    price = F.coalesce(F.when(F.col("last") != 0, F.col("last")), F.col("scored"), F.lit(0.0))
    qty = F.least("qty", F.coalesce("held", F.lit(0.0)))
    x = x.withColumn("price", price).withColumn("sold", qty).withColumn("notional", F.col("sold") * F.col("price")).where((F.col("sold") > 0) & (F.col("price") > 0) & (F.col("notional") >= rules.least))
    made = F.struct(
        "symbol", F.lit("SELL").alias("side"), F.lit("exit").alias("kind"), "trigger", F.coalesce("composite", F.lit(0.0)).alias("composite"), F.col("price").alias("entry"),
        F.coalesce("stop", "price").alias("stop"), F.coalesce("target", "price").alias("target"), F.col("sold").alias("qty"), "notional", F.lit(0.0).alias("risk"),
        (F.col("notional") * (rules.fee_bps / 1e4)).alias("fee"), F.array().cast("array<struct<date:date,ret:double>>").alias("returns"),
    ).cast(CANDIDATE)
    return x.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", made.alias("c")))), lambda s: s["c"]).alias("exits"))


def _scaled(candidates: Column, by: Column, rules: Rules, fees: bool) -> Column:
    """The candidates with their purchases scaled, without what falls under the least notional."""

    def one(c: Column) -> Column:
        x = c.withField("qty", c["qty"] * by).withField("notional", c["notional"] * by).withField("risk", c["risk"] * by)
        return F.when(c["side"] == "BUY", x.withField("fee", c["fee"] * by) if fees else x).otherwise(c)

    return F.filter(F.transform(candidates, one), lambda c: ((c["side"] == "SELL") & F.lit(fees)) | (c["notional"] >= rules.least))


def slates(scores: DataFrame, holdings: DataFrame, signals: DataFrame, state: DataFrame, returns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a run that has scores: `candidates` in order, exits first, and `skipped`, why others were left out.

    scores (run, symbol, composite, price, atr_daily, atr_week); holdings (run, symbol, held); signals (run, seq, symbol, qty, last, stop, target,
    composite, trigger); state (run, cash, equity, exposure, blocked, halted), cash and equity NULL where they can't be
    read; returns as trailing_returns gives them. A run without scores has no row; ties are in order of symbols."""
    basis = F.when(F.col("equity") >= 0, F.col("equity")).otherwise(F.lit(rules.equity))
    runs = scores.select("run").distinct().join(state, "run", "left").join(_exits(signals, scores, holdings, rules), "run", "left")
    gross = F.aggregate("exits", F.lit(0.0), lambda s, c: s + c["notional"])
    runs = runs.withColumns({
        "exits": F.coalesce("exits", F.array().cast(f"array<{CANDIDATE}>")), "basis": basis, "exposure": F.coalesce("exposure", F.lit(1.0)),
        "blocked": F.coalesce("blocked", F.lit(False)), "halted": F.coalesce("halted", F.lit(False)),
    }).withColumn("power", F.col("cash") + gross * (1 - rules.haircut_pct / 100))
    flags = signals.select("run", "symbol").distinct().withColumn("flagged", F.lit(True))
    rows = scores.join(runs.select("run", "basis", "power", "blocked", "halted"), "run").join(holdings, ["run", "symbol"], "left").join(flags, ["run", "symbol"], "left").join(returns, ["run", "symbol"], "left")
    x = _sized(rows.withColumn("flagged", F.coalesce("flagged", F.lit(False))), rules)
    way = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    made = F.struct(
        "symbol", "side", F.lit("entry").alias("kind"), F.lit("").alias("trigger"), "composite", F.col("price").alias("entry"), (F.col("price") - way * F.col("stop_d")).alias("stop"),
        (F.col("price") + way * F.col("target_d")).alias("target"), "qty", "notional", F.least("budget", "notional").alias("risk"), (F.col("notional") * (rules.fee_bps / 1e4)).alias("fee"),
        F.coalesce("returns", F.array().cast("array<struct<date:date,ret:double>>")).alias("returns"),
    ).cast(CANDIDATE)
    key = F.col("composite") if rules.relative else F.abs("composite")
    entry = F.struct((-key).alias("k"), "symbol", "verdict", (F.coalesce(F.col("side") == "BUY", F.lit(False))).alias("buy"), made.alias("c"))
    ordered = x.groupBy("run").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["symbol"] < b["symbol"], -1).otherwise(1)).alias("entries"))
    start = F.struct(F.lit(0).alias("buys"), F.array().cast(f"array<{CANDIDATE}>").alias("taken"), F.array().cast("array<string>").alias("skipped"))

    def step(s: Column, e: Column) -> Column:
        full = e["buy"] & (s["buys"] >= rules.top) & e["verdict"].isin("halted", "regime_blocked", "below_min_notional", "taken")
        taken = (e["verdict"] == "taken") & ~full
        return F.struct(
            F.when(taken & e["buy"], s["buys"] + 1).otherwise(s["buys"]).alias("buys"),
            F.when(taken, F.array_append(s["taken"], e["c"])).otherwise(s["taken"]).alias("taken"),
            F.when(taken | full, s["skipped"]).otherwise(F.array_append(s["skipped"], e["verdict"])).alias("skipped"),
        )

    folded = runs.join(ordered.withColumn("fold", F.aggregate("entries", start, step)), "run").withColumn("candidates", F.concat("exits", "fold.taken"))

    def purchases(c: Column | str, field: str) -> Column:
        return F.aggregate(F.filter(c, lambda x: x["side"] == "BUY"), F.lit(0.0), lambda s, x: s + x[field])

    cap = F.least(F.col("basis") * (rules.deployed_pct / 100) * F.col("exposure"), F.coalesce("power", F.lit(float("inf"))))
    capped = folded.withColumns({"cap": cap, "buy_total": purchases("candidates", "notional")}).withColumn(
        "candidates",
        F.when((F.col("buy_total") > F.col("cap")) & (F.col("cap") > 0), _scaled(F.col("candidates"), F.col("cap") / F.col("buy_total"), rules, fees=False))
        .when(F.col("cap") <= 0, F.filter("candidates", lambda c: c["side"] == "SELL"))
        .otherwise(F.col("candidates")),
    )
    if rules.correlation_sizing:
        buys = F.filter("candidates", lambda c: c["side"] == "BUY")

        def pair(x: Column, y: Column) -> Column:
            return F.when(x["symbol"] < y["symbol"], 2 * x["risk"] * y["risk"] * _correlation(x["returns"], y["returns"], rules)).when(x["symbol"] == y["symbol"], x["risk"] * y["risk"]).otherwise(0.0)

        square = F.aggregate("buys", F.lit(0.0), lambda s, x: s + F.aggregate("buys", F.lit(0.0), lambda t, y: t + pair(x, y)))
        capped = capped.withColumn("buys", buys).withColumn("heat", F.sqrt(F.greatest(F.lit(0.0), square)))
        most = F.col("basis") * (rules.heat_pct / 100)
        capped = capped.withColumn("candidates", F.when((F.size("buys") >= 2) & (F.col("heat") > most) & (most > 0), _scaled(F.col("candidates"), most / F.col("heat"), rules, fees=True)).otherwise(F.col("candidates")))
    return capped.select("run", "candidates", F.col("fold.skipped").alias("skipped"), "basis", "cash")


def proposals(slated: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a proposal, by rank in its run."""
    x = slated.select("run", F.posexplode("candidates").alias("at", "c")).select("run", (F.col("at") + 1).alias("rank"), "c.*").drop("returns")
    risk = F.greatest(F.abs(F.col("entry") - F.col("stop")), F.lit(1e-9))
    reward, trip = F.abs(F.col("target") - F.col("entry")), rules.round_trip_bps / 1e4 * F.col("entry")
    net = F.greatest(F.lit(0.0), reward - trip) / (risk + trip)
    entry = F.col("kind") == "entry"
    return x.withColumns({"reward_risk": F.when(entry, reward / risk).otherwise(0.0), "reward_risk_net": F.when(entry, net).otherwise(0.0)})


def skip_reasons(slated: DataFrame) -> DataFrame:
    """run, reason, n: why scored names of a run are not in its slate."""
    return slated.select("run", F.explode("skipped").alias("reason")).groupBy("run", "reason").agg(F.count("*").alias("n"))


def executed(slated: DataFrame, slippage: float = 6.0, fee_bps: float = 40.0) -> DataFrame:
    """Each proposal filled in order against the run's cash: a purchase that costs more than is left is refused, a sale
    adds what it brings. run, rank, symbol, side, fill, fee, status, cash (after it). Runs whose cash is unknown are left out."""
    cash = F.struct(F.col("cash").alias("cash"), F.array().cast("array<struct<rank:int,symbol:string,side:string,qty:double,fill:double,fee:double,status:string,cash:double>>").alias("done"))

    def step(s: Column, c: Column) -> Column:
        fill = adverse(c["entry"], c["side"], F.lit(slippage))
        fee = commission(c["qty"] * fill, F.lit(False), taker_bps=fee_bps)
        buy = c["side"] == "BUY"
        refused = buy & (c["qty"] * fill + fee > s["cash"] + 1e-9)
        left = F.when(refused, s["cash"]).otherwise(s["cash"] - F.when(buy, 1.0).otherwise(-1.0) * c["qty"] * fill - fee)
        row = F.struct(
            (F.size(s["done"]) + 1).alias("rank"), c["symbol"].alias("symbol"), c["side"].alias("side"), c["qty"].alias("qty"), fill.alias("fill"), F.when(refused, 0.0).otherwise(fee).alias("fee"),
            F.when(refused, "REJECTED_INSUFFICIENT_CASH").otherwise("FILLED").alias("status"), left.alias("cash"),
        )
        return F.struct(left.alias("cash"), F.array_append(s["done"], row).alias("done"))

    known = slated.where("cash is not null")
    return known.select("run", F.explode(F.aggregate("candidates", cash, step)["done"]).alias("d")).select("run", "d.*")
