"""What the order log says about positions: average cost, terms, imports, checks before an order; and what measured ICs say about weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.operators import book, evaluation

EMPTY = 1e-12


def average_cost(log: DataFrame) -> DataFrame:
    """(symbol, qty, avg) after all fills in order of (ts, order_id): buys average in, sales leave the average, and a sale beyond
    what is held empties the position.

    The cost of a position is a linear recurrence: a buy adds to it, a sale keeps the share that is left. So the cost at the end
    is the sum of the buys since the position was last empty, each times the shares that the sales after it kept;
    these are products of fractions, kept as sums of logarithms that only shrink.
    """
    order = Window.partitionBy("symbol").orderBy("ts", "order_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    s = book.fills(log).withColumn("__s", F.sum(signed).over(so_far))
    s = s.withColumn("__q", F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(so_far))).withColumn("__before", F.coalesce(F.lag("__q").over(order), F.lit(0.0)))
    s = s.withColumn("__part", F.sum((F.col("__q") <= EMPTY).cast("long")).over(so_far))
    kept = F.when((F.col("side") != "BUY") & (F.col("__q") > EMPTY), F.log(F.col("__q") / F.col("__before"))).otherwise(F.lit(0.0))
    s = s.withColumn("__l", F.sum(kept).over(so_far))
    last = s.groupBy("symbol").agg(F.max_by(F.struct("__q", "__part", "__l"), F.struct("ts", "order_id")).alias("e")).select("symbol", F.col("e.__q").alias("qty"), F.col("e.__part").alias("__p"), F.col("e.__l").alias("__e"))
    spent = s.where("side = 'BUY'").join(last, "symbol").where(F.col("__part") == F.col("__p"))
    cost = spent.groupBy("symbol").agg(F.sum(F.col("price") * s["qty"] * F.exp(F.col("__e") - F.col("__l"))).alias("__c"))
    return last.join(cost, "symbol", "left").select("symbol", "qty", F.when(F.col("qty") > EMPTY, F.col("__c") / F.col("qty")).alias("avg"))


def paper_book(log: DataFrame, start: float) -> DataFrame:
    """What each book has after its fills: cash, begun with `start`, which purchases and all fees lower and sales raise, and the fees paid. Fees are no part of
    an average cost."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    g = book.fills(log).groupBy("book").agg(F.sum((signed * F.col("price")).cast("decimal(28,8)")).alias("__spent"), F.sum(F.abs("fee").cast("decimal(28,8)")).alias("fees"), F.count("*").alias("fills"))
    return g.select("book", (start - F.col("__spent").cast("double") - F.col("fees").cast("double")).alias("cash"), F.col("fees").cast("double").alias("fees"), "fills")


def portfolio(holdings: DataFrame, basis: DataFrame, prices: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """holdings (symbol, qty) with value and weight at prices (symbol, last), a result only where the basis (symbol, qty, avg) covers 99.9 % of
    them, and, with terms (symbol, stop, target, age_days, high), how far stop and target are. What can't be priced has no value."""
    x = holdings.join(prices, "symbol", "left").join(basis.withColumnRenamed("qty", "__b"), "symbol", "left")
    covered = (F.col("avg") > 0) & (F.coalesce("__b", F.lit(0.0)) >= 0.999 * F.col("qty"))
    total = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy())  # one row a position
    out = x.withColumn("value", F.col("qty") * F.col("last")).withColumn("weight_pct", F.when(total > 0, 100 * F.coalesce("value", F.lit(0.0)) / total))
    out = out.withColumns({"avg": F.when(covered, F.col("avg")), "pnl": F.when(covered, (F.col("last") - F.col("avg")) * F.col("qty")), "pnl_pct": F.when(covered, (F.col("last") / F.col("avg") - 1) * 100)})
    shown = ["symbol", "qty", "avg", "last", "value", "pnl", "pnl_pct", "weight_pct"]
    if terms is None:
        return out.select(*shown)
    stop, target = F.nullif("stop", F.lit(0.0)), F.nullif("target", F.lit(0.0))
    out = out.join(terms, "symbol", "left").withColumns({"stop": stop, "target": target})
    far = {"to_stop_pct": (F.col("last") / F.col("stop") - 1) * 100, "to_target_pct": (F.col("target") / F.col("last") - 1) * 100}
    return out.withColumns(far).select(*shown, "age_days", "stop", "target", *far, "high")


def portfolio_warnings(view: DataFrame, cash: float | None, configured: float, live: bool) -> DataFrame:
    """warning, n: what a portfolio view (with terms) does not know, and whether its equity is over 20 % away from the configured one."""
    equity = (cash or 0.0) + F.col("__v")
    g = view.agg(
        F.count_if(F.col("last").isNull()).alias("unpriced"), F.count_if(F.col("age_days").isNull()).alias("no_terms"), F.count_if(F.col("avg").isNull() & F.lit(live)).alias("no_basis"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("__v")
    ).withColumns({
        "no_balance": F.lit(int(cash is None)).cast("long"), "basis_off": (F.lit(cash is not None and configured > 0) & (F.abs(equity - configured) / (configured or 1.0) > 0.20)).cast("long"),
    })
    kinds = ("unpriced", "no_terms", "no_basis", "no_balance", "basis_off")
    return g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("warning"), F.col(k).alias("n")) for k in kinds])).alias("w")).select("w.*").where("n > 0")


#: States of an exchange's order that still rest, and of a pair of orders that is over. Fixed values.
OPEN, OVER = ("NEW", "PARTIALLY_FILLED", "PENDING_NEW"), ("ALL_DONE", "REJECT")


def protection_status(resting: DataFrame, legs: DataFrame) -> DataFrame:
    """resting protective orders (id, symbol, kind, list_status) that the exchange has finished with, and how: filled if any of their legs (id, status,
    executed) was. A pair is finished by its own status, a single order by its leg's; one whose legs are not known stays."""
    g = legs.groupBy("id").agg(F.max("executed").alias("__e"), F.min(F.col("status").isin(*OPEN).cast("int")).alias("__open"))
    over = F.when(F.col("kind") == "oco", F.col("list_status").isin(*OVER)).otherwise(F.col("__open") == 0)
    return resting.join(g, "id").where(over).select("id", "symbol", "kind", F.when(F.coalesce("__e", F.lit(0.0)) > 0, "filled").otherwise("cancelled").alias("status"))


def stale_terms(terms: DataFrame, holdings: DataFrame, prices: DataFrame, dust: float = 1.0) -> DataFrame:
    """The terms (symbol) whose position is worth less than `dust`; an unknown price is not zero, but nothing held is."""
    x = terms.select("symbol").join(holdings, "symbol", "left").join(prices, "symbol", "left")
    qty = F.coalesce("qty", F.lit(0.0))
    return x.where(F.when(qty <= 0, F.lit(0.0)).otherwise(qty * F.col("last")) < dust).select("symbol")


def protection(terms: DataFrame, free: DataFrame, prices: DataFrame, resting: DataFrame, least: float) -> DataFrame:
    """symbol, qty, why of positions without a resting order: why one can't be placed, or NULL where a stop is to be placed. Unpriced ones are left out."""
    x = terms.join(resting.select("symbol").distinct(), "symbol", "left_anti").join(free, "symbol", "left").join(prices.where("last is not null"), "symbol")
    qty, stop, target = F.coalesce("qty", F.lit(0.0)), F.nullif("stop", F.lit(0.0)), F.nullif("target", F.lit(0.0))
    why = F.when(qty * F.col("last") < least, "small").when(stop.isNull(), "no stop").when(F.col("last") <= stop, "through the stop").when(F.col("last") >= target, "past the target")
    return x.select("symbol", qty.alias("qty"), why.alias("why"))


def merged_terms(held: DataFrame, new: DataFrame) -> DataFrame:
    """The terms (symbol, opened, entry, stop, target, high) after new ones: entry, stop and target are replaced, the highest price only rises, and the day
    of opening is kept."""
    n = new.select("symbol", *[F.col(c).alias(f"__{c}") for c in ("opened", "entry", "stop", "target", "high")])
    x = held.join(n, "symbol", "full")
    fresh = F.col("__entry").isNotNull()
    return x.select("symbol", F.coalesce("opened", "__opened").alias("opened"), *[F.when(fresh, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("entry", "stop", "target")], F.greatest("high", "__high").alias("high"))


#: Assets that count as the quote currency. Fixed values.
STABLE = ("USDT", "USDC", "USD", "BUSD", "DAI")


def fill_fees(fills: DataFrame) -> DataFrame:
    """For each order of fills (order_id, symbol, price, qty, fee, fee_asset): quantity, mean price by volume, and the fee in the quote currency: fees in
    the asset itself are worth the mean price, and one in any other asset leaves the order's fee unknown. So does no fee at all."""
    paid = F.col("fee_asset").isNotNull()
    g = fills.groupBy("order_id", "symbol").agg(
        F.sum("qty").alias("qty"), F.sum(F.col("price") * F.col("qty")).alias("__quote"), F.sum(F.when(F.col("fee_asset").isin(*STABLE), F.col("fee"))).alias("__usd"), F.sum(F.when(F.col("fee_asset") == F.col("symbol"), F.col("fee"))).alias("__base"),
        F.bool_or(paid & ~F.col("fee_asset").isin(*STABLE) & (F.col("fee_asset") != F.col("symbol"))).alias("__other"), F.bool_or(paid).alias("__paid"),
    )
    price = F.when(F.col("qty") != 0, F.col("__quote") / F.col("qty"))
    fee = F.when(F.col("__paid") & ~F.coalesce("__other", F.lit(False)), F.coalesce("__usd", F.lit(0.0)) + F.coalesce(F.col("__base") * price, F.lit(0.0)))
    return g.select("order_id", "symbol", "qty", price.alias("price"), fee.alias("fee"))


def position_terms(log: DataFrame) -> DataFrame:
    """Of each position (symbol, book): when it was opened (kept), its newest entry, and the highest entry so far."""
    at = F.struct("ts", "order_id")
    return book.fills(log).where("side = 'BUY'").groupBy("symbol", "book").agg(F.min("ts").alias("opened"), F.max_by("price", at).alias("entry"), F.max("price").alias("high_water"), F.max("ts").alias("updated"))


def imported(fills: DataFrame, ours: DataFrame, stored: DataFrame, since: DataFrame) -> DataFrame:
    """One row for each exchange order (order_ref, symbol, ts, side, qty, price) that we did not send (ours: order_ref), is not stored with
    the same quantity (stored: order_ref, qty), and began when its symbol was tracked (since: symbol, start)."""
    g = fills.groupBy("order_ref", "symbol").agg(F.min("ts").alias("ts"), F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("__quote"), F.min("side").alias("side"))
    new = g.where("qty > 0").join(ours, "order_ref", "left_anti").join(since, "symbol").where(F.col("ts") >= F.col("start"))
    known = stored.select("order_ref", F.col("qty").alias("__held"))
    new = new.join(known, "order_ref", "left").where(F.col("__held").isNull() | (F.abs(F.col("__held") - F.col("qty")) > EMPTY))
    return new.select("order_ref", "symbol", "ts", "side", "qty", (F.col("__quote") / F.col("qty")).alias("price"))


def preflight(entry: Column, live: Column, notional: Column, is_limit: Column, guard: float = 75.0, cross: float = 10.0, least: float = 10.0) -> Column:
    """Why an order would be refused: drift beyond the guard (for limit orders at least cross + 20 basis points; 0 turns it off), or under the least notional."""
    allowed = F.when(is_limit, F.lit(max(guard, cross + 20.0))).otherwise(F.lit(guard))
    return F.array_compact(F.array(F.when(((live / entry - 1) * 1e4 > allowed) & F.lit(guard > 0), "drift"), F.when(notional < least, "min_notional")))


def dampened(state: Column, scale: Column, score: Column, off_at: float = -0.6, least: float = 0.5) -> Column:
    """struct(state, scale): a macro score never raises exposure, cuts it in proportion, and from off_at down turns it off."""
    off = score <= off_at
    cut = F.when(score < 0, scale * F.greatest(F.lit(least), 1 + score)).otherwise(scale)
    return F.struct(F.when(off, "risk_off").otherwise(state).alias("state"), F.when(off, F.lit(0.0)).otherwise(cut).alias("scale"))


def recommended_weights(ics: DataFrame, least_t: float = 2.0) -> DataFrame:
    """(family, weight, clear, verdict) from ICs (family, mean_ic, t) of one horizon: weights in proportion to positive, significant
    ICs, NULL where fewer than two families are clear; the verdict says whether the composite is worse than its best part."""
    whole = Window.partitionBy()  # one row a family
    clear = (F.col("mean_ic") > 0) & (F.abs("t") >= least_t)
    part = F.col("family") != "composite"
    x = ics.withColumn("__w", F.when(part & F.coalesce(clear, F.lit(False)), F.col("mean_ic")).otherwise(F.lit(0.0)))
    x = x.withColumn("clear", F.sum((F.col("__w") > 0).cast("long")).over(whole)).withColumn("__t", F.sum("__w").over(whole))
    x = x.withColumn("__c", F.max(F.when(~part, F.col("mean_ic"))).over(whole)).withColumn("__b", F.max(F.when(part, F.col("mean_ic"))).over(whole))
    verdict = F.when(F.col("__c") < F.col("__b") - 0.01, "worse").when(F.col("__c").isNotNull(), "adds")
    return x.where(part).select("family", F.when(F.col("clear") >= 2, F.col("__w") / F.col("__t")).alias("weight"), "clear", verdict.alias("verdict"))


def half_ics(pairs: DataFrame, horizon: int) -> DataFrame:
    """Mean rank IC of each family in the first and the second half of the runs; the run in the middle begins the second."""
    at = pairs.where(F.col("horizon") == horizon)
    runs = at.select("run").distinct()
    order = Window.orderBy("run")  # one row a run
    numbered = runs.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    half = numbered.select("run", F.when(F.col("__i") < F.floor(F.col("__n") / 2), "first_half").otherwise("second_half").alias("half"))
    per = evaluation.spearman(at, ["family", "run"]).where("rho is not null").join(half, "run")
    return per.groupBy("family").pivot("half", ["first_half", "second_half"]).agg(F.avg("rho"))
