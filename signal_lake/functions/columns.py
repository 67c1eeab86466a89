"""Scalar expressions of the domain, as Column functions. NULL means "no opinion"; NaN is never produced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 4) -> Column:
    """x to so many digits, halves away from zero, by binary arithmetic: x times ten to the digits decides. (F.round decides by the
    shortest decimal text of x, so that a half would go another way than in engines that round numbers.) Doubles that have no
    digits to round any more stay as they are."""
    x = F.col(x) if isinstance(x, str) else x
    scaled = F.abs(x) * 10.0**digits
    return F.when(scaled >= 2.0**52, x.cast("double")).otherwise(F.signum(x) * F.floor(scaled + 0.5) / 10.0**digits)


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x held between low and high; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def squash(x: Column, scale: float | Column) -> Column:
    """tanh(x / scale), and 0 where scale is 0."""
    s = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return F.when(s == 0, F.lit(0.0)).otherwise(F.tanh(x / s))


def decay(age: Column, half_life: float | Column) -> Column:
    """Half for every half-life; a negative age counts as none."""
    h = F.lit(float(half_life)) if isinstance(half_life, (int, float)) else half_life
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / h)


#: What a post's kind and the rule that matched weigh. Fixed values.
KIND_WEIGHT, RULE_WEIGHT = {"post": 1.0, "comment": 0.6}, {"cashtag": 1.0, "ticker": 0.85, "name": 0.8}


def engagement(score: Column, comments: Column) -> Column:
    return F.log1p(F.greatest(score, F.lit(0))) + 0.5 * F.log1p(F.greatest(comments, F.lit(0)))


def mention_weight(score: Column, comments: Column, kind: Column, rule: Column) -> Column:
    """What a mention counts: its post's engagement, less for comments and for weaker matches; to four digits."""
    by_kind = F.when(kind == "post", KIND_WEIGHT["post"]).otherwise(KIND_WEIGHT["comment"])
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in RULE_WEIGHT.items() for x in kv]), rule)
    return rounded((1.0 + engagement(score, comments)) * by_kind * by_rule)


def tent(days: Column, ahead: float = 30.0, behind: float = 3.0, peak: float = 7.0) -> Column:
    """Weight of an event that is `days` away: a ramp up to `peak` days before, flat to the day, then down; else NULL."""
    ramp = F.when(days > peak, (ahead - days) / (ahead - peak)).when(days >= 0, F.lit(1.0)).otherwise(1.0 + days / behind)
    return F.when((days <= ahead) & (days >= -behind), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp)))


def book_of(mode: Column) -> Column:
    """The book that a mode belongs to: paper for modes that begin so and for none, else live. All tables take this rule."""
    return F.when(F.coalesce(mode, F.lit("paper")).startswith("paper"), "paper").otherwise("live")


def commission(notional: Column, maker: Column, maker_bps: float = 40.0, taker_bps: float = 40.0, discount: float = 0.0) -> Column:
    return notional * F.when(maker, F.lit(maker_bps)).otherwise(F.lit(taker_bps)) * (1.0 - discount) / 1e4


def slippage_bps(notional: Column, adv: Column, base: float = 6.0, impact: float = 10.0) -> Column:
    """A base and an impact that grows with the root of the share of daily volume; no known volume, no impact."""
    return base + F.when(adv > 0, impact * F.sqrt(notional / adv)).otherwise(F.lit(0.0))


def capped_slippage(bps: Column, is_limit: Column, cross: float = 10.0) -> Column:
    """Slippage that a marketable limit order can't exceed by more than it may cross; never below 0."""
    return F.greatest(F.lit(0.0), F.when(is_limit, F.least(bps, F.lit(cross))).otherwise(bps))


def tradable(qty: Column, step: Column, least: Column) -> Column:
    """A quantity in whole steps, and 0 where that is under the least the exchange takes."""
    whole = floor_step(qty, step)
    return F.when(whole >= least, whole).otherwise(F.lit(0.0))


def adverse(price: Column, side: Column, bps: Column) -> Column:
    return price * (1 + F.when(F.upper(side) == "BUY", bps).otherwise(-bps) / 1e4)


def floor_step(x: Column, step: Column) -> Column:
    """x rounded down to a multiple of step, in decimals."""
    d, s = x.cast("decimal(28,10)"), step.cast("decimal(28,10)")
    return F.when(step > 0, (F.floor(d / s) * s).cast("double")).otherwise(x)


def number(text: Column) -> Column:
    """A number that may come as text; NULL where it is blank or none."""
    return text.cast("string").try_cast("double")


def implied_probability(bid: Column, ask: Column, last: Column, bid_cents: Column, ask_cents: Column, last_cents: Column) -> Column:
    """The middle of the quote, if either side is above 0, else the last trade, in dollars; else the same of the older fields in cents."""

    def of(b: Column, a: Column, trade: Column) -> Column:
        return F.coalesce(F.when((b > 0) | (a > 0), (b + a) / 2), trade)

    return F.coalesce(of(number(bid), number(ask), number(last)), of(number(bid_cents), number(ask_cents), number(last_cents)) / 100)


def strike(listed: Column, subtitle: Column, title: Column) -> Column:
    """The listed strike, or else the first dollar amount of the subtitle (of the title, where there is none)."""
    text = F.coalesce(F.nullif(subtitle, F.lit("")), title, F.lit(""))
    amount = F.regexp_extract(text, r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.coalesce(number(listed), F.regexp_replace(amount, ",", "").try_cast("double"))


def age_days(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 86400e6


def strip_html(text: Column) -> Column:
    """Tags to spaces, the five basic references decoded, white space to single spaces."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f\\x0B]+", " "))


def parse_date(text: Column) -> Column:
    """RFC-2822 first, then ISO; without an offset it is UTC; NULL where neither fits."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(text))


def fill_state(status: Column, requested: Column, filled: Column) -> Column:
    return F.when(status == "VALIDATED", "validated").when(F.coalesce(filled, F.lit(0.0)) <= 0, "none").when(filled < 0.999 * requested, "partial").otherwise("filled")
