"""Tone, mentions and headline classes of texts, as native expressions over constant tables.

The lexicon and the taxonomy are parameters; those of the domain are in lexicon.py.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from signal_lake.functions.columns import decay, rounded
from signal_lake.functions.lexicon import AHEAD, DENIED, EMOJI, EMOJI_MOST, HALF_LIFE, HEADLINES, INTENSIFIERS, LEXICON, NEGATORS, PRERELEASE, word


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _counted(text: Column, what: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, what, F.lit("")))) / F.length(what))


#: A pattern between places where a word begins and, if at all, ends.
_BETWEEN = re.compile(r"\(\^\|\[\^([A-Za-z0-9_-]+)\]\)(.*)(\(\[\^\1\]\|\$\))", re.S)
_FROM = re.compile(r"\(\^\|\[\^([A-Za-z0-9_-]+)\]\)(.*)", re.S)


def starts(pattern: str) -> list[str] | None:
    """Literals of which whatever the pattern finds begins with one; None where they are not seen at once."""
    if re.search(r"\\|\(\?|[\^$.]|\[\^", re.sub(r"\[[.]\]|\\[ntr]", "_", pattern)):
        return None
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return None
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for part in parts:
        if part.startswith("("):
            depth, end = 0, 0
            for end, c in enumerate(part):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            inner = None if part[end + 1 : end + 2] in ("?", "*", "{") and part[end + 1 :] else starts(part[1:end])
            if inner is None:
                return None
            out += inner
            continue
        run = re.match(r"[^][(){}?*+|\\]*", part)[0]
        if part[len(run) : len(run) + 1] in ("?", "*", "{") and part[len(run) :]:
            run = run[:-1]
        if not run:
            return None
        out.append(run)
    return out


def found(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), for patterns between word boundaries at a fraction of the work: the boundaries are looked at, not matched, and
    a text that holds none of the literals with which a find would begin is not searched."""
    between = _BETWEEN.fullmatch(pattern) or _FROM.fullmatch(pattern)
    if not between or re.search(r"\\[0-9k]", pattern):
        return text.rlike(pattern)
    edge, body = between[1], between[2]
    hit = text.rlike(f"(?<![{edge}]){body}" + (f"(?![{edge}])" if between.re is _BETWEEN else ""))
    literals = starts(body)
    if literals is None:
        return hit
    held = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        held = held | F.contains(text, F.lit(x))
    return held & hit


def sentiment(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """struct(polarity in -1..1, confidence in 0..1), both to 4 digits.

    URLs are dropped; phrases count wherever they stand and are blanked; each emoji counts up to EMOJI_MOST times; a word's
    value is turned (x -0.75) if one of the three words before it negates, and multiplied by the first of them that intensifies.
    """
    raw = F.coalesce(text, F.lit(""))
    low = F.regexp_replace(F.lower(raw), "https?://[^ \\t\\n\\r]+", " ")
    words = {k: v for k, v in lexicon.items() if " " not in k}
    phrases = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(v).alias("v")) for k, v in lexicon.items() if " " in k] or [F.struct(F.lit("\0").alias("p"), F.lit(0.0).alias("v"))])

    def blanked(a: Column, x: Column) -> Column:
        n = _counted(a["low"], x["p"])
        return F.struct(F.replace(a["low"], x["p"], F.lit(" ")).alias("low"), (a["total"] + n * x["v"]).alias("total"), (a["hits"] + n).alias("hits"))

    # each value is bound by a lambda where it is used twice: else it would be worked out as often as it is named
    marks = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(v).alias("v")) for k, v in EMOJI.items()])
    seen = F.transform(marks, lambda x: F.struct(F.least(_counted(raw, x["p"]), F.lit(EMOJI_MOST)).alias("n"), x["v"].alias("v")))
    sums = F.aggregate(seen, F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("hits")), lambda a, x: F.struct((a["total"] + x["n"] * x["v"]).alias("total"), (a["hits"] + x["n"]).alias("hits")))
    start = F.transform(F.array(sums), lambda e: F.struct(low.alias("low"), e["total"].alias("total"), e["hits"].alias("hits")))[0]
    first = F.aggregate(phrases, start, blanked)
    values = _lookup(words)

    def scored(begun: Column) -> Column:
        t = F.regexp_extract_all(begun["low"], F.lit("[a-z0-9']+"), F.lit(0))
        of = F.transform(F.array(t), of_words)
        return F.transform(of, lambda o: F.struct((begun["total"] + o["total"]).alias("total"), (begun["hits"] + o["hits"]).alias("hits")))[0]

    def of_words(t: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.slice(t, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            value = F.try_element_at(values, w)
            turned = F.when(F.exists(before, lambda b: b.isin(list(NEGATORS))), value * -0.75).otherwise(value)
            strong = F.filter(before, lambda b: b.isin(list(INTENSIFIERS)))
            told = turned * F.when(F.size(strong) > 0, F.try_element_at(_lookup(INTENSIFIERS), F.get(strong, F.lit(0)))).otherwise(F.lit(1.0))
            return F.when(w.isin(list(words)), told)  # a set, and nothing else is looked at for most words; maps are searched from their start

        found = F.filter(F.transform(t, one), lambda v: v.isNotNull())
        return F.struct(F.aggregate(found, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size(found).alias("hits"))

    def told(got: Column) -> Column:
        n, total = got["hits"], got["total"]
        polarity = F.when(n > 0, F.tanh(total / (2.5 * F.sqrt(n)))).otherwise(F.lit(0.0))
        return F.struct(rounded(polarity, 4).alias("polarity"), rounded(F.least(F.lit(1.0), n / 6.0), 4).alias("confidence"))

    return F.transform(F.transform(F.array(first), scored), told)[0]


@dataclass(frozen=True)
class Asset:
    symbol: str
    names: tuple[str, ...]
    ambiguous: bool = False


def mentions(text: Column, assets: list[Asset]) -> Column:
    """array<struct(symbol, rule)>: for each asset its best rule, a cashtag before a name before a ticker. A name is found in any case, a
    ticker only as written and only if it is not an ordinary word. Words end where no ASCII letter or digit follows."""
    t = F.coalesce(text, F.lit(""))
    once = F.struct(t.alias("t"), F.lower(t).alias("low"), F.contains(t, F.lit("$")).alias("tagged"))

    def of(x: Column) -> Column:
        rules = []
        for a in assets:
            names = "|".join(n.lower() for n in a.names)
            hit = F.when(x["tagged"] & x["t"].rlike(f"(?i)[$]{a.symbol}([^a-z0-9]|$)"), "cashtag").when(found(x["low"], f"(^|[^a-z0-9])({names})([^a-z0-9]|$)"), "name")
            if not a.ambiguous:
                hit = hit.when(found(x["t"], f"(^|[^A-Za-z0-9])({a.symbol})([^A-Za-z0-9]|$)"), "ticker")
            rules.append(F.struct(F.lit(a.symbol).alias("symbol"), hit.alias("rule")))
        return F.filter(F.array(*rules), lambda m: m["rule"].isNotNull())

    return F.transform(F.array(once), of)[0]


@dataclass(frozen=True)
class Event:
    name: str
    pattern: str
    impact: float
    direction: int
    tone_driven: bool = False


#: The kinds of headlines of the domain.
TAXONOMY = [Event(name, word(pattern), impact, direction, by_tone) for name, pattern, impact, direction, by_tone in HEADLINES]


def news(event: Column, text: Column, age_days: Column, prerelease: Column | None = None) -> Column:
    """The weight of what classify() found, at its age: what is ahead fades slower than what was; a release fades by its own half-life over
    whole days, and one before the final one is worth less."""
    ahead = F.lower(F.coalesce(text, F.lit(""))).rlike(word(AHEAD, False))
    if prerelease is not None:
        return event["impact"] * F.when(prerelease, F.lit(PRERELEASE)).otherwise(F.lit(1.0)) * decay(F.floor(age_days), HALF_LIFE["release"])
    return event["impact"] * F.when(ahead, decay(age_days, HALF_LIFE["ahead"])).otherwise(decay(age_days, HALF_LIFE["news"]))


def classify(text: Column, tone: Column, events: list[Event] = TAXONOMY, forward: str = word(AHEAD, False), denial: str = word(DENIED)) -> Column:
    """struct(event, impact, direction): the first event whose pattern is found, discounted if denied, raised if ahead; a topic takes its
    direction from the tone, an event of a weak prior yields to a strong contrary tone and a strong one is discounted."""
    once = F.struct(tone.alias("tone"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))  # else each event would work the tone out anew

    def scaled(x: Column) -> Column:
        scale = F.when(found(x["low"], denial), 0.35).otherwise(1.0) * F.when(found(x["low"], forward), 1.25).otherwise(1.0)
        return F.struct(x["tone"].alias("tone"), x["low"].alias("low"), scale.alias("scale"))

    return F.transform(F.transform(F.array(once), scaled), lambda x: _classified(x["low"], x["tone"], x["scale"], events))[0]


def _classified(low: Column, tone: Column, scale: Column, events: list[Event]) -> Column:
    has = (tone["confidence"] >= 0.15) & (F.abs(tone["polarity"]) >= 0.20)
    sign = F.when(tone["polarity"] > 0, 1).otherwise(-1)
    case = None
    for e in events:
        base = F.lit(e.impact) * scale
        if e.tone_driven:
            impact, direction = F.when(has, base).otherwise(base * 0.45), F.when(has, sign).otherwise(F.lit(e.direction))
        else:
            contrary = has & (F.abs(tone["polarity"]) >= 0.30) & (sign != e.direction)
            impact = F.when(contrary, base * (0.85 if e.impact < 0.60 else 0.55)).otherwise(base)
            direction = F.when(contrary, sign).otherwise(F.lit(e.direction)) if e.impact < 0.60 else F.lit(e.direction)
        out = F.struct(F.lit(e.name).alias("event"), rounded(F.least(F.lit(1.0), impact), 4).alias("impact"), direction.alias("direction"))
        case = F.when(found(low, e.pattern), out) if case is None else case.when(found(low, e.pattern), out)
    return case.otherwise(F.struct(F.lit("").alias("event"), F.lit(0.0).alias("impact"), F.lit(0).alias("direction")))
