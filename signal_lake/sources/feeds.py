"""Readers of saved feed responses into one row shape.

Each reader takes a table of responses (channel, raw: one response's text, as `spark.read.text(wholetext=True)` gives them) and
gives one row a post, comment, message, status or thread entry in the columns of POST. Responses are parsed by Spark's
own JSON and XML functions with declared schemas, so a reader is one projection with a generator and needs no shuffle.

Defined cases: a null, empty or malformed response gives no rows; a missing number is 0, a missing text is empty, a missing
author is null; a time that cannot be read is null and never drops its row; repeated responses give repeated rows
(`adapters.first_source` and the keyed merges decide among them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_lake.functions import text as tx
from signal_lake.functions.columns import age_days, implied_probability, number, rounded, strike, strip_html

#: Columns of every reader, in order.
POST = ("post_id", "channel", "source", "kind", "author", "created", "score", "comments", "title", "body", "link")
#: Confidence of a label that the author set. Fixed value.
LABELLED = 0.9
#: Characters that are kept of a news summary. Fixed value.
SUMMARY = 600

_ITEM = "struct<id string, author string, created_utc double, score double, num_comments double, title string, selftext string, body string, permalink string>"
_MESSAGE = "struct<id string, body string, created_at string, user struct<username string>, likes struct<total double>, entities struct<sentiment struct<basic string>>>"
_STATUS = "struct<id string, content string, created_at string, account struct<acct string>, favourites_count double, url string>"
_ENTRY = "no string, sub string, com string, time double, replies double, resto string"
_UNLOCK = "symbol string, ticker string, date string, unlock_date string, nextUnlock string, pct_of_circulating string, percent string, value string, note string"


def _posts(df: DataFrame, **columns: Column) -> DataFrame:
    given = {"channel": F.col("channel"), "title": F.lit(""), "comments": F.lit(0), "author": F.lit(None).cast("string")} | columns
    numbers = {c: F.coalesce(given[c].cast("long"), F.lit(0)) for c in ("score", "comments")}
    texts = {c: F.coalesce(given[c], F.lit("")) for c in ("title", "body", "link")}
    made = given | numbers | texts
    return df.select(*[made[c].alias(c) for c in POST], *[v.alias(k) for k, v in columns.items() if k not in POST])


def _parsed(raw: str, schema: str) -> Column:
    return F.from_json(raw, schema)


def _time(text: str) -> Column:
    return F.try_to_timestamp(F.col(text))


def _seconds(number: str) -> Column:
    return F.timestamp_seconds(F.col(number))


def forum(responses: DataFrame, kind: str = "post") -> DataFrame:
    """Listings of a forum: `data.children[].data` (the signed interface) or `data[]` (its archive); kind is post or comment."""
    listing = _parsed("raw", f"data struct<children array<struct<data {_ITEM}>>>").getField("data").getField("children")
    archive = _parsed("raw", f"data array<{_ITEM}>").getField("data")
    items = F.coalesce(F.transform(listing, lambda c: c["data"]), archive)
    x = responses.select("channel", F.inline(items))
    mark, body = ("t3_", "selftext") if kind == "post" else ("t1_", "body")
    comments = F.col("num_comments") if kind == "post" else F.lit(0)
    title = F.col("title") if kind == "post" else F.lit("")
    link = F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit("")))
    return _posts(x, post_id=F.concat(F.lit(mark), F.coalesce("id", F.lit(""))), source=F.lit("reddit"), kind=F.lit(kind), author=F.col("author"), created=_seconds("created_utc"), score=F.col("score"), comments=comments, title=title, body=F.col(body), link=link)


def forum_atom(responses: DataFrame, kind: str = "post") -> DataFrame:
    """The forum's Atom feed. The `/u/` before an author goes as a prefix."""
    schema = "entry array<struct<id string, title string, updated string, content string, author struct<name string>, link struct<_href string>>>"
    x = responses.where(F.length("raw") > 0).select("channel", F.inline(F.from_xml("raw", schema, {"mode": "PERMISSIVE"}).getField("entry")))
    author = F.regexp_replace(F.col("author.name"), "^/u/", "")
    return _posts(x, post_id=F.coalesce("id", F.lit("")), source=F.lit("reddit"), kind=F.lit(kind), author=author, created=_time("updated"), score=F.lit(0), title=F.col("title"), body=strip_html(F.coalesce("content", F.lit(""))), link=F.col("link._href"))


def ticker_messages(responses: DataFrame) -> DataFrame:
    """Messages of a ticker's stream, with the mention that the stream itself names: symbol (channel without `.X`), sentiment,
    confidence, weight and matched_on. A label that the author set overrides the lexicon."""
    x = responses.select("channel", F.inline(_parsed("raw", f"messages array<{_MESSAGE}>").getField("messages")))
    label, tone = F.col("entities.sentiment.basic"), tx.sentiment(F.coalesce("body", F.lit("")))
    labelled = label.isin("Bullish", "Bearish")
    polarity = F.when(label == "Bullish", 1.0).when(label == "Bearish", -1.0).otherwise(tone["polarity"])
    return _posts(
        x, post_id=F.concat(F.lit("st_"), F.coalesce("id", F.lit(""))), source=F.lit("stocktwits"), kind=F.lit("post"), author=F.col("user.username"), created=_time("created_at"),
        score=F.col("likes.total"), body=F.col("body"), link=F.concat(F.lit("https://stocktwits.com/message/"), F.coalesce("id", F.lit(""))),
        symbol=F.regexp_replace("channel", "\\.X$", ""), sentiment=polarity, confidence=F.when(labelled, LABELLED).otherwise(tone["confidence"]), weight=F.lit(1.0),
        matched_on=F.when(F.length(label) > 0, "cashtag_label").otherwise("cashtag"),
    )


def statuses(responses: DataFrame) -> DataFrame:
    """Statuses of a hashtag (channel `#tag`); those without text are left out."""
    x = responses.select("channel", F.inline(_parsed("raw", f"array<{_STATUS}>"))).withColumn("text", strip_html(F.coalesce("content", F.lit("")))).where("text <> ''")
    return _posts(x, post_id=F.concat(F.lit("md_"), F.coalesce("id", F.lit(""))), source=F.lit("mastodon"), kind=F.lit("post"), author=F.col("account.acct"), created=_time("created_at"), score=F.col("favourites_count"), body=F.col("text"), link=F.col("url"))


def board(responses: DataFrame) -> DataFrame:
    """A board's catalogue (channel `/name/`): each thread's first post and the newest replies within it, without marks and back links."""
    pages = _parsed("raw", f"array<struct<threads array<struct<{_ENTRY}, last_replies array<struct<{_ENTRY}>>>>>>")
    threads = responses.select("channel", F.explode(F.flatten(F.transform(pages, lambda p: F.coalesce(p["threads"], F.array())))).alias("t"))
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    first = F.struct(*[F.col(f"t.{n}").alias(n) for n in names])
    x = threads.select("channel", F.inline(F.concat(F.array(first), F.coalesce("t.last_replies", F.array()))))
    words = F.concat_ws(" ", F.coalesce("sub", F.lit("")), F.coalesce("com", F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(strip_html(words), ">>[0-9]+", " "), "\\s+", " "))
    x = x.withColumn("text", clean).where("text <> ''")
    parent = F.when(F.col("resto") != "0", F.col("resto"))  # a first post answers to 0
    link = F.concat(F.lit("https://boards.4chan.org"), "channel", F.lit("thread/"), F.coalesce(parent, "no", F.lit("")))
    return _posts(x, post_id=F.concat(F.lit("4c_"), F.coalesce("no", F.lit(""))), source=F.lit("biz"), kind=F.lit("post"), created=_seconds("time"), score=F.col("replies"), body=F.col("text"), link=link)


def news(responses: DataFrame, first: int) -> DataFrame:
    """channel, place, title, link, date, summary: the first so many items of each feed, RSS items or else Atom entries."""
    rss = "channel struct<item array<struct<title string, link string, pubDate string, description string>>>"
    atom = "entry array<struct<title string, link array<struct<_href string>>, updated string, published string, summary string>>"
    items = F.transform(F.from_xml("raw", rss).getField("channel").getField("item"), lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["pubDate"].alias("date"), i["description"].alias("summary")))
    entries = F.transform(F.from_xml("raw", atom).getField("entry"), lambda e: F.struct(e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), F.coalesce(F.nullif(e["updated"], F.lit("")), e["published"]).alias("date"), e["summary"].alias("summary")))
    x = responses.where(F.length("raw") > 0).select(F.col("channel").alias("__feed"), F.coalesce(items, entries).alias("__all"))
    x = x.select(F.col("__feed").alias("channel"), F.posexplode(F.slice("__all", 1, first)).alias("place", "i"))
    text = {c: F.trim(F.coalesce(f"i.{c}", F.lit(""))).alias(c) for c in ("title", "link", "date")}
    return x.select("channel", "place", *text.values(), F.substring(strip_html(F.coalesce("i.summary", F.lit(""))), 1, SUMMARY).alias("summary"))


def unlocks(responses: DataFrame, known: DataFrame) -> DataFrame:
    """symbol, date, percent, note of a feed of unlocks: a list, or one under `data` or `results`; fields go by several names, of which
    the first that says something holds. Rows of unknown symbols, without a date or with a percent that is no number are left out."""
    held = F.coalesce(F.when(F.ltrim("raw").startswith("["), _parsed("raw", f"array<struct<{_UNLOCK}>>")), *[_parsed("raw", f"{c} array<struct<{_UNLOCK}>>").getField(c) for c in ("data", "results")])
    x = responses.select(F.inline(held))

    def said(*names: str) -> Column:
        return F.coalesce(*[F.when(~F.col(n).isin("", "0", "0.0", "false"), F.col(n)) for n in names])

    percent = F.coalesce(said("pct_of_circulating", "percent", "value"), F.lit("0"))
    out = x.select(F.upper(said("symbol", "ticker")).alias("symbol"), F.substring(said("date", "unlock_date", "nextUnlock"), 1, 10).alias("date"), percent.try_cast("double").alias("percent"), F.coalesce(said("note"), F.lit("from unlock feed")).alias("note"))
    return out.where("date IS NOT NULL AND percent IS NOT NULL").join(known.select("symbol").distinct(), "symbol", "left_semi")


#: What a release counts that no headline's pattern fits, and the characters of its notes that are read and kept. Fixed values.
PLAIN_RELEASE, NOTES_READ, NOTES_KEPT = (0.30, 1), 1200, 400


def releases(responses: DataFrame, as_of: Column, days: float, events=tx.TAXONOMY, lexicon: dict[str, float] = tx.LEXICON) -> DataFrame:
    """channel (the repository), event, title, link, published, impact, direction, detail of the releases of the last `days`: what the headline and its
    notes say, or else a plain release; one before the final one is worth less, and all fade over whole days. A release
    without a time is left out."""
    schema = "array<struct<name string, tag_name string, body string, html_url string, published_at string, created_at string, prerelease boolean>>"
    x = responses.select("channel", F.inline(_parsed("raw", schema))).withColumn("published", F.try_to_timestamp(F.coalesce(F.nullif("published_at", F.lit("")), F.col("created_at"))))
    title = F.coalesce(F.nullif("name", F.lit("")), F.nullif("tag_name", F.lit("")), F.lit("release"))
    x = x.where(F.col("published") >= as_of - F.make_dt_interval(days=F.lit(int(days)))).withColumns({"title": title, "notes": F.substring(F.coalesce("body", F.lit("")), 1, NOTES_READ)})
    text = F.concat_ws(" ", "title", "notes")
    x = x.withColumn("found", tx.classify(text, tx.sentiment(text, lexicon), events))
    plain = F.struct(F.lit("release").alias("event"), F.lit(PLAIN_RELEASE[0]).alias("impact"), F.lit(PLAIN_RELEASE[1]).alias("direction"))
    x = x.withColumn("e", F.when(F.col("found.event") != "", F.col("found")).otherwise(plain))
    impact = tx.news(F.col("e"), text, age_days(as_of, F.col("published")), F.coalesce("prerelease", F.lit(False)))
    return x.select("channel", "e.event", F.concat(F.lit("[release] "), "title").alias("title"), F.coalesce("html_url", F.lit("")).alias("link"), "published", rounded(impact).alias("impact"), "e.direction", F.substring("notes", 1, NOTES_KEPT).alias("detail"))


def funding(responses: DataFrame) -> DataFrame:
    """channel (the instrument), time (milliseconds), rate of a funding history's answers: the realised rate, or else the announced one. Entries
    without a time or a rate are left out."""
    x = responses.select("channel", F.inline(_parsed("raw", "data array<struct<fundingTime string, realizedRate string, fundingRate string>>").getField("data")))
    rate = F.coalesce(F.nullif("realizedRate", F.lit("")), F.nullif("fundingRate", F.lit(""))).try_cast("double")
    return x.select("channel", F.col("fundingTime").try_cast("long").alias("time"), rate.alias("rate")).where("coalesce(time, 0) <> 0 AND rate IS NOT NULL")


def ladder_markets(responses: DataFrame, least_volume: int, types: tuple[str, ...] = ("greater", "greater_or_equal")) -> DataFrame:
    """channel (the series), event, ticker, strike, probability, volume, close_time of answers of open markets: those of a supported kind whose strike and
    probability can be read and that have traded enough."""
    fields = "ticker event_ticker strike_type floor_strike subtitle title yes_bid_dollars yes_ask_dollars last_price_dollars yes_bid yes_ask last_price volume_fp volume close_time".split()
    x = responses.select("channel", F.inline(_parsed("raw", f"markets array<struct<{', '.join(f'{f} string' for f in fields)}>>").getField("markets")))
    quote = implied_probability(*[F.col(c) for c in ("yes_bid_dollars", "yes_ask_dollars", "last_price_dollars", "yes_bid", "yes_ask", "last_price")])
    volume = F.floor(F.coalesce(number(F.col("volume_fp")), number(F.col("volume")), F.lit(0.0))).cast("long")
    out = x.where(F.lower("strike_type").isin(*types)).select("channel", F.col("event_ticker").alias("event"), "ticker", strike(F.col("floor_strike"), F.col("subtitle"), F.col("title")).alias("strike"), rounded(quote).alias("probability"), volume.alias("volume"), "close_time")
    return out.where((F.col("strike").isNotNull()) & F.col("probability").isNotNull() & (F.col("volume") >= least_volume))
