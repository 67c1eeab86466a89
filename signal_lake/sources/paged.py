"""Data sources over saved pages of candle and market interfaces: `spark.read.format("saved_pages")`, or readStream.

A page is one response's text, saved as <path>/venue=<venue>/pair=<pair>/cursor=<cursor>/ by whoever fetched it. Each symbol is a
partition that follows its venue's pages from the start: the venue says how a symbol's pairs are called and tried, what a
page holds and which cursor comes next. A symbol whose pages are broken or missing gives one row that says so in `error`
and leaves the others alone. Filters on the symbol and on the time reach the reader: they choose the partitions and the first page.

Defined cases: a number that can't be read is NULL, a row without a close is left out; of candles of one time the last one
holds; what is before the start is left out; a page without rows ends its pair, and a pair without rows gives way to the next
one; a stream reads each page once, those that are there when a batch is planned, and stops at a broken one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "venue string, symbol string, pair string, time long, open double, high double, low double, close double, volume double, error string"


class BrokenPage(Exception):
    """A page that is missing where one is due, can't be parsed or reports an error."""


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class Venue:
    """How a venue's pages are read. Times are seconds."""

    limit = 1000  # rows of a full page

    def pairs(self, symbol: str) -> list[str]:
        return [symbol]

    def first(self, start: int) -> str:
        return str(start)

    def page(self, pair: str, payload) -> list[tuple]:
        """(time, open, high, low, close, volume) of a page."""
        raise NotImplementedError

    def following(self, cursor: str, payload, rows: list[tuple], end: int, width: int) -> str | None:
        """The cursor of the next page, if there is one."""
        return None

    def missing(self, cursor: str, start: int) -> bool:
        """Whether a page that isn't there is an error (else the pages end with the one before)."""
        return True


class Binance(Venue):
    """Full pages of `limit` candles, each from the last opening and a millisecond on; quotes are tried in turn."""

    quotes = ("USDT", "USD", "USDC")

    def pairs(self, symbol):
        return [f"{symbol}{q}" for q in self.quotes]

    def first(self, start):
        return str(1000 * start)

    def page(self, pair, payload):
        return [(int(r[0]) // 1000, *map(_number, r[1:6])) for r in payload]

    def following(self, cursor, payload, rows, end, width):
        return str(int(payload[-1][0]) + 1) if len(rows) >= self.limit else None


class Coinbase(Venue):
    """Windows of `limit` candles from the start to the end, each (time, low, high, open, close, volume), newest first."""

    limit = 300

    def pairs(self, symbol):
        return [f"{symbol}-USD"]

    def page(self, pair, payload):
        return [(int(t), _number(o), _number(h), _number(low), _number(c), _number(v)) for t, low, h, o, c, v in payload]

    def following(self, cursor, payload, rows, end, width):
        after = int(cursor) + self.limit * width
        return str(after) if after < end else None


class Kraken(Venue):
    """One page, under the venue's own names."""

    alias = {"BTC": "XBT", "DOGE": "XDG"}

    def pairs(self, symbol):
        return [f"{self.alias.get(symbol, symbol)}USD"]

    def page(self, pair, payload):
        if payload.get("error"):
            raise BrokenPage(str(payload["error"]))
        held = [v for k, v in payload["result"].items() if k != "last"]
        return [(int(r[0]), *map(_number, (*r[1:5], r[6]))) for r in (held[0] if held else [])]


class Markets(Venue):
    """A series' open markets: pages name the cursor of the next one. A row is (closing time, strike, bid, ask, last, volume); `pair` is its ticker."""

    def first(self, start):
        return "first"

    def page(self, pair, payload):
        return [(_number(m.get("close")) and int(m["close"]), _number(m.get("strike")), _number(m.get("bid")), _number(m.get("ask")), _number(m.get("last")), _number(m.get("volume_fp", m.get("volume")))) for m in payload.get("markets") or []]

    def following(self, cursor, payload, rows, end, width):
        return payload.get("cursor") or None


VENUES: dict[str, type[Venue]] = {"binance": Binance, "coinbase": Coinbase, "kraken": Kraken, "markets": Markets}


class Pages:
    """The saved pages of a venue, wherever the path leads."""

    def __init__(self, path: str, venue: str):
        from pyarrow import fs  # in the task that reads: its threads must not be there when workers are forked

        self.select = fs.FileSelector
        self.files, root = fs.FileSystem.from_uri(path)
        self.root = f"{root}/venue={venue}"

    def cursors(self, pair: str) -> list[str]:
        at = self.files.get_file_info(self.select(f"{self.root}/pair={pair}", allow_not_found=True))
        return [f.base_name.removeprefix("cursor=") for f in at if f.base_name.startswith("cursor=")]

    def text(self, pair: str, cursor: str) -> str | None:
        at = self.files.get_file_info(self.select(f"{self.root}/pair={pair}/cursor={cursor}", allow_not_found=True))
        parts = sorted(f.path for f in at if f.is_file and not f.base_name.startswith(("_", ".")))
        return "".join(self.files.open_input_file(p).read().decode() for p in parts) if parts else None

    def payload(self, pair: str, cursor: str):
        """A page, or None if it isn't there."""
        raw = self.text(pair, cursor)
        if raw is None:
            return None
        try:
            return json.loads(raw)
        except ValueError as e:
            raise BrokenPage(f"page {cursor} of {pair}: {e}") from None


class Symbol(InputPartition):
    def __init__(self, symbol: str, start: int):
        self.symbol, self.start = symbol, start


class Span(InputPartition):
    """Pages of a pair that a batch of a stream reads."""

    def __init__(self, symbol: str, pair: str, cursors: list[str]):
        self.symbol, self.pair, self.cursors = symbol, pair, cursors


class Options:
    def __init__(self, options):
        self.path, self.name = options["path"], options["venue"]
        self.venue = VENUES[self.name]()
        self.venue.limit = int(options.get("limit", self.venue.limit))
        self.venue.alias = json.loads(options["alias"]) if "alias" in options else getattr(self.venue, "alias", {})
        self.symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
        self.start, self.end, self.width = int(options.get("start", 0)), int(options.get("end", 0)), int(options.get("width", 86_400))

    def read(self, payload, pair: str, cursor: str) -> list[tuple]:
        try:
            rows = self.venue.page(pair, payload)
            if any(len(r) != 6 for r in rows):
                raise ValueError("a row is too short")
            return rows
        except (AttributeError, IndexError, KeyError, TypeError, ValueError) as e:
            raise BrokenPage(f"page {cursor} of {pair}: {type(e).__name__} {e}") from None

    def rows(self, symbol: str, pair: str, found: list[tuple], start: int) -> Iterator[tuple]:
        for r in found:
            if r[4] is not None and (r[0] is None or r[0] >= start):
                yield (self.name, symbol, pair, *r, None)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.only, self.since = Options(options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("time",):
                    self.since = max(self.since or f.value, f.value)
                yield f  # a page holds more than the filter asks for, so Spark filters too

    def partitions(self):
        start = max(self.options.start, self.since or 0)
        if isinstance(self.options.venue, Coinbase) and start > self.options.start:  # windows lie where the start put them
            step = self.options.venue.limit * self.options.width
            start = self.options.start + (start - self.options.start) // step * step
        elif not isinstance(self.options.venue, Coinbase):
            start = self.options.start  # the other venues' cursors are told by the page before
        return [Symbol(s, start) for s in self.options.symbols if self.only is None or s in self.only]

    def _pair(self, pages: Pages, pair: str, start: int) -> list[tuple]:
        o, found, cursor, seen = self.options, [], self.options.venue.first(start), set()
        while cursor is not None and cursor not in seen:
            seen.add(cursor)
            payload = pages.payload(pair, cursor)
            if payload is None:
                raise BrokenPage(f"no page {cursor} of {pair}")
            rows = o.read(payload, pair, cursor)
            found += rows
            if not rows and not isinstance(o.venue, Coinbase):
                break
            cursor = o.venue.following(cursor, payload, rows, o.end, o.width)
        return found

    def read(self, partition: Symbol):
        o, pages, why = self.options, Pages(self.options.path, self.options.name), "no rows"
        for pair in o.venue.pairs(partition.symbol):
            try:
                found = self._pair(pages, pair, partition.start)
            except BrokenPage as e:  # the next pair may be whole
                why = str(e)
                continue
            if found:
                last = found if o.name == "markets" else list({r[0]: r for r in sorted(found, key=lambda r: r[0])}.values())
                yield from o.rows(partition.symbol, pair, last, o.start)
                return
        yield (o.name, partition.symbol, None, *[None] * 6, why)


class PagedStream(DataSourceStreamReader):
    """New pages as they are saved. The offset is the newest cursor of each pair, so a page is read once; pairs are not tried in turn."""

    def __init__(self, options):
        self.options = Options(options)

    def _order(self, cursor: str):
        return (0, int(cursor), "") if cursor.isdigit() else (1, 0, cursor)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        pages, found = Pages(self.options.path, self.options.name), {}
        for symbol in self.options.symbols:
            pair = self.options.venue.pairs(symbol)[0]
            if held := pages.cursors(pair):
                found[pair] = max(held, key=self._order)
        return found

    def partitions(self, start: dict, end: dict):
        pages, out = Pages(self.options.path, self.options.name), []
        for symbol in self.options.symbols:
            pair = self.options.venue.pairs(symbol)[0]
            low, high = start.get(pair), end.get(pair)
            new = [c for c in pages.cursors(pair) if high is not None and self._order(c) <= self._order(high) and (low is None or self._order(c) > self._order(low))]
            if new:
                out.append(Span(symbol, pair, sorted(new, key=self._order)))
        return out

    def read(self, partition: Span):
        o, pages = self.options, Pages(self.options.path, self.options.name)
        for cursor in partition.cursors:
            try:
                yield from o.rows(partition.symbol, partition.pair, o.read(pages.payload(partition.pair, cursor), partition.pair, cursor), o.start)
            except BrokenPage as e:
                yield (o.name, partition.symbol, partition.pair, *[None] * 6, str(e))


class SavedPages(DataSource):
    """Options: path, venue, symbols (comma-joined), start and end (seconds), width (seconds of a candle), limit (rows of a full page), alias (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedPages)
