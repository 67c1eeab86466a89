"""Main text of web pages by equivalence-class template deduction.

A page is read into tokens: its block-level elements with their paths, and its texts with the paths they stand in. For each
host, tokens with the same occurrence vector over the host's pages (how often each page holds them) form an equivalence
class; Spark sums a hash of (page, count) for each token, so equal sums stand for equal vectors and no host's pages
are gathered anywhere. A class of at least MIN_CLASS tokens is valid if an element is among them, which marks the pages of a
layout (MIN_PAGES pages and LAYOUT of the host's or more), or if SUPPORT of the host's pages hold it. Classes nest: as sums of hashes add up, a
text class whose vector is that of two layouts together, or of the host's pages without one or two layouts, lies round
these layouts and is valid too. A template has slots that its pages fill differently, so a class whose pages all have the same
texts (pages that mirror one another) is none. The texts of valid classes are fixed texts of the template; the other slots are
the page's own texts, inside article and main elements as elsewhere. Slots whose elements say
that they are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
are left out; where a page has an article or main element, only slots inside it count. A name tells only if all its words do, or say
merely where something stands. The order of a class's tokens is not examined.

Defined cases: a null or empty html gives an empty text; a host with few pages has no template, and only the
elements' own roles decide; unclosed and crossing tags are closed where an outer one ends; repeated rows are pages of
their own with equal results; columns other than page_id, url and html are not carried.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import materialise, table

MIN_CLASS = 2
#: Tokens (of eight bytes) and letters of hosts that are sent to every task at most, and places for each host beyond that.
MOST, SALTS = 4_000_000, 64
MIN_PAGES = 3
#: The share of a host's pages that hold a class of texts alone, and one that an element marks as a layout. No page has more tokens than
#: its html, so at most 1 / LAYOUT times the tokens of a page can have such a share: a host's template doesn't grow with its pages.
SUPPORT, LAYOUT = 0.8, 0.01

#: Elements, by what they do to the text around them. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
LEFT_OUT = frozenset("nav header footer aside form button select option fieldset menu dialog svg math object canvas audio video head map".split()) | RAW
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS_LEFT_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets related recommended comment comments disqus reply replies cookie cookies consent notice "
    "notices alert gdpr newsletter subscribe subscription signup login share sharing social popup modal overlay pagination pager toc".split()
)
#: Words that say where or how something stands, and nothing of what it is: with them a name of WORDS_LEFT_OUT still means itself. Fixed values.
WORDS_PLAIN = frozenset(
    "site page global main top bottom left right upper lower inner outer primary secondary box block list item items wrap wrapper container section area bar "
    "row column col panel group unit slot zone text title body links link user reader js id the and of for".split()
)
MAIN = frozenset(("article", "main"))
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[^<]*|[^<]+", re.S)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _element(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's name on paths, whether it is left out, and whether it is the main one."""
    words, role, telling = [], "", False
    for kind, value in _NAMES.findall(attributes):
        value = value.strip("\"'").lower()
        if kind.lower() == "role":
            role = value.strip()
            continue
        for name in value.split():  # has-sidebar, toc-free or related-work are not what a part of them says
            parts = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
            telling = telling or (not WORDS_LEFT_OUT.isdisjoint(parts) and WORDS_LEFT_OUT.union(WORDS_PLAIN).issuperset(parts))
            words += parts
    main = tag in MAIN or role in MAIN or "articlebody" in words
    out = tag in LEFT_OUT or role in ROLES_LEFT_OUT or (not main and tag not in ("html", "body") and telling)
    return ".".join([tag, *sorted(set(words))]), out, main


def blocks(page: str) -> tuple[list[str], list[tuple[str, str, bool, bool]]]:
    """The paths of a page's elements in order, and its text blocks as (path, text, left out, main)."""
    paths: list[str] = []
    found: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, left out, main
    held: list[str] = []
    raw = ""

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, out, main = stack[-1]
                found.append((path, text, out, main))

    at, n, end = 0, len(page), None
    while at < n:
        if raw:  # up to its end tag nothing counts
            end = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
            at, raw = (end.end() if end else n), ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                held.append(m[0])
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                raw = tag
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            name, out, main = _element(tag, m[3])
            _, path, was_out, was_main = stack[-1]
            paths.append(f"{path}/{name}")
            if not m[3].endswith("/"):
                stack.append((tag, f"{path}/{name}", out or was_out, main or was_main))
    flush()
    return paths, found


def _token(kind: str, path: str, text: str = "") -> int:
    """Odd for texts, even for elements."""
    return ((xxhash.xxh64_intdigest(f"{kind}\n{path}\n{text}".encode(), 7) - (1 << 63)) & ~1) | (kind == "text")


_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")
#: Stands for the page itself among its tokens.
PAGE = 0


def _host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, token, n for each token of each page (page, url, html), and what its own slots hold."""
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            b = whole.slice(i, 500)
            out: list[tuple] = []
            for key, url, page in zip(*(c.to_pylist() for c in b.columns)):
                paths, found = blocks(page or "")
                counts = Counter(_token("element", p) for p in paths)
                counts.update(_token("text", p, t) for p, t, _, _ in found)
                host, body = _host(url), _token("body", "", "\n".join(t for _, t in _own(found)))
                out += [(host, key, PAGE, 1, body), *((host, key, t, n, body) for t, n in counts.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["host", "page", "token", "n", "body"])


def _own(found: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """A page's text blocks (path, text) that no element leaves out; of a page with a main element, those inside it."""
    has_main = any(main for *_, main in found)
    return [(path, text) for path, text, out, main in found if not out and (main or not has_main)]


SLOTS = "page_id long, url string, host string, slots array<struct<token: long, text: string>>"
_SLOT = pa.list_(pa.struct([("token", pa.int64()), ("text", pa.string())]))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's slots, with their tokens."""
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            b = whole.slice(i, 500)
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                _, found = blocks(page or "")
                rows.append((page_id, url, _host(url), [{"token": _token("text", p, t), "text": t} for p, t in _own(found)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), _SLOT))], names=["page_id", "url", "host", "slots"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed): the fixed texts of the templates of hosts that have any. A host of several layouts has the fixed texts of them all, and
    those that stand round two of them or round all but one or two."""
    read = pages.select(F.xxhash64("page_id", "url"), "url", "html")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector")
    found = read.mapInArrow(_occurrences, "host string, page long, token long, n int, body long")
    tokens = found.groupBy("host", "token").agg(F.count("*").alias("support"), vector, F.max("n").alias("most"), (F.min("body") != F.max("body")).alias("differ"))
    tokens = materialise(tokens.where((F.col("support") >= MIN_PAGES) & F.col("differ")), "tokens")
    whole = tokens.where(F.col("token") == PAGE).select("host", F.col("support").alias("pages"), F.col("vector").alias("all"))
    is_text = F.col("token").bitwiseAND(F.lit(1)) == 1
    classes = (
        tokens.where(F.col("token") != PAGE).join(whole, "host").groupBy("host", "vector", "support", "pages", "all")
        .agg(F.collect_list(F.when(is_text, F.col("token"))).alias("members"), F.count("*").alias("size"), F.min("most").alias("most"))
    )
    marked, text = F.col("size") > F.size("members"), F.size("members") > 0
    common = F.col("support") >= LAYOUT * F.col("pages")
    valid = text & (F.col("size") >= MIN_CLASS) & (F.col("support") >= F.when(marked, LAYOUT).otherwise(SUPPORT) * F.col("pages"))
    # Vectors of element classes are looked up by what is left of a text class's vector, or of what it lacks, once a layout is taken from it.
    layouts = classes.where(marked & common & (F.col("support") < F.col("pages"))).select("host", F.col("vector").alias("layout"), F.col("support").alias("share")).distinct()
    open_ = classes.where(text & ~marked & common & (F.col("support") < SUPPORT * F.col("pages")) & (F.col("most") == 1))
    sides = F.explode(F.array(F.struct(F.col("vector").alias("side"), F.col("support").alias("n")), F.struct((F.col("all") - F.col("vector")).alias("side"), (F.col("pages") - F.col("support")).alias("n"))))
    sided = open_.select("host", "members", sides.alias("s")).select("host", "members", "s.*")
    one = sided.join(layouts, ["host"]).where(F.col("share") <= F.col("n")).select("host", "members", (F.col("side") - F.col("layout")).alias("rest"), (F.col("n") - F.col("share")).alias("left"))
    two = layouts.select("host", F.col("layout").alias("rest"), F.col("share").alias("left"))
    round_ = one.where("rest = 0 and left = 0").select("host", "members").unionByName(one.where("left > 0").join(two, ["host", "rest", "left"]).select("host", "members"))
    return classes.where(valid).select("host", "members").unionByName(round_).groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("fixed"))


def _with_templates(read: DataFrame, fixed: DataFrame) -> DataFrame:
    """The pages' slots and their host's template. Templates of MOST tokens together go to every task; more of them are copied to
    SALTS places each, among which the pages of a host are dealt."""
    total = fixed.agg(F.sum(F.size("fixed") + F.length("host"))).first()[0] or 0
    if total <= MOST:
        return read.join(F.broadcast(fixed), "host", "left")
    salted = read.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    copies = fixed.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies.hint("shuffle_hash"), ["host", "__salt"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html). Pages are read twice rather than kept in between."""
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    fixed = materialise(templates(read), "templates")
    met = _with_templates(read.mapInArrow(_slots, SLOTS), fixed)
    met = met.withColumn("own", F.filter("slots", lambda b: F.col("fixed").isNull() | ~F.array_contains("fixed", b["token"])))
    text = F.array_join(F.transform("own", lambda b: b["text"]), "\n")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
