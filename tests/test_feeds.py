"""Feed readers on hand-made responses: awkward, malformed, empty and repeated ones."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from signal_lake.sources import feeds

BROKEN = [None, "", "not {json", "[]", "{}", '{"data": null}', '{"error": "limit"}', "<html><body>503</body></html>"]
READERS = [feeds.forum, feeds.forum_atom, feeds.ticker_messages, feeds.statuses, feeds.board, lambda r: feeds.news(r, 3)]


def responses(spark, *raws, channel="c"):
    return spark.createDataFrame([(channel, r if r is None or isinstance(r, str) else json.dumps(r), 7) for r in raws], "channel string, raw string, title long")


@pytest.mark.parametrize("i", range(len(READERS)))
def test_malformed_and_empty_responses_give_no_rows(spark, i):
    assert READERS[i](responses(spark, *BROKEN)).collect() == []
    assert READERS[i](spark.createDataFrame([], "channel string, raw string")).collect() == []


def test_forum_rows(spark):
    item = {"id": "a", "author": "user1", "created_utc": 1700000000.0, "score": -3, "num_comments": 4, "title": "T", "selftext": "S", "body": "B", "permalink": "/r/x"}
    got = feeds.forum(responses(spark, {"data": {"children": [{"data": item}, {"data": {"id": "b"}}]}}, {"data": [item]})).collect()
    assert sorted(r.post_id for r in got) == ["t3_a", "t3_a", "t3_b"]
    first = next(r for r in got if r.post_id == "t3_a")
    assert (first.author, first.created, first.score, first.comments, first.title, first.body, first.link) == ("user1", datetime(2023, 11, 14, 22, 13, 20), -3, 4, "T", "S", "https://reddit.com/r/x")
    bare = next(r for r in got if r.post_id == "t3_b")
    assert (bare.author, bare.created, bare.score, bare.title, bare.body) == (None, None, 0, "", "")
    comment = feeds.forum(responses(spark, {"data": [item]}), "comment").first()
    assert (comment.post_id, comment.comments, comment.title, comment.body) == ("t1_a", 0, "", "B")


def test_forum_atom_takes_the_prefix_from_the_author(spark):
    entry = '<entry><author><name>/u/user1</name></author><id>t3_q</id><title>T</title><updated>2023-11-14T22:13:20+00:00</updated><content type="html">&lt;p&gt;Hi  there&lt;/p&gt;</content><link href="L"/></entry>'
    undated = "<entry><id>t3_r</id><updated>soon</updated></entry>"
    got = {r.post_id: r for r in feeds.forum_atom(responses(spark, f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}{undated}</feed>')).collect()}
    assert (got["t3_q"].author, got["t3_q"].body, got["t3_q"].link, got["t3_q"].created) == ("user1", "Hi there", "L", datetime(2023, 11, 14, 22, 13, 20))
    assert got["t3_r"].created is None


def test_a_label_overrides_the_lexicon(spark):
    text = "bullish moon gains"
    messages = [{"id": i, "body": text, "entities": {"sentiment": {"basic": b} if b else None}} for i, b in enumerate(["Bearish", "Bullish", None])]
    got = {r.post_id: r for r in feeds.ticker_messages(responses(spark, {"messages": messages}, channel="BTC.X")).collect()}
    assert [got[f"st_{i}"].sentiment for i in (0, 1)] == [-1.0, 1.0] and got["st_2"].sentiment > 0
    assert [got[f"st_{i}"].matched_on for i in range(3)] == ["cashtag_label", "cashtag_label", "cashtag"]
    assert {r.symbol for r in got.values()} == {"BTC"} and got["st_0"].confidence == 0.9


def test_board_has_first_posts_and_replies(spark):
    pages = [{"threads": [{"no": 1, "sub": "a", "com": "b", "time": 1, "resto": 0, "replies": 9, "last_replies": [{"no": 2, "com": "&gt;&gt;1<br>hm", "resto": 1}, {"no": 3, "com": "&gt;&gt;1", "resto": 1}]}, {"no": 4, "com": "x"}]}, {}]
    got = {r.post_id: (r.body, r.score, r.link) for r in feeds.board(responses(spark, pages, channel="/biz/")).collect()}
    at = "https://boards.4chan.org/biz/thread/"
    assert got == {"4c_1": ("a b", 9, at + "1"), "4c_2": ("hm", 0, at + "1"), "4c_4": ("x", 0, at + "4")}


def test_news_takes_the_first_of_each_feed(spark):
    item = "<item><title> T{0} </title><link>L</link><pubDate>D</pubDate><description>&lt;b&gt;" + "s" * 700 + "</description></item>"
    rss = f"<rss><channel>{''.join(item.format(i) for i in range(5))}</channel></rss>"
    one = "<rss><channel><item><title>only</title></item></channel></rss>"
    got = feeds.news(responses(spark, rss, one), 2).orderBy("title").collect()
    assert [(r.place, r.title, r.date, len(r.summary)) for r in got] == [(0, "T0", "D", 600), (1, "T1", "D", 600), (0, "only", "", 0)]


def test_unlocks_take_the_first_name_that_says_something(spark):
    rows = [{"ticker": "btc", "date": "", "unlock_date": "2024-05-01T10:00", "percent": 0, "value": 2.5}, {"symbol": "XXX", "date": "2024-01-01"}, {"symbol": "BTC", "date": "2024-01-02", "percent": "n/a"}, {"symbol": "BTC"}, {"symbol": "BTC", "date": "2024-03-03", "note": "n"}]
    known = spark.createDataFrame([("BTC",), ("BTC",)], "symbol string")
    for held in (rows, {"data": rows}, {"results": rows}):
        got = feeds.unlocks(responses(spark, held, *BROKEN), known).orderBy("date").collect()
        assert [tuple(r) for r in got] == [("BTC", "2024-03-03", 0.0, "n"), ("BTC", "2024-05-01", 2.5, "from unlock feed")]
