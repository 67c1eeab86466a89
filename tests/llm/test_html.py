"""Main text of hand-made pages, with and without a template."""

from __future__ import annotations

from signal_lake.llm import html_text

SCHEMA = "page_id long, url string, html string, host string, text string"


def page(i: int, body: str) -> str:
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><style>p {{ color: red }}</style></head><body><div class='top'><div>The Site</div><div>Since 1999</div></div>"
        f"<nav><a href=/>Home</a> <a href=/x>About</a></nav><div class='story'>{body}</div>"
        "<div class='newsletter'>Sign up</div><ul class=comments><li>First!</li></ul><footer>&copy; all</footer><script>var x = '<p>no</p>';</script></body></html>"
    )


def texts(spark, rows):
    out = html_text.extract(spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.text) for r in got), key=repr)


def test_template_leaves_the_pages_own_texts(spark):
    rows = [(i, f"https://one.example.org/{i}", page(i, f"<h1>Head {i}</h1><p>Body   of\n<b>page</b> {i} &amp; more&nbsp;text<p>Second {i * 7}<br>line")) for i in range(6)]
    assert texts(spark, rows) == [(i, f"Head {i}\nBody of page {i} & more text\nSecond {i * 7} line") for i in range(6)]


def test_many_templates_are_dealt_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MOST", 0)
    test_template_leaves_the_pages_own_texts(spark)
    test_article_and_lone_pages(spark)


def test_article_and_lone_pages(spark):
    rows = [
        (1, "https://a.example.org/x", "<div>Out</div><article><header>by me</header><p>In &lt;b&gt; &#233;</p><aside>more</aside><div class='ad-box'>buy</div></article><p>Out</p>"),
        (2, "https://b.example.org", "<p>Just one<p>Two<table><tr><td>a<td>b</table>"),
        (3, None, None), (4, "", ""), (5, "not a url", "plain < text"), (5, "not a url", "plain < text"), (None, "https://c.example.org", "<p>x</p>"),
        (6, "https://d.example.org", "<div><!-- no --><p>unclosed <i>still</div>after</section>end<script>never closed"),
    ]
    assert texts(spark, rows) == sorted([(1, "In <b> é"), (2, "Just one\nTwo\na\nb"), (3, ""), (4, ""), (5, "plain < text"), (5, "plain < text"), (None, "x"), (6, "unclosed still\nafter\nend")], key=repr)


def test_no_pages(spark):
    assert texts(spark, []) == []


def test_repeated_lines_without_a_telling_class_inside_an_article(spark):
    """Two layouts on one host: a line that all pages repeat, and one of the smaller layout only. Mirrored pages keep their texts."""

    def body(i: int) -> str:
        extra = "<section><div>Our letter every Friday</div></section>" if i < 4 else ""
        return f"<body><article><h1>Head {i}</h1><div>Reading is free</div><p>Own text {i}</p>{extra}</article></body>"

    rows = [(i, f"https://two.example.org/{i}", body(i)) for i in range(12)]
    mirrored = [(20 + i, f"https://three.example.org/{i}", "<article><p>Same one</p><p>Same two</p></article>") for i in range(3)]
    want = [(i, f"Head {i}\nOwn text {i}") for i in range(12)] + [(20 + i, "Same one\nSame two") for i in range(3)]
    assert texts(spark, rows + mirrored) == sorted(want, key=repr)


def test_names_that_only_hold_a_telling_word(spark):
    """Articles under layouts and beside topics whose names hold `sidebar`, `related` or `toc`, and what such names do tell."""
    rows = [
        (1, "https://a.example.org/1", "<div class='site has-sidebar'><article><p>One</p><div class='related-work'><p>Two</p></div><p class='toc-free'>Three</p></article></div>"),
        (2, "https://b.example.org/2", "<div class='content no-sidebar'><p>One</p></div><div class='site-sidebar'>Out</div><div id='comment-list'>Out</div><div class='ad-box top'>Out</div>"),
    ]
    assert texts(spark, rows) == [(1, "One\nTwo\nThree"), (2, "One")]


def test_most_of_an_article_may_be_template(spark):
    """One host, four lines that all pages share in their articles and two blocks of their own: only the template tells them apart."""
    shared = ["Free to read", "Join our letter", "Follow us", "Printed on paper"]
    rows = [(i, f"https://m.example.org/{i}", "<article>" + "".join(f"<p>{t}</p>" for t in [f"Head {i}", *shared, f"Own text {i}"]) + "</article>") for i in range(12)]
    assert texts(spark, rows) == sorted([(i, f"Head {i}\nOwn text {i}") for i in range(12)], key=repr)


def test_classes_nest_round_layouts(spark):
    """Three layouts of one host: a line of two of them, a line of one, and a line of all."""
    wrap = {0: "<section class=a><div>{}</div></section>", 1: "<table><tr><td>{}</table>", 2: "<blockquote>{}</blockquote>"}
    rows = []
    for i in range(30):
        own = wrap[i % 3].format(f"Own text {i}")
        letter = "<p>Join our letter</p>" if i % 3 != 2 else ""
        rows.append((i, f"https://n.example.org/{i}", f"<body><article><h1>Head {i}</h1>{letter}{own}<p>All rights reserved</p></article></body>"))
    assert texts(spark, rows) == sorted([(i, f"Head {i}\nOwn text {i}") for i in range(30)], key=repr)


def test_what_some_articles_share_is_no_template(spark):
    """A sentence of a third of a host's pages that no layout holds, and pages that mirror one another among others."""
    rows = [(i, f"https://s.example.org/{i}", f"<article><h1>Head {i}</h1><p>Own text {i}</p>{'<p>As told before</p>' if i in (1, 4, 5, 9) else ''}</article>") for i in range(12)]
    rows += [(20 + i, f"https://s.example.org/m{i}", "<article><table><tr><td>Same one<td>Same two</table></article>") for i in range(5)]
    want = [(i, f"Head {i}\nOwn text {i}" + ("\nAs told before" if i in (1, 4, 5, 9) else "")) for i in range(12)] + [(20 + i, "Same one\nSame two") for i in range(5)]
    assert texts(spark, rows) == sorted(want, key=repr)


def test_long_pages_and_ties(spark):
    """Pages of 20,000 blocks; tokens that tie in every vector."""
    body = "".join(f"<p>Block {k}</p>" for k in range(20_000))
    rows = [(i, f"https://l.example.org/{i}", f"<article><p>Page {i}</p>{body}</article>") for i in range(2)]
    want = "\n".join(f"Block {k}" for k in range(20_000))
    assert texts(spark, rows) == [(i, f"Page {i}\n{want}") for i in range(2)]
