from bindery.llm import html

NAV = '<nav><ul><li><a href="/x">Home</a></li><li>About</li></ul></nav>'
PAGE = ("<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>" + NAV +
        "<!-- ad --><div class=\"ad\">Buy now</div><article><h1>One\n two</h1><p><b>Bold te</b>xt &lt;3<br>next<p>Second &amp;amp; &eacute;"
        "<aside>side</aside><form>Name <input></form><div class='user-comments'><article>I agree</article></div></article><footer>&copy; host</footer></body></html>")


def test_article(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", None), (3, None, ""), (4, "http://[bad", "<p>open <b>text"),
            (None, "http://a.example/1", PAGE), (1, "http://a.example/1", PAGE), (6, "x", "<script>never closed <p>gone"), (7, "x", "a < b > c <")]
    got = html.extract(spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, key long, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[1] == "One two Bold text <3 next Second &amp; é"
    assert text[None] == text[1] and text[2] == "" and text[3] == "" and text[4] == "open text" and text[6] == "" and text[7] == "a < b > c <"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _site(i):
    """A page without an article element: what all pages of the host share is template."""
    return (f"<html><body><div>Our Site, the best</div><div><p>Story {i} begins</p><p>and goes on, {i * 7}</p></div>"
            "<div>All rights reserved by us</div></body></html>")


def test_template_of_a_host(spark, monkeypatch):
    rows = [(i, f"http://b.example/{i}", _site(i)) for i in range(40)] + [(99, "http://c.example/", _site(99))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    want = {i: f"Story {i} begins and goes on, {i * 7}" for i in range(40)} | {99: "Our Site, the best Story 99 begins and goes on, 693 All rights reserved by us"}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    monkeypatch.setattr(html, "TEMPLATES", 0)  # tables too large to send
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_alignment_is_the_largest_matching():
    a = html.parse("<ul><li>1<li>2<li>3</ul><p>x")
    b = html.parse("<div>new</div><ul><li>1<li>3</ul><p>y")
    pairs = [(p.tag, p.text(), q.text()) for p, q in html.align(a, b)]
    assert ("p", "x", "y") in pairs and sum(t == "li" for t, _, _ in pairs) == 2 and not any(t == "div" for t, _, _ in pairs)
    deep = html.parse("<div>" * 5000 + "x")
    assert html.align(deep, deep) and html.main_text(deep, set(), "") == "x"


def test_template_whatever_the_layout(spark, monkeypatch):
    """Pages of many hosts, each in a partition of its own; a menu of undeclared markup inside the article, and one that the first pages lack."""
    def page(h, i):
        late = "<div>Read our newest offers</div>" if i % 2 else ""
        return (f"<html><body><div>Site {h}</div><article><div>Home About Contact {h}</div><p>Story {h} {i} begins</p><p>and ends {i * 7}</p>{late}"
                f"<div>Rights of {h}</div></article></body></html>")

    rows = [(h * 100 + i, f"http://h{h}.example/{i}", page(h, i)) for h in range(6) for i in range(30)]
    rows += [(1000 + i, f"http://copy.example/{i}", page(9, 0)) for i in range(12)]  # copies are no template of each other
    want = {h * 100 + i: f"Story {h} {i} begins and ends {i * 7}" for h in range(6) for i in range(30)}
    want |= {1000 + i: "Home About Contact 9 Story 9 0 begins and ends 0 Rights of 9" for i in range(12)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for laid in (pages.repartition(64, "page_id"), pages.coalesce(1)):
        assert {r.page_id: r.text for r in html.extract(laid).collect()} == want
    monkeypatch.setattr(html, "GROUP", 15)  # several groups a host
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
