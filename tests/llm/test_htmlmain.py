import random
import time

import pytest

from millrace.llm import htmlmain

LONG = "Some words that make up a paragraph of the text, long enough to count."
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-head"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">Other</a></ul></nav>
<div class="cookie-notice"><p>no cookies please, %s</p></div><div class="layout-3"><div class="post-body x17"><h1>Title &amp; more</h1>
<p><b>First&nbsp;part<br>of  it. %s<p>Second <a href="#">link</a> here. <!-- no --></p><div class="advert"><p>Buy this</p></div>
<ul><li>one</li><li>two</li></ul><blockquote>Quoted &lt;text&gt;</blockquote><div id="comments"><p>nice post %s</p></div>
<form><p>Join us</p></form></div><div class="sidebar"><p>side %s</p></div></div><footer>&copy; me</footer>"""


def page(body):
    return PAGE % (LONG, LONG, LONG * 3, LONG * 2) if body is None else body


WANT = f"Title & more First part of it. {LONG} Second link here. one two Quoted <text>"


def test_one_page():
    assert htmlmain.article(page(None), None) == WANT


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<nav>only menu</nav>", ""), ("<p>a<p>b", "a b"), ("x <b y", "x <b y"), ("<article><p class='hidden-gem'>gem</p></article>", "gem"), ("<select><p>open", "open"), ("<p title=it's>a</p><p>b's", "a b's"), ("<p title='a > b'>c", "c"), ("<p>a<!-->b", "ab"), ("<svg/><p>d", "d"), ("</div></p>x", "x"), ("<article>cut off <p>in the mid", "cut off in the mid"),
    ("<body><main><h1>T</h1><section><p>one one one</p></section><section><p>two two two</p></section><section><p>three</p></section></main><footer>f</footer>", "T one one one two two two three"),
    ("<div class='entry'><p>a &#233; &eacute; &unknown; < b</p></div>", "a é é &unknown; < b"),
    ("<table><tr><td>left<td>right</table>", "left right"), ("<article><p>x</p><script>if (a<b) {}</script></article><!-- open", "x"),
])
def test_small_pages(html, want):
    assert htmlmain.article(html, None) == want


@pytest.mark.parametrize(("around", "want"), [
    ("<article><h1>Title</h1><p>lead</p><div class=body>%s</div></article>", "Title lead {}"),
    ("<article><section class=intro><p>start</p></section><section class=main><p>%s</p></section><section class=end><p>close</p></section></article>", "start {} close"),
    ("<main><header><h1>Title</h1></header><p>lead</p><article><div class=body><p>%s</p></div></article></main>", "Title lead {}"),
    ("<div class='post'><h1>Title</h1><div class=ad><p>buy</p></div><p>lead</p><div class=body><p>%s</p></div><div class=coda><p>close</p></div></div>", "Title lead {} close"),
    ("<div id=content><div class=story><p>%s</p></div><div class=sidebar><p>side</p></div><div class=extra><p>short</p></div></div>", "{}"),
    ("<main><article class=story><h1>T</h1><div class=body><p>%s</p></div></article><article class=card><p>other</p></article><aside><p>side</p></aside></main>", "T {}"),
    ("<article><h1>T</h1><div class=body><p>%s</p></div><ul><li><a>a one</a><li><a>b two</a><li><a>c three</a></ul><article class=comment><p>nice</p></article></article>", "T {}"),
])
def test_whole_articles(spark, around, want):
    text = f"{LONG} {LONG} {LONG} {LONG}"
    html = f"<body><nav><a>menu</a></nav>{around % text}<footer>f</footer>"
    assert htmlmain.article(html, None) == want.format(text)
    pages = spark.createDataFrame([(i, f"http://h.example.com/{i}", html) for i in range(3)], "page_id bigint, url string, html string")
    assert {r["text"] for r in htmlmain.extract(pages).collect()} == {want.format(text)}


@pytest.mark.parametrize(("inner", "want"), [
    ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id='comments'>Comments</h2>", "Comments"), ("<section id='form-and-function'><p>form</p></section>", "form"), ("<p id='social-history'>history</p>", "history"), ("<section id='head-injury'><div><p>head</p></div></section>", "head"),
    ("<section id='comments'><p>nice</p></section>", None), ("<section id='comment-list'><p>nice</p></section>", None), ("<section class='related-items'><p>other</p></section>", None), ("<p role='alert' id='social-history'>no</p>", None), ("<div id='comments'><p>nice</p></div>", None),
])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class='wrap'>%s</div>"])
def test_ids_of_titled_parts(around, inner, want):
    html = f"<body><p id='cookie-note'>cookies</p><div id='sidebar-left'><p>side</p></div>{around % f'<p>{LONG}</p>{inner}<p>{LONG}</p>'}<section id='related-news'><p>{LONG * 5}</p></section></body>"
    assert htmlmain.article(html, None) == " ".join(filter(None, [LONG, want, LONG]))


def test_hosts_agree_on_a_path(spark):
    usual = f"<body><div class='wrap'><div class='story n%d'><h2>T%d</h2><p>{LONG}</p></div><div class='extra'><p>short</p></div></div>"
    odd = f"<body><div class='wrap'><div class='story n9'><p>tiny</p></div><div class='extra'><p>{LONG} {LONG}</p></div></div>"
    rows = [(i, f"http://H.example.com/{i}", usual % (i, i)) for i in range(8)] + [(8, "http://h.example.com/8?x", odd), (9, None, odd), (10, "http://h.example.com/10", None), (11, "http://h.example.com/0", f"<p>{LONG}"), (0, "http://h.example.com/0", usual % (0, 0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as text")
    assert {r["host"]: r["path"] for r in htmlmain.winning_paths(pages).collect()}["h.example.com"] == "body/div.wrap/div.n.story"
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmlmain.extract(pages).collect()}
    assert out[3] == (f"T3 {LONG}", len(LONG) + 3) and out[8] == ("tiny", 4) and out[9][0] == f"{LONG} {LONG}" and out[10] == ("", 0) and out[11][0] == LONG
    assert htmlmain.extract(pages.limit(0)).collect() == []


JUNK = (
    "<nav><ul><li><a href='/'>%s</a></ul></nav>", "<aside><p>%s</p></aside>", "<div class='ad'><p>%s</p></div>", "<div class=\"ad-box top\"><span>%s</span></div>", "<form action=x><p>%s</p><select><option>%s</select></form>",
    "<script>if (a < b) { document.write('<p>%s</p>') }</script>", "<style>p:before{content:'%s'}</style>", "<!-- <p>%s</p> -->", "<section id=comments><h3>%s</h3><article class=comment><p>%s</p></article></section>",
    "<div class='share-buttons'>%s</div>", "<p role='alert'>%s</p>", "<footer><p>%s</p></footer>", "<noscript><p>%s</p></noscript>", "<div class=cookie-notice><div><p>%s</p></div></div>",
)


def planted(r):
    """A page and the text of its article, known from the way it is made."""
    want = []
    article = r.choice(("<article>%s</article>", "<main>%s</main>", "<article class='story n7'>%s</article>", "<div class='post-body'>%s</div>"))
    # A div with a menu or sidebar inside counts as the frame of the page, not as an article.
    inner = JUNK if not article.startswith("<div") else [x for x in JUNK if not x.startswith(("<nav", "<aside", "<footer"))]

    def junk(choice=None):
        part = r.choice(choice or inner)
        return part.replace("%s", f"JUNK{r.randrange(1000)} words nobody wants")

    def words(k):
        text = " ".join(r.choice(("alpha", "beta", "gamma", "d&amp;e", "caf&eacute;", "x &lt; y", "<b>bold</b>", "<a href='#'>link</a>", "<em class=hidden>em</em>", "line<br>break")) for _ in range(k))
        return text

    def plain(text):
        for a, b in (("&amp;", "&"), ("&eacute;", "é"), ("<br>", " "), ("<b>", ""), ("</b>", ""), ("<a href='#'>", ""), ("</a>", ""), ("<em class=hidden>", ""), ("</em>", ""), ("&lt;", "<")):
            text = text.replace(a, b)
        return text

    def block():
        text = words(r.randint(12, 40))
        want.append(plain(text))
        form = r.choice(("<p>%s</p>", "<p>%s", "<h2 id='related-work'>%s</h2>", "<blockquote>%s</blockquote>", "<ul><li>%s</ul>", "<p class='side-effects'>%s</p>", "<pre>\n %s \n</pre>", "<table><tr><td>%s</table>"))
        return form % text

    def content(depth):
        out = []
        for _ in range(r.randint(2, 4)):
            k = r.random()
            if k < 0.25 and depth:
                out.append(r.choice(("<section class='social-history'>%s</section>", "<div class='body n3'>%s</div>", "<div>%s</div>", "<section>%s</section>")) % content(depth - 1))
            elif k < 0.45:
                out.append(junk())
            else:
                out.append(block())
        return " ".join(out)

    first, last = block(), content(3)
    article = article % (first + last)
    around = [junk(JUNK) for _ in range(r.randint(1, 5))]
    at = r.randint(0, len(around))
    return f"<!DOCTYPE html><html><head><title>JUNK</title></head><body><header class=site-head><h1>JUNK site</h1></header>{''.join(around[:at])}<div class=wrap>{article}</div>{''.join(around[at:])}</body></html>", " ".join(want)


def test_planted_articles(spark):
    r = random.Random(11)
    made = [planted(r) for _ in range(150)]
    for html, want in made:
        assert htmlmain.article(html, None) == want, html
    rows = [(i, f"http://h{i}.example.org/x", html) for i, (html, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (1 << 20, 0):
        out = {x["page_id"]: x["text"] for x in htmlmain.extract(pages, broadcast_bytes=limit).collect()}
        assert out == {i: want for i, (_, want) in enumerate(made)}


def test_winning_paths_shuffle_no_page(spark):
    pages = spark.createDataFrame([(i, "http://h/x", f"<article><p>{LONG}") for i in range(5)], "page_id bigint, url string, html string")
    plan = htmlmain.extract(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("html", [
    "<a " * 350_000, "<a href=\"x' " * 100_000, "<div class=x>" * 100_000 + "deep" + "</div>" * 100_000, "".join(f"<div>t{i}" for i in range(100_000)), "<ul><li>" * 50_000 + "x",
    "<div>" * 50_000 + "</section>" * 100_000 + "y", "<select>" * 100_000 + "z", "<p class='" + "a " * 300_000, "</script" * 100_000,
])
def test_time_is_in_proportion(html):
    began = time.perf_counter()
    assert htmlmain.article(html, None)
    assert time.perf_counter() - began < 10


def test_very_long_pages():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    text = htmlmain.article(f"<body><article>{body}</article>", None)
    assert text == " ".join(f"{LONG} {i}" for i in range(5000))
    assert htmlmain.article("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"
