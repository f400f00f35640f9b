import html
import re

import pytest

from vellumark.llm.htmltext import Page, extract_pages, host_of


def test_pages_against_their_template(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


MAIN = "<h1>Title</h1><p>One  two\n three, &amp; four&nbsp;five &lt;six&gt; seven eight nine ten.</p><ul><li>item <b>bo</b>ld<li>second</ul><p>Last para with enough words to count here.</p>"
TEXT = "Title\n\nOne two three, & four five <six> seven eight nine ten.\n\nitem bold\n\nsecond\n\nLast para with enough words to count here."


@pytest.mark.parametrize("wrap", [
    "<body><article>{}</article></body>",
    "<body><header>Top</header><nav><ul><li><a href=x>Home</a></ul></nav><main>{}</main><footer>Foot</footer>",
    "<div id='page'><div class='sidebar'>Side text here</div><div class='post-content'>{}<div class='comments'><p>Nice post, thanks a lot for all this.</p></div></div></div>",
    "<table><tr><td class=menu><a href=a>A</a><td>{}</table>",
    "<body><div class='cookie-notice'>We use cookies.</div><div class=ad-slot>Buy</div><section>{}<form>Mail <input></form><script>if (a<b) x('</p>')</script></section><aside>More</aside>",
    "<!-- <p>gone</p> --><div class=a><div hidden>hid</div>{}<noscript>no</noscript><section id=comments><p>Reader says a lot of things here.</p></section></div>",
])
def test_templates(wrap):
    page = Page(wrap.format(MAIN))
    assert page.extract(page.best().path) == TEXT


PARTS = [
    ("<h2 id='search'>Search</h2>", "Search"), ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<p class='notice'>Mind this.</p>", "Mind this."), ("<div class='entry-header'><h1>Name</h1></div>", "Name"),
    ("<div class='post-header'><h1>Name</h1></div>", "Name"), ("<header><h1>Name</h1></header>", "Name"), ("<div class='alert'>Take care.</div>", "Take care."), ("<div id='search'><p>How to search.</p></div>", "How to search."),
    ("<section id='related-work'><p>Others did.</p></section>", "Others did."), ("<ul class='tools'><li>Saw</ul>", "Saw"), ("<div role=alert>Hot.</div>", "Hot."), ("<div class=header-section>Part</div>", "Part"),
    ("<div class=ad>Buy</div>", ""), ("<div class='ad-slot'>Buy</div>", ""), ("<div id='comments'><p>Nice.</p></div>", ""), ("<ul class='social-links'><li>Post</ul>", ""), ("<aside>More</aside>", ""), ("<footer>Foot</footer>", ""),
    ("<div class='newsletter-box'>Mail</div>", ""), ("<article class='comment'><p>Reader.</p></article>", ""), ("<div class=adorable>Cat</div>", "Cat"), ("<span class='ad'>in line</span>", "in line"),
]


@pytest.mark.parametrize(("part", "text"), PARTS)
def test_parts_of_an_article(part, text):
    """Inside an article only what can't be a part of it goes."""
    page = Page(f"<body><div class=header>Top</div><article>{part}{MAIN}</article></body>")
    assert page.extract(page.best().path) == f"{text}\n\n{TEXT}".strip()


@pytest.mark.parametrize("name", ["header", "site-header", "SiteFooter", "notice", "cookie-notice", "sidebar-2", "top-nav", "search-form", "skip-links", "widget-area", "related", "alert"])
def test_parts_outside_the_article(name):
    page = Page(f"<body><div class='{name}'>Gone, with a good many words to it.</div><div class=page><h1 class='{name}'>Stays</h1>{MAIN}</div></body>")
    assert page.extract(page.best().path) == f"Stays\n\n{TEXT}"


def test_parts_far_down_are_left_out_too():
    """Whatever the depth, what isn't the article goes, and what follows it stays."""
    for n in (100, 511, 512, 513, 600, 3000):
        deep = "<div>" * n + "<nav><ul><li>Menu</ul></nav><p>Text here.</p><script>x</script><div class=ad>Buy<div>more</div></div><table><tr><td class=menu>M<td>Cell</table>" + "</div>" * n
        page = Page(f"<article>{deep}<p>End.</p></article>")
        assert page.extract(page.best().path) == "Text here.\n\nCell\n\nEnd."


def test_consensus_beats_a_long_sidebar(spark):
    short, long = "<p>Short text.</p>", "<p>Word after word after word, all the way on.</p>" * 5
    pages = [(k, f"http://h.example/{k}", f"<body><div class=x{k}>{long if k else short}</div><div class=extra>{'' if k else long}</div></body>", 1) for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got[0] == "Short text." and got[3].startswith("Word after")


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "odd url", "", "x"), (3, "http://a/", "no tags at all", "x"), (None, "http://a/", "<p>no id</p>", "x"), (4, "HTTP://U@A:80/x", "<", "x"), (4, "http://a", "<p>a &lt b", "x"), (5, "http://a", "<div>" * 20_000 + "deep", "x"), (6, "http://b", "<p>" + "word " * 200_000, "x"), (7, "http://c", "<p title=\"a>b' c>x", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(df).collect()), key=str)
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert {(k, t) for k, t, _ in got} >= {(1, ""), (2, ""), (3, "no tags at all"), (0, "no id"), (4, "a < b"), (5, "deep")}
    assert extract_pages(df.where("false")).collect() == []
    assert [r.h for r in df.where("page_id = 4").select(host_of(df.url).alias("h")).collect()] == ["a", "a"]


BODY = "<p>" + "The article tells a long story about the house on the hill. " * 6 + "</p>"


def one(html, path=None):
    return Page(html).extract(path)


def test_furniture_by_name_goes_inside_articles_too():
    for name in ("footer", "notice", "recommended", "related", "share", "signup", "subscribe", "widget", "login", "site-footer", "share-buttons"):
        page = f'<body><article><h1>Head</h1>{BODY}<div class="{name}">furniture here</div>{BODY}</article></body>'
        assert "furniture" not in one(page) and one(page).startswith("Head"), name
    kept = f'<body><article><h2 class="related">Related work</h2>{BODY}<p class="notice">Mind the gap.</p><table class="menu"><tr><td>Soup</td></tr></table><div class="entry-footer-notes">x</div></article></body>'
    assert all(x in one(kept) for x in ("Related work", "Mind the gap.", "Soup", "x"))


def test_a_form_around_the_page_is_its_frame():
    page = f'<body><form id="aspnet"><input type="hidden" value="state"><label>hidden</label><div class="content">{BODY}</div></form></body>'
    assert one(page).startswith("The article tells") and "hidden" not in one(page)
    small = f'<body><div class="content">{BODY}<form><p>Send us your name</p><button>go</button></form></div></body>'
    assert "Send us" not in one(small) and one(small).startswith("The article tells")


def test_a_teaser_on_the_hosts_path_is_not_the_article():
    page = f'<body><div class="main-col"><p>Teaser.</p></div><article>{BODY}</article></body>'
    assert one(page, "body>div.main-col").startswith("The article tells")
    assert one(page, "body>article").startswith("The article tells") and "Teaser" not in one(page, "body>article")
