import html
import random
import re
import time

import pytest

from condeval.llm import html_text as H

PAGES = {
    "": "",
    "plain  text &amp; more": "plain text & more",
    "<p>a<b>b</b> c<br>d</p><p>e&nbsp;f\n g</p>": "ab c d\ne f g",
    "<nav><ul><li><a href='/x'>menu</a></li></ul></nav><article><h1>T</h1><p>x<p>y</article><footer>f</footer>": "T\nx\ny",
    "<body><div class='ad'>buy</div><div>story one</div><!-- <p>no</p> --><div>two</div>": "story one\ntwo",
    "<script>var t='</p><p>x';</script><style>p{}</style><p>kept</p>": "kept",
    "<article><p>text</p><div class='comments'><p>reader</p><div>nested</div></div><p>end</p></article>": "text\nend",
    "<article>a</article><section id=comments><p>reader says</p></section>": "a",
    "<nav>never closed <article><p>still found</p></article>": "still found",
    "<aside>side</aside><form><p>f</p></form><div role='navigation'>n</div><p>main</p>": "main",
    "<p class=notice>cookies<p>story": "story",
    '<p title="a > b">attr</p>&lt;p&gt;': "attr\n<p>",
    "<article><header><h1>Title</h1></header><p>x</p></article><header>site</header>": "Title\nx",
    "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>a story of its own</p>": "a story of its own",
    "<p>unfinished <b": "unfinished <b",
    "<textarea>t</textarea><p>x</p><script>unclosed <p>y": "x",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_cases(page):
    assert H.main_text(page) == PAGES[page]


def test_isolated_scraps_have_no_surge():
    far = "".join(f"<nav>{i}</nav>" for i in range(9))
    assert H.main_text(f"<p>{'long text ' * 200}</p>{far}<p>ok</p>") == ("long text " * 200).strip()


def test_operator(spark):
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(PAGES)] + [(99, None, None, "x"), (0, "u0", "", "x"), (None, "u", "<p>z</p>", "x")]
    rows.append((100, "long", "<article>" + "<p>word word</p>" * 30_000 + "</article>", "x"))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extracted(table).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r for r in got}
    assert found[99].text == "" and found[99].url is None and found[None].text == "z"
    assert found[100].text.count("\n") == 29_999
    assert H.extracted(table.limit(0)).count() == 0


def test_pages_of_the_small_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", article))
        assert H.main_text(r.html) == "\n".join(b for b in blocks if b)


LONG = "long text " * 700


@pytest.mark.parametrize("before", ["<p>short</p>", "<p>short</p>" * 140, "<h1>A</h1><p>b</p>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_lines_before_a_very_long_one_stay(before, around):
    lines = [b for b in re.split("<[^>]*>", before) if b]
    assert H.main_text(around.format(f"{before}<p>{LONG}</p>")) == "\n".join([*lines, LONG.strip()])


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_lines_after_a_dive_stay(around):
    adverts = "<div class='ad'>buy</div>" * 9
    page = around.format(f"<p>An opening.</p>{adverts}<p>{LONG}</p>{adverts}<p>So it ends.</p>")
    assert H.main_text(page) == f"An opening.\n{LONG.strip()}\nSo it ends."


def test_short_lines_of_an_article_stay_wherever_they_stand():
    adverts = "<div class='ad'>buy</div>" * 9
    assert H.main_text(f"<article><p>ok</p>{adverts}<p>{LONG}</p>{adverts}<p>ok</p></article>") == f"ok\n{LONG.strip()}\nok"


def test_articles_of_pages_with_very_long_paragraphs(spark):
    """Of these articles page 1027 once lost 140 lines and the others their heading."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id IN (300, 1027, 1219, 2309)").collect()
    assert len(pages) == 4
    for r in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", article))
        assert H.main_text(r.html) == "\n".join(b for b in blocks if b)


LINKED = {
    "<article><h2><a href=1>Linked heading</a></h2><p>text</p><ul><li><a href=2>item</a><li><a href=3>other</a></ul></article>":
        "Linked heading\ntext\nitem\nother",
    "<main><p><a href=1>A reference</a></p></main>": "A reference",
    "<p><a href=1>never closed</p><p>A story.</p><p>Its end.</p>": "A story.\nIts end.",
    "<body><a name=top><p>A story.</p><p>Its end.</p>": "A story.\nIts end.",
    "<a id=x/>A story.<p>Its end.</p>": "A story.\nIts end.",
    '<a id="x" />A story.<p>Its end.</p>': "A story.\nIts end.",
    "<p><a href=1>one</p><p>A story.</a></p><p>Its end.</p>": "A story.\nIts end.",
    "<p>A <a href=1>b <a href=2>c</a> story that goes on</p><p>Its end.</p>": "A b c story that goes on\nIts end.",
    "<nav><ul><li><a href=1>menu</nav><p>A story.</p>": "A story.",
    "<a href=/1/>all of it a link</a><p>A story.</p>": "A story.",
    "<a href=1><div>a card</div><p>all of it a link</p></a><p>A story.</p>": "A story.",
    "<p><a href=1><img src=x> all of it<br>a link</a></p><p>A story.</p>": "A story.",
}


@pytest.mark.parametrize("page", list(LINKED))
def test_links(page):
    assert H.main_text(page) == LINKED[page]


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<section id='related-work'><h2>Related work</h2><p>They did.</p></section>", "Related work\nThey did."),
        ("<h2 id='search-methods'>Methods</h2><p>We did.</p>", "Methods\nWe did."),
        ("<h2 class=search id=search>Search</h2><p>We did.</p>", "Search\nWe did."),
        ("<div class='entry-header'><h1>T</h1></div><p>x</p>", "T\nx"),
        ("<div class='header'><h1>T</h1></div><p>x</p>", "T\nx"),
        ("<p id='notice'>x <span class='ad-hoc'>y</span></p>", "x y"),
        ("<p>x</p><div class='box AD'>buy</div><div role='search'>s</div><div id='comments' class='area'>r</div><p>y</p>", "x\ny"),
    ],
)
def test_marks_inside_articles_are_whole_names(around, page, text):
    assert H.main_text(f"<{around}>{page}</{around}>") == text


def test_marks_outside_articles_are_words():
    assert H.main_text("<div id='page-header'>h</div><h2 class='site-menu'>m</h2><div class='related-posts'>r</div><p>x</p>") == "x"


@pytest.mark.parametrize("piece", ["<a ", '<a " ', "<!x ", "<a ' \"", "<a", "<!--", "<script", "</script ", "<a href=", "</", "<a href=href=", "<?", "<p class="])
@pytest.mark.parametrize("tail", ["", ">", ' ">', "<p>x"])
def test_broken_markup_takes_time_in_proportion(piece, tail):
    """A megabyte of tags that never end."""
    page = piece * (1_000_000 // len(piece)) + tail
    begun = time.process_time()
    H.main_text(page)
    assert time.process_time() - begun < 2


def test_tags_equal_a_regular_expression():
    """The scanner against one expression that backtracks, on short broken pages."""
    whole = re.compile(
        r"""(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>"""
    )
    pick = random.Random(2)
    pool = ["<a ", "</p>", "<div class='ad'>", '"', "'", ">", "<", "t ", "<!--", "-->", "<!x ", "<?x>", "<b", '<h1 id="a>b">', "<1", "</", "<!"]
    for _ in range(20_000):
        page = "".join(pick.choice(pool) for _ in range(pick.randrange(1, 14)))
        want = [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or "") for m in whole.finditer(page)]
        assert list(H.tags(page)) == want, page


@pytest.mark.parametrize(
    ("attributes", "closes"),
    [(" id=x/", True), (" /", True), ("/", True), (" href=x/", False), (" HREF =x/", False), (" href= x/", False), (" href = x/", False),
     (" xhref=x/", True), (" href='x'/", True), (" href=x", False), (" a href=/1/", False), (" href= x y/", True)],
)
def test_a_slash_of_an_address_closes_nothing(attributes, closes):
    assert H._closes_itself(attributes) == closes


BOXES = ["related-posts", "ad-slot", "cookie-notice", "comment-list", "user-comments", "sidebar-left", "post ad_box", "newsletter-signup"]


@pytest.mark.parametrize("name", BOXES)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_boxes_with_compound_names_go(around, name):
    page = f"<{around}><h1>T</h1><p>one</p><div class='{name}'><p>box</p></div><p>two</p></{around}>"
    assert H.main_text(page) == "T\none\ntwo"


@pytest.mark.parametrize("name", ["article-header", "related-work", "ad-hoc", "search-methods", "entry-header", "post-header"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_names_that_are_of_the_text_stay(around, name):
    page = f"<{around}><p>one</p><div class='{name}'><h1>T</h1><p>kept</p></div><p>two</p></{around}>"
    assert H.main_text(page) == "one\nT\nkept\ntwo"


def test_a_short_heading_that_stands_apart_stays():
    menus = "<nav>menu</nav>" * 6
    assert H.main_text(f"<h1>Title</h1>{menus}<p>{LONG}</p>{menus}<p>ok</p>") == f"Title\n{LONG.strip()}"
    assert H.main_text(f"<h1>Site</h1><article><p>{LONG}</p></article>") == LONG.strip()
