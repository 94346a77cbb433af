"""Pages whose text lies beside, within or after what looks like noise."""

import re
import time
from html import unescape

import pytest

from cadenza.llm import html_text

LONG = ("Long text here. " * 10).strip()
WRAPPED = [
    f"<body><div class='{c}'><{e}><h1>Title</h1><p>{LONG}</p></{e}></div><div class=sidebar>Side</div></body>"
    for c in ("content-sidebar-wrap", "page no-sidebar", "article-body has-comments", "post-header", "sidebar", "x widget") for e in ("article", "main", "div")
] + [f"<form id=f class=search action=x><h1>Title</h1><p>{LONG}</p></form>", f"<div data-class=ad><h1>Title</h1><p>{LONG}</p></div><div class='cookie-banner'>Cookies</div>"]


@pytest.mark.parametrize("html", WRAPPED)
def test_wrappers_are_no_noise(html):
    assert html_text.main_text(html) == f"Title\n\n{LONG}"


NOISY = ["ad", "x ads", "sidebar", "comments", "ad-1", "cookie-banner", "site-header", "share-buttons"]
COMPOUND = "post-comments comments-section comment-thread reader-comments advert-box cookie-bar left-sidebar sidebar-right page-footer newsletter-box post-comments-list commentList adContainer js-ad-slot c-comments__item skip-link".split()
WRAPPERS = "has-sidebar ad-free no-comments with-sidebar no-ads layout-has-sidebar-not article-header post-header".split()


@pytest.mark.parametrize("name", NOISY)
def test_whole_tokens_are_noise(name):
    for a in (f'class="{name}"', f'id="{name}"', f"role='{name}'"):
        assert html_text.main_text(f"<body><div><p>{LONG}</p></div><div {a}><p>noise</p></div><p>end</p></body>") == f"{LONG}\n\nend"


@pytest.mark.parametrize("name", COMPOUND)
def test_compound_names_are_noise(name):
    for a in (f'class="x {name}"', f'id="{name}"'):
        noise = f"<div {a}><p>noise and {LONG}</p></div>"
        assert html_text.main_text(f"<body><div><p>{LONG}</p></div>{noise}<p>end</p><p>{LONG}</p></body>") == f"{LONG}\n\nend\n\n{LONG}"
        assert html_text.main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{noise}<p>end</p></article></body>") == f"T\n\n{LONG}\n\nend"
        assert html_text.main_text(f"<body><article><p>short</p></article>{noise}</body>") == "short"


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_that_deny_noise_are_kept(name):
    assert html_text.main_text(f"<div class='{name}'><h1>T</h1><p>one</p></div><div><p>{LONG}</p></div>") == f"T\n\none\n\n{LONG}"
    assert html_text.main_text(f"<article><div class='{name}'><h1>T</h1></div><p>{LONG}</p></article>") == f"T\n\n{LONG}"


def test_distance_drops_nothing():
    gap = "<div></div>" * 12
    assert html_text.main_text(f"<h1>T</h1>{gap}<p>{LONG}</p><p>{LONG}</p>{gap}<p>The end.</p>") == f"T\n\n{LONG}\n\n{LONG}\n\nThe end."


@pytest.mark.parametrize("text", [LONG, "Some words."])
def test_links_between_paragraphs_stay(text):
    sources = "<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li><li><a href=c>Source three</a></li></ul>"
    assert html_text.main_text(f"<p>{text}</p>{sources}<p>{text}</p>") == f"{text}\n\nSource one\n\nSource two\n\nSource three\n\n{text}"


def test_menus_around_the_text_go():
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul>"
    foot = "".join(f"<div><a href={i}>Link {i}</a></div>" for i in range(4))
    assert html_text.main_text(f"<div>{menu}</div><h1>T</h1><p>{LONG}</p>{foot}<p>end</p>") == f"T\n\n{LONG}\n\nend"
    assert html_text.main_text(menu + foot) == ""


def test_comments_in_articles_are_noise():
    html = f"<article><p>{LONG}</p></article><section class=comments><article class='comment'><p>Reader says.</p></article></section>"
    assert html_text.main_text(html) == LONG


def test_adverts_longer_than_the_article_are_noise():
    assert html_text.main_text(f"<div class=ad>{LONG}</div><article><p>Short.</p></article>") == "Short."


@pytest.mark.parametrize("svg", ['<svg class="i"/>', "<svg/>", '<svg a=">"  />', '<svg-icon name="x"></svg-icon>', "<svg><path d='M0'/></svg>", '<svg a="b/"><g/></svg>', "<template-part></template-part>"])
def test_svg_ends_at_its_own_tag(svg):
    assert html_text.main_text(f"<article><p>one</p>{svg}<p>two</p></article>") == "one\n\ntwo"
    assert html_text.main_text(f"{svg}<p>two</p>") == "two"


AD = "<div class=ad>Buy now</div>"
UNMARKED = [
    (f"<h1>Title</h1><div class=share>Share</div><div>{LONG}</div>", ["Title", LONG]),
    (f"<p>{LONG}</p>{AD}<p>short</p>{AD}<p>{LONG}</p>", [LONG, "short", LONG]),
    (f"<p>{LONG}</p>{AD * 5}<p>short</p>{AD * 5}<h2>Head</h2>{AD * 5}<p>{LONG}</p>{AD * 3}<p>end</p>", [LONG, "short", "Head", LONG, "end"]),
    (f"<p>one</p>{AD * 3}<p>two</p>{AD * 3}<p>three</p>", ["one", "two", "three"]),
    (f"<p>{LONG}</p><p><a href=x>A paragraph that is a link</a></p><ul>" + "<li><a href=y>menu item</a></li>" * 6 + "</ul><p>after</p>", [LONG, "A paragraph that is a link", "after"]),
    (f"<ul><li><a href=x>one</a> and much more said of it here</li><li><a href=x>only link</a></li></ul><p>{LONG}</p>", ["one and much more said of it here", "only link", LONG]),
    (f"<h1>Title</h1><p>Lead</p><main><p>{LONG}</p></main><p>After</p><p>{LONG}</p>", ["Title", "Lead", LONG, "After", LONG]),
]


@pytest.mark.parametrize(("html", "want"), UNMARKED)
def test_only_noise_is_dropped(html, want):
    assert html_text.main_text(html).split("\n\n") == want


def plain_article(html):
    """The article's blocks, for pages of the driver's table, by plain patterns."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    texts = (" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_query_over_the_whole_table(spark):
    from cadenza.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: plain_article(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op9_html_text"](spark, sf).collect()
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


SHAPES = [
    (f'<div class="layout has-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<div class="ad-free reading"><p>{LONG}</p></div>', LONG),
    (f"<html><head><title>x</title><meta a=b><body><p>{LONG}</p>", LONG),
    (f"<html><head><title>x</title><p>{LONG}</p>", LONG),
    (f"<article>Teaser one</article><div><p>{LONG}</p><p>{LONG}</p></div>", f"Teaser one\n\n{LONG}\n\n{LONG}"),
    (f"<p>{LONG}</p>{AD}<p>Thanks for reading.</p>", f"{LONG}\n\nThanks for reading."),
    (f"<p>{LONG}</p><p><a href=x>{LONG}</a></p>", f"{LONG}\n\n{LONG}"),
    ("<div><a href=a>Home</a></div><div><a href=b>About</a></div><div><a href=c>Contact</a></div>" + f"<div><h1>T</h1><p>{LONG}</p></div>", f"T\n\n{LONG}"),
    (f"<p don't>it</p><p>isn't {LONG}</p>", f"it\n\nisn't {LONG}"),
    (f"<div>© 2020</div>{'<div></div>' * 9}<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{'<div></div>' * 9}<div>All rights</div>", f"T\n\n{LONG}\n\n{LONG}"),
]


@pytest.mark.parametrize(("html", "want"), SHAPES)
def test_shapes(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("piece", ["<b></i>", "<a '", "<p>x</p><div class=ad>", "<svg ", "<!", "<div>", "<script", "= =", "<p title='"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(piece * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 12 * seconds(10_000) + 0.2
