"""HTML extraction: page-wide forms, long comments, names within names, broken markup, and a plain extractor on a tree."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from bagdiv.llm import html_extract

LONG = "a reader says so very much more than the article has to say " * 5


def text_of(source):
    return html_extract.main_text(html_extract.parse(source), None)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<body><form><main><p>The article</p></main></form>", "The article"),
        ("<body><form id='aspnetForm' action='x'><input type='hidden' name='__VIEWSTATE' value='abc'><div class='content'><h1>Title</h1><p>The whole article of the page</p></div><label for='q'>Find</label><input name='q'><button>Go</button><select><option>One</option></select></form>", "Title\n\nThe whole article of the page"),
        (f"<body><form><main><p>The article</p></main></form><div id='comments'><p>{LONG}</p></div>", "The article"),
        ("<body><article><p>The article is here</p><form><p>Sign up now, as many others do, for all the news of the day</p><label>Mail</label><input></form></article>", "The article is here"),
        ("<div class='post'><p>The whole article</p></div><form class='search'><label>Search</label><input></form>", "The whole article"),
        (f"<div class='post'><p>The whole article</p></div><section id='comments'><p>{LONG}</p></section>", "The whole article"),
        (f"<article><p>The whole article</p><div class='comment-list'><article class='comment'><p>{LONG}</p></article></div></article>", "The whole article"),
        (f"<div class='widget'><p>The whole article</p></div><section class='user-comments'><p>{LONG}</p></section>", "The whole article"),
        ("<body><div class='comments'><p>Nothing but this</p></div>", "Nothing but this"),
        ("<article><h2>Figures</h2><section class='market-share'><p>A third of it</p></section><p class='reply'>Yes, we do.</p><p title='see class=ad here'>Kept</p></article>", "Figures\n\nA third of it\n\nYes, we do.\n\nKept"),
        ("<article><p>One</p><p class='ad'>Buy</p><div class='ad-slot'>Buy</div><div class=\"shareButtons\">Tell</div><ul class='related-posts'><li>Other</li></ul><p>Two</p></article>", "One\n\nTwo"),
        ("<div data-x='a class=\"ad\" b'><p>The whole article</p></div>", "The whole article"),
        ("<div title=\"it's class='sidebar' id=ads\" class=text><p>The whole article</p></div><div CLASS=Sidebar>Side</div>", "The whole article"),
        ("<div class='x' class='ad'><p>The first of two names counts</p></div>", "The first of two names counts"),
        ("<div class='post-header'><h1>Title</h1></div><div class='site-header'>Site</div><p>Body</p>", "Title\n\nBody"),
        ("<div class=ad>Buy", "Buy"),
    ],
)
def test_what_is_the_article(source, want):
    assert text_of(f"<html>{source}") == want


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 90_000 + "</p>" * 130_000,
        "<div class='a'>x" * 60_000,
        "<p>x</b>" * 120_000,
        "<span class=ad>" * 70_000,
        "<form><article>" * 60_000,
        "<a href='" * 100_000,
        "<x " * 300_000,
    ],
)
def test_a_megabyte_of_broken_markup_takes_seconds(source):
    assert len(source) > 850_000
    began = time.process_time()
    text_of(source)
    assert time.process_time() - began < 8


def test_deep_containers_count_for_the_last_that_is_told_apart():
    assert text_of("<div>" * 3000 + "<p>Deep</p>" + "</div>" * 3000 + "<footer>No</footer>") == "Deep"


def page_of(rng, n):
    """The second family: no article element, a form around all, comments longer than the text, adverts and lists of links."""
    word = lambda: "".join(rng.choice(list("klmnopqrst"), rng.integers(2, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    paras = [text(rng.integers(25, 60)) for _ in range(rng.integers(3, 6))]
    junk = [f"<div class='ad-box'><p>{text(6)}</p></div>", f"<ul class='share-links'><li>{text(2)}</li></ul>", f"<div class='newsletter-signup'><label>{text(2)}</label><input></div>", ""]
    shown = "".join(f"<p class='{rng.choice(['', 'lead', 'reply'])}'>{p}</p>{rng.choice(junk)}" for p in paras)
    comments = "".join(f"<div class='comment'><p>{text(40)}</p></div>" for _ in range(rng.integers(4, 9)))
    links = "".join(f"<li><a href='/{k}'>{text(3)}</a></li>" for k in range(6))
    page = f"<!doctype html><html><head><title>{text(3)}</title></head><body><form method='post' action='/p.aspx'><input type='hidden' name='__VIEWSTATE' value='{text(2)}'><div id='top-bar'><ul class='menu'>{links}</ul></div><div class='wrap w{n}'><div class='main-column'><h1>{text(4)}</h1>{shown}</div><div class='right-rail sidebar'><p>{text(20)}</p></div></div><div class='comments-section'>{comments}</div><div class='footer'><p>{text(9)}</p></div></form></body></html>"
    return page, "\n\n".join([page.split("<h1>")[1].split("</h1>")[0], *paras])


class Tree(HTMLParser):
    """Elements as [tag, classes, children]; the pages are well formed."""

    def __init__(self, source):
        super().__init__()
        self.root = ["root", set(), []]
        self.open = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, set((dict(attrs).get("class") or "").split()), []]
        self.open[-1][2].append(node)
        if tag not in ("input", "meta", "br"):
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.open[-1][2].append(" ".join(data.split()))


def plain_extract(source):
    """All that isn't named as something else, from the container whose own blocks have the most letters."""
    out = {"ad-box", "share-links", "newsletter-signup", "comments-section", "sidebar", "menu", "footer"}

    def blocks(node):
        if isinstance(node, str) or node[1] & out or node[0] in ("head", "label", "button", "select", "script", "style"):
            return []
        if node[0] in ("p", "h1"):
            return [" ".join(c for c in node[2] if isinstance(c, str))]
        return [b for c in node[2] for b in blocks(c)]

    def every(node):
        yield node
        for c in node[2]:
            if not isinstance(c, str):
                yield from every(c)

    own = lambda node: sum(len(b) for c in node[2] if not isinstance(c, str) and c[0] in ("p", "h1") for b in blocks(c)) if not node[1] & out else 0
    best = max(every(Tree(source).root), key=lambda node: own(node) if blocks(node) else 0)
    return "\n\n".join(blocks(best))


def test_second_family_of_pages(spark):
    rng = np.random.default_rng(5)
    pages = [page_of(rng, i) for i in range(60)]
    assert [plain_extract(p) for p, _ in pages] == [want for _, want in pages]
    df = spark.createDataFrame([(i, f"http://h{i % 4}.example/{i}", p, "clash", 1) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string, text string, _path int")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == dict(enumerate(want for _, want in pages))
