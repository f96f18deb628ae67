"""Main text of web pages by host-wide consensus on the path of the main container.

Each page scores its containers by the text that stands in them outside of links and of boilerplate.
Paths are generalised (tags and classes, digits taken out), hosts vote in Spark for the path that
their pages score best, and each page is then extracted again from the container on the winning
path of its host; a page that lacks the path falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Names of HTML elements by what they are here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "textarea", "title"}
SKIPPED = {"nav", "header", "footer", "aside", "button", "select", "option", "menu", "dialog", "fieldset", "head", *RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "br"} | {
    "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "merror", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd",
}
CONTAINERS = {"body", "div", "section", "article", "main", "td", "center", "blockquote", "html"}
#: Elements that end an open paragraph when they begin.
ENDS_P = {"p", "div", "section", "article", "main", "ul", "ol", "li", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "form", "nav", "header", "footer", "aside", "figure", "fieldset", "center", "dialog", "menu"}
#: Words of a class, id or role that mark what isn't the article.
BOILERPLATE = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "widget", "toolbar", "pagination", "pager", "skip", "complementary", "contentinfo", "copyright", "legal", "disclaimer",
}
#: Words that may stand beside those above in one class or id; with any other word (market-share) it is the name of something else.
BESIDE = {
    "site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "sub", "box", "bar", "block", "area", "section", "wrapper", "wrap", "container", "inner", "outer", "list", "link", "links", "button", "buttons",
    "icon", "icons", "item", "items", "panel", "form", "post", "posts", "article", "articles", "story", "stories", "user", "reader", "readers", "blog", "mobile", "desktop", "sticky", "fixed", "js", "the", "slot", "unit", "space", "zone", "rail",
    "col", "column", "thread", "count", "media", "content", "text", "body", "title", "module", "row", "group", "small", "large",
}
#: Of the marks, those of readers' comments; they are never taken for the article.
COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Words with which a header is that of an article.
OF_ARTICLE = {"post", "article", "story", "content", "body", "text", "title"}
#: Elements that hold text of their own: a name marks them only as adverts.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "figcaption", "caption", "th"}
#: Levels of containers that are told apart and scored; what is deeper counts for the last of them.
LEVELS = 50
#: Of these, the words that mark an advert within a line of text.
ADVERTS = {"ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion"}
#: Parts of a class or id that say something about a page or container which isn't boilerplate itself.
ABOUT = re.compile(r"^(?:has|no|not|with|without|hide|show|is)[-_]|[-_](?:open|opened|closed|enabled|disabled|active|inactive|on|off|left|right|none)$")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|</?[a-zA-Z][^<>]*\Z", re.S)
#: All attributes in their order, so that no name is sought within a quoted value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'][^"']*["']?""")
READ = {"class", "id", "role", "hidden", "style", "aria-hidden"}
MARKS = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
#: Ends of raw elements; sought in the source itself, as lower() makes two characters of some.
SHUT = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """Text of a block, the innermost container that it stands in (-1: none), and its letters within links."""

    text: str
    inside: int
    linked: int


@dataclass
class Page:
    """Containers (path and the container around, by number) and blocks of a page, without boilerplate."""

    paths: list[str] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    """The attributes that matter here, the first of a name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text) if text else ():
        if m[1] and (name := m[1].lower()) in READ:
            out.setdefault(name, html.unescape((m[2] or "").strip("\"'")))
    return out


def _step(tag: str, own: dict[str, str]) -> str:
    """A tag and its classes, generalised: sorted, in lower case, without digits."""
    names = sorted({re.sub(r"\d+", "", c) for c in own.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


def _names(own: dict[str, str], in_article: bool = False) -> set[str]:
    """The words of boilerplate in a class, id and role: of names that consist of such words and of those that stand beside them."""
    out: set[str] = set()
    for name in f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".split():
        if ABOUT.search(name.lower()):
            continue
        words = {w.lower() for w in _WORDS.findall(name)}
        found = words & BOILERPLATE
        if found and words <= BOILERPLATE | BESIDE:
            out |= found - {"header"} if in_article or not OF_ARTICLE.isdisjoint(words) else found
    return out


def parse(source: str) -> Page:
    """Blocks and containers of a page; markup may be broken or cut off.

    Forms and elements with the name of boilerplate are left out, but never article and main, no form around one of these,
    and none that holds most of the page's letters outside of links and comments, unless an article or main stands apart
    from all such. Readers' comments are left out unless the page has nothing else. Of forms that stay the controls and their
    labels go.
    """
    page, spared = _parsed(source, frozenset())
    return _parsed(source, spared)[0] if spared else page


def _parsed(source: str, spared: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The page, and the marked elements (by the place of their tags) that are to stay. In time linear in the source."""
    page = Page()
    open_: list[tuple[str, bool, int | None, tuple[int, int, bool] | None]] = []  # tag, whether it is boilerplate, its container; if only by name, its place, the letters before it and whether it has comments
    opened: Counter[str] = Counter()
    skipping, links, named, talking, within = 0, 0, 0, 0, 0
    lit = dimmed = spoken = 0  # letters outside of links: shown, and left out only by the name of an element, those of comments apart
    held: dict[int, int] = {}
    talk: list[int] = []
    forms: list[int] = []
    around: set[int] = set()  # forms around an article or main
    apart = False
    inside, level = -1, 0
    path = ""
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            if own := " ".join("".join(text).split()):
                page.blocks.append(Block(own, inside, min(linked, len(own))))
            text, linked = [], 0

    def close() -> None:
        nonlocal skipping, inside, path, named, talking, within, level
        tag, dark, number, mark = open_.pop()
        opened[tag] -= 1
        skipping -= dark
        within -= tag in INLINE
        if tag == "form" and forms:
            forms.pop()
        if mark:
            named -= 1
            talking -= mark[2]
            if mark[2]:
                talk.append(mark[0])
            else:
                held[mark[0]] = dimmed - mark[1]
        if number is not None:
            inside, level = page.around[number], level - 1
            path = page.paths[inside] if inside >= 0 else ""

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        stop = m.start() if m else end
        if stop > at and not skipping:
            piece = html.unescape(source[at:stop])
            text.append(piece)
            if links:
                linked += len(piece.strip())
            else:
                lit += len(piece.strip())
        elif stop > at and skipping == named and not links:
            n = len(html.unescape(source[at:stop]).strip())
            dimmed, spoken = (dimmed, spoken + n) if talking else (dimmed + n, spoken)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if tag in INLINE:
            if tag == "br" and not skipping:
                text.append(" ")
            # An inline element is followed only if it is an advert or hidden, and those of its name within it.
            elif m[1]:
                if within and opened[tag]:
                    while open_[-1][0] != tag:
                        close()
                    close()
            elif tag not in VOID and not m[3].endswith("/") and (within or MARKS.search(m[3]) or (tag == "label" and opened["form"])):
                own = _attributes(m[3])
                if dark := _hidden(own) or not ADVERTS.isdisjoint(_names(own)) or (within and opened[tag] > 0) or (tag == "label" and opened["form"] > 0):
                    open_.append((tag, dark, None, None))
                    opened[tag] += 1
                    skipping += 1
                    within += 1
            continue
        if tag in RAW and not m[1]:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                shut = SHUT[tag].search(source, at)
                at = end if shut is None else (source.find(">", shut.start()) + 1 or end)
            continue
        flush()
        links = 0
        if m[1]:
            if opened[tag]:
                while open_[-1][0] != tag:
                    close()
                close()
            continue
        if tag in ENDS_P and opened["p"]:
            while open_[-1][0] != "p":
                close()
            close()
        if tag == "li" and open_ and open_[-1][0] == "li":
            close()
        if tag in VOID or m[3].endswith("/"):
            continue
        own = _attributes(m[3])
        dark = (tag in SKIPPED and not (tag == "header" and opened["article"])) or (_hidden(own) and tag not in ("html", "body"))
        mark = None
        if not dark and tag not in ("html", "body", "article", "main") and m.start() not in spared:
            words = _names(own, opened["article"] > 0)
            if tag == "form" or (words if tag not in TEXTUAL else words & ADVERTS):
                comments = not COMMENTS.isdisjoint(words)
                dark, mark = True, (m.start(), dimmed, comments)
                talking += comments
        if tag == "form":
            forms.append(m.start())
        if tag in ("article", "main"):
            apart |= not skipping and not dark
            if not talking:
                for at_form in reversed(forms):
                    if at_form in around:
                        break
                    around.add(at_form)
        number = None
        if tag in CONTAINERS and not skipping and not dark and level < LEVELS:
            path = f"{path}/{_step(tag, own)}"
            number = len(page.paths)
            page.paths.append(path)
            page.around.append(inside)
            inside, level = number, level + 1
        open_.append((tag, dark, number, mark))
        opened[tag] += 1
        skipping += dark
        named += mark is not None
    flush()
    while open_:
        close()
    most = frozenset() if apart else frozenset(k for k, n in held.items() if 2 * n > lit + dimmed)
    return page, most | (around - spared) | frozenset(talk if spoken and not lit + dimmed else ())


def scores(page: Page) -> list[float]:
    """Score of each container: letters outside of links, whole from its own blocks, half from a container within it, and so on."""
    out = [0.0] * len(page.paths)
    for b in page.blocks:
        worth, number = float(len(b.text) - 2 * b.linked), b.inside
        while number >= 0:
            out[number] += worth
            worth, number = worth / 2, page.around[number]
    return out


def best_path(page: Page) -> str:
    """The path of the container that scores best, the outermost of equals; articles and main elements count double."""
    found = [(s * (2 if re.search(r"/(article|main)[^/]*$", p) else 1), -i) for i, (s, p) in enumerate(zip(scores(page), page.paths))]
    top = max(found, default=(0.0, 0))
    return page.paths[-top[1]] if top[0] > 0 else ""


def main_text(page: Page, path: str | None) -> str:
    """Blocks in all containers on the path, in the page's order; from the page's own best path if it lacks the one given, and all if no container has text."""
    for tried in (path, best_path(page)):
        wanted: list[bool] = []
        for p, outer in zip(page.paths, page.around):
            wanted.append(p == tried or (outer >= 0 and wanted[outer]))
        if kept := [b.text for b in page.blocks if b.inside >= 0 and wanted[b.inside]]:
            return "\n\n".join(kept)
    return "\n\n".join(b.text for b in page.blocks)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, worth = [], []
        for source in batch.column(1):
            page = parse(source.as_py() or "")
            path = best_path(page)
            paths.append(path or None)
            worth.append(sum(len(b.text) for b in page.blocks))
        yield pa.RecordBatch.from_pydict({"host": batch.column(0), "path": pa.array(paths, pa.string()), "letters": pa.array(worth, pa.int64())})


def _extracted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [main_text(parse(h.as_py() or ""), p.as_py()) for h, p in zip(part.column("html"), part.column("_path"))]
                own = {c: part.column(c) for c in names}
                yield pa.RecordBatch.from_pydict(own | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return run


def host():
    """Host of a URL in lower case, without a leading www or m and without the port; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^(www|m)\.", ""), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of the host's pages, by letters and then by name among equals."""
    votes = pages.select(host().alias("host"), "html").mapInArrow(_votes, "host string, path string, letters long").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "letters", "path")).alias("path"))


def extract(pages: DataFrame, broadcast_hosts: int = 100_000, salts: int = 32) -> DataFrame:
    """pages (page_id, url, html; more are ignored) -> (page_id, url, text, n_chars), a row for each page.

    Null html gives an empty text; a null or odd url belongs to the host "", whose pages vote like those of any
    other. Every row is a page of its own, repeated and null page_ids too; an empty table gives no rows; long pages are
    read whole. Of paths with equal votes the one with more letters wins, then the greater name. Winning paths are broadcast for at most broadcast_hosts hosts; beyond, pages and paths are joined by
    shuffle, each host in `salts` parts so that a large one is spread.
    """
    paths = checkpointed(host_paths(pages)).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    own = pages.select("page_id", "url", "html").withColumn("_host", host())
    if paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        met = own.join(F.broadcast(paths), "_host", "left")
    else:
        own = own.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)))
        met = own.join(paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["_host", "_salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return met.select("page_id", "url", "html", "_path").mapInArrow(_extracted(["page_id", "url"]), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
