"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one a block element. A line's length counts the text
that can be content: menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, known by their elements and class names, count nothing, nor do lines
outside articles that are mostly links, nor, on a page with an article element, lines
outside it. A word in a name marks an element (``sidebar-left``), unless another makes it
part of the text (``related-work``). Inside an article all words of a name have to fit,
an id does so for reader comments alone, and headings, and what is marked as a header, are kept.
Lengths are summed over sliding windows of lines. A page's text dives where a whole
window holds nothing; dives cut it into runs. Inside an article every line that counts is
kept. On a page without one, a run is kept whole, from its first line that counts to its
last, if one of its windows surges; what has no surge there is a scrap of a few characters
that stands alone and is no heading.

Defined cases: NULL or empty html has empty text; elements that are never closed end
with the page, or where an article begins; a link ends with the block that holds it and at
the next link, and one that is never closed at the next block; pages of any length are read
whole, in time in proportion to it, and tags that never end are text; rows that repeat get equal rows; an empty table gives an empty table; other columns
are neither read nor returned.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame

# Lines of a window; a surge needs this share of the page's fullest window, but never
# more than so many characters.
WINDOW, SURGE, SCRAP = 4, 0.05, 10
# A line outside articles of which links hold more than this share counts nothing.
LINKS = 0.6

# Elements by role.
UNSEEN = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "textarea"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
WHOLE = {"html", "body", "article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
# Elements without an end, and elements that the next block ends.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IMPLIED = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
# Words of class, id and role that mark an element as no content.
MARKS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "complementary", "search", "login",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words that stand beside such a word in a name, and leave it what it is.
BESIDE = {
    "area", "bar", "block", "bottom", "box", "container", "content", "form", "global", "google", "inline", "inner", "item", "items",
    "left", "link", "links", "list", "main", "outer", "page", "panel", "policy", "post", "posts", "reader", "right", "section",
    "site", "slot", "space", "sticky", "stories", "tags", "thread", "top", "unit", "user", "wrap", "wrapper",
}
# Words that make it something of the text: a related-work section, an article's header.
OF_TEXT = {"ad": {"hoc"}, "related": {"work", "works"}, "header": {"article", "entry", "post", "story"}, "search": {"methods"}}
# Names that mark an element inside an article: of classes and roles, and ids.
INSIDE = {"class": MARKS - {"header"}, "role": MARKS, "id": {"comments", "disqus_thread", "respond"}}

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">]+)*+>""")
_SPECIAL = re.compile(r"""["'>]""")
_NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ENDS = {name: re.compile(rf"(?i)</{name}\b[^>]*>") for name in UNSEEN}
_WORD = re.compile(r"[a-z]+")
_ANCHOR = re.compile(r"(?i)<(/?)a[\s/>]")
_HREF, _HREF_LAST = re.compile(r"(?i)\bhref="), re.compile(r"(?i)\bhref\Z")
_GAP = re.compile(r"""[\s"'>]""")


class _Ends:
    """Where tags end, for pages with tags that don't: each quote and ``>`` is looked at once.

    Outside quotes a ``>`` ends a tag, and a quote leads on to what follows the next one of
    its kind; where there is none, no tag ends that comes by here.
    """

    def __init__(self, page: str) -> None:
        self.places = [found.start() for found in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        following = {'"': -1, "'": -1}
        for i in range(len(self.places) - 1, -1, -1):
            sign = page[self.places[i]]
            if sign == ">":
                self.ends[i] = self.places[i] + 1
            else:
                closing, following[sign] = following[sign], i
                self.ends[i] = self.ends[closing + 1] if closing >= 0 else -1

    def after(self, place: int) -> int:
        return self.ends[bisect_left(self.places, place)]


def tags(page: str) -> Generator[tuple[int, int, bool, str, str], int | None, None]:
    """Start, end, whether it closes, name and attributes of each tag; comments and the like have no name.

    In time in proportion to the page, also where tags, quotes or comments never end.
    """
    last = page.rfind(">")
    ends = None
    position = 0
    while (start := page.find("<", position)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            position = len(page) if end < 0 else end + 3
            position = (yield start, position, False, "", "") or position
            continue
        if start > last:  # only a comment can still come
            position = page.find("<!--", start)
            if position < 0:
                return
            continue
        if page[start + 1] in "!?":
            position = page.index(">", start + 2) + 1 if start + 2 <= last else start + 1
            if position > start + 1:
                position = (yield start, position, False, "", "") or position
            continue
        found = _NAME.match(page, start)
        if not found:
            position = start + 1
            continue
        if ends is None:
            rest = _REST.match(page, found.end())
            end = rest.end() if rest else -1
            if not rest:
                ends = _Ends(page)
        else:
            end = ends.after(found.end())
        if end < 0:
            position = start + 1
            continue
        position = (yield start, end, bool(found[1]), found[2].lower(), page[found.end() : end - 1]) or end


def _closes_itself(attributes: str) -> bool:
    """Whether attributes end with a slash that does not belong to an unquoted address."""
    if not attributes.endswith("/"):
        return False
    gaps = [found.end() for found in _GAP.finditer(attributes)]
    cut = gaps[-1] if gaps else 0
    before, value = attributes[:cut].rstrip(), attributes[cut:]
    if before.endswith("="):
        before, value = before[:-1].rstrip(), "=" + value
    return not (_HREF.search(value) or (value.startswith("=") and _HREF_LAST.search(before[-8:])))


def _marked(attributes: str, name: str, inside: int) -> bool:
    """Whether class, id or role name something that isn't content."""
    if "=" not in attributes or (inside and name in HEADINGS):
        return False
    for found in _NAMES.finditer(attributes):
        value = (found[2] or found[3] or found[4] or "").lower()
        kind = found[1].lower()
        for token in value.split():
            words = set(_WORD.findall(token))
            if inside:
                marks = INSIDE[kind]
                if token in marks or (kind == "class" and words & marks and words <= marks | BESIDE):
                    return True
            elif any(word in MARKS and words.isdisjoint(OF_TEXT.get(word, ())) for word in words):
                return True
    return False


def _next(found: Generator, place: int | None = None):
    """The next tag, from a place on if given."""
    try:
        return found.send(place) if place else next(found)
    except StopIteration:
        return None


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """A page's lines in order, each with the length that counts and whether an article or a heading holds it."""
    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []  # of the line so far
    linked = 0  # characters of it inside links
    in_link, closed = False, False  # whether a link is open, and whether it has an end
    within_link, inside = 0, 0  # blocks begun in the link, depth of articles
    dropped = ""  # the element that is being left out, with its depth
    depth = 0
    saw_article, heading = False, False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                counts = 0 if dropped or (not inside and linked > LINKS * len(line)) else len(line)
                lines.append((line, counts, inside > 0, heading))
        linked = 0

    at, last = 0, page.rfind(">") + 1
    found_tags = tags(page)
    tag = next(found_tags, None)
    while tag:
        start, at_end, closing, name, attributes = tag
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = at_end
        if name in UNSEEN and not closing:
            if not attributes.endswith("/"):
                end = _ENDS[name].search(page, at, last)
                at = end.end() if end else len(page)
            tag = _next(found_tags, at)
            continue
        tag = _next(found_tags)
        if not name:
            continue
        if name == "a":
            in_link = not closing and not _closes_itself(attributes)
            if in_link:
                follows = _ANCHOR.search(page, at)
                closed, within_link = bool(follows and follows[1]), 0
            continue
        if in_link and name in BLOCKS:
            within_link += -1 if closing else name not in EMPTY
            in_link = closed and within_link >= 0
        if name == "br":
            text.append(" ")
            continue
        if name in HEADINGS:
            flush()
            heading = not closing
        if name not in BLOCKS and not dropped:
            if not closing and name not in EMPTY and _marked(attributes, name, inside):
                flush()
                dropped, depth = name, 1
            elif name in DROPPED and not closing:
                flush()
                dropped, depth = name, 1
            continue
        if dropped:
            if name in ("article", "main") and not closing and dropped not in ("article", "main"):
                flush()
                dropped = ""
            elif dropped in IMPLIED and name in BLOCKS and (name != dropped or not closing):
                flush()
                dropped = ""
            elif name == dropped:
                flush()
                depth += -1 if closing else 1
                if depth <= 0:
                    dropped = ""
                if closing or dropped:
                    continue
            else:
                if name in BLOCKS:
                    flush()
                continue
        flush()
        if closing:
            if name in ("article", "main"):
                inside = max(0, inside - 1)
            continue
        article_header = name == "header" and inside
        if name not in WHOLE and ((name in DROPPED and not article_header) or _marked(attributes, name, inside)):
            dropped, depth = name, 1
        elif name in ("article", "main"):
            inside += 1
            saw_article = True
    if at < len(page):
        text.append(page[at:])
    flush()
    return [
        (line, counts if within or not saw_article else 0, within or heads) for line, counts, within, heads in lines
    ]


def main_text(page: str | None) -> str:
    """The lines of an article, or of the runs that surge, joined by line feeds."""
    lines = lines_of(page or "")
    counts = [c for _, c, _ in lines]
    sums = [sum(counts[i : i + WINDOW]) for i in range(len(counts))]
    least = min(SCRAP, max(1.0, SURGE * max(sums, default=0)))
    kept: list[str] = []
    run: list[str] = []  # since the last dive
    surged = False
    for (line, count, within), ahead in zip(lines, sums, strict=True):
        if not ahead:  # dive
            if surged:
                kept += run
            run, surged = [], False
        elif count:
            run.append(line)
            surged = surged or within or ahead >= least
    if surged:
        kept += run
    return "\n".join(kept)


def extracted(table: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["key", "url", "text", "n_chars"],
            )

    kind = table.schema[key].dataType.simpleString()
    rows = table.select(key, url, page)
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint").withColumnsRenamed(
        {"key": key, "url": url}
    )
