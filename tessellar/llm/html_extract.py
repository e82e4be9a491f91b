"""HTML extraction by line-block distribution.

Markup is stripped first: comments, scripts, styles and the like go with what they hold, and so do parts whose element, role, class or
id names them as page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Block elements end
lines; each line keeps its text, with character references decoded and white space turned into one space, and how much of it is
link text. Then each line has a mass, and masses are summed over sliding windows of `window` lines. A surge point is a line where
the sum rises above a threshold, a share of the largest sum; the dive point after it is where the sum falls to the floor. The text between
surge and dive is kept, short lines included.

A line's mass is its length without links, at most CAP, or 0 if it is mostly links. Where the page marks its article (article, main, role=main, itemprop=articleBody), and the marked
lines hold a good part of the page's text, marks are a prior: a marked line counts PRIOR more, another line a quarter; the floor is PRIOR / 2, which only marked lines
rise above, and a surge needs a line that alone outweighs its share of the threshold. Marks of a small part (cards beside a story) say nothing; such pages, and pages without marks, go by
lengths alone, with the floor at zero.

A null or empty page, or one without text, gives an empty text. Unclosed or wrongly nested elements end with what is
around them. Time is linear in the page's length, whatever its markup: after a quote that never ends, tags end at the next >. Pages are handled one at a time, by rows; a page's memory is a
small multiple of its size. Repeated rows each give their row, an empty table none; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: What follows a tag's name up to its end, quoted parts whole; nothing is tried twice.
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
#: What these hold is no text; it is skipped up to the end tag without being read as markup.
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas video audio select xmp noembed noframes".split())
#: Page furniture by element.
_FURNITURE = frozenset("nav header footer aside form head menu dialog button fieldset label input datalist".split())
#: Page furniture by a word of the class, id or role.
_FURNITURE_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|sidebar|side-?bar|aside|widget|related|recommend(?:ed|ations)?"
    r"|comments?|commentlist|disqus|replies|respond|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|pagination|pager|skip-?link|copyright|contentinfo|complementary|search)(?:[^a-z]|$)"
)
_ARTICLE_NAME = re.compile(r"(?:^|[^a-z])(?:articlebody|article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|main-?content)(?:[^a-z]|$)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
#: An opening tag of these ends an open element of the named ones.
_PARAGRAPH = {"p"}
_ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"p", "option"}}
_FENCE = frozenset("ul ol dl table article section div main body html".split())
#: An article element of such a class is furniture too.
_ASIDE_NAME = re.compile(r"(?:^|\s)(?:comments?|comment-?(?:body|item|entry)|repl(?:y|ies)|related|teaser|promo|sponsored|advert(?:isement)?)(?:\s|$)")
#: A line's length counts up to CAP; a marked line has PRIOR more.
CAP = 400
PRIOR = 600


class Line:
    __slots__ = ("text", "linked", "article")

    def __init__(self, text: str, linked: int, article: bool):
        self.text, self.linked, self.article = text, linked, article


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether attributes name an element as furniture, and as an article."""
    furniture = article = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            article |= bool(_ARTICLE_NAME.search(value)) or key == "role" and value in ("main", "article")
            furniture |= bool(_FURNITURE_NAME.search(re.sub(r"_", "-", value)))
        elif key == "itemprop":
            article |= value == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            furniture = True
        elif key == "style":
            furniture |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
    return furniture and not article, article


def tags(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, "/" or "", name, attributes, end) of each tag in turn, and at last the rest as text with an empty name. The caller may send a place to go on from."""
    at = begin = 0
    last = page.rfind(">")
    quotes = True
    text: list[str] = []
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:  # no tag ends any more; one that has begun is no text
            m = _NAME.match(page, lt + 1) if lt >= 0 else None
            yield "".join((*text, page[begin : lt if m else len(page)])), "", "", "", len(page)
            return
        if page.startswith("<!--", lt):
            text.append(page[begin:lt])
            stop = page.find("-->", lt + 4)
            begin = at = stop + 3 if stop >= 0 else len(page)
        elif page.startswith(("<!", "<?"), lt):
            text.append(page[begin:lt])
            end = "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(end, lt)
            begin = at = stop + len(end) if stop >= 0 else len(page)
        elif m := _NAME.match(page, lt + 1):
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:
                quotes = False  # a quote without an end: from here on they mean nothing
            end = rest.end() if rest else page.find(">", m.end()) + 1
            text.append(page[begin:lt])
            on = yield "".join(text), m[1], m[2].lower(), page[m.end() : end - 1], end
            text = []
            begin = at = end if on is None else on
        else:
            at = lt + 1


def lines_of(page: str) -> list[Line]:
    """The page's lines with text outside furniture, in page order."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, article, link: each for the element or one around it
    open_names: dict[str, int] = {}  # of the whole stack, so that no end tag walks it in vain
    levels: list[dict[str, int]] = [{}]  # the same from each fence on, the fence included
    fences: list[int] = []
    furniture = article = link = False
    breaks = 0

    def end_line() -> None:
        nonlocal linked, breaks
        breaks = 0
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Line(text, min(linked, len(text)), article))
            parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal furniture, article, link
        if any(x[0] in _BLOCK for x in stack[depth:]):
            end_line()
        for at in range(len(stack) - 1, depth - 1, -1):
            name = stack[at][0]
            open_names[name] -= 1
            if fences and fences[-1] == at:
                fences.pop()
                levels.pop()
            else:
                levels[-1][name] -= 1
        del stack[depth:]
        furniture, article, link = stack[-1][1:] if stack else (False, False, False)

    found, on = tags(page), None
    while True:
        text, closing, name, attributes, end = found.send(on)
        on = None
        if text and not furniture:
            if "&" in text:
                text = html.unescape(text)
            if not text.isspace():
                breaks = 0
            parts.append(text)
            if link:
                linked += len(text)
        if not name:
            break
        if closing:
            if name == "p" and not open_names.get("p"):
                end_line()
            level = open_names if name in _BLOCK else levels[-1]
            if level.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                leave(depth)
            continue
        if name in _RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, end)
                on = stop.end() if stop else len(page)
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                end_line()
            continue
        if name in _BLOCK:
            end_line()
            ends = _ENDS.get(name, _PARAGRAPH)
            if any(levels[-1].get(x) for x in ends):
                depth = len(stack) - 1
                while stack[depth][0] not in ends:
                    depth -= 1
                leave(depth)
        if name in _VOID:
            continue
        is_furniture, is_article = _named(attributes) if attributes else (False, False)
        if name in ("article", "main"):
            is_furniture = name == "article" and any(_ASIDE_NAME.search((m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class")
            is_article = not is_furniture
        elif name == "body" or name == "html":
            is_furniture = False
        elif name in _FURNITURE and not is_article:
            is_furniture = True
        if attributes.endswith("/") and name not in _BLOCK:
            continue
        furniture, article, link = furniture or is_furniture, article or is_article, link or name == "a"
        if name in _FENCE:
            fences.append(len(stack))
            levels.append({})
        stack.append((name, furniture, article, link))
        open_names[name] = open_names.get(name, 0) + 1
        levels[-1][name] = levels[-1].get(name, 0) + 1
    end_line()
    return out


def between(masses: np.ndarray, window: int, threshold: float, floor: float = 0.0, lead: float = 0.0) -> np.ndarray:
    """Which lines lie between a surge point, a line of more mass than lead, and its dive point."""
    n = len(masses)
    keep = np.zeros(n, bool)
    sums = np.concatenate(([0], np.cumsum(masses)))
    block = sums[np.minimum(np.arange(n) + window, n)] - sums[:n]  # of each line and the next ones
    i = 0
    while i < n:
        if masses[i] > lead and block[i] > threshold:  # surge
            j = last = i
            while j < n and block[j] > floor:  # dive
                if masses[j] > lead:
                    last = j
                j += 1
            keep[i : last + 1] = True
            i = j
        else:
            i += 1
    return keep


def extract(page: str | None, window: int = 3, share: float = 0.2) -> str:
    """The page's main text."""
    if not page:
        return ""
    lines = lines_of(page)
    if not lines:
        return ""
    lengths = np.array([0 if 2 * x.linked > len(x.text) else len(x.text) - x.linked for x in lines], np.int64)
    marked = np.array([x.article for x in lines])
    masses = np.minimum(lengths, CAP).astype(float)
    trusted = 4 * sum(len(x.text) for x in lines if x.article) >= lengths[~marked].sum() and marked.any()
    if trusted:
        own = np.array([len(x.text) for x in lines])  # in an article links are text too
        masses = np.where(marked, np.minimum(own, CAP) + PRIOR, masses / 4)
    sums = np.concatenate(([0], np.cumsum(masses)))
    blocks = sums[np.minimum(np.arange(len(lines)) + window, len(lines))] - sums[:-1]
    threshold = share * float(blocks.max()) if trusted or len(lines) > window else 0.0
    keep = between(masses, window, threshold, *((PRIOR / 2, threshold / window) if trusted else (0.0, 0.0)))
    return "\n".join(x.text for x, kept in zip(lines, keep, strict=True) if kept)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, window: int = 3, share: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, window, share) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return shared.one_pass(pages, {"page_id": "long", "url": "string", "html": "string"}).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extract_pages(shared.table(spark, sf_dir, "pages"))
