"""Main text of web pages by line-block distribution.

The markup is cut into lines at block-level tags.  A line's weight is its text outside
links, and inside a named article (``article``, ``main``, an articleBody) its text in
links too, so that a list of links belongs to an article but not to a page.  Lines
inside chrome (menus, headers and footers of the page, sidebars, notices, adverts,
forms, comments) are left out.  Sums over a sliding window of lines give the block
distribution; a stretch of text lies between the point where it surges and the point
where it dives, and the heaviest stretch is the main text.  A named article adds
weight: its lines count ``ARTICLE_WEIGHT`` times when stretches are compared.  Where
it makes up a good part of the text found, the main text is that article, with all its
parts; where the distribution lies elsewhere (teasers, an empty frame), the name
counts for nothing.  Without an article, the stretches whose container is the same,
around it or inside it, are joined with the heaviest (the page's body is around
nothing but its own lines).

Outside an article an element is chrome by its name or by a word of its class, id or
role.  Inside one, headings and ids never are, a wrapper is chrome if its class names a
block of its own kind (``ad-box``, ``comments``), and any other class word only
raises a doubt: the element goes if most of its text is links.

A wrapper that is chrome by its class, or a form, doesn't make an article inside it
chrome, if that outweighs the articles outside such wrappers; menus, sidebars and
footers by name, hidden parts, and wrappers of comments, adverts and related pages do.

Defined cases: null and empty html, and pages without a line of main text, give an
empty text; a null id or url stays null; unclosed and misnested tags close at the next
block that rules them out; character references are decoded once; repeated rows are
extracted alike; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, texts_of

WINDOW = 3
#: A window of lines surges from so many characters outside links.
SURGE = 40
#: How much more an article's lines count, and its least share of the text found.
ARTICLE_WEIGHT, ARTICLE_SHARE = 4, 1 / 3
#: How much more an article's lines count, and its least share of the text found.
ARTICLE_WEIGHT, ARTICLE_SHARE = 4, 1 / 3

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea title head audio video annotation annotation-xml".split())
CHROME = frozenset("nav aside footer form menu dialog button select fieldset search".split())
NOT_IN_P = BLOCKS - frozenset(["br"])

# Words in class, id or role that mark chrome.
CHROME_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|rail|widget|footer|foot|masthead|topbar|toolbar|header|"
    r"cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|contentinfo|complementary|search|pagination|pager|tags|skip)(?:$|[\s_-])",
    re.I,
)
#: Of a class inside an article: what names a block that is no part of it.
OWN_BLOCK = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|popup|modal|overlay|breadcrumbs?|"
    r"pagination|pager|sidebar|nav|navbar|navigation|menu|footer|widget|notices?|banner|toolbar)(?:[-_]?(?:bar|block|box|buttons?|container|form|icons?|inner|links?|list|section|slot|thread|unit|widget|wrapper))*",
    re.I,
)
WRAPPERS = frozenset("div section ul ol dl table details figure center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Of a class inside an article: what names a block that is no part of it.
OWN_BLOCK = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|popup|modal|overlay|breadcrumbs?|"
    r"pagination|pager|sidebar|nav|navbar|navigation|menu|footer|widget|notices?|banner|toolbar)(?:[-_]?(?:bar|block|box|buttons?|container|form|icons?|inner|links?|list|section|slot|thread|unit|widget|wrapper))*",
    re.I,
)
WRAPPERS = frozenset("div section ul ol dl table details figure center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLE_WORD = re.compile(r"(?:^|[\s_-])(?:articlebody|article-body|article-content|article-text|post-content|post-body|entry-content|main-content|story-body)(?:$|\s)", re.I)

#: Of these, the words of parts that hold articles of their own.
OWN_ARTICLES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|discussion)(?:$|[\s_-])", re.I
)
CONTAINERS = frozenset("div td main article".split())

OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: As TAG for pages with a quote that never closes: a tag ends at the next bracket.
BROKEN_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)([^>]*+)>")
TITLE_HEADER = re.compile(r"(?:article|post|entry|story)[-_]header", re.I)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
SPACE = re.compile(r"\s+")


class Line:
    """A line of a page: its text, what surrounds it, and its characters outside and inside links."""

    __slots__ = ("article", "box", "chrome", "lifted", "linked", "loose", "text")

    def __init__(self, text: str, loose: int, linked: int, around: _Open):
        self.text, self.loose, self.linked = text, loose, linked
        self.chrome, self.article, self.lifted, self.box = bool(around.chrome), around.article, around.lifted, around.box

    @property
    def weight(self) -> int:
        return self.loose + self.linked if self.article else self.loose


class Line:
    """A line of a page: its text, what surrounds it, and its characters outside and inside links."""

    __slots__ = ("article", "box", "chrome", "lifted", "linked", "loose", "text")

    def __init__(self, text: str, loose: int, linked: int, around: _Open):
        self.text, self.loose, self.linked = text, loose, linked
        self.chrome, self.article, self.lifted, self.box = bool(around.chrome), around.article, around.lifted, around.box

    @property
    def weight(self) -> int:
        return self.loose + self.linked if self.article else self.loose


class _Open:
    """An open element, with what it or one around it is.

    ``doubt``: (first line, characters outside and inside links before it) of an
    element that is chrome if most of its text is links.
    """

    __slots__ = ("article", "box", "chrome", "doubt", "lifted", "link", "name")

    def __init__(self, name: str, chrome: int, article: bool, link: bool, lifted: bool, box: _Box, doubt: tuple[int, int, int] | None = None):
        self.name, self.chrome, self.article, self.link, self.lifted, self.box, self.doubt = name, chrome, article, link, lifted, box, doubt


class _Box:
    """A container: its first line, and the one after its last (None: the page's body)."""

    __slots__ = ("end", "first")

    def __init__(self, first: int, end: int | None = None):
        self.first, self.end = first, end

    def holds(self, other: _Box) -> bool:
        return self is other or self.end is not None and other.end is not None and self.first <= other.first and other.end <= self.end


#: Chrome that an article inside it can outweigh, and chrome that stays.
SOFT, HARD = 1, 2


def _marks(name: str, rest: str, inside: bool) -> tuple[int, bool, bool]:
    """Whether and how an element is chrome, whether it is the article, and whether it is chrome if it is mostly links."""
    chrome, article, doubt = name in CHROME or (name == "header" and not inside), name in ("article", "main"), False
    hard = chrome and name != "form"
    if rest:
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role") and value and name not in ("body", "html"):
                article = article or bool(ARTICLE_WORD.search(value))
                if name == "article":
                    if re.search(r"comment|related|teaser|promo", value, re.I):
                        chrome, article, hard = True, False, hard or bool(OWN_ARTICLES.search(value))
                elif name == "main" or name in HEADINGS or ARTICLE_WORD.search(value):
                    pass
                elif not inside:
                    chrome = chrome or bool(CHROME_WORD.search(TITLE_HEADER.sub("", value)))
                    hard = hard or bool(OWN_ARTICLES.search(value))
                elif key != "id":
                    if name in WRAPPERS and any(map(OWN_BLOCK.fullmatch, value.split())):
                        chrome = hard = True
                    doubt = doubt or bool(CHROME_WORD.search(TITLE_HEADER.sub("", value)))
            elif key == "itemprop" and value.lower() == "articlebody":
                article = True
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                chrome = hard = True
    return (HARD if hard else SOFT) if chrome else 0, article and not chrome, doubt and not chrome


def page_lines(page: str) -> list[Line]:
    """The lines, in page order.

    One pass: each element knows what surrounds it, and numbers of open elements by
    name spare searches that would find nothing.
    """
    lines: list[Line] = []
    stack: list[_Open] = [_Open("", 0, False, False, False, _Box(0))]
    opened: Counter = Counter()
    parts: list[str] = []
    loose = linked = all_loose = all_linked = 0
    links_only: list[tuple[int, int]] = []

    def end_line() -> None:
        nonlocal loose, linked, all_loose, all_linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, loose, linked, stack[-1]))
                all_loose, all_linked = all_loose + loose, all_linked + linked
            parts.clear()
        loose = linked = 0

    def text(raw: str) -> None:
        nonlocal loose, linked
        if raw:
            parts.append(raw)
            if stack[-1].link:
                linked += len(raw.strip())
            else:
                loose += len(raw.strip())

    def cut(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.name] -= 1
            if x.name in CONTAINERS:
                x.box.end = len(lines)
            if x.doubt is not None and all_linked - x.doubt[2] > all_loose - x.doubt[1]:
                links_only.append((x.doubt[0], len(lines)))
        del stack[depth:]

    at, n, tag = 0, len(page), TAG
    last_end = page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last_end and not page.startswith("<!", start):
            text(page[at:])
            break
        text(page[at:start])
        sign = page[start + 1 : start + 2]
        if sign in ("!", "?"):
            m = OTHER.match(page, start)
            at = m.end()
            if m[0].startswith("<![CDATA["):
                text(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        m = tag.match(page, start)
        if m is None and tag is TAG and (BROKEN_TAG.match(page, start)):
            tag = BROKEN_TAG  # a quote never closes: each later tag would look for it again
            m = tag.match(page, start)
        if m is None:
            text(page[start : start + 1])
            at = start + 1
            continue
        at, name = m.end(), m[1].lower()
        if sign == "/":
            if name in BLOCKS:
                end_line()
            if opened[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        cut(i)
                        break
                    if name not in BLOCKS and stack[i].name in NOT_IN_P:
                        break  # an inline end tag doesn't close a block
            continue
        empty = m[2].rstrip().endswith("/")
        if name in RAW:
            if name in BLOCKS:
                end_line()
            if not empty:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if name == "head" and close is None:
                    continue
                at = close.end() if close else n
            continue
        if name in BLOCKS:
            end_line()
            if name == "br":
                continue
            # a p ends where any block begins; a li, dt, dd, option, tr or cell where the next one does
            again = name in ("li", "dt", "dd", "option", "tr", "td", "th")
            if opened["p"] > 0 or again and opened[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p" or again and stack[i].name == name:
                        cut(i)
                        break
                    if stack[i].name in NOT_IN_P:
                        break
        if name in VOID or empty:
            continue
        around = stack[-1]
        chrome, article, doubt = _marks(name, m[2], around.article)
        # the article in soft chrome is judged by itself
        lifts = article and around.chrome == SOFT
        box = _Box(len(lines), len(lines)) if name in CONTAINERS else around.box
        stack.append(_Open(name, chrome if lifts else max(around.chrome, chrome), around.article or article, around.link or name == "a", around.lifted or lifts, box, (len(lines), all_loose, all_linked) if doubt else None))
        opened[name] += 1
    end_line()
    cut(1)
    if links_only:
        depth = [0] * (len(lines) + 1)
        for first, end in links_only:
            depth[first] += 1
            depth[end] -= 1
        for line, n in zip(lines, accumulate(depth), strict=False):
            line.chrome = line.chrome or n > 0
    return lines


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of line blocks, in page order; the dive is exclusive.

    A block is the sum of ``window`` lines.  A stretch begins where a block reaches
    ``surge`` and ends where blocks fall to zero.
    """
    blocks = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, i = [], 0
    while i < len(blocks):
        if blocks[i] < surge:
            i += 1
            continue
        j = i
        while j < len(blocks) and blocks[j] > 0:
            j += 1
        found.append((i, j))
        i = j + 1
    return found


def heaviest(lengths: list[int], found: list[tuple[int, int]]) -> tuple[int, int]:
    return max(found, key=lambda x: (sum(lengths[x[0] : x[1]]), -x[0]), default=(0, 0))


def stretch(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """(surge, dive) of the heaviest stretch."""
    return heaviest(lengths, stretches(lengths, window, surge))


def _container(lines: list[Line], first: int, last: int) -> _Box:
    """The container of most of a stretch's text."""
    weight: Counter = Counter()
    for line in lines[first:last]:
        weight[line.box] += line.weight
    return max(weight, key=weight.__getitem__)


def main_text(page: str) -> str:
    lines = page_lines(page)
    # an article in soft chrome counts if it outweighs those outside
    plain, lifted = (sum(max(1, x.weight) for x in lines if x.article and not x.chrome and x.lifted == v) for v in (False, True))
    # chrome inside the text doesn't cut it in two
    lines = [x for x in lines if not x.chrome and (lifted > plain or not x.lifted)]
    weights = [x.weight for x in lines]
    # 1: a page of a few short lines
    found = stretches(weights) or stretches(weights, surge=1)
    first, last = heaviest([x.weight * (ARTICLE_WEIGHT if x.article else 1) for x in lines], found)
    if not last:
        return ""
    named = sum(x.weight for x in lines[first:last] if x.article)
    if named and named >= ARTICLE_SHARE * sum(weights[first:last]):
        return "\n".join(x.text for x in lines if x.article)
    if len(found) > 1:
        boxes = [_container(lines, a, b) for a, b in found]
        own = boxes[found.index((first, last))]
        joined = [x for x, box in zip(found, boxes, strict=True) if own.holds(box) or box.holds(own)]
        first, last = joined[0][0], joined[-1][1]
    # a window reaches past the line that lifts it: leave out the empty lines at the start
    while first < last and not weights[first]:
        first += 1
    return "\n".join(x.text for x in lines[first:last])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(t) for t in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
