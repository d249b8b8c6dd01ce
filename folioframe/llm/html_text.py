"""Main text of web pages: text-to-tag ratios, smoothed and clustered, choose the content region.

A page is read as a stream of the standard library's parser events into lines (blocks of text) with
their text length and number of tags. The ratios of text to tags are smoothed with a Gaussian and
split by a threshold into content and clutter. The content lines choose the region: the smallest
element around all of them and the title, or an article element that holds nearly all of them. At the
region's ends, before its first and after its last content line, blocks that are not of the content
lines' kind go. Elements that are clutter by their tag or their class leave no text, unless they turn
out to be around the content.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, text_or_empty

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLUTTER = frozenset(
    "script style noscript template nav header footer aside form button select option textarea input svg canvas"
    " iframe object audio video head title dialog menu".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("body html main article section div td center table tbody tr".split())
ARTICLES = frozenset(["article", "main"])
CLOSED_BY_BLOCK = frozenset(["p"])
#: Whatever their class says, these are not clutter: a word there is about what is around or inside.
NEVER_MARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Whole names in class, id or role that mark menus, notices, adverts, comments and the like.
CLUTTER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu"
    " menubar breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead footer foot toolbar share sharing"
    " social gdpr paywall adsense adslot adbox related recommended recommendations trending comment comments commentlist disqus reply replies respond"
    " discussion pagination pager search copyright legal disclaimer complementary contentinfo".split()
)
#: Parts of a name that say where or what kind a marked element is; any other part makes the name another one.
PLACE_WORDS = frozenset(
    "site page main global primary secondary top bottom left right inner outer post article blog user list box bar block area"
    " section container wrap wrapper content links item items text unit panel sticky mini small large".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
#: Blocks that belong to the text around them, whatever their ratio.
PLAIN = frozenset("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tr td th address".split())
#: Characters a tag at which a paragraph beyond the content lines is prose, too.
PROSE = 20
#: Smoothing of the ratios, as a standard deviation in lines, and where the kernel ends.
SIGMA, RADIUS = 1.0, 3
#: Part of the content lines' text that an article must hold to be chosen, and part of the text outside
#: links that shows a marked element or form to be a wrapper around the page; half if an article is inside.
SHARE = 0.9


@dataclass
class _Element:
    tag: str
    parent: _Element | None
    clutter: bool
    depth: int
    link: bool = False
    wrapper: bool = False  # marked, but perhaps around the whole page
    article: bool = False  # an article or main is inside
    within: bool = False  # inside an article or main
    head: bool = False  # an article's header: its headings are text
    block: _Element | None = None  # the nearest element, itself included, that is not inline
    near: _Element | None = None  # the nearest wrapper, itself included
    title: bool = False  # in an h1
    heading: bool = False  # in a heading
    paragraph: bool = False  # in a p
    listed: bool = False  # in a list
    # Filled in once the region is looked for: sums over what is inside, and where the element is in it.
    votes: int = 0
    musts: int = 0
    inside: bool = False
    branch: _Element | None = None
    leaf: bool = False

    def __post_init__(self) -> None:
        up = self.parent
        self.block = self if self.tag not in INLINE else up and up.block
        self.near = self if self.wrapper else up and up.near
        self.title = self.tag == "h1" or bool(up and up.title)
        self.heading = self.tag in HEADINGS or bool(up and up.heading)
        self.paragraph = self.tag == "p" or bool(up and up.paragraph)
        self.listed = self.tag in LISTS or bool(up and up.listed)


@dataclass
class _Line:
    text: str
    tags: int
    element: _Element
    linked: int  # characters inside links


_PARTS = re.compile(r"[^a-z]+")


@lru_cache(1 << 14)
def _clutter_name(name: str) -> bool:
    """``ad``, ``top-menu`` or ``site_footer``, but not ``with-sidebar``, ``search-results`` or ``no-comments``."""
    parts = {*_PARTS.split(name)} - {""}
    return not CLUTTER_WORDS.isdisjoint(parts) and parts <= CLUTTER_WORDS | PLACE_WORDS


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role") and tag not in NEVER_MARKED and any(map(_clutter_name, value.lower().split())):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


class _Lines(HTMLParser):
    """Parser events to lines; clutter elements leave no text, those that may be wrappers do.

    ``elements`` has all elements, parents before children; ``path`` those that are open, and ``open_at``
    where in it each tag is, so that no event has to look through a deep nest.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = _Element("html", None, False, 0)
        self.elements, self.path = [self.at], [self.at]
        self.open_at: dict[str, list[int]] = {}
        self.lines: list[_Line] = []
        self.buffer: list[str] = []
        self.tags = self.linked = 0

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                self.lines.append(_Line(text, self.tags, self.at, self.linked))
                self.tags = 0
            self.linked = 0

    def _close_from(self, place: int) -> None:
        """Close the open elements from this place of the path on."""
        while len(self.path) > place:
            self.open_at[self.path.pop().tag].pop()
        self.at = self.path[-1]

    def _last(self, *tags: str) -> int:
        """The last place in the path of one of the tags; 0, where the document is, if there is none."""
        return max((places[-1] for t in tags if (places := self.open_at.get(t))), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "br":
                self.buffer.append(" ")
            if tag in VOID:
                return
        else:
            self._flush()
            if tag in VOID:
                return
            e = self.at.block  # a block ends an open paragraph
            if e.parent is not None and (e.tag in CLOSED_BY_BLOCK or (e.tag == tag and tag in ("li", "td", "tr", "dt", "dd", "option"))):
                self._close_from(e.depth)
        up = self.at
        marked = tag in CLUTTER or _marked(tag, attrs)
        wrapper = marked and (tag == "form" or tag not in CLUTTER) and tag not in INLINE
        clutter = up.clutter and not (up.head and tag in HEADINGS) or marked and not wrapper
        head = tag == "header" and up.within and not up.clutter or up.head and not marked
        self.at = _Element(tag, up, clutter, up.depth + 1, up.link or tag == "a", wrapper, within=up.within or tag in ARTICLES, head=head)
        self.elements.append(self.at)
        self.open_at.setdefault(tag, []).append(len(self.path))
        self.path.append(self.at)
        if tag in ARTICLES and not self.at.clutter:
            e = up
            while e is not None and not e.article:
                e.article = True
                e = e.parent

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._flush()
        place = self._last(tag)
        # an inline end tag can't close a block, nor any tag the article or body around it
        if not place or tag in INLINE and self.at.block.depth > place or tag not in ("html", "body") and self._last("body", *ARTICLES) > place:
            return
        self._close_from(place)

    def handle_data(self, data: str) -> None:
        if not self.at.clutter:
            self.buffer.append(data)
            if self.at.link:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def _unwrapped(lines: list[_Line]) -> list[_Line]:
    """The lines outside clutter; a marked element that holds nearly all the text is none.

    Of the outermost marked elements the largest that holds so much is opened, and what is marked inside
    it is weighed in turn. The tags of a line that goes count for the next one.
    """
    own: dict[int, int] = {}  # text outside links of an element's lines that no marked element inside it has
    outside = 0
    nodes: dict[int, _Element] = {}
    for x in lines:
        size, e = len(x.text) - x.linked, x.element.near
        if e is None:
            outside += size
        else:
            own[id(e)] = own.get(id(e), 0) + size
        while e is not None and id(e) not in nodes:
            nodes[id(e)] = e
            e = e.parent.near if e.parent else None
    held = {i: own.get(i, 0) for i in nodes}
    inner: dict[int, list[_Element]] = {}
    tops: list[_Element] = []
    for e in sorted(nodes.values(), key=lambda e: -e.depth):
        up = e.parent.near if e.parent else None
        if up is None:
            tops.append(e)
        else:
            held[id(up)] += held[id(e)]
            inner.setdefault(id(up), []).append(e)
    queues: dict[bool, list[tuple[int, int, _Element]]] = {True: [], False: []}
    order = itertools.count()

    def queue(e: _Element) -> None:
        heapq.heappush(queues[e.article], (-held[id(e)], next(order), e))

    for e in tops:
        queue(e)
    opened: set[int] = set()
    while True:
        firsts = [q[0] for q in queues.values() if q]
        firsts = [f for f in firsts if f[0] < 0 and -f[0] >= (0.5 if f[2].article else SHARE) * (outside - f[0])]
        if not firsts:
            break
        e = heapq.heappop(queues[min(firsts)[2].article])[2]
        opened.add(id(e))
        outside += own.get(id(e), 0)
        for i in inner.get(id(e), ()):
            queue(i)
    free: dict[int, bool] = {}  # whether an element and all the marked ones around it are open
    for e in sorted(nodes.values(), key=lambda e: e.depth):
        up = e.parent.near if e.parent else None
        free[id(e)] = id(e) in opened and (up is None or free[id(up)])
    kept, tags = [], 0
    for x in lines:
        tags += x.tags
        if x.element.near is None or free[id(x.element.near)]:
            x.tags, tags = tags, 0
            kept.append(x)
    return kept


def _smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in enumerate(kernel, i - RADIUS):
            if 0 <= d < len(values):
                total += k * values[d]
                weight += k
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Between the two clusters of the ratios (two means)."""
    low, high = min(values), max(values)
    for _ in range(32):
        middle = (low + high) / 2
        a, b = [v for v in values if v <= middle], [v for v in values if v > middle]
        if not a or not b:
            break
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _region(elements: list[_Element], lines: list[tuple[_Line, bool]]) -> _Element | None:
    """The article that holds nearly all of the content, or else the deepest container of all of it and of the title."""
    total = musts = 0
    holds: set[int] = set()
    for x, content in lines:
        size, must = len(x.text) if content else 0, int(content or x.element.title)
        x.element.votes += size
        x.element.musts += must
        holds.add(id(x.element))
        total += size
        musts += must
    for e in reversed(elements):  # children before parents
        if id(e) in holds and e.parent is not None:
            e.parent.votes += e.votes
            e.parent.musts += e.musts
            holds.add(id(e.parent))
    found = [e for e in elements if id(e) in holds and e.tag in CONTAINERS and (e.musts == musts or e.tag in ARTICLES and e.votes >= SHARE * total)]
    return max(found, key=lambda e: (e.tag in ARTICLES, e.depth), default=None)


def _place(elements: list[_Element], top: _Element | None) -> None:
    """Tell each element whether it is in the region, in which branch of it, and whether all of that branch's text is its own."""
    for e in elements:
        up = e.parent
        e.inside = top is None or e is top or bool(up and up.inside)
        if up is top:
            e.branch, e.leaf = e, True
        elif up is not None and up.branch is not None:
            e.branch, e.leaf = up.branch, up.leaf and e.tag in INLINE


def _branch(x: _Line, top: _Element | None) -> tuple[str, bool] | None:
    """Tag of the element under ``top`` that the line is in, and whether the line is all of it; None if there is none."""
    e = x.element
    return (e.branch.tag, e.leaf) if e is not top and e.branch is not None else None


def _sentence(text: str) -> bool:
    """Whether a block reads as a sentence and not as a label or an imprint."""
    return text.rstrip("\"'”’»)").endswith((".", "!", "?", "…", "。")) and len(text.split()) >= 5 and not any(c in text for c in "©®™")


def _at_the_end(x: _Line, top: _Element | None, kinds: set, before: bool) -> bool:
    """Whether a line beyond the content lines belongs to the text."""
    in_article = top is not None and (top.within or top.tag in ARTICLES)
    e = x.element
    if 2 * x.linked > len(x.text):  # made of links: sources and notes in an article are text
        return in_article and (e.paragraph and e.tag in ("p", "a") or e.listed and not before)
    if in_article or e.heading:
        return in_article or before
    kind = _branch(x, top)
    if kind is None or kind[0] in PLAIN or kind[0] in INLINE or kind in kinds:
        return True
    return _sentence(x.text) and not x.linked or len(x.text) >= PROSE * max(1, x.tags) and e.paragraph


def main_text(html: str | None) -> str:
    """Main text of a page: blocks in page order joined by a line break; empty if there is none."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = _unwrapped(parser.lines)
    if not lines:
        return ""
    smooth = _smooth([len(x.text) / max(1, x.tags) for x in lines])
    bound = min(_threshold(smooth), max(smooth))
    judged = [(x, ratio >= bound) for x, ratio in zip(lines, smooth)]
    top = _region(parser.elements, judged)
    _place(parser.elements, top)
    inside = [(x, content) for x, content in judged if x.element.inside]
    sure = [i for i, (_, content) in enumerate(inside) if content]
    first, last = (sure[0], sure[-1]) if sure else (0, len(inside) - 1)
    kinds = {kind for x, content in inside if content and (kind := _branch(x, top)) and kind[1]}
    return "\n".join(
        x.text for i, (x, _) in enumerate(inside) if first <= i <= last or _at_the_end(x, top, kinds, i < first)
    )


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of ``html_col``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left
    out; character references are decoded; white space inside a block becomes one space. Null or
    empty HTML gives an empty text. Columns ``text`` and ``n_chars`` of ``pages`` are replaced;
    repeated rows each come out.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("_"))
    rows = pages.select(rest.alias("_rest"), text_or_empty(html_col).alias("_html"))
    schema = T.StructType([rows.schema["_rest"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["_rest", "text", "n_chars"]
            )

    return in_batches(rows, run, schema).select(*[F.col("_rest")[c].alias(c) for c in kept], "text", "n_chars")
