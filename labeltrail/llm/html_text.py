"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block of
text, with the number of tags met on the way. Each line's ratio of characters to tags
is smoothed by a Gaussian over its neighbours, and a two-means threshold parts lines of content
from lines of markup. The element that holds the content lines is the article, and where the page names one by its
tag, the outermost such element, widened until all lines are in it that are content by their own ratio or inside an article; its text are all its
lines, short ones too, but for those inside elements that are menus, notices and the like by their tag, role, class or id.
A class or id, and a form, count only for a block that is no heading, holds no article or main and a minor share of the content;
blocks with the names of reader comments always go, also where they are articles. Lists of short links outside of articles are menus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, map_arrow, record_batch, slices, table, whole_text

SIGMA = 1.0
_SHARE = 0.5  # of the content's characters that an element needs to be gone into
_MINOR = 0.5  # of the content's characters that an element named like a menu or notice holds at most
_MORE = 0.25  # of its characters that its parent may add, as a heading beside the body does

_WORDS = lambda s: frozenset(s.split())
#: Elements without text of their own and those whose text is never content.
_VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
_DROPPED = _WORDS("script style noscript template head title svg math iframe object canvas audio video button select option textarea datalist")
_BOILERPLATE = _WORDS("nav footer aside form dialog menu fieldset")
_BLOCKS = _WORDS(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
_SECTIONS = _WORDS("html body main article section div table tbody tr td center blockquote")
_ARTICLES = _WORDS("article main")
_HEADINGS = _WORDS("h1 h2 h3 h4 h5 h6")
_PROSE = _WORDS("p pre blockquote")  # "notice" says something of these, "notice-period" does not
#: Elements that a new block ends where their end tag was left out.
_CLOSED_BY = {t: _WORDS("p") for t in _BLOCKS} | {
    "li": _WORDS("li p"), "dt": _WORDS("dt dd p"), "dd": _WORDS("dt dd p"), "tr": _WORDS("tr td th p"), "td": _WORDS("td th p"),
    "th": _WORDS("td th p"), **{f"h{i}": _WORDS("p h1 h2 h3 h4 h5 h6") for i in range(1, 7)},
}
_BOILERPLATE_ROLES = _WORDS("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar")
_BOILERPLATE_NAMES = _WORDS(
    "nav navbar navigation menu submenu masthead footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo"
    " promotion banner cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay share sharing social"
    " related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond reply replies"
    " login search toolbar widget copyright disclaimer skip"
)
_COMMENT_NAMES = _WORDS("comment comments commentlist disqus respond reply replies")
_ABOUT_COMMENTS = _WORDS("with no has open closed enabled disabled on off count")
_LISTS = _WORDS("ul ol dl")
_SHORT = 40  # characters of an entry of a menu
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Element:
    __slots__ = ("tag", "parent", "depth", "dropped", "sure", "named", "boilerplate", "in_article", "is_article", "holds_article", "content", "chars", "linked", "lines", "longest", "held", "inside")

    def __init__(self, tag: str, parent: _Element | None, attrs: dict[str, str | None]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.content = self.chars = self.linked = self.lines = self.longest = self.held = 0
        self.holds_article = self.inside = False
        self.dropped = tag in _DROPPED or bool(parent and parent.dropped)
        above = bool(parent and parent.in_article)
        self.sure = bool(parent and parent.sure) or tag not in ("html", "body") and (
            _is_boilerplate(tag, attrs, above or tag in _ARTICLES) or _is_comment(tag, attrs)
        )
        self.is_article = tag in _ARTICLES and not self.sure
        self.in_article = above or self.is_article
        self.named = tag not in ("html", "body") and _is_named(tag, attrs, self.in_article)
        self.boilerplate = self.sure


def _is_comment(tag: str, attrs: dict[str, str | None]) -> bool:
    """Named as reader comments, also where it is an article; a name that says whether there are any is none."""
    if not attrs or tag == "main" or tag in _HEADINGS:
        return False
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = {token.lower()} if tag in _PROSE else {n.lower() for n in _NAME.findall(token)}
        if words & _COMMENT_NAMES and not words & _ABOUT_COMMENTS:
            return True
    return False


def _is_boilerplate(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """By its tag, its role or as it is hidden."""
    if tag in _BOILERPLATE and tag != "form" or (tag == "header" and not in_article):
        return True
    if not attrs or tag in _ARTICLES:
        return False
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return (attrs.get("role") or "").lower() in _BOILERPLATE_ROLES


def _is_named(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Likely so by a word of its class or id, or as a form, which may go around a whole page."""
    if tag == "form":
        return True
    if not attrs or tag in _ARTICLES or tag in _HEADINGS:
        return False
    own = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    names = set(own.lower().split()) if tag in _PROSE else {n.lower() for n in _NAME.findall(own)}
    return bool(names & _BOILERPLATE_NAMES) or ("header" in names and not in_article)


class _Lines(HTMLParser):
    """Lines of a page: ``(element, text, tags)``, and all block elements, parents first.

    An inline element that is hidden or has no text of its own is muted: what is in it goes, the line goes on.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, {})
        self.elements = [self.at]
        self.open: Counter[str] = Counter()
        self.muted: list[str] = []
        self.in_mute: Counter[str] = Counter()
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0
        self.lines: list[tuple[_Element, str, int]] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((self.at, text, self.tags))
            self.at.lines += 1
            self.at.longest = max(self.at.longest, len(text))
            self.at.linked += min(self.linked, len(text))
            self.at.held += len(text)
            self.tags = 0
        self.linked = 0

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def _open(self, tag: str, attrs) -> None:
        self._end_line()
        self.links = 0
        closed = _CLOSED_BY.get(tag, ())
        while self.at.tag in closed:
            self._leave()
        self.at = _Element(tag, self.at, dict(attrs))
        self.elements.append(self.at)
        self.open[tag] += 1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.muted:
            if tag not in _VOID:
                self.muted.append(tag)
                self.in_mute[tag] += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self._end_line()
        elif tag in _VOID:
            pass
        elif tag in _BLOCKS or tag in ("head", "title"):
            self._open(tag, attrs)
        elif tag in _DROPPED or _is_boilerplate(tag, dict(attrs), True):
            self.muted.append(tag)
            self.in_mute[tag] += 1
        elif tag == "a":
            self.links = 1

    def handle_startendtag(self, tag, attrs):
        if tag in _DROPPED:
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.muted:
            if self.in_mute[tag]:
                while self.muted[-1] != tag:
                    self.in_mute[self.muted.pop()] -= 1
                self.in_mute[self.muted.pop()] -= 1
                return
            if tag not in _SECTIONS or not self.open[tag]:
                return
            self.muted.clear()
            self.in_mute.clear()
        if tag == "a":
            self.links = 0
        if not self.open[tag]:
            return
        found = self.at
        while found.tag != tag:
            found = found.parent
        if self.at.dropped and not found.dropped and tag not in _SECTIONS:
            return
        self._end_line()
        while self.at is not found:
            self._leave()
        self._leave()

    def handle_data(self, data):
        if not self.muted and not self.at.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: ratios smoothed by a Gaussian and parted by two means."""
    if len(ratios) < 2:
        return np.ones(len(ratios), bool)
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios.astype(float), reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), "valid")
    low, high = smooth.min(), smooth.max()
    while True:
        upper = smooth >= (low + high) / 2
        if upper.all():
            return upper
        means = smooth[~upper].mean(), smooth[upper].mean()
        if means == (low, high):
            return upper
        low, high = means


def _sum_up(elements: list[_Element], *names: str) -> None:
    """Each element's numbers with those of all below it."""
    for e in reversed(elements):
        if e.parent is not None:
            for name in names:
                setattr(e.parent, name, getattr(e.parent, name) + getattr(e, name))


def _judge_names(page: _Lines, core: np.ndarray) -> None:
    """Mark what is in elements with the names of menus and notices, but for those with an article or much of the content.

    So are lists outside of articles whose entries are all short and links.
    """
    lines, elements = page.lines, page.elements
    free = [k for k, (e, _, _) in enumerate(lines) if not e.sure]
    if not core[free].any():
        core = np.ones(len(lines), bool)
    total = 0
    for k in free:
        size = len(lines[k][1]) * bool(core[k])
        total += size
        lines[k][0].content += size
    _sum_up(elements, "content", "linked", "held", "lines")
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.holds_article |= e.holds_article or e.is_article
            e.parent.longest = max(e.parent.longest, e.longest)
    for e in elements:
        menu = e.tag in _LISTS and not e.in_article and e.lines > 1 and e.linked >= 0.9 * e.held and e.longest <= _SHORT
        own = (e.named or menu) and not e.holds_article and e.content <= _MINOR * total
        e.boilerplate = e.sure or own or e.parent is not None and e.parent.boilerplate
    if free and all(lines[k][0].boilerplate for k in free):  # nothing but such elements: the ratios decide
        for k in free:
            lines[k][0].boilerplate = False


def main_text(html: str) -> str:
    """Blocks of the article, joined by newlines; empty if there is none."""
    page = _Lines()
    page.feed(html)
    page.close()
    lines, elements = page.lines, page.elements
    ratios = np.array([len(t) / max(1, n) for _, t, n in lines])
    core = content_lines(ratios)
    _judge_names(page, core)
    open_ = [k for k, (e, _, _) in enumerate(lines) if not e.boilerplate]
    if not open_:
        return ""
    if not core[open_].any():
        core[open_] = True
    total = 0
    for e in elements:
        e.content = e.chars = e.held = 0
    for k in open_:
        element, text, _ = lines[k]
        total += len(text) * bool(core[k])
        element.chars += len(text)
        element.content += len(text) * bool(core[k])
    _sum_up(elements, "chars", "content")
    inner = [e for e in elements if e.tag in _SECTIONS and e.content > _SHARE * total]
    if not inner:
        return "\n".join(lines[k][1] for k in open_)
    named = [e for e in inner if e.is_article]
    chosen = min(named, key=lambda e: e.depth) if named else max(inner, key=lambda e: e.depth)
    # content by its own ratio or inside an article, not only by a neighbour's ratio
    own = sorted((k for k in open_ if core[k]), key=lambda k: ratios[k])
    middle = own[int(np.searchsorted(np.cumsum([len(lines[k][1]) for k in own]), total / 2))]
    needed = [lines[k][0] for k in own if lines[k][0].in_article or ratios[k] >= ratios[middle] / 4]
    for e in needed:
        e.held += 1
    _sum_up(elements, "held")
    while chosen.parent is not None and (
        named and chosen.held < len(needed) or chosen.parent.chars <= (1 + _MORE) * chosen.chars and not (named and chosen.parent.tag == "body")
    ):
        chosen = chosen.parent
    for e in elements:
        e.inside = e is chosen or e.parent is not None and e.parent.inside
    return "\n".join(lines[k][1] for k in open_ if lines[k][0].inside)


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = list(map(main_text, batch.column(2).to_pylist()))
        yield record_batch(_TEXTS, [batch.column(0), batch.column(1), texts, list(map(len, texts))])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A page that is null, empty or has no article gives the empty text. Ids and addresses pass through, null or
    repeated as they are; an empty table gives an empty one; other columns are not looked at.
    """
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), whole_text(html).alias("html")
    )
    return map_arrow(own, _extract_part, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
