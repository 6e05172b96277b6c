"""Main text of web pages, by text-to-tag ratios of lines.

The standard library's parser streams the page as events. Every block element ends a *line*; a line knows its text, how
many tags it took, and where it stands. A line's text-to-tag ratio is its characters over its tags (link text does not
count). Ratios are smoothed over neighbouring lines by a Gaussian, and lines at or above one standard deviation of the
smoothed ratios form the content cluster, which selects where the content is. Structure vetoes and rounds off:

* Noise is never taken: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments by
  readers, hidden elements. It is known by tag, role, or a class or id all of whose words say so (``cookie-notice`` does,
  ``has-sidebar`` and ``share-price`` do not). A class or id does not reach into an article or main element below it,
  unless it says comments; and one that holds half of the page's text or more says nothing.
* The content are the outermost article or main elements in which the cluster lies, those of them with at least SHARE of
  the largest one's sum of smoothed ratios, with all their other lines: a short heading belongs to its article. If the
  cluster lies outside all of them, it is the one with the largest sum.
* On pages without such elements the content is the cluster, with the lines without many links that stand between two of
  its lines or directly in the same container.

White space inside a line becomes one space; lines are joined by a line feed. Null and empty pages give an empty text. A
page is never cut, however long; unclosed and misnested tags are closed where the next fitting tag demands it.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from docketflow.llm.rows import map_rows

SIGMA = 1.0
RADIUS = 2
SHARE = 0.2
FEED_CHARS = 65_536

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul caption".split())
_SKIP = frozenset("head title script style noscript template nav aside form button select option textarea iframe svg "
                  "object canvas audio video menu dialog footer".split())
_ENDED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: What each tag ends, if it is open.
_ENDS = {tag: [inner for inner, by in _ENDED_BY.items() if tag in by] for by in _ENDED_BY.values() for tag in by}
_SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())
_CONTAINER = frozenset("article body div html main section td th".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
_NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu "
                   "nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification "
                   "alert popup modal overlay share sharing social related recommended newsletter subscribe subscription "
                   "signup login search widget pagination pager toolbar masthead topbar skip".split()) | _COMMENTS
#: Words that may stand beside those without changing what they say.
_NEUTRAL = frozenset("area bar block bottom box button buttons column container content form group icons inner item items left "
                     "link links list main page panel post posts right row section site slot text top unit wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _says(attributes: dict, hints: frozenset) -> bool:
    """Whether a whole class or id is made of hints, with neutral words and numbers beside them."""
    for name in ("class", "id"):
        for one in (attributes.get(name) or "").split():
            words = [w.lower() for w in _WORD.findall(one)]
            if any(w in hints for w in words) and all(w in hints or w in _NEUTRAL or w.isdigit() for w in words):
                return True
    return False


class _Element(NamedTuple):
    """An open element: what its lines inherit."""

    tag: str
    noise: bool         # by tag, role, comments or hiding
    named: int          # the outermost element whose name says noise; 0: none
    region: int
    container: int
    links: int          # open links when it began


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    noise: bool
    named: int
    region: int
    container: int


_ROOT = _Element("", False, 0, 0, 0, 0)


class _Lines(HTMLParser):
    """Collects lines from parser events.

    Only elements that may matter to a line are kept open: blocks, and inline ones that say noise or lie in such a one of
    their tag. How many of each tag are open is counted, so most tags need no search, and a search ends at a block.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self._open: list[_Element] = []
        self._held: Counter = Counter()
        self._text: list[str] = []
        self._tags = self._linked = self._links = self._count = 0

    def _top(self) -> _Element:
        return self._open[-1] if self._open else _ROOT

    def _end_line(self) -> None:
        top = self._top()
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(_Line(text, max(1, self._tags), self._linked, top.noise, top.named, top.region, top.container))
            self._tags = 0
        self._text, self._linked = [], 0

    def _close_from(self, at: int) -> None:
        self._links = self._open[at].links
        for element in self._open[at:]:
            self._held[element.tag] -= 1
        del self._open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in _BLOCK or tag in _SKIP
        if block:
            self._end_line()
        self._tags += 1
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            return
        if any(self._held[inner] for inner in _ENDS.get(tag, ())):
            for at in range(len(self._open) - 1, -1, -1):
                inner = self._open[at].tag
                if tag in _ENDED_BY.get(inner, ()):
                    self._close_from(at)
                    break
                if inner in _BLOCK and inner not in _ENDED_BY:
                    break
        if tag == "a":
            self._links += 1
        top, attributes = self._top(), dict(attrs)
        role = (attributes.get("role") or "").lower()
        marks = tag in ("article", "main") or role in ("main", "article")
        whole = tag in ("html", "body")
        noise = top.noise or tag in _SKIP or (tag == "header" and not top.region) or role in _ROLES or "hidden" in attributes \
            or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style") or "") is not None \
            or (not whole and _says(attributes, _COMMENTS))
        named = 0 if marks else top.named
        says = not whole and not marks and _says(attributes, _NOISE if top.region else _NOISE | {"header"})
        if not block:   # a part of a line: its text is left out
            noise, says = noise or says, False
            if noise == top.noise and not self._held[tag]:
                return
        self._count += 1
        region = self._count if marks and not noise and not top.region else top.region
        self._held[tag] += 1
        self._open.append(_Element(tag, noise, self._count if says and not named else named, region,
                                   self._count if tag in _CONTAINER else top.container, self._links - (tag == "a")))

    def handle_endtag(self, tag: str) -> None:
        block = tag in _BLOCK or tag in _SKIP
        if block:
            self._end_line()
        self._tags += 1
        if self._held[tag]:
            for at in range(len(self._open) - 1, -1, -1):
                inner = self._open[at].tag
                if inner == tag:
                    self._close_from(at)
                    return
                if inner in _SCOPE and tag not in _SCOPE and tag not in _SKIP:
                    break
        if tag == "a" and self._links > self._top().links:
            self._links -= 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1].noise and self._open[-1].tag not in _BLOCK:
            return
        self._text.append(data)
        if self._links > 0:
            self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; the weights beyond the ends fall away and the rest are scaled up."""
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma ** 2))
    padded = lambda x: np.convolve(x, weights)[radius:radius + len(x)]
    return padded(ratios) / padded(np.ones(len(ratios)))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = _Lines()
    for at in range(0, len(html), FEED_CHARS):
        parser.feed(html[at:at + FEED_CHARS])
    parser.close()
    lines = parser.lines
    clean = _clean(lines)
    if not clean.any():
        return ""
    ratios = np.array([max(0, len(x.text) - x.linked) / x.tags for x in lines]) * clean
    smoothed = smooth(ratios)
    cluster = clean & (smoothed >= min(smoothed.std(), smoothed[clean].max())) & (ratios > 0)
    region = np.array([x.region for x in lines])
    if (clean & (region > 0)).any():
        chosen = region[cluster & (region > 0)] if (cluster & (region > 0)).any() else region[clean & (region > 0)]
        sums = {r: smoothed[clean & (region == r)].sum() for r in np.unique(chosen).tolist()}
        most = max(sums.values())
        if not (cluster & (region > 0)).any():
            sums = {max(sums, key=lambda r: (sums[r], -r)): most}
        taken = clean & np.isin(region, [r for r, value in sums.items() if value >= SHARE * most])
    else:
        at = np.flatnonzero(cluster)
        inside = np.zeros(len(lines), bool)
        inside[at[0]:at[-1] + 1] = True
        container = np.array([x.container for x in lines])
        unlinked = np.array([2 * x.linked <= len(x.text) for x in lines])
        taken = clean & (cluster | (unlinked & (inside | np.isin(container, container[cluster]))))
    return "\n".join(x.text for x, t in zip(lines, taken) if t)


def _clean(lines: list[_Line]) -> np.ndarray:
    """Which lines are no noise; of the elements whose name says noise only those count that hold less than half the text."""
    sizes: Counter = Counter()
    for x in lines:
        if not x.noise:
            sizes[x.named] += len(x.text) - x.linked
    total = sum(sizes.values())
    return np.array([not x.noise and (not x.named or 2 * sizes[x.named] >= total > 0) for x in lines], bool)


def texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    def work(address, page):
        text = extract(page)
        return address, text, len(text)

    return map_rows(pages.select(key, url, html), work, "url string, text string, n_chars long", keep=True)
