"""Main text of web pages by text-to-tag ratios.

Events of the standard library's streaming parser cut a page into lines (blocks). Each line has a ratio
of text to tags, in which the text of links is none; the ratios are smoothed by a Gaussian and clustered
by a threshold (two means) into content and the rest. A region is an ``article`` or ``main`` element, or
else the page's body: of the former, those count that hold a content line, of the latter the stretch
from its first to its last content line. Within either, lines below the threshold are left out if most of
their text is links, as in lists of further articles, tags or shares; headings and short paragraphs, of
which the ratio is low too, stay. Lines inside menus, headers, footers, sidebars, notices, adverts, forms
and reader comments never count, whether marked by their element, role, class or id.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements whose text isn't part of any article.
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input menu nav noscript object script "
    "search select style svg template textarea title video".split()
)
SKIPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Words that mark such parts as the first or last word of a class name or an id.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright disclaimer disqus feedback footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related "
    "replies reply respond responses share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget "
    "widgets".split()
)
#: What a head may hold; anything else ends one that isn't closed.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A class such as "with-sidebar" tells of the page's layout; "entry-header" holds the article's title.
LAYOUT = frozenset("has no with without".split())
TITLES = frozenset("article entry post section story".split())
#: An open element of a key ends where one of its values begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
SCOPES = frozenset("ul ol dl table article aside body div main nav section td th form footer header".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _is_noise(names: str) -> bool:
    for name in names.split():
        words = [x.lower() for x in _WORDS.findall(name)]
        if words and not LAYOUT & set(words) and (words[0] in NOISE or words[-1] in NOISE):
            if words[-1] == "header" and words[0] in TITLES:
                continue
            return True
    return False


def _skips(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in SKIPPED:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return any(k in ("class", "id") and v and "comment" in v.lower().split("-")[0] for k, v in attrs) if tag == "article" else False
    for k, v in attrs:
        if k in ("class", "id") and v and _is_noise(v):
            return True
        if k == "role" and v and v.lower() in SKIPPED_ROLES or k == "hidden":
            return True
        if k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, tags, region, characters in links) of each line; region 0 is the body outside article and main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: (name, by how much its end lowers skip, region before it)
        self.open: list[tuple[str, int, int]] = []
        self.skip, self.region, self.regions = 0, 0, 0
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []

    def end_line(self):
        words = " ".join("".join(self.text).split())
        if words:
            self.lines.append((words, self.tags, self.region, min(self.linked, len(words))))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def _end_head(self):
        if self.open and self.open[-1][0] == "head":
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            if not self.skip:
                self.end_line()
            self._imply_ends(tag)
        if tag == "a":
            self._end_link()
        self.tags += not self.skip
        if tag == "br" and not self.skip:
            self.text.append(" ")
        if tag in VOID:
            return
        skips, region = int(_skips(tag, attrs)), self.region
        if tag in ("article", "main") and not skips and all(name == "form" for name, n, _ in self.open if n > 0):
            skips = -self.skip  # a form about the whole page is no part of the article
            self.skip = self.linked = 0
            self.text.clear()
        if tag in ("article", "main") and not skips and not self.skip and not self.region:
            self.regions += 1
            self.region = self.regions
        self.open.append((tag, skips, region))
        self.skip += max(skips, 0)
        self.links += tag == "a"

    def _end_link(self):
        """A link ends where another begins."""
        if self.links:
            at = max(i for i, x in enumerate(self.open) if x[0] == "a")
            if all(name not in SCOPES for name, _, _ in self.open[at:]):
                self._close(at)

    def handle_startendtag(self, tag, attrs):
        # HTML has no self-closing elements but the void ones; in foreign content there are some.
        if tag in VOID or tag not in BLOCK:
            if tag in BLOCK or tag == "br":
                self.handle_starttag(tag, attrs)
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK and not self.skip:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self._close(i)
                return
            if name in SCOPES and tag not in BLOCK:
                return  # the end of an inline element doesn't end blocks

    def _imply_ends(self, tag):
        ends = ENDED_BY.get(tag)
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p" or ends and name in ENDED_BY and tag in ENDED_BY[name]:
                self._close(i)
                if name != "p":
                    return
            elif name in SCOPES:
                return

    def _close(self, i):
        for name, skips, region in reversed(self.open[i:]):
            self.skip -= skips
            self.links -= name == "a"
            self.region = region
        del self.open[i:]

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if not self.skip:
            self.text.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def lines_of(html: str) -> list[tuple[str, int, int, int]]:
    parser = _Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # of the standard library, on some malformed declarations
        parser = _Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.end_line()
    return parser.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, by weights that sum to one at the borders too."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def threshold(values: np.ndarray, apart: float = 1.4) -> float:
    """Where two means part the values; the least value if these aren't ``apart`` (four times, of logarithms)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            return float(values.min())
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= apart else float(values.min())


def main_text(html: str | None) -> str:
    """The content lines of a page, joined by single spaces; empty without any."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    length, tags, regions, linked = (np.array(x) for x in zip(*((len(x[0]), *x[1:]) for x in lines), strict=True))
    level = smoothed(np.log1p((length - linked) / np.maximum(tags, 1)))
    content = level >= threshold(level)
    left_out = ~content & (2 * linked > length)
    if regions.any():
        chosen = set(regions[content & (regions > 0)].tolist()) or set(regions[regions > 0].tolist())
        kept = [i for i in range(len(lines)) if regions[i] in chosen]
    else:
        at = np.flatnonzero(content)
        kept = range(at[0], at[-1] + 1)
    return " ".join(lines[i][0] for i in kept if not left_out[i])


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (its code points) from whole pages.

    Edge cases: a null or empty page, or one without text, has the empty text; an article within a form
    about the whole page counts; markup that is broken or
    never closed is read as far as it goes; repeated rows are read alike; an empty table gives none;
    input columns named like an added one give way to it.
    """

    def rows():
        def of(pages):
            texts = [main_text(x.decode("utf-8", "replace") if x is not None else None) for x in pages]
            return [texts, [len(x) for x in texts]]

        return of

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return annotate(pages, rows, fields, html, keep)
