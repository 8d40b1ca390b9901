"""Main text of web pages by text-to-tag ratios.

Parser events cut a page into lines, one per block element; a line knows its
text, the tags within it, its innermost article (or main part) and its
container, the innermost block that is more than a paragraph, heading, item or
list (a list of nothing but links is a container too).  The ratio of characters
to tags, up to FULL, is smoothed with a Gaussian; the threshold between the
clusters is a standard deviation of the smoothed ratios.

Articles are content, but for the containers in them whose smoothed ratios lie
under the threshold on average and that are link text for the greater part, or
stand under a heading of their own behind all that is content: readers' comments.
Other plain text stays, however short.  On a page
without any, lines at or above the threshold, by themselves and smoothed, settle
the content regions: all lines within a container of one, headings included, and
what stands between two of its lines.  Lines inside menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like, as far as they are
marked, are no candidates.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import appended

#: Deviation of the Gaussian in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 1.0
#: Characters a tag from which on a line is plain text: longer ones don't raise the threshold.
FULL = 100.0

# Elements that are never content, elements that make a line of their own, elements without an end
# tag, and words in class, id or role that mark what is around an article.
SKIPPED = frozenset("head title nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login social share sharing related recommended recommendations comment comments commentlist disqus replies reply widget toolbar pagination pager search complementary contentinfo".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt figcaption caption td th tr tbody thead tfoot legend summary hr address".split())
LISTS = frozenset("ul ol dl dir table blockquote pre figure hgroup".split())
ARTICLES = frozenset(("article", "main"))
_SPACE, _WORD, _CUT = re.compile(r"\s+"), re.compile(r"[a-z]+"), re.compile(r"<[/!a-zA-Z][^>]*\Z")


@dataclass
class Line:
    text: str
    tags: int
    article: int
    container: int
    #: Characters within links, without blanks, and whether it is a heading.
    linked: int = 0
    heading: bool = False


@dataclass
class Element:
    tag: str
    number: int
    skipped: bool
    article: int
    #: Places among the open elements of the innermost block, numbers of the innermost container and list, whether within a link.
    block: int = 0
    container: int = 0
    holder: int = 0
    link: bool = False
    parts: list[str] = field(default_factory=list)
    #: Inline elements open right within a block, by tag.
    inline: Counter | None = None


class Lines(HTMLParser):
    """Collects the candidate lines of a page; `lines` is whole after close(). `up` has each container's own container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.parts, self.tags, self.numbers, self.plain = [Element("", 0, False, 0, inline=Counter())], [], [], 0, 0, False
        self.up, self.blocks, self.linked = {0: -1}, Counter(), 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        top = self.open[-1]
        if text and not top.skipped:
            self.lines.append(Line(text, self.tags, top.article, top.container if self.plain else top.holder, self.linked, self.open[top.block].tag in HEADINGS))
        self.parts, self.tags, self.plain, self.linked = [], 0, False, 0

    def _skips(self, tag: str, attrs: list[tuple[str, str | None]], article: int) -> bool:
        if tag in SKIPPED or (tag == "header" and not article):
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = set(_WORD.findall(value.lower()))
                if words & AROUND or ("header" in words and not article):
                    return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
        return False

    def _drop(self, at: int) -> list[Element]:
        """Close the open elements from `at` on."""
        gone = self.open[at:]
        del self.open[at:]
        for e in gone:
            if e.tag in BLOCKS:
                self.blocks[e.tag] -= 1
        if gone and gone[0].tag not in BLOCKS:
            inline = self.open[self.open[-1].block].inline
            for e in gone:
                if e.tag in BLOCKS:
                    break
                inline[e.tag] -= 1
        return gone

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            at = self.open[-1].block
            if at and (self.open[at].tag == "p" or (tag == "li" and self.open[at].tag == "li")):
                self._drop(at)  # an open paragraph ends, and what it holds with it
        elif tag == "br":
            self.parts.append("\n")
        self.tags += 1
        if tag in VOID:
            return
        top = self.open[-1]
        self.numbers += 1
        n, at = self.numbers, len(self.open)
        skipped = top.skipped or self._skips(tag, attrs, top.article)
        e = Element(tag, n, skipped, n if tag in ARTICLES and not top.article else top.article, top.block, top.container, top.holder, top.link or tag == "a")
        if tag in BLOCKS:
            self.blocks[tag] += 1
            e.block, e.inline = at, Counter()
            if tag not in PROSE:
                e.holder, self.up[n] = n, top.holder
                if tag not in LISTS:
                    e.container = n
        else:
            self.open[top.block].inline[tag] += 1
        self.open.append(e)
        if skipped and not top.skipped:
            held, self.parts, self.tags = self.parts, [], 0
            e.parts = held  # what an inline element interrupts goes on after it

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        if not (self.blocks if tag in BLOCKS else self.open[self.open[-1].block].inline)[tag]:
            return  # nothing that it ends; a stray inline end tag ends no block
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                gone = self._drop(i)
                if not self.open[-1].skipped and (first := next((e for e in gone if e.skipped), None)):
                    self.parts, self.tags = first.parts, 0
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].skipped:
            self.parts.append(data)
            if self.open[-1].link:
                self.linked += sum(map(len, data.split()))
            self.plain = self.plain or (not self.open[-1].link and not data.isspace())

    def close(self) -> None:
        super().close()
        self._flush()


def lines_of(html: str | None) -> tuple[list[Line], dict[int, int]]:
    """The candidate lines of a page, and each container's own container."""
    html = html or ""
    cut = html.rfind("<")
    if cut >= 0 and _CUT.match(html, cut):
        html = html[:cut]  # a page that ends within a tag
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser.lines, parser.up


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbouring lines; at the ends, over those that there are."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    full = lambda x: np.convolve(x, kernel, mode="full")[reach : reach + len(x)]
    return full(ratio) / full(np.ones(len(ratio)))


def chosen(lines: list[Line], up: dict[int, int]) -> list[Line]:
    """The lines of the content regions, in page order."""
    within = [x for x in lines if x.article]
    lines = within or lines
    if not lines:
        return []
    ratio = np.minimum(FULL, np.array([len(x.text) / max(1, x.tags) for x in lines]))
    smooth = smoothed(ratio)
    least = THRESHOLD * smooth.std()
    return _of_articles(lines, up, smooth, least) if within else _of_regions(lines, up, ratio, smooth, least)


def _of_articles(lines: list[Line], up: dict[int, int], smooth: np.ndarray, least: float) -> list[Line]:
    """All lines but those in a container within their article whose smoothed ratios are under `least` on average, if it is links or comes under a heading behind the content."""
    total, many, chars, linked, headings, first = Counter(), Counter(), Counter(), Counter(), Counter(), {}
    for i, (x, s) in enumerate(zip(lines, smooth.tolist(), strict=True)):
        c = x.container
        total[c] += s
        many[c] += 1
        chars[c] += len(x.text) - x.text.count(" ")
        linked[c] += x.linked
        headings[c] += x.heading
        first.setdefault(c, i)
    for c in sorted(up, reverse=True):  # a container comes after its own
        if many[c] and up[c] >= 0:
            for n in (total, many, chars, linked, headings):
                n[up[c]] += n[c]
            first[up[c]] = min(first[c], first.get(up[c], first[c]))
    articles = {x.article for x in lines}
    low, gone = {}, {}  # whether a container, or one that it is in, has low ratios; whether it goes
    for c in sorted(up):
        low[c] = c not in articles and (low.get(up[c], False) or (many[c] > 0 and total[c] < least * many[c]))
    end = {x.article: i for i, x in enumerate(lines) if not low[x.container]}
    of = {c: lines[i].article for c, i in first.items()}
    for c in sorted(up):
        own = many[c] > 0 and total[c] < least * many[c] and (2 * linked[c] > chars[c] or (headings[c] > 0 and first[c] > end.get(of[c], -1)))
        gone[c] = c not in articles and (gone.get(up[c], False) or own)
    return [x for x in lines if not gone[x.container]]


def _of_regions(lines: list[Line], up: dict[int, int], ratio: np.ndarray, smooth: np.ndarray, least: float) -> list[Line]:
    """Lines within a container of a content line, and those between two such lines."""
    content = (smooth >= least) & (ratio >= least)  # a neighbour's ratio alone makes no content
    if not content.any():
        content = smooth >= least
    holds = {x.container for x, c in zip(lines, content, strict=True) if c}
    inside = {}
    for c in sorted(up):
        inside[c] = (c in holds and c > 0) or inside.get(up[c], False)
    first, last = {}, {}
    for i, x in enumerate(lines):
        if x.container in holds:
            first.setdefault(x.container, i)
            last[x.container] = i
    between = np.zeros(len(lines) + 1, np.int64)
    for c, i in first.items():
        between[i] += 1
        between[last[c] + 1] -= 1
    between = np.cumsum(between)
    return [x for i, x in enumerate(lines) if inside[x.container] or between[i]]


def main_text(html: str | None) -> str:
    """The article of one whole page, a block a line; null, empty and text-free pages have none."""
    return "\n".join(x.text for x in chosen(*lines_of(html)))


def extract(df: DataFrame, html: str) -> DataFrame:
    """`df` with text, the main text of `html`, and n_chars, its code points.

    A null or empty page, or one without text, has the empty text.  Repeated rows are kept; columns named like the new ones are replaced.
    """

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        got = [main_text(h) for h in b.column(html).to_pylist()]
        return [pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]

    return appended(df, html, {"text": "string", "n_chars": "long"}, work)
