"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser turns a page into lines: each block
element, and each line break, ends one. A line's ratio is its characters outside links over its
tags. The ratios, in page order, are smoothed with a Gaussian kernel, and
lines above THRESHOLD standard deviations form the content clusters. The
region is the smallest element that holds most of the clusters' text, then its parents as long as most of what
each adds is of the clusters too; inside an article or main element it is enough that what is added isn't mostly links.
The region's lines are the result, short ones too. A page without a cluster has no text.

Menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles,
told by element, role or class, count as lines without a character in the ratios and never return. A class or id tells only as a whole (see ``_marked``), and
not by itself if its element holds more than half of the page's text.

Defined results: null and empty html give an empty text. Character references
are decoded once, white space in a line becomes one space, and lines are
joined by one newline. Rows come back one each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGMA, THRESHOLD = 1.0, 1.0
#: The share of the clusters' text that the region must hold.
SHARE = 0.7

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template nav footer aside form button select textarea iframe svg object canvas dialog menu head title search audio video".split())
#: Elements whose content no reader sees: it makes no line.
UNSEEN = frozenset("script style noscript template head title svg object canvas audio video iframe select textarea".split())
#: Elements whose content is text, so that no comment begins in it.
PLAIN = frozenset("textarea title iframe noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr hidden login masthead menu menus modal"
    " nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related reply respond replies share sharing sidebar signup"
    " site-header page-header skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What an element closes that has no end tag of its own.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article main section div td body blockquote table center".split())
#: What a marked name may have beside it and be marked still, as in main-nav or related-posts.
BESIDE = frozenset(
    "area articles bar block bottom box btn button buttons col column container form global icon icons inner item items left link links list outer panel posts primary right row secondary site slot top unit"
    " wrap wrapper".split()
)
#: Elements that are headings or text themselves; their ids are often made from their words.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption caption td th span a".split())
#: What readers wrote is no main text, however long.
DISCUSSION = frozenset("comment comments reply respond replies".split())
_PIECES = re.compile(r"[a-z]+")
KEPT, MAYBE, GONE = 0, 1, 2


def _marked(token: str) -> bool:
    """Whether a class or id as a whole says boilerplate: no piece of it says anything else."""
    if token in MARKED:
        return True
    pieces = _PIECES.findall(token)
    return not MARKED.isdisjoint(pieces) and all(x in MARKED or x in BESIDE for x in pieces)


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """KEPT, GONE, or MAYBE: by its class or id alone, so that it stays if it holds most of the page's text."""
    if tag in NEVER or tag == "header" and not in_article:
        return GONE
    out = KEPT
    for name, value in attrs:
        if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
            for token in value.lower().split() if name == "class" or tag not in TEXTUAL else ():
                if _marked(token):
                    out = max(out, MAYBE if DISCUSSION.isdisjoint(_PIECES.findall(token)) else GONE)
        elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
    return out


class _Lines(HTMLParser):
    """Lines of a page, with the elements that they are in."""

    def __init__(self, stay: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.stay = stay  # numbers of MAYBE elements that aren't dropped
        self.maybes = 0
        self.gone = 0  # how many open elements are GONE
        self.seen = self.body = 0  # characters outside those; and of these, not dropped and in an article or main element
        self.bodies = 0
        self.marks: list[tuple[int, int, bool] | None] = []  # of open MAYBE elements: number, ``seen`` before, whether in an article or main element
        self.marked: list[tuple[int, int, bool]] = []  # number, characters, the same
        self.open: list[tuple[str, int]] = []  # element and its container's number, or -1
        self.unseen = 0  # how many open elements are UNSEEN
        self.other = False  # whether boilerplate has text in this line
        self.dropped = 0  # how many open elements are boilerplate
        self.drops: list[int] = []
        self.articles = 0
        self.links = 0
        self.parent = [-1]  # container 0 is the page
        self.kind = ["page"]
        self.at = 0  # the innermost container
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, container

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or self.other:
            self.lines.append((text, self.tags, self.linked, self.at))
        self.parts.clear()
        self.tags = self.linked = 0
        self.other = False

    def pop(self) -> None:
        tag, container = self.open.pop()
        if tag in BLOCKS:
            self.end_line()
        drop = self.drops.pop()
        self.dropped -= drop > KEPT
        self.gone -= drop == GONE
        self.unseen -= tag in UNSEEN
        mark = self.marks.pop()
        if mark:
            self.marked.append((mark[0], self.seen - mark[1], mark[2]))
        self.bodies -= tag in ("article", "main")
        self.articles -= tag == "article"
        self.links -= tag == "a"
        if container >= 0:
            self.at = self.parent[container]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self.end_line()
            closes = CLOSES.get(tag, ())
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in closes or name == "p" and tag != "br":
                    while len(self.open) > k:
                        self.pop()
                    break
                if name in BLOCKS:
                    break
        self.tags += 1
        if tag in VOID:
            return
        container = -1
        if tag in CONTAINERS and not self.dropped:
            container = len(self.parent)
            self.parent.append(self.at)
            self.kind.append(tag)
            self.at = container
        drop = _boilerplate(tag, attrs, self.articles > 0)
        mark = None
        if drop == MAYBE:
            mark = self.maybes, self.seen, self.bodies > 0
            if self.maybes in self.stay:
                drop = KEPT
            self.maybes += 1
        self.open.append((tag, container))
        self.drops.append(drop)
        self.marks.append(mark)
        self.dropped += drop > KEPT
        self.gone += drop == GONE
        self.unseen += tag in UNSEEN
        self.bodies += tag in ("article", "main")
        self.articles += tag == "article"
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                return
        if tag in BLOCKS:
            self.end_line()

    def parse_comment(self, i: int, report: bool = True) -> int:
        if any(tag in PLAIN for tag, _ in self.open):
            self.handle_data("<!--")
            return i + 4
        k = super().parse_comment(i, report)
        return k if k >= 0 else len(self.rawdata)  # a comment without end takes the rest

    def handle_data(self, data: str) -> None:
        if not self.gone:
            size = len(data.strip())
            self.seen += size
            if self.bodies and not self.dropped:
                self.body += size
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)
        elif not self.unseen and not data.isspace():
            self.other = True


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with a kernel of two sigmas to each side, its weights made to sum to 1 at the ends."""
    r = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    full = np.convolve(np.pad(ratios, r), kernel, "valid")
    return full / np.convolve(np.pad(np.ones(len(ratios)), r), kernel, "valid")


def _parsed(html: str, stay: frozenset[int] = frozenset()) -> _Lines:
    p = _Lines(stay)
    p.feed(html)
    p.close()
    while p.open:
        p.pop()
    p.end_line()
    return p


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = _parsed(html)
    # a name is no reason to drop most of the text, unless an article stands beside it
    stay = frozenset(k for k, size, in_body in p.marked if 2 * size > p.seen and (in_body or not p.body))
    if stay:
        p = _parsed(html, stay)
    lines = p.lines
    if not lines:
        return ""
    chars = np.array([len(t) for t, _, _, _ in lines], float)
    tags = np.array([max(1, n) for _, n, _, _ in lines], float)
    linked = np.minimum(chars, [n for _, _, n, _ in lines])
    ratio = smoothed((chars - linked) / tags)
    content = (ratio >= min(THRESHOLD * ratio.std(), ratio.max())) & (chars > 0)
    if not content.any():
        return ""
    at = np.array([k for _, _, _, k in lines])
    # characters in the clusters, in links and in all, of each element with what is in it
    inside = np.zeros((3, len(p.parent)))
    for total, value in zip(inside, (np.where(content, chars, 0), linked, chars), strict=True):
        np.add.at(total, at, value)
    for k in range(len(p.parent) - 1, 0, -1):  # a container follows its parent
        inside[:, p.parent[k]] += inside[:, k]
    weight = inside[0]
    region = max(k for k in range(len(weight)) if weight[k] >= SHARE * weight[0])
    bodies = [k for k, kind in enumerate(p.kind) if kind in ("article", "main")]
    if not any(_within(p.parent, region, k) for k in bodies):  # text in several elements: an article among them that has most of it
        best = max((k for k in bodies if _within(p.parent, k, region)), key=weight.__getitem__, default=region)
        region = best if 2 * weight[best] >= weight[region] else region
    while region:
        more = inside[:, p.parent[region]] - inside[:, region]
        in_body = any(_within(p.parent, p.parent[region], k) for k in bodies)
        if 2 * more[0] <= more[2] and not (in_body and 2 * more[1] <= more[2]):
            break
        region = p.parent[region]
    body = any(_within(p.parent, region, k) for k in bodies)
    return "\n".join(t for i, (t, _, _, k) in enumerate(lines) if t and _within(p.parent, k, region) and (body or content[i] or 2 * linked[i] <= chars[i]))


def _within(parent: list[int], k: int, outer: int) -> bool:
    """Whether container k is ``outer`` or in it; a container follows its parent."""
    while k > outer:
        k = parent[k]
    return k == outer


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
