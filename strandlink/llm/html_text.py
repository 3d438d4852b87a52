"""Main text of web pages by tag ratios.

Events of the standard library's parser make lines: a block-level tag, a line
break or the end of an excluded element ends a line. Each line has its text, the
number of tags seen since the line before, the characters inside links, and the
container (article, main, section, division, cell, body) that holds it. Menus,
headers, footers, sidebars, forms, scripts and styles never enter a line where their
tags or roles say so. A class or id that begins or ends with a word for such a thing,
for notices, adverts or reader comments is only a suspicion: the ratios decide. An
element under suspicion stays if no article or main outside of it has text and it has most of
the page's content, or an article or main with content; else it is left out.

The ratio of text to tags, links left out, is smoothed along the page by a Gaussian,
and the smoothed ratios are split into two clusters, at the threshold midway between
their means. The upper cluster's lines are content, but for those that smoothing alone lifts
there from next to text and that are no heading or paragraph. The region grows from them to the
innermost container that holds them all, or to the article or main that this lies
in, so that its short lines stay. Where that is the whole body, the region is from
the first to the last of them and of the articles that they lie in, with the
headings, paragraphs and longer texts next to them. No line of the region is dropped,
but for lists of links: sections or divisions of several lines, none of them content, whose
text is links for the most part.

Null pages count as empty and have empty text; a null ``url`` or ``page_id`` stays null.
Rows that repeat get equal results each, other columns aren't read, an empty table gives
no rows. Unclosed and stray tags are tolerated; a page cut off in the middle of a tag
or of a script loses that tag. Every event takes a bounded number of steps, whatever is open.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import light_batches, pieces, record

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EXCLUDED = frozenset("script style noscript template head title nav header footer aside form button select textarea input option iframe object embed svg canvas audio video dialog menu".split())
HOLDERS = frozenset("article main section div td body".split())
#: Words that begin or end a class or id of a menu, header, footer, sidebar, notice, advert, form or of reader comments.
NOISE = frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar sidebars notice notices cookie cookies consent gdpr ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners form forms comment comments disqus newsletter newsletters subscribe signup popup modal toolbar pagination pager social sharing".split())
#: What follows "related" or "recommended" where that names links to other pages.
ELSEWHERE = frozenset("posts articles stories links items news reading pages".split())
#: Words before one of those by which a class speaks of the layout, and before "header" of the article's own heading.
LAYOUT = frozenset("no has with without hide show".split())
OWN = frozenset("article entry post story content".split())
NAME = re.compile(r"[A-Za-z]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Tags that end an open element of their own name.
CLOSING = frozenset("p li td th tr dt dd option".split())
SPACE = re.compile(r"\s+")
SIGMA = 2.0  #: lines over which ratios are smoothed
NEXT = 25  #: characters of a text next to the region that belongs to it, if no heading or paragraph
APART = 3.0  #: least factor between the mean ratios of content and the rest


def is_noise(name: str) -> bool:
    """Whether a class or id names something that isn't content."""
    for token in name.lower().split():
        words = NAME.findall(token)
        if not words or words[0] in LAYOUT or (words[0] in OWN and words[-1] == "header"):
            continue
        if words[0] in NOISE or words[-1] in NOISE:
            return True
        if words[0] in ("related", "recommended") and (len(words) == 1 or words[-1] in ELSEWHERE):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, container, is a heading or paragraph).

    ``parent``, ``begins`` and ``ends`` give each container's holder and the lines that it holds. Elements under suspicion
    are numbered in page order: those of ``trusted`` are read, all for None. Of each ``suspects`` has the one around it,
    the characters outside links in it, and whether some are in an article or main inside; of each line read,
    ``inside`` has the innermost of them and ``article`` the innermost article or main.
    """

    def __init__(self, trusted: frozenset[int] | None = frozenset()):
        super().__init__(convert_charrefs=True)
        self.trusted = trusted
        self.suspects: list[list] = []  # [around, characters, holds an article with text, articles open around it]
        self.suspected: list[int] = []  # those that are open
        self.excluded = 0  # open elements that tags or roles exclude
        self.inside: list[int] = []
        self.article: list[int] = []
        self.seen = 0  # characters outside links and suspects
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.link = self.heading = self.articles = self.silent = 0
        self.parent, self.begins, self.ends, self.kind = [-1], [0], [0], [""]  # container 0 is the page
        self.holder = 0
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # (tag, isn't read, is an article, is excluded, is under suspicion)
        self.places: dict[str, list[int]] = {}  # of the open tags by name
        self.walls: list[int] = []  # places of open blocks and excluded elements
        self.stops: list[int] = []  # places of open articles and bodies

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.holder, self.heading > 0))
            self.inside.append(self.suspected[-1] if self.suspected else -1)
            self.article.append(enclosing(self, self.holder, "whole"))
            self.tags = self.linked = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or (tag in EXCLUDED and not self.silent):
            self.end_line()
        if not self.silent:
            self.tags += 1
        if tag in VOID:
            return
        # A paragraph or item ends the one before it that wasn't closed, if no other block or excluded element is open in that.
        if tag in CLOSING and self.walls and self.open[self.walls[-1]][0] == tag:
            self._close(self.walls[-1])
        named = dict(attrs)
        role = named.get("role")
        article = tag in ("article", "main") or role in ("article", "main")
        excluded = tag in EXCLUDED and not (tag == "header" and self.articles and not self.silent)
        able = tag not in ("html", "body") and not article
        excluded = excluded or (able and role in ROLES)
        suspect = not excluded and not self.excluded and able and any(is_noise(named.get(k) or "") for k in ("class", "id"))
        noise = excluded or (suspect and self.trusted is not None and len(self.suspects) not in self.trusted)
        if suspect:
            self.suspects.append([self.suspected[-1] if self.suspected else -1, 0, False, self.articles])
            self.suspected.append(len(self.suspects) - 1)
        at = len(self.open)
        self.open.append((tag, noise, article, excluded, suspect))
        self.excluded += excluded
        self.places.setdefault(tag, []).append(at)
        if noise or tag in BLOCKS or tag == "option":
            self.walls.append(at)
        if tag in ("article", "body"):
            self.stops.append(at)
        self.silent += noise
        self.articles += article
        if tag in HOLDERS:
            self.parent.append(self.holder)
            self.begins.append(len(self.lines))
            self.ends.append(-1)
            self.kind.append("whole" if article else tag)
            self.holder = len(self.parent) - 1
        self.heading += tag in HEADINGS or tag == "p"
        self.link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()

    def _close(self, place: int) -> None:
        """Closes the element at a place and all that is open in it."""
        while len(self.open) > place:
            tag, noise, article, excluded, suspect = self.open.pop()
            self.excluded -= excluded
            if suspect:
                # What it holds counts for the one around it.
                around, characters, whole, _ = self.suspects[self.suspected.pop()]
                if around >= 0:
                    self.suspects[around][1] += characters
                    self.suspects[around][2] |= whole
            self.places[tag].pop()
            for held in (self.walls, self.stops):
                if held and held[-1] == len(self.open):
                    held.pop()
            self.silent -= noise
            self.articles -= article
            if tag in HOLDERS:
                self.ends[self.holder] = len(self.lines)
                self.holder = self.parent[self.holder]
            self.heading -= tag in HEADINGS or tag == "p"
            self.link -= tag == "a"

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in EXCLUDED:
            self.end_line()
        if not self.silent:
            self.tags += 1
        if not self.places.get(tag):
            return
        place = self.places[tag][-1]
        # A stray end tag doesn't close what holds it.
        if tag in ("article", "body", "html", "main") or not self.stops or self.stops[-1] < place:
            self._close(place)

    def handle_data(self, data):
        if not self.excluded and not self.link and not data.isspace():
            if self.suspected:
                own = self.suspects[self.suspected[-1]]
                own[1] += len(data)
                own[2] |= self.articles > own[3]
            else:
                self.seen += len(data)
        if not self.silent:
            self.text.append(data)
            if self.link:
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, int, bool]]:
        self.close()
        self.end_line()
        self._close(0)
        self.ends[0] = len(self.lines)
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """Midway between the means of the two clusters that it separates itself.

    Means within a factor of ``APART`` are one cluster: the threshold is the least value.
    """
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        if not len(low) or not len(high):
            return float(values.min())
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at if high.mean() > APART * low.mean() else float(values.min())


def ratios_of(lines: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Characters outside links to a tag, of each line."""
    return np.array([(len(text) - linked) / max(tags, 1) for text, tags, linked, _, _ in lines], float)


#: Share of the page's content, at least, of an element under suspicion that stays.
MOST = 0.75


def read(html: str) -> Lines:
    """The page's lines, those of elements under suspicion only where the ratios acquit them."""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    total = parser.seen + sum(s[1] for s in parser.suspects if s[0] < 0)
    # Where no element under suspicion has much of the text or an article, none can stay.
    if not any(s[2] or 2 * s[1] > total for s in parser.suspects):
        return parser
    whole = Lines(None)
    whole.feed(html)
    trusted = acquitted(whole, content(whole.finish()))
    if not trusted:
        return parser
    parser = Lines(trusted)
    parser.feed(html)
    parser.finish()
    return parser


def content(lines: list[tuple[str, int, int, int, bool]]) -> list[int]:
    """The lines of the upper cluster."""
    if not lines:
        return []
    own = ratios_of(lines)
    ratios = smoothed(own)
    limit = threshold(ratios)
    chosen = np.flatnonzero(ratios >= limit).tolist()
    # Next to text, smoothing lifts what isn't; only headings and paragraphs may be short there.
    return [k for k in chosen if lines[k][4] or own[k] >= limit] or chosen


def certain(lines: list[tuple[str, int, int, int, bool]], chosen: list[int]) -> list[int]:
    """Those of the upper cluster's lines that belong there by their own ratio."""
    own = ratios_of(lines)
    limit = threshold(smoothed(own))
    return [k for k in chosen if own[k] >= limit]


def acquitted(parser: Lines, chosen: list[int]) -> frozenset[int]:
    """The elements under suspicion that stay, by the content that they hold."""
    n = len(parser.suspects)
    size, held, written, total, articles = [0] * n, [0] * n, [0] * n, 0, 0
    picked = set(chosen)
    for k, (line, e, article) in enumerate(zip(parser.lines, parser.inside, parser.article, strict=True)):
        length = len(line[0]) - line[2]
        total += length * (k in picked)
        articles += length * (article > 0)
        if e >= 0:
            size[e] += length * (k in picked)
            held[e] += length * (article > 0 and k in picked)
            written[e] += length * (article > 0)
    for e in range(n - 1, -1, -1):  # elements inside come after those around them
        if (around := parser.suspects[e][0]) >= 0:
            for sums in (size, held, written):
                sums[around] += sums[e]
    out: set[int] = set()
    for e in range(n):
        around = parser.suspects[e][0]
        if around >= 0 and around not in out:
            continue
        if articles == written[e] and (held[e] or 0 < MOST * total <= size[e]):
            out.add(e)
    return frozenset(out)


def main_text(html: str | None) -> str:
    """The main text of one page; blocks in page order joined by a space."""
    parser = read(html or "")
    lines = parser.lines
    if not lines:
        return ""
    chosen = content(lines)
    links = lambda x: 2 * x[2] > len(x[0])
    first, last = region(parser, chosen)
    if first is None:
        # No container but the body: the articles of the chosen lines, and what stands next to them.
        first, last = chosen[0], chosen[-1]
        for k in (first, last):
            if whole := enclosing(parser, lines[k][3], "whole"):
                first, last = min(first, parser.begins[whole]), max(last, parser.ends[whole] - 1)
        near = lambda x: not links(x) and (x[4] or len(x[0]) >= NEXT)
        while first and near(lines[first - 1]):
            first -= 1
        while last + 1 < len(lines) and near(lines[last + 1]):
            last += 1
    listed = link_lists(parser, certain(lines, chosen), first, last)
    return " ".join(lines[k][0] for k in range(first, last + 1) if not listed[k])


#: Least lines of a list of links.
LISTED = 3


def link_lists(parser: Lines, chosen: list[int], first: int, last: int) -> np.ndarray:
    """Which lines stand in a section or division inside the region that is a list of links."""
    lines = parser.lines
    length, linked = (np.concatenate([[0], np.cumsum([f(x) for x in lines])]) for f in (lambda x: len(x[0]), lambda x: x[2]))
    held = np.zeros(len(lines) + 1, np.int64)
    held[np.asarray(chosen, np.int64) + 1] = 1
    held = np.cumsum(held)
    edges = np.zeros(len(lines) + 1, np.int64)
    for kind, a, b in zip(parser.kind, parser.begins, parser.ends, strict=True):
        if kind in ("div", "section") and first <= a and b - 1 <= last and b - a >= LISTED and held[a] == held[b] and 2 * (linked[b] - linked[a]) > length[b] - length[a]:
            edges[a] += 1
            edges[b] -= 1
    return np.cumsum(edges) > 0


def enclosing(parser: Lines, holder: int, kind: str) -> int:
    """The innermost container of a kind at or around a container; 0 for none."""
    while holder and parser.kind[holder] != kind:
        holder = parser.parent[holder]
    return holder


def region(parser: Lines, chosen: list[int]) -> tuple[int | None, int | None]:
    """First and last line of the innermost container of all chosen lines, or of the article around it; None where that is the body."""
    holder = parser.lines[chosen[0]][3]
    while holder and parser.ends[holder] <= chosen[-1]:
        holder = parser.parent[holder]
    holder = enclosing(parser, holder, "whole") or holder
    if not holder or parser.kind[holder] == "body":
        return None, None
    return parser.begins[holder], parser.ends[holder] - 1


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    light_batches(pages.sparkSession)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def of(batches):
        for piece in pieces(batches, "html"):
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield record(out, piece.column("page_id"), piece.column("url"), texts, pa.array([len(t) for t in texts], pa.int64()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
