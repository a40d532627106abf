"""Main-text extraction from HTML.

The standard library's streaming parser yields events, from which the page becomes lines: one for each block of text, with its
number of characters and tags. The text-to-tag ratio of the lines is smoothed by a Gaussian kernel, and a two-means
threshold over the smoothed ratios marks the lines that read like content. These alone vote, by their characters, for every container
around them, and the smallest container that holds nearly all (HOME of the votes) is the text's: siblings that share the content are kept together, and
its headings and short paragraphs stay. Tags refine this: where articles and mains hold a QUARTER of the votes, they are taken, all of them. Lines inside
menus, sidebars, notices, adverts, forms, comments and other marked subtrees never count; but a class, id or role marks no subtree that holds most
of the text of articles and mains or, on a page without them, MOST of the text, unless it names comments.

Defined cases: a null or empty page, or one without text outside such subtrees, has an empty text; cut-off pages,
unclosed and stray tags are read as far as they go; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
QUARTER, HOME, MOST = 0.25, 0.9, 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Subtrees that are never article text.
SKIPPED = frozenset(
    "script style noscript template head nav footer aside form button select textarea input iframe object svg canvas "
    "audio video map menu dialog datalist".split()
)
#: Words of a class, id or role that mark a subtree as furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets related "
    "recommended recommendations share sharing social comment comments disqus reply replies respond discussion menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar skip search searchform pager pagination "
    "complementary contentinfo dialog alertdialog form hidden toc".split()
)
#: Those that mark it however much text it holds.
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: An open element that the start of one of these tags ends.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: Elements inside which an implied end does not reach further out.
FENCES = frozenset("ul ol dl table div section article main aside nav body td th blockquote form".split())

_TOKEN = re.compile(r"[a-z]+")


class Line:
    """A block of text: its text, tags, containers from the outside in, whether its subtree is furniture, and the numbers of the words that mark it so."""

    __slots__ = ("containers", "furniture", "marks", "tags", "text")

    def __init__(self, text, tags, containers, furniture, marks=()):
        self.text, self.tags, self.containers, self.furniture, self.marks = text, tags, containers, furniture, marks


class LineReader(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[tuple[str, bool, int, bool]] = []  # tag, starts furniture, container number or -1, starts a mark
        self._marks: tuple[int, ...] = ()
        self._furniture = 0
        self._containers: tuple[tuple[str, int], ...] = ()
        self._text: list[str] = []
        self._tags = 0
        self._n = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(text, max(1, self._tags), self._containers, self._furniture > 0, self._marks))
            self._tags = 0
        self._text = []

    def _is_furniture(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether the subtree is furniture, and whether a word marks it as such."""
        marked = False
        if tag in SKIPPED:
            return True, False
        if tag == "header":  # a site header is furniture; that of an article may hold its title
            return not any(t in REGIONS for t, _ in self._containers), False
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return True, False
            if value and name in ("class", "id", "role") and tag not in ("html", "body", "main"):
                words = set(_TOKEN.findall(value.lower()))
                if words & MARKS and not (tag == "article" and not words & {"comment", "comments", "reply", "ad", "advert", "related", "sponsored"}):
                    if words & COMMENTS:
                        return True, False
                    marked = True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True, False
        return False, marked

    def _pop(self) -> None:
        tag, furniture, container, marked = self._open.pop()
        if tag in BLOCKS or furniture or marked:
            self._flush()  # text of inline furniture, such as a script, is a line of its own
        self._furniture -= furniture
        if marked:
            self._marks = self._marks[:-1]
        if container >= 0:
            self._containers = self._containers[:-1]

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
            if tag != "body":
                self._imply_ends(tag)
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        furniture, marked = self._is_furniture(tag, attrs)
        if furniture or marked:
            self._flush()
        number = -1
        if tag in CONTAINERS:
            self._n += 1
            number = self._n
            self._containers = (*self._containers, (tag, number))
        self._furniture += furniture
        if marked:
            self._n += 1
            self._marks = (*self._marks, self._n)
        self._open.append((tag, furniture, number, marked))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply_ends(self, tag: str) -> None:
        ends = CLOSES.get(tag, frozenset()) | {"p"}  # any block ends an open paragraph
        if tag in HEADINGS:
            ends = ends | HEADINGS
        for i in range(len(self._open) - 1, -1, -1):
            name = self._open[i][0]
            if name in ends:
                while len(self._open) > i:
                    self._pop()
            elif name in FENCES and name not in ends:
                return

    def handle_endtag(self, tag):
        self._tags += 1
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i][0] in FENCES and tag not in FENCES:
                break
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data):
        self._text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        return self.lines


def smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - RADIUS):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def two_means_threshold(values: list[float]) -> float:
    """Midpoint of the centres of two clusters; the value itself if there is only one."""
    low, high = min(values), max(values)
    while True:
        cut = (low + high) / 2
        under = [v for v in values if v <= cut]
        over = [v for v in values if v > cut]
        if not over or not under:
            return cut if over else low
        a, b = sum(under) / len(under), sum(over) / len(over)
        if (a, b) == (low, high):
            return cut
        low, high = a, b


def _in_region(line: Line) -> bool:
    return any(tag in REGIONS for tag, _ in line.containers)


def settle_marks(lines: list[Line]) -> None:
    """Make furniture of the lines under a marking word, unless its subtree holds most of the text."""
    free = [x for x in lines if not x.furniture]
    inside = [x for x in free if _in_region(x)]
    pool, share = (inside, 0.5) if inside else (free, MOST)
    total = sum(len(x.text) for x in pool)
    held: dict[int, int] = {}
    for x in pool:
        for mark in x.marks:
            held[mark] = held.get(mark, 0) + len(x.text)
    for x in free:
        x.furniture = any(held.get(mark, 0) <= share * total for mark in x.marks)


def select(lines: list[Line]) -> list[Line]:
    """The lines of the region that the content-like lines vote for."""
    settle_marks(lines)
    usable = [x for x in lines if not x.furniture]
    if not usable:
        return []
    smoothed = smooth([0.0 if x.furniture else len(x.text) / x.tags for x in lines])
    cut = two_means_threshold(smoothed)
    votes: dict[tuple[str, int], int] = {}
    total = regions = 0
    for x, ratio in zip(lines, smoothed, strict=True):
        if x.furniture:
            continue
        weight = len(x.text) if ratio >= cut else 0
        total += weight
        regions += weight if _in_region(x) else 0
        for c in x.containers:
            votes[c] = votes.get(c, 0) + weight
    if total and regions >= QUARTER * total:
        return [x for x in usable if _in_region(x)]
    if not total:  # the ratios tell nothing: the lines that read most like content are furniture
        return usable
    # Containers that hold nearly all lie inside each other; the last one opened is the smallest.
    home = max((c for c, v in votes.items() if v >= HOME * total), key=lambda c: c[1], default=None)
    return [x for x in usable if home is None or home in x.containers]


def extract(html: str | None) -> str:
    reader = LineReader()
    reader.feed(html or "")
    return "\n\n".join(x.text for x in select(reader.finish()))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, type=pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], type=pa.int64()),
                })

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
