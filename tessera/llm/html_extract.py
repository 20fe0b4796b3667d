"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser sends events; a block tag ends a line, and a line has its
text, its number of tags and its place. Its ratio is the characters of text per tag; lines of elements
that HTML itself sets apart from content (navigation, forms, scripts and more, also by role) have
ratio zero. The ratios are smoothed with a Gaussian over the neighbouring lines of the same place, and
the smoothed ratios add up to the mass of a region. Two clusters of the regions' masses (of their
square roots, so that a few times less is not far) give the threshold that a region must reach:

1. the articles of a page, its main element without them, and the rest are held against each other;
   markup counts here as a factor, `PRIOR`, by which text of an article or main element weighs more;
2. if the rest is taken, its regions (runs of lines in one container) are held against each other and
   against none, and of those taken the lines whose own smoothed ratio reaches the threshold of two
   clusters of lines, of no ratio too, are content.

Articles and main elements that are taken give all their lines but those set apart, so headings and
short paragraphs stay. An article inside another, which is how HTML marks comments, is a region of
the rest. Names of classes and ids decide nothing.

A null or empty html, and a page without text, gives an empty text. Pages are independent: repeated
rows and ids, and null ids, give repeated results, and ties of regions are taken or left together.
Texts of any length are parsed whole, in time near their length; an empty table gives an empty
result. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import begin, slices, type_name

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_APART = frozenset("aside audio button canvas datalist dialog embed footer form head header iframe map math menu nav noscript object script select style svg template textarea title video".split())
_SPACED = frozenset("audio br button canvas embed iframe object select textarea video".split())  # boxes or breaks between words
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTAINERS = frozenset("article blockquote body center details div dl fieldset figure main ol section table td ul".split())
_SECTIONS = frozenset(("article", "main"))

PRIOR = {"article": 64.0, "main": 32.0, "rest": 1.0}


class Lines(HTMLParser):
    """Collects (text, tags, kind, container, apart) of each line: kind is article, main or rest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, str, int]] = []  # tag, apart, kind, container
        self.open: dict[str, list[int]] = defaultdict(list)  # places of a tag in the stack
        self.barriers: list[int] = []  # places of what ends the search for an element to close
        self.sections: list[int] = []
        self.boxed = 0  # open elements that are set apart for another reason than being a form
        self.apart, self.kind, self.container = False, "rest", 0
        self.parents = [-1]  # of containers
        self.sectioning = {0}
        # text and tags of content and of what is set apart: inline elements of either do not end the other
        self.text: tuple[list[str], list[str]] = ([], [])
        self.tags = [0, 0]
        self.lines: list[tuple[str, int, str, int, bool]] = []

    def _flush(self):
        """End the line; within an element that is set apart only its own."""
        for apart in (True,) if self.apart else (False, True):
            text = " ".join("".join(self.text[apart]).split())
            if text:
                self.lines.append((text, max(self.tags[apart], 1), self.kind, self.container, apart))
                self.tags[apart] = 0
            self.text[apart].clear()

    def _pop_to(self, at: int):
        for k in range(len(self.stack) - 1, at - 1, -1):
            tag, apart, _, _ = self.stack[k]
            self.open[tag].pop()
            if self.barriers and self.barriers[-1] == k:
                self.barriers.pop()
            if self.sections and self.sections[-1] == k:
                self.sections.pop()
            self.boxed -= apart and tag != "form"
        del self.stack[at:]
        self.apart, self.kind, self.container = self.stack[-1][1:] if self.stack else (False, "rest", 0)

    def _last(self, tags) -> int:
        """Place of the innermost open element of some tags."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags[self.apart] += 1
        if tag in _VOID:
            if tag in _BLOCK:
                self._flush()
            elif tag in _SPACED:
                self.text[self.apart].append(" ")
            return
        if closes := _CLOSES.get(tag):
            at = self._last(closes)
            if at >= 0 and at >= (self.barriers[-1] if self.barriers else -1):
                self._pop_to(at)
        if tag in _BLOCK:
            self._flush()
        elif tag in _SPACED:
            self.text[self.apart].append(" ")
        # an article's own header has its title
        apart = self.apart or tag in _APART and not (tag == "header" and self.kind != "rest")
        for name, value in attrs:
            if name == "hidden":
                apart = True
            elif value and name == "role":
                apart = apart or value.lower() in _ROLES
            elif name == "aria-hidden":
                apart = apart or value == "true"
        kind, container = self.kind, self.container
        if tag in _CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        if tag in _SECTIONS:
            if self.apart and not self.boxed:
                apart = False  # a form around a whole page
            kind = tag if tag == "main" or not self.open["article"] else "rest"
            self.sections.append(len(self.stack))
        if tag in _SECTIONS or tag == "section":
            self.sectioning.add(container)
        if tag in _BLOCK or tag in _APART:
            self.barriers.append(len(self.stack))
        self.boxed += apart and tag != "form"
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, apart, kind, container))
        self.apart, self.kind, self.container = apart, kind, container

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags[self.apart] += 1
        if tag == "br":
            self.text[self.apart].append(" ")
            return
        if tag in _BLOCK:
            self._flush()
        at = self._last((tag,))
        # a stray end tag closes nothing outside its section
        if at < 0 or tag not in _SECTIONS and tag not in ("body", "html") and self.sections and at < self.sections[-1]:
            return
        if tag in _BLOCK and self.apart and not (at and self.stack[at - 1][1]):
            self.apart = self.stack[at][1]  # an inline element that is still open ends with its block
            self._flush()
        self._pop_to(at)

    def handle_data(self, data):
        self.text[self.apart].append(data)

    def close(self):
        super().close()
        self.apart = False
        self._flush()


def lines_of(html: str) -> Lines:
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match("[A-Za-z/!?]", html[cut + 1 :]):
        html = html[:cut]  # the page breaks off within a tag
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing that keeps the ends' weight."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach)
    weight = np.convolve(np.pad(np.ones(len(ratios)), reach), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint between the centres of two clusters; what reaches it is in the upper one."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below):
            return low
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _places(parser: Lines) -> list[tuple]:
    """Per line what it is smoothed within: a kind of section; or a run of the rest's lines in one
    container, where a container of a single line counts as part of its parent."""
    lines = parser.lines
    held = defaultdict(int)
    for _, _, kind, container, _ in lines:
        held[container] += 1
    out, run, before = [], 0, None
    for _, _, kind, container, apart in lines:
        if apart:
            place = ("apart",)
        elif kind != "rest":
            place = (kind,)
        else:
            if held[container] == 1 and container not in parser.sectioning:
                container = parser.parents[container]
            run += ("rest", container) != before
            place = ("rest", run)
            before = ("rest", container)
        if place[0] != "rest":
            before = None
        out.append(place)
    return out


def content(parser: Lines) -> list[bool]:
    """Which lines of a page are its main text."""
    lines, places = parser.lines, _places(parser)
    smoothed = np.zeros(len(lines))
    members: dict[tuple, list[int]] = defaultdict(list)
    for k, place in enumerate(places):
        members[place].append(k)
    members.pop(("apart",), None)
    mass: dict[tuple, float] = {}
    for place, some in members.items():
        smoothed[some] = smooth(np.array([len(lines[k][0]) / lines[k][1] for k in some], float))
        mass[place] = float(smoothed[some].sum())
    kinds: dict[str, float] = defaultdict(float)
    for place, m in mass.items():
        kinds[place[0]] += PRIOR[place[0]] * m
    taken = [False] * len(lines)
    if not kinds:
        return taken
    cut = threshold(np.sqrt(list(kinds.values())))
    kept = {kind for kind, m in kinds.items() if np.sqrt(m) >= cut}
    rest = {place: m for place, m in mass.items() if place[0] == "rest"}
    if "rest" in kept:
        region_cut = threshold(np.sqrt([0.0, *rest.values()]))
        line_cut = threshold(np.sqrt([0.0, *(smoothed[k] for place in rest for k in members[place])]))
    for place, some in members.items():
        if place[0] not in kept or place[0] == "rest" and np.sqrt(rest[place]) < region_cut:
            continue
        for k in some:
            taken[k] = place[0] != "rest" or bool(np.sqrt(smoothed[k]) >= line_cut)
    return taken


def extract(html: str | None) -> str:
    """Main text of a page: blocks in page order, one per line."""
    if not html:
        return ""
    parser = lines_of(html)
    return "\n".join(line[0] for line, good in zip(parser.lines, content(parser)) if good)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""

    def run(batches):
        begin("html_extract")
        for batch in slices(batches):
            texts = [extract(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {type_name(pages, id_col)}, `{url_col}` {type_name(pages, url_col)}, text string, n_chars bigint")
