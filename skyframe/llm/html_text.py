"""The main text of web pages from parser events.

The parser of the standard library streams tags and text. Block tags end a line; each
line has its text and the tags met since the line before. The ratio of text to tags,
smoothed by a Gaussian over neighbouring lines and cut at its own standard deviation,
clusters lines into content and the rest. Regions are given whole, so that their short
lines, such as headings, stay: all articles (or main elements) or, in a page that marks
none, the smallest container outside of which no line is content; a list or a table is no
such container. What lies in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments is left out wherever it stands, by its tag, role or
class words. Class words never leave out an article or a main element by its own class,
nor what holds the only ones or the only text of a page.

Defined results: a null or empty page, and one without text, gives the empty text.
Unclosed and crossing tags are closed by the tag that ends their parent; a page may end
anywhere. Every row gives a row. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyframe.llm.common import fields_of, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
#: Not entered in search of the smallest container.
WHOLE = frozenset("ul ol dl table td".split())
CONTAINERS = frozenset("article main body section div td center table ul ol dl blockquote".split())
LEFT_OUT = frozenset(
    "head title script style noscript template nav menu header footer aside form button select option textarea fieldset "
    "iframe svg canvas object audio video dialog math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside rail widget widgets "
    "notice notices cookie cookies consent gdpr banner popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist disqus respond replies reply related recommended share sharing social search "
    "pagination pager toolbar".split()
)
#: Words that may stand beside a mark in a class name; with one, it marks what holds less
#: than half of the page's text.
NEUTRAL = frozenset(
    "site page main global top bottom left right primary secondary sticky fixed mobile desktop inner outer box block bar list "
    "links link items item wrapper wrap container area section slot unit group".split()
)
#: A new tag of the first kind closes an open one of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
#: Closing by a new tag does not reach beyond these.
BARRIERS = frozenset("ul ol dl table article main body section div td th".split())
WORDS = re.compile(r"[a-z]+")
SIGMA = 1.0
RADIUS = 2
#: How class words mark an element.
UNMARKED, WEAK, STRONG = 0, 1, 2


class PageReader(HTMLParser):
    """Collects lines: (container, pieces, tags, is a heading), where a piece is a container
    and text. Containers form a tree by ``parents``; ``marks`` tells class marks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, left out, container
        self.counts: dict[str, int] = {}
        self.parents, self.kinds, self.marks = [-1], ["page"], [UNMARKED]
        self.lines: list[tuple[int, list[tuple[int, str]], int, bool]] = []
        self.text: list[tuple[int, str]] = []
        self.tags = 0

    def _left_out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _container(self) -> int:
        return self.open[-1][2] if self.open else 0

    def _end_line(self) -> None:
        if any(text.strip() for _, text in self.text):
            self.lines.append((self._container(), self.text, self.tags, bool(self.counts.get("h1"))))
            self.tags = 0
        self.text = []

    def _pop(self) -> None:
        tag, _, _ = self.open[-1]
        if tag not in INLINE:
            self._end_line()
        self.open.pop()
        self.counts[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append((self._container(), " "))
            return
        if tag not in INLINE:
            self._end_line()
            self._close_before(tag)
        if tag in VOID:
            return
        out = self._left_out() or tag in LEFT_OUT or (tag not in ("body", "html") and _hidden(attrs))
        mark = UNMARKED if out or tag in ("body", "html", "article", "main") else _mark(attrs)
        container = self._container()
        if (tag in CONTAINERS or mark) and not out:
            self.parents.append(container)
            self.kinds.append(tag)
            self.marks.append(mark)
            container = len(self.parents) - 1
        self.open.append((tag, out, container))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _close_before(self, tag: str) -> None:
        """A block ends an open paragraph; items and cells end the one before."""
        ended = CLOSES.get(tag, ()) + ("p",)
        if not any(self.counts.get(e) for e in ended):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in ended:
                while len(self.open) > i:
                    self._pop()
            elif name in BARRIERS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.counts.get(tag):
            if tag not in INLINE:
                self._end_line()
            return
        while self.open[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not self._left_out():
            self.text.append((self._container(), data))

    def close(self) -> None:
        super().close()
        self._end_line()


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if value and name == "role" and value.lower() in ROLES:
            return True
    return False


def _mark(attrs: list[tuple[str, str | None]]) -> int:
    """By whole names: all their words are marks, or all but neutral ones."""
    found = UNMARKED
    for name, value in attrs:
        if value and name in ("class", "id"):
            for token in value.lower().split():
                words = set(WORDS.findall(token))
                if words & MARKS and words <= MARKS | NEUTRAL:
                    found = max(found, STRONG if words <= MARKS else WEAK)
    return found


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio reaches the standard deviation."""
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]
    smooth = np.convolve(ratios, kernel)[RADIUS:-RADIUS] / weight
    return smooth >= smooth.std()


def main_text(html: str) -> str:
    reader = PageReader()
    reader.feed(html)
    reader.close()
    out = _left_out(reader)
    lines: list[tuple[int, str, int, bool]] = []
    carried = 0
    for node, pieces, tags, heading in reader.lines:
        text = " ".join("".join(t for at, t in pieces if not out[at]).split())
        carried += tags
        if text:
            lines.append((node, text, carried, heading))
            carried = 0
    if not lines:
        return ""
    content = content_lines(np.array([len(text) / max(tags, 1) for _, text, tags, _ in lines]))
    chosen = _regions(reader, lines, content)
    inside = [False] * len(reader.parents)
    for node, parent in enumerate(reader.parents):  # a parent comes before its children
        inside[node] = node in chosen or (parent >= 0 and inside[parent])
    return " ".join(text for node, text, _, _ in lines if inside[node])


def _sums(parents: list[int], values: list[int]) -> list[int]:
    """Values of each container with those inside it."""
    total = list(values)
    for node in range(len(parents) - 1, 0, -1):
        total[parents[node]] += total[node]
    return total


def _left_out(reader: PageReader) -> list[bool]:
    """Containers that class words leave out, with all that is in them."""
    parents, marks = reader.parents, reader.marks
    length = [0] * len(parents)
    for _, pieces, _, _ in reader.lines:
        for node, text in pieces:
            length[node] += len("".join(text.split()))
    length = _sums(parents, length)
    mains = [int(kind in ("article", "main") and n > 0) for kind, n in zip(reader.kinds, length)]
    holds = _sums(parents, mains)
    # A layout's wrapper is named after what stands in it.
    marked = [m == STRONG or (m == WEAK and 2 * n <= length[0]) for m, n in zip(marks, length)]
    while True:
        out = [False] * len(parents)
        for node in range(1, len(parents)):
            out[node] = marked[node] or out[parents[node]]
        if not holds[0] or any(m and not o for m, o in zip(mains, out)):
            break
        # All articles are in marked elements: the outermost of those are no boilerplate.
        marked = [m and not (h and not out[p]) for m, h, p in zip(marked, holds, parents)]
    if length[0] and not any(text.strip() for _, pieces, _, _ in reader.lines for node, text in pieces if not out[node]):
        return [False] * len(parents)
    return out


def _regions(reader: PageReader, lines: list[tuple[int, str, int, bool]], content: np.ndarray) -> set[int]:
    """Containers to give whole."""
    parents, kinds = reader.parents, reader.kinds
    mass = [0] * len(parents)
    length = [0] * len(parents)
    for (node, text, _, heading), good in zip(lines, content.tolist()):
        length[node] += len(text)
        mass[node] += len(text) if good or heading else 0
    mass, length = _sums(parents, mass), _sums(parents, length)
    marked = _outermost(parents, [n for n, kind in enumerate(kinds) if kind == "article" and length[n]])
    marked = marked or _outermost(parents, [n for n, kind in enumerate(kinds) if kind == "main" and length[n]])
    if marked:
        return set(marked)
    at = 0
    while True:
        whole = [n for n, p in enumerate(parents) if p == at and mass[n] and mass[n] == mass[at] and kinds[n] not in WHOLE]
        if not whole:
            return {at}
        at = whole[0]


def _outermost(parents: list[int], nodes: list[int]) -> list[int]:
    wanted, below = set(nodes), set()
    for node, parent in enumerate(parents):
        if parent in wanted or parent in below:
            below.add(node)
    return [n for n in nodes if n not in below]


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text``."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html_column and c.lower() != "text"]

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, "text"])

    columns = [fields_of(pages, *kept)] if kept else []
    return pages.select(*kept, html_column).mapInArrow(run, ", ".join([*columns, "text string"]))
