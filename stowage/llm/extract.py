"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one for each block of text.  A line's
ratio is its characters outside links to its tags.  Ratios are smoothed by a Gaussian; lines
above a threshold taken from their spread are content, and a content region is every line that has
the container of such a line.  If the page has an article with text, lines outside it are none.  Elements that
are boilerplate by their name give no lines.  Those with the label of boilerplate, asides in an article, and
forms are decided with the whole page at hand: what holds the article is no boilerplate, what else
is dense in text may not be (see ``_open_labels``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import by_batch, pick

_CHUNK = 1 << 16
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
#: Never part of the article.
_DROP = frozenset(
    "applet aside audio button canvas datalist dialog embed footer head iframe input menu nav"
    " noscript object optgroup option script select style svg template textarea title video".split()
)
_ROOT = frozenset(["article", "main"])
_NEVER_AROUND = frozenset("header menu nav select".split())
_HOLDER = frozenset("body div section table td".split())
#: Words in class, id or role of elements that are not part of the article.
_LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie"
    " cookies consent gdpr notice notices alert sidebar sidebars comment comments commentlist respond disqus reply"
    " replies menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing"
    " social related recommended newsletter subscribe subscription popup modal overlay widget widgets pagination"
    " pager skip search login signup complementary contentinfo".split()
)
_HEADS = frozenset(["header", "banner", "masthead"])
#: Labels of text by others than the author, which is as dense as an article: only what holds the article opens them.
_OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent"
    " gdpr comment comments commentlist respond disqus reply replies newsletter subscribe popup modal".split()
)
#: Words that make a label say what is in or not in an element (has-sidebar, no-ads), not what it is.
_ABOUT = frozenset("has have no not with without".split())
_FORMS = frozenset(["form", "fieldset"])
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKED = re.compile(r"<!\[[^>]*>?")
#: Elements that end an open one of the same kind.
_ENDS = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_SIGMA = 1.0
_RADIUS = 2


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # text, characters outside links, tags, container, labelled element, article
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        #: Labelled elements and forms: (the one around it, whether by others, article); 0 is the page.
        self.labels: list[tuple[int, bool, int]] = [(0, False, 0)]
        #: Labelled elements whose label is part of a longer name only (share-price).
        self.vague: set[int] = set()
        #: Labelled element around every article.
        self.articles: dict[int, int] = {}
        # name, dropped, container, article, labelled element
        self._stack: list[tuple[str, bool, int, int, int]] = []
        self._text: list[str] = []
        self._plain = 0
        self._tags = 0
        self._links = 0
        #: Container around every container.
        self.parents: list[int] = [0]
        self._vague = False

    def _end_line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, _, holder, article, label = self._stack[-1] if self._stack else ("", False, 0, 0, 0)
                self.lines.append((text, self._plain, max(1, self._tags), holder, label, article))
            self._text.clear()
            self._plain = self._tags = 0

    def _dropped(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
            if self._stack and self._stack[-1][0] == "p":
                self._stack.pop()
            for name in _ENDS.get(tag, ()):
                if self._stack and self._stack[-1][0] == name:
                    self._stack.pop()
                    break
        self._tags += 1
        if tag == "br":
            if not self._dropped():
                self._text.append(" ")
            return
        if tag in _VOID:
            return
        if tag in _ROOT:  # no article lies in these: they were left open
            for at, opened in enumerate(self._stack):
                if opened[0] in _NEVER_AROUND:
                    self._links -= sum(s[0] == "a" for s in self._stack[at:])
                    del self._stack[at:]
                    break
        _, dropped, holder, article, label = self._stack[-1] if self._stack else ("", False, 0, 0, 0)
        dropped = dropped or self._is_boilerplate(tag, attrs, article > 0)
        if not dropped:
            others = self._label(tag, attrs, article > 0)
            if others is not None:
                if tag not in _BLOCK:
                    self._end_line()  # so that no line is in and out of it
                self.labels.append((label, others, article))
                label = len(self.labels) - 1
                if self._vague:
                    self.vague.add(label)
        if tag in _ROOT or (tag in _HOLDER and not article):
            self.parents.append(holder)
            holder = len(self.parents) - 1
        if tag in _ROOT and not article and not dropped:
            article = holder
            self.articles[article] = label
        self._stack.append((tag, dropped, holder, article, label))
        if tag == "a":
            self._links += 1

    def _is_boilerplate(self, tag, attrs, inside) -> bool:
        if tag in _DROP and not (tag == "aside" and inside):
            return True
        if tag in _ROOT or tag in ("body", "html"):
            return False
        if tag == "header" and not inside:
            return True
        return any(
            name == "hidden"
            or (name == "aria-hidden" and value == "true")
            or (name == "style" and value and _HIDDEN.search(value))
            for name, value in attrs
        )

    def _label(self, tag, attrs, inside) -> bool | None:
        """None without a label of boilerplate, else whether it is one of ``_OTHERS``."""
        self._vague = False
        if tag in _ROOT or tag in ("body", "html"):
            return None
        words: set[str] = set()
        exact: set[str] = set()
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                for token in value.lower().split():
                    found = set(_WORD.findall(token))
                    if not found & _ABOUT:
                        words |= found
                        exact |= found if len(found) == 1 else set()
        known = _LABELS - _HEADS if inside else _LABELS | _HEADS
        if words & known:
            self._vague = not exact & known
            return bool(words & _OTHERS)
        return False if tag in _FORMS or tag == "aside" else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._end_line()
        self._tags += 1
        for at in range(len(self._stack) - 1, -1, -1):
            if self._stack[at][0] == tag:
                if at and self._stack[at][4] != self._stack[at - 1][4]:
                    self._end_line()
                self._links -= sum(s[0] == "a" for s in self._stack[at:])
                del self._stack[at:]
                break
            # a stray end tag of a small element does not reach out of a block
            if tag not in _BLOCK and self._stack[at][0] in _BLOCK:
                break

    def handle_data(self, data):
        if not self._dropped():
            self._text.append(data)
            if self._links <= 0:
                self._plain += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def _smooth(values: np.ndarray) -> np.ndarray:
    steps = np.arange(-_RADIUS, _RADIUS + 1)
    kernel = np.exp(-(steps**2) / (2 * _SIGMA**2))
    weights = np.convolve(np.ones(len(values)), kernel)[_RADIUS:-_RADIUS]
    return np.convolve(values, kernel)[_RADIUS:-_RADIUS] / weights


def _open_labels(parser: _Lines) -> set[int]:
    """Labelled elements whose lines count like those of unlabelled ones.

    First all around the article, which is the one with the most characters outside links (an unlabelled one
    counts four times, those under the label of others come last).  Then, from the outside in, those by the author that are as dense as
    content and no list of links: all in an article, and on a page without one those that hold at
    least as many characters as all that is open so far.  In an article, a label that is part of a longer name
    only counts against a list of links.
    """
    lines, labels = parser.lines, parser.labels
    if not lines:
        return {0}
    own = np.zeros((len(labels), 3))  # characters outside links, characters, tags
    held: dict[int, int] = {}
    for text, plain, tags, _, label, article in lines:
        own[label] += plain, len(text), tags
        if article and label == parser.articles[article]:
            held[article] = held.get(article, 0) + plain

    def around(label: int) -> list[int]:
        found = []
        while label:
            found.append(label)
            label = labels[label][0]
        return found

    opened = {0}
    if held:
        main = max(
            held,
            key=lambda a: (
                not any(labels[i][1] for i in around(parser.articles[a])),
                held[a] if parser.articles[a] else 4 * held[a],
                -a,
            ),
        )
        opened.update(around(parser.articles[main]))
    ratios = np.array([plain / tags for _, plain, tags, _, label, _ in lines if label in opened], np.float64)
    if len(ratios) < 2:
        ratios = np.array([plain / tags for _, plain, tags, *_ in lines], np.float64)
    threshold = float(ratios.std())
    for label in range(1, len(labels)):
        parent, others, article = labels[label]
        plain, characters, tags = own[label]
        if label in opened or parent not in opened or others:
            continue
        if not held and not plain:
            opened.add(label)  # a wrapper without text of its own
        elif article and label in parser.vague and 2 * plain >= characters:
            opened.add(label)
        elif plain and plain / tags >= threshold and 2 * plain >= characters:
            if article or (not held and plain >= sum(own[i][0] for i in opened)):
                opened.add(label)
    return opened


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    html = _MARKED.sub("", html)
    for start in range(0, len(html), _CHUNK):
        parser.feed(html[start : start + _CHUNK])
    parser.finish()
    opened = _open_labels(parser)
    lines = [line for line in parser.lines if line[4] in opened]
    inside = [line for line in lines if line[5]]
    if any(plain for _, plain, *_ in inside):
        lines = inside
    if not lines:
        return ""
    ratios = np.array([plain / tags for _, plain, tags, *_ in lines], np.float64)
    smooth = _smooth(ratios)
    threshold = min(float(ratios.std()), float(smooth.max()))
    content = (smooth >= threshold) & (ratios > 0)
    if not content.any():
        return ""
    # a smoothed line only counts as a seed if it is itself at least half as dense
    content &= ratios >= min(threshold / 2, float(ratios.max()))
    seeds = [int(i) for i in np.flatnonzero(content)]
    holders = {lines[i][3] for i in seeds}
    if not any(line[5] for line in lines):
        # tables and other containers between two lines of a content container belong to it
        ends: dict[int, tuple[int, int]] = {}
        for i, line in enumerate(lines):
            if line[3] in holders:
                ends[line[3]] = ends.get(line[3], (i, i))[0], i
        for around, (start, end) in ends.items():
            for text, plain, _, holder, *_ in lines[start:end]:
                above = holder
                while above and above != around:
                    above = parser.parents[above]
                if above == around and 2 * plain >= len(text):
                    holders.add(holder)
        # a container of several such containers is a region from the first to the last of them
        spans: dict[int, tuple[int, int]] = {}
        for i in seeds:
            around = parser.parents[lines[i][3]]
            spans[around] = spans.get(around, (i, i))[0], i
        for around, (start, end) in spans.items():
            for text, plain, _, holder, *_ in lines[start:end]:
                if around and parser.parents[holder] == around and 2 * plain >= len(text):
                    holders.add(holder)
    return " ".join(text for text, _, _, holder, *_ in lines if holder in holders)


def _extract_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [main_text(html) for html in batch.column(2).to_pylist()]
    sizes = pa.array([len(t) for t in found], pa.int64())
    return pa.record_batch(
        [batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes],
        ["page_id", "url", "text", "n_chars"],
    )


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: key, url, text (empty if there is none), n_chars in code points.

    Null, empty and tag-only pages give an empty text.  Pages may have any length and are
    parsed in chunks; repeated rows and rows without an id come back as they are; an empty table
    gives no rows; other columns are not looked at.
    """
    pages = pick(pages, key, url, html).toDF("page_id", "url", "html")
    pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    found = pages.mapInArrow(
        by_batch(_extract_batch), "page_id long, url string, text string, n_chars long"
    )
    return found.toDF(key, url, "text", "n_chars")
