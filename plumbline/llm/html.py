"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; a line is the text between two block-level tags. Smoothed
text-to-tag ratios above a threshold cluster into content lines. Their text is weighed by element, and the article is
the smallest container that holds most of it, or the <article> around that; landmarks weigh more. All its lines count,
except those in menus, forms and other matter, and blocks of links among its parts that hold no content line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Tags by kind; fixed values of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("html head body title option optgroup td th tr tbody thead tfoot template noscript".split())
DROPPED = frozenset("head title script style noscript template nav footer aside button select textarea svg iframe object canvas dialog menu datalist math".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Class names and ids that mark matter around an article, and roles. A name marks only as a whole, or with a word
#: in front or behind that says what part of the page it is: has-sidebar or menu-open tell of the page's state.
_WORD = r"ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?(?:list|body|form|section|area|thread)|respond|repl(?:y|ies)|disqus\w*|cookies?|consent|notices?|alert|menu|nav|navbar|navigation|navi|side-?bar|footer|masthead|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|popup|modal|overlay|widget|toolbar|pagination|pager|skip-?link"
_FRONT = "site|page|main|top|bottom|left|right|global|post|article|user|reader|header"
_BACK = "box|bar|block|lists?|links?|items?|container|wrap|wrapper|area|section|slot|unit|panel|posts?|articles?|stories|news|form|buttons?|icons?|inner|outer|top|bottom|left|right|content|title|header|heading|text|message|body|\\d+"
MARKED = re.compile(rf"(?:(?:{_FRONT})[_-])?(?:{_WORD}|(?:site|page)-?header)(?:[_-](?:{_WORD}|{_BACK}))*", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
LANDMARKS = ("article", "main")
FOREIGN = ("svg", "math")
#: What may be the article's element, and how much more than elsewhere text in a landmark weighs.
CONTAINERS = frozenset("article main section div body td html".split())
LANDMARK_WEIGHT = 4
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Element:
    """dropped: lines in it are never text; marked: they aren't, unless it turns out to be around the article."""

    __slots__ = ("tag", "up", "dropped", "marked", "depth", "landmark", "around", "weight", "n_lines", "size", "link_size")

    def __init__(self, tag: str, up: _Element | None, dropped: bool, marked: bool):
        self.tag, self.up, self.dropped, self.marked = tag, up, dropped, marked
        self.depth = up.depth + 1 if up else 0
        self.landmark = tag in LANDMARKS and not marked or bool(up and up.landmark)
        self.around = False  # holds an article, a main part or a title of its own
        self.weight = self.n_lines = self.size = self.link_size = 0

    def path(self) -> Iterator[_Element]:
        at: _Element | None = self
        while at is not None:
            yield at
            at = at.up


class LineParser(HTMLParser):
    """Collects lines: (text, tags seen, element they stand in, characters in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = self.root = _Element("", None, False, False)
        self.lines: list[tuple[str, int, _Element, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.where: _Element | None = None

    def _break(self) -> None:
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip(" ")
            if text:
                self.lines.append((text, self.tags, self.where or self.root, min(self.linked, len(text))))
                self.tags = 0
        self.parts, self.where, self.linked = [], None, 0

    def _drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        if tag in DROPPED or tag == "header" and not self.at.landmark:
            return True, False
        marked = tag == "form"
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
            if name in ("class", "id") and value:
                marked = marked or any(MARKED.fullmatch(x) for x in value.split())
            if name == "role" and value:
                marked = marked or value.strip().lower() in ROLES
        return False, marked and tag not in ("html", "body", "main")

    def _pop_to(self, tag: str, stop: tuple[str, ...]) -> None:
        found = self.at
        while found.up is not None and found.tag != tag and found.tag not in stop:
            found = found.up
        if found.up is not None and found.tag == tag:
            self.at = found.up

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        elif tag == "br":
            self.parts.append(" ")
        if tag in CLOSES_P:
            self._pop_to("p", ("article", "body", "div", "main", "section", "td", "button"))
        if tag in SAME_CLOSES:
            self._pop_to(tag, SAME_CLOSES[tag])
        if tag == "a":
            self.links += 1
        if tag not in VOID:
            dropped, marked = self._drops(tag, attrs)
            self.at = _Element(tag, self.at, self.at.dropped or dropped, marked)
            if tag in ("article", "main", "h1") and not marked:
                for at in self.at.up.path():
                    at.around = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        foreign = tag in FOREIGN or any(at.tag in FOREIGN for at in self.at.path())
        self.handle_starttag(tag, attrs)  # a slash closes foreign elements, and no others that aren't void
        if foreign:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        if tag == "a":
            self.links = max(0, self.links - 1)
        self._pop_to(tag, ())

    def handle_data(self, data: str) -> None:
        if not self.at.dropped:
            if self.where is None and not data.isspace():
                self.where = self.at
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._break()


def content_lines(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines are content: ratios smoothed by a Gaussian, then cut in two clusters (means of each side of
    the threshold move until it stands midway between them on a logarithmic scale)."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(np.log1p(ratios), reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    cut = (smooth.min() + smooth.max()) / 2
    for _ in range(20):
        high = smooth >= cut
        if high.all():
            break
        following = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(following - cut) < 1e-9:
            break
        cut = following
    return smooth >= cut


def article_element(lines: list[tuple[str, int, _Element, int]]) -> _Element:
    """The container that holds most of the content lines' text, or the <article> around it."""
    high = content_lines(np.array([len(text) / max(1, tags) for text, tags, _, _ in lines]))
    total, below = 0, {}
    for (text, _, where, linked), h in zip(lines, high.tolist()):
        weight = (len(text) - linked) * (LANDMARK_WEIGHT if where.landmark else 1) if h else 0
        total += weight
        inner = None
        for at in where.path():
            at.weight += weight
            at.n_lines += bool(h)
            at.size += len(text)
            at.link_size += linked
            if inner is not None:
                below.setdefault(id(at), {})[id(inner)] = inner
            if at.tag in CONTAINERS or at.up is None:
                inner = at
    at = next(reversed(list(lines[0][2].path())))
    while True:  # down to the smallest container of more than half
        inner = max((x for x in below.get(id(at), {}).values()), key=lambda x: x.weight, default=None)
        if inner is None or 2 * inner.weight <= total:
            break
        at = inner
    return next((x for x in at.path() if x.tag == "article"), at)


def main_text(html: str) -> str:
    """The article's blocks, joined by newlines; empty if the page has none."""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    # a marked element around an article or a title is no matter beside it, nor is a form around a whole page
    marks = [{at.tag == "form" for at in x[2].path() if at.marked and not at.around} for x in parser.lines]
    lines = [x for x, m in zip(parser.lines, marks) if not m] or [x for x, m in zip(parser.lines, marks) if False not in m]
    if not lines:
        return ""
    article = article_element(lines)
    out = []
    for text, _, where, _ in lines:
        path = []
        for at in where.path():
            if at is article:
                break
            path.append(at)
        else:
            continue
        # a part of several lines, none of them content and nearly all of them links, is a menu
        if any(at.tag in ("ul", "ol", "div", "section", "table") and not at.n_lines and at.size > len(text) and 10 * at.link_size >= 9 * at.size for at in path):
            continue
        out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row of pages: id_col, the columns in keep, and text.

    Null or empty html, and pages without text, have the empty text. Malformed and cut-off pages are read as far
    as they go. Repeated and null ids stay, one row each; other columns aren't read. One pass, no shuffle.
    """
    names = [id_col, *keep, html_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) if h else "" for h in batch.column(len(names) - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names[:-1], "text"])

    picked = pages.select(*[F.col(f"`{n}`") for n in names])
    kinds = ", ".join(f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in names[:-1])
    return mapped(picked, work, f"{kinds}, text string", 8 << 20)
