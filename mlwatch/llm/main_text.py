"""Main text of web pages by tag-path ratios.

The page's text blocks are gathered under their root-to-leaf tag paths. Each path has the mean length and
punctuation of its blocks; both are smoothed along the page, fused, lowered for parts whose names say that they are no
article text, and thresholded by their spread, which selects content blocks. The articles that hold selected text, or
without articles the container of nearly all of it, give the main text: their blocks, the selected ones outside the
container, and the headings before them, less those that the ratios hold to be parts beside the text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import by_batch, table

_MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = ".,;:!?…。，、！？；："

_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset(
    "head script style title nav footer header aside noscript template svg math canvas button select option "
    "textarea iframe object dialog menu audio video xmp noembed noframes".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset("html body main article".split())
# Elements that are parts of a text: the text goes on outside them.
_PARTS = _HEADINGS | frozenset(
    "p pre blockquote section figure figcaption ul ol dl li dt dd table caption thead tbody tfoot tr td th details summary "
    "address center".split()
)
# Words of a class, id or role that name a part beside the article.
_ASIDE = frozenset(
    "banner promo promotion nav navigation navbar "
    "menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager toolbar widget widgets copyright disclaimer complementary contentinfo".split()
)
# Words that name what readers and advertisers wrote, however long it is.
_REMARKS = frozenset(
    "comment comments disqus respond reply replies ad ads advert adverts advertisement advertising sponsor sponsored".split()
)
# Start tags that end an open element of the same kind, or an open paragraph.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPE = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
    "thead": {"table"}, "tbody": {"table"}, "option": {"select"},
}

SPREAD = 0.5
HELD = 0.8
# The part of its text that must be selected for an element to be an article as a whole.
WHOLE = 0.1
# What a part's name leaves of the ratios of its text; parts inside parts multiply.
BESIDE, REMARK = 0.02, 1e-4


class _Page:
    """Blocks of text with their elements and tag paths. Elements are numbered in page order, so that an element's
    descendants are the numbers from its own to its end."""

    def __init__(self):
        self.parents, self.ends, self.tags = [-1], [0], ["#page"]
        # text, element, path, link characters, heading, what the names of the parts around it leave of its ratios
        self.blocks: list[tuple[str, int, int, int, bool, float]] = []
        self.paths: dict[tuple[int, str], int] = {}
        # open elements: tag, number, path, never content, in a link, in an inline aside, what names leave, in remarks
        self.open: list[tuple[str, int, int, bool, bool, bool, float, bool]] = [
            ("#page", 0, -1, False, False, False, 1.0, False)
        ]
        self.waiting: list[str] = []
        self.linked, self.under, self.beside, self.left = 0, (0, -1), True, 1.0

    def text(self, chunk: str) -> None:
        _, number, path, never, linked, beside, left, _ = self.open[-1]
        if never or not chunk:
            return
        if "&" in chunk:
            chunk = html.unescape(chunk)
        if not self.waiting and not chunk.isspace():
            self.under, self.left = (number, path), left
        self.waiting.append(chunk)
        self.beside = self.beside and (beside or chunk.isspace())
        if linked:
            self.linked += len(chunk.strip())

    def flush(self) -> None:
        if self.waiting:
            text = " ".join("".join(self.waiting).split())
            if text:
                heading = any(tag in _HEADINGS for tag, *_ in self.open[-3:])
                left = self.left * (BESIDE if self.beside else 1.0)
                self.blocks.append((text, *self.under, self.linked, heading, left))
            self.waiting, self.linked, self.beside = [], 0, True

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "br" or tag == "wbr":
            self.text(" " if tag == "br" else "")
            return
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in _INLINE:
            self.flush()
            self._close_open("p", {"button", "table", "td", "th", "article", "section", "div"})
            if tag in _ENDS:
                for other in _ENDS[tag]:
                    self._close_open(other, _SCOPE[tag])
        _, parent, path, never, linked, beside, left, remarks = self.open[-1]
        words, hidden = self._words(attributes) if attributes else ((), False)
        key = f"{tag}.{words[0]}" if words else tag
        never = never or tag in _NEVER and not (tag == "header" and any(t == "article" for t, *_ in self.open[-4:]))
        never = never or hidden and tag not in _WHOLE
        number = len(self.parents)
        self.parents.append(parent)
        self.ends.append(number)
        self.tags.append(tag)
        if closed and tag not in _INLINE:
            return
        named = not _ASIDE.isdisjoint(words) and tag not in _WHOLE
        remark = not _REMARKS.isdisjoint(words) and tag not in ("html", "body", "main")
        if tag in _INLINE:
            beside = beside or named or remark
        elif tag == "main" or tag == "article" and not (remark or remarks):
            left, remarks = 1.0, False  # a text, whatever it is wrapped in
        else:
            left, remarks = left * (REMARK if remark or tag == "form" else BESIDE if named else 1.0), remarks or remark
        path = self.paths.setdefault((path, key), len(self.paths))
        self.open.append((tag, number, path, never, linked or tag == "a", beside, left, remarks))

    @staticmethod
    def _words(attributes: str) -> tuple[list[str], bool]:
        """The words of class, id and role, and whether the element is hidden."""
        found, hidden = [], False
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            elif name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name in ("class", "id", "role"):
                found += _WORD.findall(value)
        return found, hidden

    def _pop(self) -> None:
        self.ends[self.open.pop()[1]] = len(self.parents) - 1

    def _close_open(self, tag: str, stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in stop:
                return

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        elif tag in _VOID:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if tag in _INLINE and self.open[i][0] not in _INLINE:
                return  # an inline end tag closes nothing outside its block

    def containers(self) -> list[int]:
        """Of each element the nearest one around that is no part of a text."""
        out: list[int] = []
        for element, tag in enumerate(self.tags):
            out.append(out[self.parents[element]] if tag in _PARTS or tag in _INLINE else element)
        return out

    def held(self, chars: list[float]) -> np.ndarray:
        """Characters in each element and its descendants, given those of each block."""
        out = np.zeros(len(self.parents))
        for block, n in zip(self.blocks, chars):
            out[block[1]] += n
        for element in range(len(out) - 1, 0, -1):
            out[self.parents[element]] += out[element]
        return out

    def around(self, tag: str) -> list[int]:
        """Of each element the outermost element of this tag that it is or lies in, 0 for none."""
        out: list[int] = []
        for element, own in enumerate(self.tags):
            outer = out[self.parents[element]] if element else 0
            out.append(outer or (element if own == tag else 0))
        return out

    def finish(self) -> None:
        self.flush()
        while self.open:
            self._pop()


def read_page(source: str) -> _Page:
    page, at, sought = _Page(), 0, 0
    while (sought := source.find("<", sought)) >= 0:
        m = _MARKUP.match(source, sought)
        if m is None:
            sought += 1
            continue
        page.text(source[at:sought])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                page.end(tag)
            else:
                page.start(tag, m[3], m[3].endswith("/"))
                if tag in _RAW:
                    stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                    at = stop.start() if stop else len(source)
        sought = at
    page.text(source[at:])
    page.finish()
    return page


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian kernel over a block and its two neighbours on each side."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2)
    total = np.convolve(values, kernel, "same") if len(values) >= 5 else values
    weight = np.convolve(np.ones(len(values)), kernel, "same") if len(values) >= 5 else np.ones(len(values))
    return total / weight


def selected(page: _Page, spread: float = SPREAD) -> np.ndarray:
    """Which blocks lie on content paths: those whose fused ratio reaches the threshold."""
    path = np.array([b[2] for b in page.blocks])
    chars = np.array([len(b[0]) for b in page.blocks], float)
    marks = np.array([sum(map(b[0].count, _PUNCTUATION)) for b in page.blocks], float)
    links = np.array([min(b[3], len(b[0])) for b in page.blocks], float)
    _, path = np.unique(path, return_inverse=True)
    nodes = np.bincount(path)
    mean = lambda values: (np.bincount(path, values) / nodes)
    text_ratio, mark_ratio = mean(chars), mean(marks)
    plain = 1 - np.bincount(path, links) / np.bincount(path, chars)
    names = np.array([b[5] for b in page.blocks])
    fused = _smooth(text_ratio[path]) * (1 + _smooth(mark_ratio[path])) * plain[path] ** 2 * names
    score = mean(fused)
    threshold = min(score.max(), spread * fused.std()) if len(score) > 1 else 0.0
    return (score >= threshold)[path] & (plain[path] > 0.3)


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, white space within a block as one blank, blocks joined by one
    newline. Null and empty pages, and pages without text, give the empty string. Very long and very deep pages are read
    whole. Of several articles, all that hold selected text are returned, if these hold a fifth of it."""
    page = read_page(source or "")
    if not page.blocks:
        return ""
    chosen = selected(page)
    if not chosen.any():
        chosen[:] = True
    # of the rest, what is as little beside the text by its names as the selected blocks are
    names = np.array([b[5] for b in page.blocks])
    kept = chosen | (names >= names[chosen].max())
    chars = np.array([len(b[0]) for b in page.blocks])
    sizes = chars * chosen
    for tag in ("article", "main"):
        around = page.around(tag)
        inside = np.array([around[b[1]] for b in page.blocks])
        if sizes[inside > 0].sum() >= max((1 - HELD) * sizes.sum(), 1):
            parts = np.bincount(inside, sizes) >= np.maximum(WHOLE * np.bincount(inside, chars * kept), 1)
            parts[0] = False
            kept &= parts[inside] | chosen & (inside > 0)
            if tag == "article":
                return "\n".join(b[0] for b, good in zip(page.blocks, kept) if good)
            break
    page.blocks = [b for b, good in zip(page.blocks, kept) if good]
    return _container_text(page, chosen[kept])


def _container_text(page: _Page, chosen: np.ndarray) -> str:
    """The text around the ``chosen`` blocks of a page without articles."""
    held = page.held([len(b[0]) * good for b, good in zip(page.blocks, chosen)])
    enough = HELD * held[0]
    article = max(e for e in range(len(held)) if held[e] >= enough and page.tags[e] not in _INLINE)
    containers = page.containers()
    article = containers[article]
    if page.tags[article] in ("html", "body", "#page"):  # of the page itself, what isn't in other containers
        inside = [2 * b[3] < len(b[0]) and containers[b[1]] == article for b in page.blocks]
    else:
        inside = [article <= b[1] <= page.ends[article] for b in page.blocks]
    if held[article] < WHOLE * sum(len(b[0]) for b, good in zip(page.blocks, inside) if good):
        inside = list(chosen)
    first, last = np.flatnonzero(chosen | inside)[[0, -1]]
    while first and page.blocks[first - 1][4]:
        first -= 1
    between = [first <= i <= last and (b[4] or 2 * b[3] < len(b[0])) for i, b in enumerate(page.blocks)]
    return "\n".join(b[0] for b, *good in zip(page.blocks, chosen, inside, between) if any(good))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page with ``text``, its main text. Repeated rows each give a row; other columns
    are ignored; an empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
        return {name: batch.column(name) for name in keep} | {"text": pa.array(texts, pa.string())}

    kinds = dict(pages.dtypes)
    return by_batch(pages.select(*keep, html_col), run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "text string"]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
