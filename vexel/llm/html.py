"""Main text of web pages.

The standard library's parser streams events; a page becomes a row of blocks with their text and tag counts. The
text-to-tag ratio of the blocks is smoothed by a Gaussian, and the blocks above a threshold cluster into the content
region: the element that holds most of their text, with those beside it whose text is clustered for the most part, and
what lies between. All of its blocks are the article, but for block elements that markup names as something else. Where a
name is at odds with the clusters, as that of a wrapper around the page, it counts for nothing. Tags named article or main
have no say in where the region is, but it does not reach out of them. Where one element holds nearly all text that nothing
marks as something else, as on common pages, every width and threshold leads to it: then they change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import mapped


@dataclass(frozen=True)
class Params:
    """``sigma`` is the Gaussian's width in blocks, ``threshold`` a multiple of the ratios' standard deviation, and
    ``mass`` the share of the clusters' text that an element must hold to be entered."""

    sigma: float = 1.0
    threshold: float = 0.5
    mass: float = 0.7


# Names of elements, roles and of classes or ids in common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("html body div article main section center table tbody tr td form fieldset blockquote span".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas menu dialog label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar footer comment comments commentlist disqus replies respond share sharing social related recommended widget toolbar login".split())
KEPT = frozenset("html body main article".split())
#: How an element is marked as something besides the article: by a name or as a form, which the clusters can overrule, for sure, or as a header, of which headings h1 stay within the region.
NAMED, SURE, HEADER = 1, 2, 3
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of running text: of their classes and ids only whole ones count, so that share-price isn't taken for share.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption span".split())


def is_other(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether an element is named as something besides the article: 0, NAMED, SURE or HEADER. Names and roles count for block elements alone."""
    if tag in DROPPED and tag != "form":
        return SURE
    found = NAMED if tag == "form" else HEADER if tag == "header" and not in_article else 0
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return found if tag in KEPT else SURE
        if tag not in BLOCKS:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            if tag in KEPT:
                return found
            found = found or NAMED
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            words = set(value.lower().split()) if tag in TEXT else {w.lower() for w in WORDS.findall(value)}
            if tag == "article" and not words & {"comment", "comments", "ad", "ads", "promo", "related"}:
                continue
            if words & NAMES or words & {"header"} and not in_article:
                found = found or NAMED
    return found


@dataclass
class Block:
    text: str
    node: int
    tags: int
    link_chars: int
    other: bool
    tag: str
    top: int


class Blocks(HTMLParser):
    """Turns a page's events into blocks. ``parents``, ``tags`` and ``marks`` describe the elements by number, 0 being the page.

    The marks of the elements in ``freed`` count for nothing.
    """

    def __init__(self, freed: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.parents, self.tags, self.other, self.article = [0], ["html"], [False], [False]
        self.freed, self.marks = freed, [0]
        self.open: list[int] = [0]
        self.count: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.links = self.tag_count = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        node = next(n for n in reversed(self.open) if self.tags[n] in BLOCKS or n == 0)
        if text:
            self.blocks.append(Block(text, node, self.tag_count, self.links, self.other[self.open[-1]] or self.other[node], self.tags[node], self.open[-1]))
        self.text, self.links, self.tag_count = [], 0, 0

    def close_to(self, tag: str) -> None:
        while len(self.open) > 1:
            done = self.tags[self.open.pop()]
            self.count[done] -= 1
            if done == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.count["p"]:
                self.close_to("p")
            if tag in ("li", "dd", "dt", "option") and self.tags[self.open[-1]] == tag:
                self.close_to(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tag_count += 1
        if tag in VOID:
            return
        top = self.open[-1]
        inside = self.article[top] or tag in ("article", "main")
        # What only differs in kind from the text around it must end the text before it.
        mark = 0 if len(self.tags) in self.freed else is_other(tag, attrs, self.article[top])
        other = self.other[top] or mark > 0
        if other and not self.other[top] and tag not in BLOCKS:
            self.flush()
        self.parents.append(top)
        self.tags.append(tag)
        self.marks.append(mark)
        self.other.append(other)
        self.article.append(inside)
        self.open.append(len(self.tags) - 1)
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        last = self.open[-1]
        if tag in BLOCKS or self.other[last] and not self.other[self.parents[last]]:
            self.tag_count += 1
            self.flush()
        else:
            self.tag_count += 1
        self.close_to(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.count["a"] > 0:
            self.links += len(data)


def parse(page: str, freed: frozenset[int] = frozenset()) -> Blocks:
    reader = Blocks(freed)
    try:
        reader.feed(page)
        reader.close()
    except AssertionError:  # a marked section that the parser knows nothing of
        reader = Blocks(freed)
        reader.feed(page.replace("<![", "&lt;!["))
        reader.close()
    reader.flush()
    return reader


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def clustered(blocks: list[Block], other: list[bool], p: Params) -> np.ndarray:
    """Which blocks belong to a cluster; ``other`` says which can't. All are False without any text."""
    ratio = np.array([0.0 if o else (len(b.text) - min(b.link_chars, len(b.text))) / max(1, b.tags) for b, o in zip(blocks, other)])
    if not ratio.any():
        return np.zeros(len(blocks), bool)
    smooth = smoothed(ratio, p.sigma)
    chosen = (smooth >= p.threshold * ratio.std()) & (ratio > 0)
    return chosen if chosen.any() else ratio > 0


def text_held(reader: Blocks, chosen: np.ndarray) -> np.ndarray:
    """The characters of the chosen blocks within each element."""
    held = np.zeros(len(reader.tags))
    for i in np.flatnonzero(chosen):
        held[reader.blocks[i].node] += len(reader.blocks[i].text)
    for node in range(len(held) - 1, 0, -1):  # parents come before their children
        held[reader.parents[node]] += held[node]
    return held


def overruled(reader: Blocks, p: Params) -> frozenset[int]:
    """The elements marked by a name or as a form that hold the article all the same.

    These hold a main element, an article with a heading h1, or the larger part of the text that clusters over all blocks. In
    the last case the mark stands where the article is found outside: without an h1 within, if a clustered paragraph that
    nothing marks comes before (as before long comments), or an article or main element with clustered text lies apart.
    """
    marks, parents, tags, blocks = reader.marks, reader.parents, reader.tags, reader.blocks
    named = [n for n, m in enumerate(marks) if m == NAMED]
    if not named:
        return frozenset()
    size = len(tags)

    def below(marked: list[bool]) -> list[bool]:
        out = list(marked)
        for n in range(1, size):
            out[n] = out[n] or out[parents[n]]
        return out

    def above(marked: list[bool]) -> list[bool]:
        out = list(marked)
        for n in range(size - 1, 0, -1):
            out[parents[n]] = out[parents[n]] or out[n]
        return out

    sure = below([m in (SURE, HEADER) for m in marks])
    chosen = clustered(blocks, [sure[b.top] or sure[b.node] for b in blocks], p)
    if not chosen.any():
        return frozenset()
    held = text_held(reader, chosen)
    heading = above([t == "h1" and not s for t, s in zip(tags, sure)])
    vital = above([held[n] > 0 and (tags[n] == "main" or tags[n] == "article" and heading[n]) for n in range(size)])
    freed = {n for n in named if vital[n]}
    large = [n for n in named if not vital[n] and held[n] > 0.5 * held[0]]  # each lies within the one before it
    passed = freed | set(large)
    marked = below([m > 0 and n not in passed for n, m in enumerate(marks)])
    homes = [tags[n] in ("article", "main") and held[n] > 0 and not marked[n] for n in range(size)]
    around, within = below(homes), above(homes)
    first = [len(blocks)] * size
    for i, b in enumerate(blocks):
        first[b.node] = min(first[b.node], i)
    for n in range(size - 1, 0, -1):
        first[parents[n]] = min(first[parents[n]], first[n])
    lead = next((i for i, b in enumerate(blocks) if chosen[i] and b.tag == "p" and not marked[b.top] and not marked[b.node]), len(blocks))
    for n in large:
        apart = within[0] and not around[n] and not within[n]
        if not heading[n] and (lead < first[n] or apart):
            break
        freed.add(n)
    return frozenset(freed)


def in_header(reader: Blocks, node: int) -> bool:
    """Whether the marks of an element and of those around it are all those of headers."""
    marks = set()
    while node:
        marks.add(reader.marks[node])
        node = reader.parents[node]
    return marks <= {0, HEADER}


def region(reader: Blocks, p: Params) -> list[int]:
    """The elements from the page down to the one that holds the content, as the clusters of the smoothed ratios have it; empty without any text."""
    chosen = clustered(reader.blocks, [b.other for b in reader.blocks], p)
    if not chosen.any():
        return []
    held = text_held(reader, chosen)
    total = held[0]
    heavy = [n for n in range(1, len(held)) if held[n] >= p.mass * total]
    path = [0]
    for node in heavy:  # each lies within the one before it
        if reader.tags[node] not in CONTAINERS:
            break
        path.append(node)
    return path


def spread_out(reader: Blocks, path: list[int], p: Params) -> tuple[int, int]:
    """(first, last + 1): the run of blocks that is the content, going out from the region ``path`` ends with.

    Where the text of an element or block beside the path is clustered for the most part, it belongs to the content, as does what
    lies between. The content doesn't reach out of the outermost article or main element around the region.
    """
    blocks = reader.blocks
    chosen = clustered(blocks, [b.other for b in blocks], p)
    held, whole = text_held(reader, chosen), text_held(reader, np.array([not b.other for b in blocks]))
    depth = {n: i for i, n in enumerate(path)}
    top = next((i for i, n in enumerate(path) if reader.tags[n] in ("article", "main")), 0)
    # Of each element: how far down the path it lies, and the child of the path's element that it lies in (0: it is on the path).
    level, unit = [0] * len(reader.tags), [0] * len(reader.tags)
    for n in range(1, len(reader.tags)):
        up = reader.parents[n]
        level[n] = depth.get(n, level[up])
        unit[n] = 0 if n in depth else unit[up] or n
    last = len(path) - 1
    own = [i for i, b in enumerate(blocks) if level[b.node] == last]
    first, stop = (own[0], own[-1] + 1) if own else (0, 0)
    beside = [i for i, b in enumerate(blocks) if chosen[i] and top <= level[b.node] < last and held[unit[b.node]] >= (0.5 * whole[unit[b.node]] if unit[b.node] else 0)]
    return min([first, *beside]), max([stop, *(i + 1 for i in beside)])


def main_text(page: str | None, p: Params = Params()) -> str:
    """The article's blocks, joined by two newlines; null, empty and textless pages: empty."""
    if not page:
        return ""
    reader = parse(page)
    freed = overruled(reader, p)
    if freed:
        reader = parse(page, freed)
    path = region(reader, p)
    if not path:
        return ""
    inside = [reader.tags[n] in ("article", "main") for n in path]
    first, stop = spread_out(reader, path, p)
    rows = list(enumerate(reader.blocks))[first:stop]
    kept = [(i, b) for i, b in rows if not b.other or b.tag == "h1" and in_header(reader, b.node)]
    if not any(inside):
        # Outside an article, a list of at least three items that are links and nothing else is a menu, unless it stands under a heading.
        lists: dict[int, list[int]] = {}
        for i, b in kept:
            if b.tag == "li" and b.link_chars >= len(b.text):
                lists.setdefault(reader.parents[b.node], []).append(i)
        headed = {i + 1 for i, b in kept if re.fullmatch("h[2-6]", b.tag)}
        menus = {i for items in lists.values() if len(items) >= 3 and items[0] not in headed for i in items}
        kept = [(i, b) for i, b in kept if i not in menus]
    texts = [b.text for _, b in kept]
    if not any(inside):
        heading = [b.text for b in reader.blocks[:first] if b.tag == "h1" and not b.other]
        texts = heading[-1:] + texts
    return "\n\n".join(texts)


def extracted(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """``pages`` without html, with ``text`` and ``n_chars`` (code points); repeated rows get the same. Columns of these names are replaced, others may have any name."""
    kept = pages.drop("text", "n_chars")
    names = [c for c in kept.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), p) for x in batch.column(len(names))]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    rows = kept.select(*[F.col(f"`{c}`") for c in names], F.col("html"))
    more = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return mapped(rows, run, T.StructType([*rows.schema.fields[:-1], *more]))


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extracted(pages.select("page_id", "url", "html"))
