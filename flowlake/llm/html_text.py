"""Main text of web pages by tag-path ratios.

A page is a run of blocks, each with the path of block-level tags from the root.  Text length and punctuation are
aggregated per path; the two ratios are fused, smoothed along the page and compared with a threshold.  The blocks that
pass show which element is the article; of its blocks, the ratios leave out lists of links and what surrounds the text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names of HTML and the words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg canvas select option button textarea "
                   "audio video map datalist".split())
FALLBACK = frozenset("object canvas button audio video map".split())  # hidden, but read when nothing ends them
HEAD_TAGS = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog header".split())
NOISE_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner "
                        "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead header topbar "
                        "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert "
                        "popup modal overlay subscribe subscription newsletter signup login share sharing social related "
                        "recommended pagination pager toolbar widget".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption address summary".split())
HOME_TAGS = frozenset("article main".split())
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")
ENDS = frozenset(".:!?…。：！？\"'”’»)")


class Element:
    """One element of the page.  ``name`` tells whether its names hold a word of noise: None, or whether that is a whole name."""

    __slots__ = ("tag", "label", "number", "above", "noise", "home", "name", "gone")

    def __init__(self, tag: str, label: str, number: int, above: Element | None, noise: bool, home: bool, name: bool | None) -> None:
        self.tag, self.label, self.number, self.above = tag, label, number, above
        self.noise, self.home, self.name, self.gone = noise, home, name, False


class Block:
    __slots__ = ("element", "text", "links", "noise", "home", "path")

    def __init__(self, element: Element, text: str, links: int) -> None:
        self.element, self.text, self.links = element, text, links
        self.noise, self.home, self.path = element.noise, element.home, 0


class Blocks(HTMLParser):
    """Blocks of a page, each with its innermost element; every element is made, opened and closed once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", "", 0, None, False, False, None)
        self.elements: list[Element] = [self.root]
        self.stack: list[Element] = []
        self.open: dict[str, int] = defaultdict(int)  # open elements of each tag
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links, self.open_links, self.hidden = 0, 0, 0
        self.marks: list[Element] = []  # article, main and h1 elements
        self.begun: dict[int, int] = {}  # open fallback element -> blocks before it

    def top(self) -> Element:
        return self.stack[-1] if self.stack else self.root

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(self.top(), text, self.links))
        self.parts, self.links = [], 0

    def end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.close_tag("head", within=False)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.close_tag("head", within=False)
        elif tag not in HEAD_TAGS:
            self.end_head()
        if tag in INLINE:
            self.open_links += tag == "a"
            if tag in ("br", "img", "wbr"):
                self.parts.append(" " if tag != "wbr" else "")
            return
        self.flush()
        if tag in VOID:
            return
        for other in CLOSED_BY.get(tag, "p" if tag not in HIDDEN else "").split():
            self.close_tag(other, within=CLOSED_BY.get(tag) is not None)
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        words = set("".join(c if c.isalpha() else " " for c in named).split())
        above = self.top()
        noise = above.noise or (tag in NOISE_TAGS and not (tag == "header" and above.home)) or any(k == "hidden" for k, _ in attrs)
        name = None
        if tag not in ("html", "body", "article", "main") and words & NOISE_WORDS:
            name = bool(NOISE_WORDS.intersection(named.split()))
        element = Element(tag, f"{tag}.{'.'.join(sorted(words))}" if words else tag, len(self.elements), above, noise,
                          above.home or tag in HOME_TAGS, name)
        if tag in ("article", "main", "h1") and not noise and not self.hidden and not self.begun:
            self.marks.append(element)
        self.hidden += tag in HIDDEN and tag not in FALLBACK
        if tag in FALLBACK:
            self.begun[element.number] = len(self.blocks)
        self.elements.append(element)
        self.stack.append(element)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def close_tag(self, tag: str, within: bool = True) -> None:
        """Close the nearest open ``tag``; with ``within``, not across a list, table or section it stands in."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            element = self.stack[i]
            if element.tag == tag:
                self.flush()
                if element.number in self.begun:
                    del self.blocks[self.begun.pop(element.number):]
                self.unwrap(i + 1)
                for x in self.stack[i:]:
                    self.open[x.tag] -= 1
                    self.hidden -= x.tag in HIDDEN and x.tag not in FALLBACK
                del self.stack[i:]
                return
            if within and element.tag in ("ul", "ol", "dl", "table", "div", "section", "article", "body"):
                return

    def unwrap(self, i: int) -> None:
        """Open elements from place ``i`` of the stack that hide text but have no end tag count as not there."""
        for element in self.stack[i:]:
            if self.begun.pop(element.number, None) is not None:
                element.gone = True

    def finish(self) -> None:
        """Give each block its path, a number for the labels from the root, and mark the noise by names."""
        self.close()
        self.flush()
        self.unwrap(0)
        paths: dict[tuple[int, str], int] = {}
        of = [0] * len(self.elements)
        for e in self.elements[1:]:
            up = of[e.above.number]
            of[e.number] = up if e.gone else paths.setdefault((up, e.label), len(paths) + 1)
        noise = self.named_noise()
        for b in self.blocks:
            b.path, b.noise = of[b.element.number], b.noise or noise[b.element.number]

    def around(self, tags: tuple[str, ...]) -> set[int]:
        """The elements that hold one of the marked elements with these tags."""
        found: set[int] = set()
        for mark in self.marks:
            e = mark.above
            while mark.tag in tags and e.number and e.number not in found:
                found.add(e.number)
                e = e.above
        return found

    def sums(self, of_block: dict[int, float]) -> list[float]:
        """Per element the sum over it and all elements in it, from sums over its own blocks."""
        held = [of_block.get(e.number, 0.0) for e in self.elements]
        for e in reversed(self.elements[1:]):
            held[e.above.number] += held[e.number]
        return held

    def named_noise(self) -> list[bool]:
        """Per element, whether names make it noise: its own or those of an element around it.

        A name is no proof: an element that holds the main element or an h1 stays, and so does one that holds an article
        or most of the paragraph text, unless a whole name says noise and an article stands outside of all such names.
        """
        if all(e.name is None for e in self.elements):
            return [False] * len(self.elements)
        clean = [b for b in self.blocks if not b.noise]
        paragraphs = [b for b in clean if inner_tag(b.element) == "p"]
        own: dict[int, float] = defaultdict(float)
        for b in paragraphs or clean:
            own[b.element.number] += max(0, len(b.text) - b.links)
        held = self.sums(own)
        below = [False] * len(self.elements)  # in an element whose names say noise
        for e in self.elements[1:]:
            below[e.number] = below[e.above.number] or e.above.name is not None
        elsewhere = any(m.tag != "h1" and not below[m.number] for m in self.marks)
        spared, articles = self.around(("main", "h1")), self.around(("article",))
        noise = [False] * len(self.elements)
        for e in self.elements[1:]:
            small = e.number not in articles and 2 * held[e.number] <= held[0]
            named = e.name is not None and not e.gone and e.number not in spared and (small or (e.name and elsewhere))
            noise[e.number] = noise[e.above.number] or named
        return noise

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.open_links = max(0, self.open_links - (tag == "a"))
            return
        self.flush()
        self.open_links = 0
        self.close_tag(tag, within=False)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.parts.append(data)
            self.links += len(data) * bool(self.open_links)


def inner_tag(element: Element) -> str:
    while element.gone:
        element = element.above
    return element.tag


def path_scores(blocks: list[Block], width: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Fused ratio of each block, text per node and punctuation per node of its path: smoothed along the page, and as it is.

    Text in links counts against a path, blocks in noise count nothing, and blocks of an article element double.
    """
    text, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in blocks:
        text[b.path] += max(0, len(b.text) - 2 * b.links)
        marks[b.path] += sum(map(b.text.count, PUNCTUATION))
        nodes[b.path] += 1
    raw = np.array([0.0 if b.noise else math.sqrt(text[b.path] / nodes[b.path] * (1 + marks[b.path] / nodes[b.path])) * (2 if b.home else 1)
                    for b in blocks])
    reach = np.arange(-3, 4)
    weights = np.exp(-0.5 * (reach / width) ** 2)
    smooth = np.convolve(np.pad(raw, 3, mode="edge"), weights / weights.sum(), mode="valid")
    return np.where([b.noise for b in blocks], 0.0, smooth), raw


def node_choice(blocks: list[Block], inside: list[bool], content: np.ndarray, marked: bool) -> list[bool]:
    """Which blocks of the box are text, by the ratios of their paths.

    A path whose text is mostly links is a list of links.  Where no article or main element says how far the article goes,
    it also ends with its content: before the first and after the last content node only headings before it stay, and
    blocks of a path that has content nodes elsewhere, unless they are lines without a full stop after the last one.
    """
    text, links, good = defaultdict(int), defaultdict(int), set()
    for b, held, is_content in zip(blocks, inside, content, strict=True):
        text[b.path] += len(b.text)
        links[b.path] += b.links
        if held and is_content:
            good.add(b.path)
    kept = [held and (b.path in good or 2 * links[b.path] <= text[b.path]) for b, held in zip(blocks, inside, strict=True)]
    places = [i for i, b in enumerate(blocks) if content[i] and kept[i] and b.text[-1] in ENDS]
    if marked or not places:
        return kept
    for i, b in enumerate(blocks):
        heading = inner_tag(b.element) in HEADINGS
        if i < places[0]:
            kept[i] = kept[i] and (heading or b.path in good)
        elif i > places[-1]:
            kept[i] = kept[i] and b.path in good and b.text[-1] in ENDS
    return kept


def main_text(html: str | None, threshold: float = 0.5) -> str:
    """Blocks of the article in page order, joined by an empty line.

    Content nodes score at least ``threshold`` times the text-weighted mean.  The article is the smallest element, paragraphs
    and the like aside, with nine tenths of their text, or else the article element around it.  Its blocks outside noise are
    the text, headings and short lines too, but for those that ``node_choice`` leaves out.
    """
    parser = Blocks()
    parser.feed(html or "")
    parser.finish()
    blocks = parser.blocks
    if not blocks:
        return ""
    (scores, raw), sizes = path_scores(blocks), np.array([len(b.text) for b in blocks], dtype=float)
    if not scores.any():
        return ""
    limit = threshold * float((scores * sizes).sum() / sizes[scores > 0].sum())
    content = scores >= limit
    own: dict[int, float] = defaultdict(float)
    for b, inside, size in zip(blocks, content, sizes, strict=True):
        own[b.element.number] += size * inside
    held, need = parser.sums(own), 0.9 * sizes[content].sum()
    whole = [e for e in parser.elements[1:] if held[e.number] >= need and not e.gone]  # from the root down
    homes = [e for e in whole if e.tag in HOME_TAGS]
    boxes = [e for e in whole if e.tag not in LEAVES]
    article = (homes or boxes or [parser.root])[-1]
    within = [False] * len(parser.elements)
    for e in parser.elements:
        within[e.number] = e is article or (e.number > 0 and within[e.above.number])
    held_by_box = [not b.noise and within[b.element.number] for b in blocks]
    kept = node_choice(blocks, held_by_box, content & (raw >= limit), article.tag in HOME_TAGS)
    return "\n\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page; a null, empty or textless page gives an empty text.

    Broken markup is read as far as it goes: unclosed and stray tags, cut-off references and comments.  All rows and
    other columns stay; a column called ``name`` is replaced.
    """
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text)

    return pages.withColumn(name, run(F.coalesce(F.col(html), F.lit(""))))
