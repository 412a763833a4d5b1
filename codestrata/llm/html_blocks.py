"""HTML to leaf blocks: runs of text between block-level tags, with the tags and attributes around them.

The parser follows the tags as browsers do where that decides what a block is: void elements, raw text, paragraphs and
list items that end where another begins, end tags without a beginning. It works on any input and in one pass.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Names of the HTML standard, by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe".split())
ESCAPABLE, PLAIN = {"title", "textarea"}, {"xmp"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes object ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul xmp".split())
CLOSES_P = BLOCK - set("body button caption head html legend object option select tbody td textarea tfoot th thead title tr".split())
BARRIERS = set("button caption object table td th template marquee applet html".split())
#: What a new element of this name ends, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
#: A quote opens a value only after an equals sign, and only if it is closed somewhere; else the tag ends at the next ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.S)
ATTRIBUTES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.S)
LETTERS = re.compile("[a-z]+")


@dataclass
class Block:
    """text has single spaces; around counts the tags (``p``) and attribute words (``.menu``) around the block."""

    text: str
    around: frozenset
    tag: str
    depth: int
    in_links: int  # characters inside links


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.around: Counter = Counter()
        self.parts: list[str] = []
        self.linked: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag = next((t for t, _ in reversed(self.stack) if t in BLOCK), "")
                self.blocks.append(Block(text, frozenset(self.around), tag, len(self.stack), len(" ".join("".join(self.linked).split()))))
            self.parts, self.linked = [], []

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, words))
        self.around.update((tag, *words))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, words = self.stack.pop()
            self.places[tag].pop()
            for name in (tag, *words):
                self.around[name] -= 1
                if not self.around[name]:
                    del self.around[name]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def text(self, raw: str, plain: bool = False) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw and not plain else raw
            self.parts.append(text)
            if self.around.get("a"):
                self.linked.append(text)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P and self.places.get("p") and (place := self.places["p"][-1]) > self.last(BARRIERS):
            self.pop_to(place)
        if tag in ENDS:
            ended, within = ENDS[tag]
            if (place := self.last(ended)) > self.last(within):
                self.pop_to(place)
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            words = tuple(dict.fromkeys("." + w for _, value in ATTRIBUTES.findall(attributes) for w in LETTERS.findall(value.lower()))) if "=" in attributes else ()
            self.push(tag, words)

    def end(self, tag: str) -> None:
        if tag in BLOCK or tag == "br":
            self.flush() if tag in BLOCK else self.parts.append(" ")
        places = self.places.get(tag)
        if not places:
            return
        # An inline end tag doesn't reach over a block that began after it.
        if tag in BLOCK or places[-1] > self.last(BARRIERS):
            self.pop_to(places[-1])


def blocks(source: str) -> list[Block]:
    """The page's leaf blocks in order, whatever they are; text of scripts, styles and comments is in none.

    What stands in for frames and embedded objects is read as text, as by a reader that shows neither.
    """
    page, at, n = _Page(), 0, len(source)
    while at < n:
        found = TOKEN.search(source, at)
        if not found:
            page.text(source[at:])
            break
        page.text(source[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            page.end(tag)
            continue
        if tag in RAW or tag in ESCAPABLE or tag in PLAIN:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            body, at = (source[at : close.start()], close.start()) if close else (source[at:], n)
            if tag in RAW:
                at = n if not close else (source.find(">", at) + 1 or n)
                page.parts.append(" ") if tag == "noscript" else None
            else:
                page.start(tag, found[3])
                page.text(body, tag in PLAIN)
                page.end(tag)
            continue
        page.start(tag, found[3])
    page.flush()
    return page.blocks
