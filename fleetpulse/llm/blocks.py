"""Leaf blocks of an HTML page: runs of text between block elements, with the elements that hold them.

One scan over the page, linear in its length. Scripts, styles, comments and the head's title give no blocks. Elements whose end
tags are left out end where HTML ends them; unclosed inline elements end with their block.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# Elements of HTML by how they lie in a text.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
RAW = {"script", "style", "template", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "svg"}
EMPTY = {"hr", "br", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "track", "wbr"}
# A start tag that ends an open element, up to the element that contains both.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # a tag whose quotes do not close
NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    path: list[tuple[str, ...]]  # the elements around the text from the outside: tag, then words of class, id and role
    text: str
    linked: int  # code points of the text within links


def words_of(attributes: str) -> tuple[str, ...]:
    names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes))
    return tuple(p.lower() for p in PART.findall(names)) if names else ()


class Scanner:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, ...]] = []
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked = self.in_link = 0

    def text(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.in_link:
            self.linked += len(piece.strip())

    def flush(self) -> None:
        """Ends the block at hand."""
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(self.stack[:4] + self.stack[4:][-8:], text, min(self.linked, len(text))))
        self.pieces, self.linked, self.in_link = [], 0, 0

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def start(self, tag: str, attributes: str) -> None:
        if tag not in BLOCKS:
            if tag == "br":
                self.pieces.append(" ")
            self.in_link += tag == "a"
            return
        self.flush()
        if self.open["p"] and self.stack[-1][0] == "p":
            self.pop()
        ended, within = ENDS.get(tag, ((), ()))
        if any(self.open[t] for t in ended):
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth][0]
                if name in within:
                    break
                if name in ended:
                    while len(self.stack) > depth:
                        self.pop()
        if tag not in EMPTY:
            self.stack.append((tag, *words_of(attributes)))
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag not in BLOCKS:
            if tag == "a":
                self.in_link = max(0, self.in_link - 1)
            return
        self.flush()
        if self.open[tag]:
            while self.pop() != tag:
                pass


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; a null or empty page has none."""
    scanner, page = Scanner(), page or ""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            scanner.text(page[at:])
            break
        if mark > at:
            scanner.text(page[at:mark])
        if page.startswith("<!--", mark):
            close = page.find("-->", mark + 2)
            at = size if close < 0 else close + 3
        elif page.startswith(("<!", "<?"), mark):
            close = page.find(">", mark)
            at = size if close < 0 else close + 1
        elif found := TAG.match(page, mark) or LOOSE.match(page, mark):
            at, tag = found.end(), found[2].lower()
            if found[1]:
                scanner.end(tag)
            elif tag in RAW and not (tag == "svg" and found[3].endswith("/")):
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = size if close is None else page.find(">", close.start()) + 1 or size
            else:
                scanner.start(tag, found[3])
        else:
            scanner.text("<")
            at = mark + 1
    scanner.flush()
    return scanner.blocks
