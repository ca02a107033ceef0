"""A forgiving reader of HTML: a tree of elements that matter for layout, and the page's text in blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left

# fixed values: element names of the HTML standard by what they do here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript iframe object svg math canvas audio video map xmp noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr center nobr".split()) - {"center"}
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOPS = frozenset("table ul ol dl select td th".split())
_MARKS = STOPS.union(*CLOSES.values())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Tree:
    """Elements in page order with their parents; element 0 is the page.

    ``pieces`` are (block, element, text) in page order; pieces of one block number run on without a block border.
    """

    def __init__(self):
        self.tag, self.parent, self.words, self.hidden = ["#page"], [-1], [frozenset()], [False]
        self.pieces: list[tuple[int, int, str, bool]] = []


def _attributes(text: str) -> tuple[frozenset, bool]:
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            flat = value.lower().replace(" ", "")
            hidden |= "display:none" in flat or "visibility:hidden" in flat
        else:
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    return frozenset(words), hidden


class _Open:
    """The stack of open elements; every question about it looks at few entries, however deep the page is."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = [("#page", 0, True)]  # name, element that its text belongs to, block?
        self.blocks, self.marks = [0], []  # places of block elements, and of those that others close or stop at
        self.count: dict[str, int] = {}  # open elements by name
        self.inline: list[dict[str, int]] = [{}]  # open inline elements by name, for each open block
        self.links = 0

    def push(self, name: str, element: int, block: bool) -> None:
        self.count[name] = self.count.get(name, 0) + 1
        if name in _MARKS:
            self.marks.append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
            self.inline.append({})
        else:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
        self.links += name == "a"
        self.stack.append((name, element, block))

    def cut(self, k: int) -> bool:
        """Closes everything from place k on; tells whether a block was among it."""
        some = False
        while len(self.stack) > k:
            self._drop(len(self.stack) - 1)
            some |= self.stack.pop()[2]
        return some

    def _drop(self, k: int) -> None:
        name, _, block = self.stack[k]
        self.count[name] -= 1
        self.links -= name == "a"
        if self.marks and self.marks[-1] == k:
            self.marks.pop()
        if block:
            self.blocks.pop()
            self.inline.pop()
        else:
            self.inline[-1][name] -= 1

    def last(self, name: str, least: int = 1) -> int:
        k = len(self.stack) - 1
        while k >= least and self.stack[k][0] != name:
            k -= 1
        return k

    def end(self, name: str) -> bool | None:
        """An end tag: None if nothing is open that it ends, else whether a block was closed."""
        if name in INLINE:
            return self.cut(self.last(name)) if self.inline[-1].get(name) else None
        return self.cut(self.last(name)) if self.count.get(name) else None

    def end_paragraph(self) -> None:
        if self.stack[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1])

    def end_siblings(self, closes: set) -> None:
        for k in reversed(self.marks):
            name = self.stack[k][0]
            if name in closes:
                self.cut(k)
            elif name in STOPS:
                break

    def end_link(self) -> None:
        """A link within a link: the outer one ends, what it holds goes on."""
        if self.inline[-1].get("a"):
            k = self.last("a", self.blocks[-1] + 1)
            self.count["a"] -= 1
            self.inline[-1]["a"] -= 1
            self.links -= 1
            del self.stack[k]
        elif self.links:
            self.links -= 1  # it spans blocks: text behind the inner link counts as plain
            k = self.last("a")
            self.stack[k] = ("span", *self.stack[k][1:])
            for names in (self.count, self.inline[bisect_left(self.blocks, k) - 1]):
                names["a"] -= 1
                names["span"] = names.get("span", 0) + 1


def parse(page: str) -> Tree:
    tree, is_open = Tree(), _Open()
    stack = is_open.stack
    block, at, n = 0, 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        first = page[m.start()]
        if first != "<" or at - m.start() == 1:
            tree.pieces.append((block, stack[-1][1], m.group(), is_open.links > 0))
            continue
        name = m.group(2) or m.group(5)
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                tree.pieces.append((block, stack[-1][1], m.group()[9:-3].replace("&", "&amp;"), is_open.links > 0))
            continue
        name = name.lower()
        if m.group(1) or m.group(4):  # an end tag
            closed = is_open.end(name)
            block += closed if closed is not None else name == "p"
            continue
        rest = m.group(3) if m.group(2) else m.group(6)
        if name in DROPPED:
            if not rest.endswith("/") or name not in ("svg", "math", "canvas"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            tree.pieces.append((block, stack[-1][1], " ", False))
            continue
        inline = name in INLINE
        if name in VOID:
            block += name == "hr"
            continue
        if not inline:
            block += 1
            if name in PARAGRAPH_ENDS:
                is_open.end_paragraph()
            if name in CLOSES:
                is_open.end_siblings(CLOSES[name])
        elif name == "a" and is_open.links:
            is_open.end_link()
        words, hidden = _attributes(rest) if rest else (frozenset(), False)
        element = stack[-1][1]
        if not inline or hidden or words:
            element = len(tree.tag)
            tree.tag.append(name)
            tree.parent.append(stack[-1][1])
            tree.words.append(words)
            tree.hidden.append(hidden)
        if not rest.endswith("/") or name not in ("path",):
            is_open.push(name, element, not inline)
    return tree


def block_texts(tree: Tree, chosen) -> list[str]:
    """The texts of the blocks, of pieces whose element is ``chosen``: references decoded, white space as one space."""
    out, last, parts = [], -1, []
    for block, element, text, _ in [*tree.pieces, (-2, 0, "", False)]:
        if block != last:
            if parts and (flat := " ".join(html.unescape("".join(parts)).split())):
                out.append(flat)
            last, parts = block, []
        if block >= 0 and chosen[element]:
            parts.append(text)
    return out
