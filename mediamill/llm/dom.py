"""A forgiving HTML reader that gives a page as a flat tree of block elements, with what a classifier needs to know of each.

Inline elements belong to the block that they stand in.  Scripts, styles, comments, the
head and form controls carry no text.  Missing end tags are implied as browsers imply
them; a page may end anywhere, a tag cut off by the end of the page is dropped.
"""

from __future__ import annotations

import html
import re

_RAW = "script|style|noscript|template|svg|math|textarea|title|select|iframe|object|canvas|audio|video|button"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?P<ra>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(id|class|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr area embed param link meta base input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends an open element of these, unless one of the barriers stands between.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"})}


_P_BARRIERS = ("td", "th", "table", "li")


class _Open:
    """The open elements from the root down, and where those of each tag stand, so that none is searched for."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        """End the element at a place and all in it; the root never ends."""
        while place and len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()


class Node:
    __slots__ = ("tag", "words", "parent", "depth", "start", "order", "text", "link", "links", "commas", "pieces", "controls", "children")

    def __init__(self, tag: str, words: tuple[str, ...], parent: int, depth: int, start: int, order: int):
        self.tag, self.words, self.parent, self.depth, self.start, self.order = tag, words, parent, depth, start, order
        self.text = self.link = self.links = self.commas = self.pieces = self.controls = self.children = 0


class Page:
    """``nodes`` in page order (each after its parent; node 0 is the root) and ``pieces`` of text: node, block number, text."""

    __slots__ = ("nodes", "pieces", "size")

    def __init__(self, source: str):
        self.nodes = [Node("#root", (), -1, 0, 0, 0)]
        self.pieces: list[tuple[int, int, str]] = []
        self.size = max(1, len(source))
        self._read(source)

    def _read(self, source: str) -> None:
        nodes, pieces = self.nodes, self.pieces
        open_ = _Open()
        block = 0
        in_link = False
        in_head = False
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at and not in_head:
                self._text(open_.nodes[-1], block, source[at : m.start()], in_link)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                raw = m["raw"]
                if raw and raw.lower() in ("textarea", "select", "button"):
                    nodes[open_.nodes[-1]].controls += 1
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "head":
                    in_head = False
                elif tag == "a":
                    in_link = False
                elif tag not in INLINE and tag != "br":
                    open_.close(open_.last((tag,)))
                    block += 1
                    in_link = False
                continue
            if tag == "head":
                in_head = True
                continue
            if tag == "body":
                in_head = False
            if in_head:
                if tag in INLINE or tag in VOID:
                    continue
                in_head = False
            if tag == "br":
                pieces.append((open_.nodes[-1], block, " "))
                continue
            if tag == "input":
                nodes[open_.nodes[-1]].controls += 1
            if tag in INLINE:
                if tag == "a":
                    in_link = True
                    nodes[open_.nodes[-1]].links += 1
                continue
            block += 1
            in_link = False
            if tag in VOID or tag in ("html", "body"):
                continue
            ends, barriers = (("p",), _P_BARRIERS) if tag in _CLOSES_P else _SIBLINGS.get(tag, ((), ()))
            if (place := open_.last(ends)) > open_.last(barriers):
                open_.close(place)
            parent = open_.nodes[-1]
            attrs = m["attrs"]
            words = attribute_words(attrs) if attrs else ()
            nodes[parent].children += 1
            nodes.append(Node(tag, words, parent, nodes[parent].depth + 1, m.start(), nodes[parent].children))
            if not attrs.endswith("/"):
                open_.push(len(nodes) - 1, tag)
        if at < len(source) and not in_head:
            self._text(open_.nodes[-1], block, source[at:], in_link)

    def _text(self, node: int, block: int, text: str, in_link: bool) -> None:
        self.pieces.append((node, block, text))
        if not text.isspace():
            n, size = self.nodes[node], len(text)
            n.text += size
            n.pieces += 1
            n.commas += text.count(",") + text.count(".")
            if in_link:
                n.link += size

    def content(self, kept) -> str:
        """Text of the kept nodes: references decoded, white space in a block made one space, blocks joined by one space."""
        out: list[str] = []
        held: list[str] = []
        last = -1
        for node, block, text in self.pieces:
            if not kept[node]:
                continue
            if block != last:
                if held:
                    out.append("".join(held))
                held, last = [], block
            held.append(text)
        if held:
            out.append("".join(held))
        words = (" ".join((html.unescape(x) if "&" in x else x).split()) for x in out)
        return " ".join([x for x in words if x])


def attribute_words(attrs: str) -> tuple[str, ...]:
    """Words of an element's id, class, role and the like, in lower case."""
    found: list[str] = []
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found += _WORD.findall(_CAMEL.sub(" ", value).lower())
    return tuple(found)
