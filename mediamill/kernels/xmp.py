"""XMP packets: RDF properties as tags.  Entities other than the five of XML and document types are refused."""

from __future__ import annotations

from xml.parsers import expat

from ..functions.tags import XMP_GROUPS
from .tags import Tags

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
MOST_BYTES, MOST_NODES, MOST_DEPTH = 4 << 20, 65_536, 64


class _Refused(Exception):
    pass


class Element:
    __slots__ = ("ns", "local", "prefix", "attrs", "children", "text")

    def __init__(self, ns: str, local: str, prefix: str):
        self.ns, self.local, self.prefix = ns, local, prefix
        self.attrs: list[tuple[str, str, str, str]] = []
        self.children: list[Element] = []
        self.text = ""

    def attr(self, ns: str, local: str) -> str | None:
        return next((v for n, k, _, v in self.attrs if (n, k) == (ns, local)), None)

    def own(self) -> list[tuple[str, str, str, str]]:
        """Attributes that are properties."""
        return [a for a in self.attrs if a[0] not in ("", RDF, XML)]

    def described(self) -> "Element":
        return next((c for c in self.children if (c.ns, c.local) == (RDF, "Description")), self)


def parse(text: str) -> Element:
    root = Element("", "", "")
    stack, nodes = [root], 0
    p = expat.ParserCreate(namespace_separator=" ")
    p.namespace_prefixes = True
    p.buffer_text = True

    def name(full: str) -> tuple[str, str, str]:
        parts = full.split(" ")
        return ("", parts[0], "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")

    def start(tag, attrs):
        nonlocal nodes
        nodes += 1
        if nodes > MOST_NODES or len(stack) > MOST_DEPTH:
            raise _Refused
        e = Element(*name(tag))
        e.attrs = [(*name(k), v) for k, v in attrs.items()]
        stack[-1].children.append(e)
        stack.append(e)

    def refuse(*_):
        raise _Refused

    def text_(s):
        stack[-1].text += s

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), text_
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.Parse(text, True)
    return root


def _first_upper(s: str) -> str:
    return s[:1].upper() + s[1:]


def _group(ns: str, prefix: str) -> str:
    return "XMP-" + XMP_GROUPS.get(ns, prefix)


def read(data: bytes, out: Tags) -> None:
    if len(data) > MOST_BYTES:
        out.warn("XMP too large")
        return
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        text = data[2 : len(data) // 2 * 2].decode("utf-16-be" if data[:1] == b"\xfe" else "utf-16-le", "replace")
    elif data[:3] == b"\xef\xbb\xbf":
        text = data[3:].decode("utf-8", "replace")
    else:
        from .tags import text_of

        text = text_of(data)
    try:
        root = parse(text.rstrip("\0 \n\r\t").lstrip())
    except (expat.ExpatError, _Refused, ValueError):
        out.warn("invalid XMP")
        return
    todo = [root]
    while todo:
        e = todo.pop()
        if (e.ns, e.local) != (RDF, "RDF"):
            todo += reversed(e.children)
            continue
        for d in e.children:
            if (d.ns, d.local) == (RDF, "Description"):
                for ns, local, prefix, value in d.own():
                    out.push(_group(ns, prefix), _first_upper(local), value)
                for p in d.children:
                    _property(p, _group(p.ns, p.prefix), _first_upper(p.local), out)


def _property(p: Element, group: str, name: str, out: Tags) -> None:
    resource = p.attr(RDF, "resource")
    if resource is not None:
        out.push(group, name, resource)
        return
    box = next((c for c in p.children if c.ns == RDF and c.local in ("Alt", "Bag", "Seq")), None)
    if box is not None:
        items = [c for c in box.children if (c.ns, c.local) == (RDF, "li")]
        if box.local == "Alt" and any(i.attr(XML, "lang") is not None for i in items):
            for i in items:
                lang = i.attr(XML, "lang") or "x-default"
                out.push(group, name if lang.lower() == "x-default" else f"{name}-{lang}", i.text.strip())
            return
        plain = []
        for i in items:
            if i.children or i.own() or any(a[0] == "" for a in i.attrs):
                _structure(i, group, name, out)
            else:
                plain.append(i.text.strip())
        if plain:
            out.push(group, name, plain)
    elif p.attr(RDF, "parseType") == "Resource" or p.children or p.own():
        _structure(p, group, name, out)
    else:
        out.push(group, name, p.text.strip())


def _structure(s: Element, group: str, name: str, out: Tags) -> None:
    """A structure's fields as tags whose names begin with that of the structure."""
    inner = s.described()
    for _, local, _, value in inner.own():
        out.push(group, name + _first_upper(local), value)
    for f in inner.children:
        if f.ns != RDF:
            _property(f, group, name + _first_upper(f.local), out)
