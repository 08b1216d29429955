"""PDF syntax: objects, cross-references and their repair, decryption, pages and content operators."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import Invalid, Limit
from . import pdf_filters
from .ciphers import aes_cbc, rc4

WHITE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"
MOST_DEPTH, MOST_CHAIN, MOST_OBJECTS = 64, 256, 1_000_000
# Fixed value: the page size where a document names none, in points.
A4 = (0.0, 0.0, 595.0, 842.0)

_SPACE = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_OBJ = re.compile(rb"(?<![^\0\t\n\f\r ()<>\[\]{}/%])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")
_NUMBER = re.compile(rb"[+-]*\d*\.?\d*")


class Name(str):
    """A name object, without its slash."""


class Op(str):
    """A keyword: an operator or a word of the syntax."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes
    ident: tuple[int, int] | None = None


class Reader:
    """Objects out of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def read(self, depth: int = 0) -> Any:
        """The next object; an end of data raises."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            raise Invalid("end of data")
        if depth > MOST_DEPTH:
            raise Limit("nesting")
        c = d[at]
        if c == 0x2F:
            m = _REGULAR.match(d, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if c == 0x28:
            return self._literal()
        if d[at : at + 2] == b"<<":
            return self._dict(depth)
        if c == 0x3C:
            end = d.find(b">", at)
            if end < 0:
                raise Invalid("string")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at += 1
            out = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.read(depth + 1))
        if self.refs and 0x30 <= c <= 0x39 and (m := _REF.match(d, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _REGULAR.match(d, at)
        if not m:
            self.at += 2 if d[at : at + 2] in (b">>",) else 1
            return Op(d[at : self.at].decode("latin-1"))
        self.at = m.end()
        return word(m[0])

    def _literal(self) -> bytes:
        d, out, depth, at = self.data, bytearray(), 1, self.at + 1
        escapes = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while at < len(d):
            c = d[at]
            at += 1
            if c == 0x5C and at < len(d):
                c = d[at]
                at += 1
                if c in escapes:
                    out.append(escapes[c])
                elif 0x30 <= c <= 0x37:
                    v = c - 48
                    for _ in range(2):
                        if at < len(d) and 0x30 <= d[at] <= 0x37:
                            v, at = v * 8 + d[at] - 48, at + 1
                    out.append(v & 255)
                elif c == 13:
                    at += d[at : at + 1] == b"\n"
                elif c != 10:
                    out.append(c)
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at
                    return bytes(out)
            out.append(c)
        raise Invalid("string")

    def _dict(self, depth: int) -> dict[str, Any]:
        self.at += 2
        out: dict[str, Any] = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.read(depth + 1)
            if not isinstance(key, Name):
                if isinstance(key, Op) and key in ("endobj", "stream"):
                    raise Invalid("dictionary")
                continue
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            out[str(key)] = self.read(depth + 1)


def word(raw: bytes) -> Any:
    """A number, a constant, or an operator."""
    constants = {b"true": True, b"false": False, b"null": None}
    if raw in constants:
        return constants[raw]
    if raw[0] in b"+-.0123456789":
        m = _NUMBER.match(raw)
        if m and re.search(rb"\d", m[0]):
            digits = m[0]
            sign = -1 if digits.startswith(b"-") else 1
            digits = digits.lstrip(b"+-")
            return sign * (float(digits) if b"." in digits else int(digits))
    return Op(raw.decode("latin-1"))


class Document:
    """A document opened for reading: its cross-references, or what a scan of the whole file finds."""

    def __init__(self, data: bytes, password: bytes = b""):
        at = data.find(b"%PDF-")
        self.data = data[at:] if 0 < at < 1024 else data
        self.where: dict[int, tuple] = {}
        self.trailer: dict[str, Any] = {}
        self.cache: dict[int, Any] = {}
        self.busy: set[int] = set()
        self.key: bytes | None = None
        self.crypt: dict[str, Any] = {}
        self.repaired = False
        try:
            self._tables()
            if not self._rooted():
                raise Invalid("no root")
        except (Invalid, Limit, ValueError, struct.error, IndexError, KeyError, TypeError, RecursionError):
            self._rebuild()
        self.encrypted = "Encrypt" in self.trailer
        if self.encrypted:
            self._unlock(password)
        if not self._rooted():
            if not self.repaired:
                self._rebuild()
            if not self._rooted():
                raise Invalid("not a readable PDF")

    # -- cross-references ----------------------------------------------------------------------------------------------

    def _rooted(self) -> bool:
        root = self.get(self.trailer.get("Root"))
        return isinstance(root, dict) and isinstance(self.get(root.get("Pages")), dict)

    def _tables(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise Invalid("no startxref")
        next_: Any = Reader(self.data, at + 9).read()
        seen: set[int] = set()
        todo = [next_]
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or at in seen or len(seen) > MOST_CHAIN:
                continue
            seen.add(at)
            r = Reader(self.data, at)
            r.skip()
            trailer = self._plain_table(r) if self.data[r.at : r.at + 4] == b"xref" else self._stream_table(r)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [trailer[k] for k in ("XRefStm", "Prev") if k in trailer]

    def _plain_table(self, r: Reader) -> dict[str, Any]:
        r.at += 4
        while True:
            first = r.read()
            if first == "trailer":
                break
            count = r.read()
            if not isinstance(first, int) or not isinstance(count, int) or count > MOST_OBJECTS:
                raise Invalid("cross-reference table")
            for n in range(first, first + count):
                at, generation, kind = r.read(), r.read(), r.read()
                if kind == "n" and n not in self.where:
                    self.where[n] = ("at", at, generation)
                elif kind == "f":
                    self.where.setdefault(n, ("free",))
        trailer = r.read()
        if not isinstance(trailer, dict):
            raise Invalid("trailer")
        return trailer

    def _stream_table(self, r: Reader) -> dict[str, Any]:
        _, _, s = self._object_at(r.at, None)
        if not isinstance(s, Stream):
            raise Invalid("cross-reference stream")
        w = [int(x) for x in s.dict["W"]]
        if len(w) != 3 or min(w) < 0 or max(w) > 8 or not sum(w):
            raise Invalid("cross-reference stream")
        body = self._filtered(s, s.raw)
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for n in range(first, first + min(count, MOST_OBJECTS)):
                row = body[at : at + sum(w)]
                if len(row) < sum(w):
                    break
                at += sum(w)
                a, b, c = (int.from_bytes(row[sum(w[:i]) : sum(w[: i + 1])], "big") for i in range(3))
                kind = a if w[0] else 1
                if kind == 1:
                    self.where.setdefault(n, ("at", b, c))
                elif kind == 2:
                    self.where.setdefault(n, ("in", b, c))
                elif kind == 0:
                    self.where.setdefault(n, ("free",))
        return s.dict

    def _rebuild(self) -> None:
        """Every object that a scan of the whole file finds; the last definition of a number counts, those in object streams come last."""
        self.where, self.cache, self.repaired = {}, {}, True
        trailer: dict[str, Any] = {}
        inside: list[int] = []
        catalog = None
        for m in _OBJ.finditer(self.data):
            try:
                n, g, obj = self._object_at(m.start(), None)
            except (Invalid, Limit, ValueError, RecursionError):
                continue
            self.where[n] = ("at", m.start(), g)
            d = obj.dict if isinstance(obj, Stream) else obj
            if isinstance(d, dict):
                if d.get("Type") == "Catalog":
                    catalog = Ref(n, g)
                elif d.get("Type") == "ObjStm":
                    inside.append(n)
                elif d.get("Type") == "XRef":
                    trailer |= {k: v for k, v in d.items() if k in ("Root", "Info", "Encrypt", "ID")}
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Reader(self.data, m.end()).read()
            except (Invalid, Limit, ValueError, RecursionError):
                continue
            if isinstance(t, dict):
                root = self.get(t.get("Root"))
                if (isinstance(root, dict) and "Pages" in root) or "Root" not in trailer:
                    trailer |= t
        self.trailer = trailer
        for n in inside:
            for k, number in enumerate(self._numbers_in(n)):
                self.where.setdefault(number, ("in", n, k))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            if catalog is None:
                catalog = next((Ref(n, 0) for n in self.where if isinstance(o := self.get(Ref(n, 0)), dict) and o.get("Type") == "Catalog"), None)
            if catalog is not None:
                self.trailer["Root"] = catalog

    # -- objects ---------------------------------------------------------------------------------------------------------

    def _object_at(self, at: int, wanted: int | None) -> tuple[int, int, Any]:
        m = _OBJ.match(self.data, _SPACE.match(self.data, at).end())
        if not m or (wanted is not None and int(m[1]) != wanted):
            raise Invalid("object")
        r = Reader(self.data, m.end())
        obj = r.read()
        if isinstance(obj, dict):
            r.skip()
            if self.data[r.at : r.at + 6] == b"stream":
                obj = self._stream(obj, r.at + 6, (int(m[1]), int(m[2])))
        return int(m[1]), int(m[2]), obj

    def _stream(self, d: dict[str, Any], at: int, ident: tuple[int, int]) -> Stream:
        at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
        size = self.get(d.get("Length"))
        if isinstance(size, int) and 0 <= size <= len(self.data) - at:
            end = _SPACE.match(self.data, at + size).end() if size < len(self.data) - at else at + size
            if self.data[end : end + 9] == b"endstream":
                return Stream(d, self.data[at : at + size], ident)
        end = self.data.find(b"endstream", at)
        if end < 0:
            end = self.data.find(b"endobj", at)
        body = self.data[at : end if end >= 0 else len(self.data)]
        return Stream(d, body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body, ident)

    def get(self, obj: Any, depth: int = 0) -> Any:
        """An object, references followed; one that can't be read is null."""
        while isinstance(obj, Ref):
            if depth > MOST_DEPTH:
                return None
            depth += 1
            obj = self._load(obj.number)
        return obj

    def _load(self, n: int) -> Any:
        if n in self.cache:
            return self.cache[n]
        place = self.where.get(n)
        if place is None or n in self.busy or place[0] == "free":
            return None
        self.busy.add(n)
        try:
            obj = self._read(n, place)
        except (Invalid, Limit, ValueError, RecursionError, TypeError):
            obj = None
        finally:
            self.busy.discard(n)
        if place[0] == "at":
            obj = self._decrypted(obj, (n, place[2]))
        self.cache[n] = obj
        return obj

    def _read(self, n: int, place: tuple) -> Any:
        if place[0] == "at":
            try:
                return self._object_at(place[1], n)[2]
            except Invalid:
                # the table is wrong here: look for the object itself
                last = None
                for m in _OBJ.finditer(self.data):
                    if int(m[1]) == n:
                        last = m
                if last is None:
                    raise
                return self._object_at(last.start(), n)[2]
        _, holder, k = place
        s = self._load(holder)
        if not isinstance(s, Stream):
            return None
        body, first = self.decode(s), self.get(s.dict.get("First"))
        numbers = self._numbers_in(holder, body)
        k = numbers.index(n) if n in numbers else k
        r = Reader(body)
        offset = [r.read() for _ in range(2 * len(numbers))][2 * k + 1]
        return Reader(body, first + offset).read()

    def _numbers_in(self, holder: int, body: bytes | None = None) -> list[int]:
        s = self._load(holder)
        if not isinstance(s, Stream):
            return []
        try:
            r = Reader(self.decode(s) if body is None else body)
            head = [r.read() for _ in range(2 * min(int(self.get(s.dict.get("N")) or 0), MOST_OBJECTS))]
        except (Invalid, Limit):
            return []
        return [x for x in head[::2] if isinstance(x, int)]

    def decode(self, s: Stream) -> bytes:
        return self._filtered(s, s.raw)

    def _filtered(self, s: Stream, data: bytes) -> bytes:
        names = self.get(s.dict.get("Filter", s.dict.get("F")))
        params = self.get(s.dict.get("DecodeParms", s.dict.get("DP")))
        names = names if isinstance(names, list) else [names] if names is not None else []
        params = params if isinstance(params, list) else [params]
        for i, name in enumerate(names):
            p = self.get(params[i]) if i < len(params) else None
            given = {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}
            given = {k: self.decode(v) if isinstance(v, Stream) else v for k, v in given.items()}
            data = pdf_filters.apply(str(self.get(name)), data, given)
        return data

    def objects(self) -> Iterator[tuple[int, Any]]:
        for n in sorted(self.where):
            if self.where[n][0] != "free":
                yield n, self._load(n)

    # -- decryption ------------------------------------------------------------------------------------------------------

    def _unlock(self, password: bytes) -> None:
        e = self.get(self.trailer["Encrypt"])
        if not isinstance(e, dict) or e.get("Filter") != "Standard":
            raise Invalid("unsupported encryption")
        e = {k: self.get(v) for k, v in e.items()}
        v, r = int(e.get("V", 0)), int(e.get("R", 0))
        method = "V2"
        if v >= 4:
            filters = e.get("CF") or {}
            chosen = self.get(filters.get(str(e.get("StmF", "Identity"))))
            method = str(self.get(chosen.get("CFM"))) if isinstance(chosen, dict) else "None"
        length = int(e.get("Length", 40)) // 8 if v in (2, 3) else 16 if v >= 4 else 5
        ids = self.get(self.trailer.get("ID"))
        ident = self.get(ids[0]) if isinstance(ids, list) and ids else b""
        key = file_key_old(password, e, r, max(5, min(16, length)), ident) if r <= 4 else file_key_new(password, e, r)
        if key is None:
            raise Invalid("password")
        self.key, self.crypt = key, {"method": method if r <= 4 else "AESV3", "meta": e.get("EncryptMetadata", True)}
        self.cache.clear()

    def _decrypted(self, obj: Any, ident: tuple[int, int]) -> Any:
        if self.key is None or self.crypt["method"] in ("None", "Identity"):
            return obj
        if isinstance(obj, Stream):
            kind = obj.dict.get("Type")
            if kind == "XRef" or (kind == "Metadata" and not self.crypt["meta"]):
                return obj
            return Stream({k: self._decrypted(v, ident) for k, v in obj.dict.items()}, self._plain(obj.raw, ident), obj.ident)
        if isinstance(obj, bytes):
            return self._plain(obj, ident)
        if isinstance(obj, list):
            return [self._decrypted(x, ident) for x in obj]
        if isinstance(obj, dict):
            return {k: self._decrypted(v, ident) for k, v in obj.items()}
        return obj

    def _plain(self, data: bytes, ident: tuple[int, int]) -> bytes:
        if self.crypt["method"] == "AESV3":
            return aes_cbc(self.key, data)
        salt = self.key + ident[0].to_bytes(4, "little")[:3] + ident[1].to_bytes(4, "little")[:2]
        aes = self.crypt["method"] == "AESV2"
        key = hashlib.md5(salt + (b"sAlT" if aes else b"")).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc(key, data) if aes else rc4(key, data)

    # -- pages -----------------------------------------------------------------------------------------------------------

    def pages(self) -> list[dict[str, Any]]:
        """Page dictionaries with the boxes, rotation and resources that they inherit; each kid is visited once."""
        root = self.get(self.trailer.get("Root"))
        out: list[dict[str, Any]] = []
        seen: set[int] = set()
        stack: list[tuple[Any, dict[str, Any]]] = [(root.get("Pages"), {})]
        while stack:
            ref, given = stack.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            given = given | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if node.get("Type") == "Pages" or (isinstance(kids, list) and node.get("Type") != "Page"):
                stack += [(k, given) for k in reversed(kids if isinstance(kids, list) else [])]
            else:
                out.append(node | given)
            if len(out) > MOST_OBJECTS:
                raise Limit("pages")
        return out

    def box(self, page: dict[str, Any], name: str) -> tuple[float, float, float, float] | None:
        v = self.get(page.get(name))
        if not isinstance(v, list) or len(v) < 4:
            return None
        n = [self.get(x) for x in v[:4]]
        if not all(isinstance(x, int | float) for x in n):
            return None
        return min(n[0], n[2]), min(n[1], n[3]), max(n[0], n[2]), max(n[1], n[3])

    def size(self, page: dict[str, Any]) -> tuple[float, float]:
        """What a page shows, turned as it says, in points."""
        media = self.box(page, "MediaBox") or A4
        crop = self.box(page, "CropBox") or media
        w, h = min(media[2], crop[2]) - max(media[0], crop[0]), min(media[3], crop[3]) - max(media[1], crop[1])
        if w <= 0 or h <= 0:
            w, h = A4[2], A4[3]
        turn = self.get(page.get("Rotate"))
        return (h, w) if isinstance(turn, int | float) and int(turn) % 180 == 90 else (float(w), float(h))

    def content(self, page: dict[str, Any]) -> bytes:
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        out = []
        for p in parts:
            s = self.get(p)
            if isinstance(s, Stream):
                try:
                    out.append(self.decode(s))
                except (Invalid, Limit):
                    continue
        return b"\n".join(out)

    def info(self) -> dict[str, str]:
        """Texts of the information dictionary."""
        d = self.get(self.trailer.get("Info"))
        out = {}
        for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"):
            v = self.get(d.get(k)) if isinstance(d, dict) else None
            if isinstance(v, bytes):
                out[k] = v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else v[3:].decode("utf-8", "replace") if v[:3] == b"\xef\xbb\xbf" else v.decode("latin-1")
        return out

    def version(self) -> str | None:
        m = re.match(rb"%PDF-(\d\.\d)", self.data)
        return m[1].decode() if m else None


# Fixed value: the bytes that fill up a password.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def file_key_old(password: bytes, e: dict[str, Any], revision: int, length: int, ident: bytes) -> bytes | None:
    """The file key of revisions 2 to 4 from a user password, or none if it's wrong."""
    h = hashlib.md5((password + PADDING)[:32] + e["O"][:32] + struct.pack("<i", int(e["P"]) - (1 << 32) if int(e["P"]) >= 1 << 31 else int(e["P"])) + ident + (b"\xff" * 4 if revision >= 4 and e.get("EncryptMetadata") is False else b""))
    key = h.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    key = key[:length]
    if revision == 2:
        return key if rc4(key, PADDING) == e["U"][:32] else None
    probe = hashlib.md5(PADDING + ident).digest()
    for i in range(20):
        probe = rc4(bytes(b ^ i for b in key), probe)
    return key if probe == e["U"][:16] else None


def file_key_new(password: bytes, e: dict[str, Any], revision: int) -> bytes | None:
    """The file key of revisions 5 and 6 from a user password, or none if it's wrong."""
    password, u = password[:127], e["U"]
    if hash_new(password, u[32:40], revision) != u[:32]:
        return None
    return aes_cbc(hash_new(password, u[40:48], revision), e["UE"][:32], iv=bytes(16), padded=False)


def hash_new(password: bytes, salt: bytes, revision: int, user: bytes = b"") -> bytes:
    from .ciphers import aes_cbc_encrypt

    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        block = aes_cbc_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        i += 1
        if i >= 64 and block[-1] <= i - 32:
            return k[:32]


def operators(content: bytes, most: int = 1_000_000) -> Iterator[tuple[str, list[Any]]]:
    """Operators of a content stream with their operands; an inline image is one operator with its dictionary and bytes."""
    r, held = Reader(content, refs=False), []
    for _ in range(most):
        try:
            obj = r.read()
        except (Invalid, Limit):
            r.skip()
            if r.at >= len(content):
                return
            r.at += 1
            continue
        if not isinstance(obj, Op):
            held.append(obj)
            if len(held) > 512:
                del held[0]
            continue
        if obj == "BI":
            yield "BI", [*_inline(r, content)]
        elif re.fullmatch(r"[A-Za-z'\"][A-Za-z0-9*'\"]*", obj):
            yield str(obj), held
        held = []


def _inline(r: Reader, content: bytes) -> tuple[dict[str, Any], bytes]:
    d: dict[str, Any] = {}
    while True:
        key = r.read()
        if isinstance(key, Op):
            break
        d[str(key)] = r.read()
    begin = r.at + 1
    m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(content, begin)
    end = m.start() if m else len(content)
    r.at = m.end() if m else len(content)
    return d, content[begin:end]


def inspect(data: bytes) -> dict[str, Any]:
    d = Document(data)
    return {"pages": len(d.pages()), "encrypted": d.encrypted}


def printable(obj: Any, depth: int = 0) -> Any:
    """An object as JSON can hold it."""
    if isinstance(obj, Stream):
        return {"stream": len(obj.raw), "dict": printable(obj.dict, depth)}
    if isinstance(obj, Ref):
        return f"{obj.number} {obj.generation} R"
    if isinstance(obj, bytes):
        return obj.decode("latin-1")
    if isinstance(obj, Name):
        return "/" + obj
    if isinstance(obj, list):
        return [printable(x, depth + 1) for x in obj]
    if isinstance(obj, dict):
        return {k: printable(v, depth + 1) for k, v in obj.items()}
    return str(obj) if isinstance(obj, Op) else obj
