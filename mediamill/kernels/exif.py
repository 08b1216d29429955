"""EXIF: directories of a TIFF structure."""

from __future__ import annotations

import math
import struct

from ..functions.tags import EXIF_NAMES
from . import xmp
from .tags import Tags, clean, text_of

# Bytes and format of each field type.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
MOST_DIRECTORIES, MOST_ENTRIES, MOST_VALUES = 32, 1024, 64
_EXIF, _OTHER, _XMP, _ICC, _COMMENT = 0x8769, (0x8825, 0xA005), 0x02BC, 0x8773, 0x9286


class Tiff:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4], "")

    def unpack(self, form: str, at: int):
        form = self.order + form
        if at < 0 or at + struct.calcsize(form) > len(self.data):
            return None
        return struct.unpack_from(form, self.data, at)

    def one(self, form: str, at: int):
        got = self.unpack(form, at)
        return None if got is None else got[0]

    def entries(self, at: int):
        """Number, type, count and bytes of each field of a directory; None for one that is cut off, False bytes out of bounds."""
        n = self.one("H", at) or 0
        for i in range(n):
            e = at + 2 + 12 * i
            head = self.unpack("HHI", e)
            if head is None:
                yield None
                return
            tag, kind, count = head
            if kind not in TYPES:
                continue
            total = count * TYPES[kind][0]
            where = e + 8 if total <= 4 else self.one("I", e + 8)
            raw = self.data[where : where + total] if where is not None and where + total <= len(self.data) else None
            yield tag, kind, count, raw, e


def read(data: bytes, out: Tags) -> None:
    t = Tiff(data)
    if len(data) < 8 or not t.order:
        out.warn("truncated EXIF" if len(data) < 8 else "invalid EXIF header")
        return
    seen: set[int] = set()
    at = t.one("I", 4)
    for group in ("IFD0", "IFD1"):
        if not at or len(seen) >= MOST_DIRECTORIES:
            return
        at = _directory(t, at, group, out, seen)


def _directory(t: Tiff, at: int, group: str, out: Tags, seen: set[int]) -> int | None:
    if at in seen:
        out.warn("EXIF IFD loop")
        return None
    seen.add(at)
    n = t.one("H", at)
    if n is None:
        return None
    if n > MOST_ENTRIES:
        out.warn("too many EXIF entries")
        return None
    for entry in t.entries(at):
        if entry is None:
            out.warn("truncated EXIF IFD")
            return None
        tag, kind, count, raw, e = entry
        if raw is None:
            out.warn("EXIF value out of bounds")
        elif tag == _EXIF:
            sub = t.one("I", e + 8)
            if sub is not None and len(seen) < MOST_DIRECTORIES:
                _directory(t, sub, "ExifIFD", out, seen)
        elif tag == _XMP:
            xmp.read(raw, out)
        elif tag == _ICC:
            out.profile(raw)
        elif tag not in _OTHER and tag in EXIF_NAMES:
            value = _value(t, tag, kind, count, raw)
            if value != "":
                out.push(group, EXIF_NAMES[tag], value)
    return t.one("I", at + 2 + 12 * n)


def _value(t: Tiff, tag: int, kind: int, count: int, raw: bytes) -> int | float | str:
    if tag == _COMMENT:
        return user_comment(raw, t.order)
    if 0x9C9B <= tag <= 0x9C9F:
        return clean(raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace"))
    if kind == 2:
        return clean(text_of(raw.split(b"\0", 1)[0]))
    if kind == 7:
        return clean(raw.decode("latin-1"))
    size, form = TYPES[kind]
    values = []
    for i in range(min(count, MOST_VALUES)):
        got = struct.unpack_from(t.order + form, raw, i * size)
        values.append(float(got[0]) if len(got) == 1 else got[0] / got[1] if got[1] else math.inf)
    whole = lambda v: math.isfinite(v) and v == int(v) and abs(v) < 1e15
    if len(values) == 1:
        return int(values[0]) if whole(values[0]) else values[0]
    return " ".join(str(int(v)) if whole(v) else "inf" if v == math.inf else repr(v) for v in values)


def user_comment(raw: bytes, order: str) -> str:
    """A comment with a code for its characters in front."""
    if len(raw) < 8:
        return clean(raw.decode("latin-1"))
    code, body = raw[:8], raw[8:]
    if code != b"UNICODE\0":
        return text_of(body).rstrip("\0 ")
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order, body = ("<" if body[:1] == b"\xff" else ">"), body[2:]
    return body[: len(body) // 2 * 2].decode("utf-16-le" if order == "<" else "utf-16-be", "replace").rstrip("\0 ")


def orientation(data: bytes) -> int | None:
    """Orientation of the first directory."""
    t = Tiff(data)
    at = t.one("I", 4) if t.order else None
    for entry in t.entries(at) if at else ():
        if entry is None:
            return None
        tag, kind, count, raw, _ = entry
        if tag == 0x0112 and count == 1 and raw is not None and kind in (1, 3, 4):
            return struct.unpack_from(t.order + TYPES[kind][1], raw)[0]
    return None


def picture_count(data: bytes) -> int | None:
    """Number of pictures that a multi-picture index names."""
    t = Tiff(data)
    at = t.one("I", 4) if t.order else None
    for entry in t.entries(at) if at else ():
        if entry is None:
            return None
        tag, kind, count, raw, _ = entry
        if tag == 0xB001 and count == 1 and raw is not None and kind in (3, 4):
            return struct.unpack_from(t.order + TYPES[kind][1], raw)[0]
    return None
