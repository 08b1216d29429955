"""Fonts of documents: from a string's codes to glyphs, their outlines and how far they advance.

Outlines come from embedded programs.  A font without one (the fourteen standard fonts
among them) advances by its widths and draws nothing; its program isn't at hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import numpy as np

from ..errors import MediaError
from ..functions.encodings import characters, table
from . import cmap, outlines, pdf


@dataclass
class Glyph:
    """A code's place in a string: advance in thousandths, outline in text space of size one, or a Type 3 procedure."""

    code: int
    n_bytes: int
    advance: float
    path: outlines.Path
    procedure: pdf.Stream | None = None


class Font:
    def __init__(self, doc: pdf.Document, d: dict[str, Any]):
        self.doc, self.dict = doc, d
        self.kind = str(self.get("Subtype"))
        self.vertical = False
        self.glyphs: dict[tuple[int, int], Glyph] = {}
        self.program: Any = None
        self.names: dict[int, str] = {}
        self.matrix = np.array([0.001, 0, 0, 0.001, 0, 0])
        if self.kind == "Type0":
            self._composite()
        elif self.kind == "Type3":
            self.matrix = self._numbers(self.get("FontMatrix")) or self.matrix
            self.names = self._encoding({})
            self.procedures = self.get("CharProcs") or {}
        else:
            self.program = self._program(self.get("FontDescriptor"))
            own = self.program.encoding if isinstance(self.program, outlines.Type1) else {}
            self.names = self._encoding(own)

    def get(self, key: str, d: dict[str, Any] | None = None) -> Any:
        return self.doc.get((self.dict if d is None else d).get(key))

    def _numbers(self, v: Any) -> list[float] | None:
        return [float(self.doc.get(x)) for x in v] if isinstance(v, list) else None

    # -- programs ------------------------------------------------------------------------------------------------------

    def _program(self, descriptor: Any) -> Any:
        if not isinstance(descriptor, dict):
            return None
        self.symbolic = bool(int(self.get("Flags", descriptor) or 0) & 4)
        for key in ("FontFile", "FontFile2", "FontFile3"):
            held = self.get(key, descriptor)
            if not isinstance(held, pdf.Stream):
                continue
            try:
                data = self.doc.decode(held)
                if data[:4] in (b"\0\1\0\0", b"true", b"OTTO", b"ttcf"):
                    return outlines.TrueType(data)
                return outlines.Compact(data) if key == "FontFile3" else outlines.Type1(data) if key == "FontFile" else outlines.TrueType(data)
            except (MediaError, ValueError, IndexError, KeyError):
                return None
        return None

    def _encoding(self, own: dict[int, str]) -> dict[int, str]:
        """Glyph names by code: the base encoding with the font's differences."""
        e = self.get("Encoding")
        known = {"WinAnsiEncoding": "WinAnsi", "MacRomanEncoding": "MacRoman", "StandardEncoding": "Standard"}
        base = self.get("BaseEncoding", e) if isinstance(e, dict) else e
        out = dict(table(known[str(base)])) if str(base) in known else dict(own or table("Standard")) if not getattr(self, "symbolic", False) or own else {}
        if isinstance(e, dict):
            code = 0
            for x in self.get("Differences", e) or []:
                x = self.doc.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, str):
                    out[code] = str(x)
                    code += 1
        return out

    # -- composite fonts -----------------------------------------------------------------------------------------------

    def _composite(self) -> None:
        e = self.get("Encoding")
        if isinstance(e, pdf.Stream):
            self.map = cmap.parse(self.doc.decode(e))
        else:
            self.map = cmap.identity(str(e).endswith("V"))
        self.vertical = self.map.vertical
        below = self.doc.get((self.get("DescendantFonts") or [{}])[0])
        self.below = below if isinstance(below, dict) else {}
        self.program = self._program(self.get("FontDescriptor", self.below))
        to_glyph = self.get("CIDToGIDMap", self.below)
        self.to_glyph = np.frombuffer((lambda d: d[: len(d) // 2 * 2])(self.doc.decode(to_glyph)), dtype=">u2") if isinstance(to_glyph, pdf.Stream) else None
        self.default = float(self.get("DW", self.below) or 1000)
        self.widths: dict[int, float] = {}
        held = [self.doc.get(x) for x in self.get("W", self.below) or []]
        at = 0
        while at + 1 < len(held):
            if isinstance(held[at + 1], list):
                self.widths.update(enumerate((float(self.doc.get(x)) for x in held[at + 1]), int(held[at])))
                at += 2
            else:
                first, last = int(held[at]), min(int(held[at + 1]), int(held[at]) + 0xFFFF)
                self.widths.update(dict.fromkeys(range(first, last + 1), float(held[at + 2]) if at + 2 < len(held) else self.default))
                at += 3

    # -- codes ---------------------------------------------------------------------------------------------------------

    def split(self, text: bytes) -> list[Glyph]:
        codes = self.map.split(text) if self.kind == "Type0" else [(c, 1) for c in text]
        return [self.glyphs.get(c) or self.glyphs.setdefault(c, self._glyph(*c)) for c in codes]

    def _glyph(self, code: int, n_bytes: int) -> Glyph:
        if self.kind == "Type0":
            cid = self.map.cid(code, n_bytes) or 0
            return Glyph(code, n_bytes, self.widths.get(cid, self.default), self._scaled(self._by_cid(cid)))
        widths, first = self.get("Widths") or [], int(self.get("FirstChar") or 0)
        width = self.doc.get(widths[code - first]) if 0 <= code - first < len(widths) else None
        if width is None:
            descriptor = self.get("FontDescriptor")
            width = self.get("MissingWidth", descriptor) if isinstance(descriptor, dict) else 0
        if self.kind == "Type3":
            body = self.doc.get(self.procedures.get(self.names.get(code, "")))
            return Glyph(code, n_bytes, float(width or 0) * float(self.matrix[0]) * 1000, [], body if isinstance(body, pdf.Stream) else None)
        return Glyph(code, n_bytes, float(width or 0), self._scaled(self._by_code(code)))

    def _by_cid(self, cid: int) -> outlines.Path:
        p = self.program
        if isinstance(p, outlines.Compact) or (isinstance(p, outlines.TrueType) and p.compact):
            inner = p if isinstance(p, outlines.Compact) else p.compact
            return inner.glyph(inner.cids.get(cid, 0) if inner.is_cid else cid)
        if p is None:
            return []
        if self.to_glyph is not None:
            cid = int(self.to_glyph[cid]) if cid < len(self.to_glyph) else 0
        return p.glyph(cid)

    def _by_code(self, code: int) -> outlines.Path:
        p, name = self.program, self.names.get(code)
        if isinstance(p, outlines.Type1):
            return p.glyph(name or ".notdef")
        if isinstance(p, outlines.Compact):
            number = p.names.get(name) if name else None
            return p.glyph(number if number is not None else p.codes.get(code, 0))
        return self._in_truetype(p, code, name) if p is not None else []

    @staticmethod
    def _in_truetype(p: outlines.TrueType, code: int, name: str | None) -> outlines.Path:
        """By the name's character where there is one, then as a symbol, then by the code alone."""
        if name:
            char = characters().get(name) or (chr(int(name[3:7], 16)) if re.fullmatch(r"uni[0-9A-Fa-f]{4}", name) else None)
            for key in ((3, 1), (0, 3), (0, 4), (3, 10), (0, 0), (0, 1)):
                if char and (number := p.maps.get(key, {}).get(ord(char))):
                    return p.glyph(number)
            mac = next((c for c, n in table("MacRoman").items() if n == name), None)
            if mac is not None and (number := p.maps.get((1, 0), {}).get(mac)):
                return p.glyph(number)
        symbols = p.maps.get((3, 0), {})
        for at in (code, 0xF000 + code, 0xF100 + code):
            if at in symbols:
                return p.glyph(symbols[at])
        for held in p.maps.values():
            if code in held:
                return p.glyph(held[code])
        return []

    def _scaled(self, path: outlines.Path) -> outlines.Path:
        """An outline in units of the text's size."""
        p = self.program
        a, b, c, d, e, f = (1 / p.units, 0, 0, 1 / p.units, 0, 0) if isinstance(p, outlines.TrueType) and not p.compact else p.compact.matrix if isinstance(p, outlines.TrueType) else p.matrix if p is not None else self.matrix
        return [(op, *(w for x, y in zip(v[::2], v[1::2], strict=True) for w in (a * x + c * y + e, b * x + d * y + f))) for op, *v in path]
