"""Character maps of composite fonts: code spaces, codes to character identifiers and to text."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from ..errors import Invalid, Limit
from .pdf import Name, Op, Reader

MOST_ENTRIES, MOST_DEPTH = 200_000, 8


@dataclass
class CMap:
    """``spaces`` has, by number of bytes, the ranges of codes; ``ranges`` are (bytes, low, high, first identifier)."""

    name: str | None = None
    vertical: bool = False
    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)
    texts: dict[tuple[int, int], str] = field(default_factory=dict)
    parent: "CMap | None" = None

    def close(self) -> "CMap":
        self.ranges.sort()
        return self

    def cid(self, code: int, n_bytes: int) -> int | None:
        """The identifier of a code of so many bytes; later maps win over the one they build on."""
        at = bisect.bisect_right(self.ranges, (n_bytes, code, 1 << 40, 0)) - 1
        if at >= 0:
            n, low, high, first = self.ranges[at]
            if n == n_bytes and low <= code <= high:
                return first + code - low
        return self.parent.cid(code, n_bytes) if self.parent else None

    def text(self, code: int, n_bytes: int) -> str | None:
        found = self.texts.get((n_bytes, code))
        return found if found is not None or not self.parent else self.parent.text(code, n_bytes)

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """Codes of a string with their lengths: the shortest code space that holds the next bytes byte for byte, one byte where none does."""
        spaces = sorted(self.all_spaces(), key=lambda s: len(s[0]))
        out, at = [], 0
        while at < len(data):
            n = next((len(lo) for lo, hi in spaces if len(part := data[at : at + len(lo)]) == len(lo) and all(a <= x <= b for a, x, b in zip(lo, part, hi, strict=True))), 1)
            out.append((int.from_bytes(data[at : at + n], "big"), n))
            at += n
        return out

    def all_spaces(self) -> list[tuple[bytes, bytes]]:
        return self.spaces + (self.parent.all_spaces() if self.parent else [])


def identity(vertical: bool = False) -> CMap:
    """Two-byte codes that are their own identifiers."""
    return CMap("Identity-V" if vertical else "Identity-H", vertical, [(b"\0\0", b"\xff\xff")], [(2, 0, 0xFFFF, 0)])


def parse(data: bytes, known: dict[str, CMap] | None = None) -> CMap:
    """A map from its program; ``known`` has the maps that it may build on."""
    known = {"Identity-H": identity(), "Identity-V": identity(True)} | (known or {})
    out, held, count = CMap(), [], 0
    r = Reader(data, refs=False)
    while True:
        try:
            t = r.read()
        except Invalid:
            break
        if not isinstance(t, Op):
            held.append(t)
            continue
        if t == "usecmap" and held:
            out.parent = known.get(str(held[-1]))
            if out.parent is None:
                raise Invalid("unknown character map")
        elif t == "def" and len(held) >= 2:
            if held[-2] == "WMode":
                out.vertical = held[-1] == 1
            elif held[-2] == "CMapName" and isinstance(held[-1], Name):
                out.name = str(held[-1])
        elif t == "endcodespacerange":
            out.spaces += [(lo, hi) for lo, hi in zip(held[::2], held[1::2], strict=False) if isinstance(lo, bytes) and isinstance(hi, bytes) and len(lo) == len(hi) <= 4]
        elif t in ("endcidchar", "endcidrange", "endnotdefchar", "endnotdefrange"):
            if not t.startswith("endnotdef"):
                step = 3 if t == "endcidrange" else 2
                for k in range(0, len(held) - step + 1, step):
                    low, cid = held[k], held[k + step - 1]
                    high = held[k + 1] if step == 3 else low
                    if isinstance(low, bytes) and isinstance(high, bytes) and isinstance(cid, int):
                        out.ranges.append((len(low), int.from_bytes(low, "big"), int.from_bytes(high, "big"), cid))
                        count += 1
        elif t == "endbfchar":
            for code, text in zip(held[::2], held[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(text, bytes):
                    out.texts[len(code), int.from_bytes(code, "big")] = text.decode("utf-16-be", "replace")
                    count += 1
        elif t == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                if b - a > 0xFFFF:
                    raise Limit("character map size")
                for i in range(b - a + 1):
                    target = to[i] if isinstance(to, list) and i < len(to) else to[:-2] + (int.from_bytes(to[-2:], "big") + i & 0xFFFF).to_bytes(2, "big") if isinstance(to, bytes) and len(to) >= 2 else None
                    if isinstance(target, bytes):
                        out.texts[len(low), a + i] = target.decode("utf-16-be", "replace")
                        count += 1
        if t.startswith("begin") or t.startswith("end") or t in ("def", "usecmap"):
            held = []
        if count > MOST_ENTRIES:
            raise Limit("character map size")
    return out.close()
