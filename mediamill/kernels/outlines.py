"""Glyph outlines of font programs: TrueType, compact (CFF) and Type 1.

A program gives paths in its own units: ``("m", x, y)``, ``("l", x, y)``, ``("c", x1, y1, x2,
y2, x3, y3)`` and ``("h",)``.  Damaged glyphs are empty; bounds hold for nesting, operators
and points.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from ..errors import Invalid
from ..functions.encodings import standard_strings, table

MOST_DEPTH, MOST_STEPS, MOST_PARTS = 10, 20_000, 64

Path = list[tuple]


# --- TrueType ---------------------------------------------------------------------------------------------------------


class TrueType:
    """A program of ``glyf`` outlines (or the ``CFF`` table of an OpenType file, as :attr:`compact`)."""

    def __init__(self, data: bytes):
        if len(data) < 12:
            raise Invalid("font program")
        self.tables: dict[bytes, bytes] = {}
        for i in range(struct.unpack_from(">H", data, 4)[0]):
            entry = data[12 + 16 * i : 28 + 16 * i]
            if len(entry) == 16:
                name, _, at, size = struct.unpack(">4sIII", entry)
                self.tables[name] = data[at : at + size]
        self.compact = Compact(self.tables[b"CFF "]) if b"CFF " in self.tables else None
        head = self.tables.get(b"head", b"")
        self.units = struct.unpack_from(">H", head, 18)[0] if len(head) >= 54 else 1000
        long = len(head) >= 54 and struct.unpack_from(">h", head, 50)[0]
        loca = self.tables.get(b"loca", b"")
        self.places = [x * (1 if long else 2) for x in struct.unpack(f">{len(loca) // (4 if long else 2)}{'I' if long else 'H'}", loca[: len(loca) // 4 * 4 if long else len(loca) // 2 * 2])]
        self.maps = self._maps()

    def _maps(self) -> dict[tuple[int, int], dict[int, int]]:
        """Glyphs by code, of each platform and encoding."""
        d, out = self.tables.get(b"cmap", b""), {}
        if len(d) < 4:
            return out
        for i in range(struct.unpack_from(">H", d, 2)[0]):
            if 12 + 8 * i > len(d):
                break
            platform, encoding, at = struct.unpack_from(">HHI", d, 4 + 8 * i)
            try:
                out[platform, encoding] = self._map(d[at:])
            except struct.error:
                continue
        return out

    @staticmethod
    def _map(d: bytes) -> dict[int, int]:
        form = struct.unpack_from(">H", d)[0]
        if form == 0:
            return {c: g for c, g in enumerate(d[6:262]) if g}
        if form == 6:
            first, n = struct.unpack_from(">HH", d, 6)
            return dict(enumerate(struct.unpack_from(f">{n}H", d, 10), first))
        if form == 12:
            out: dict[int, int] = {}
            for i in range(min(struct.unpack_from(">I", d, 12)[0], 100_000)):
                low, high, glyph = struct.unpack_from(">III", d, 16 + 12 * i)
                out.update(zip(range(low, min(high, low + 0xFFFF) + 1), range(glyph, glyph + 0x10000), strict=False))
            return out
        if form != 4:
            return {}
        n = struct.unpack_from(">H", d, 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", d, at) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
        out = {}
        for k in range(n):
            for code in range(starts[k], min(ends[k], 0xFFFE) + 1):
                if offsets[k] == 0:
                    glyph = code + deltas[k] & 0xFFFF
                else:
                    at = 16 + 6 * n + 2 * k + offsets[k] + 2 * (code - starts[k])
                    glyph = struct.unpack_from(">H", d, at)[0] if at + 2 <= len(d) else 0
                    glyph = glyph + deltas[k] & 0xFFFF if glyph else 0
                if glyph:
                    out[code] = glyph
        return out

    def glyph(self, number: int) -> Path:
        if self.compact:
            return self.compact.glyph(number)
        try:
            return [step for c in self._contours(number, 0) for step in _quadratic(c)]
        except (struct.error, IndexError):
            return []

    def _contours(self, number: int, depth: int) -> list[list[tuple[float, float, bool]]]:
        """Closed contours of points, with whether each lies on the outline."""
        if depth > MOST_DEPTH or not 0 <= number < len(self.places) - 1:
            return []
        d = self.tables.get(b"glyf", b"")[self.places[number] : self.places[number + 1]]
        if len(d) < 10:
            return []
        n = struct.unpack_from(">h", d)[0]
        return self._simple(d, n) if n >= 0 else self._composite(d, depth)

    @staticmethod
    def _simple(d: bytes, n: int) -> list[list[tuple[float, float, bool]]]:
        ends = struct.unpack_from(f">{n}H", d, 10)
        total = ends[-1] + 1 if n else 0
        at = 12 + 2 * n + struct.unpack_from(">H", d, 10 + 2 * n)[0]
        flags: list[int] = []
        while len(flags) < total:
            f = d[at]
            at += 1
            again = 1
            if f & 8:
                again += d[at]
                at += 1
            flags += [f] * again
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, values = 0, []
            for f in flags[:total]:
                if f & short:
                    value += d[at] if f & same else -d[at]
                    at += 1
                elif not f & same:
                    value += struct.unpack_from(">h", d, at)[0]
                    at += 2
                values.append(value)
            axes.append(values)
        points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags, strict=False)]
        return [points[a:b] for a, b in zip([0, *[e + 1 for e in ends]], [e + 1 for e in ends], strict=False)]

    def _composite(self, d: bytes, depth: int) -> list[list[tuple[float, float, bool]]]:
        out, at = [], 10
        for _ in range(MOST_PARTS):
            flags, number = struct.unpack_from(">HH", d, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", d, at)
            at += 4 if flags & 1 else 2
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack_from(f">{n}h", d, at)]
            at += 2 * n
            a, b, c, e = (v[0], 0, 0, v[0]) if n == 1 else (v[0], 0, 0, v[1]) if n == 2 else v if n == 4 else (1, 0, 0, 1)
            if not flags & 2:
                dx = dy = 0
            out += [[(a * x + c * y + dx, b * x + e * y + dy, on) for x, y, on in part] for part in self._contours(number, depth + 1)]
            if not flags & 32:
                break
        return out


def _quadratic(points: list[tuple[float, float, bool]]) -> Path:
    """A contour of on- and off-curve points as cubic curves; between two points off the curve lies one on it."""
    if len(points) < 2:
        return []
    full: list[tuple[float, float, bool]] = []
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        full.append(p)
        if not p[2] and not q[2]:
            full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
    start = next((i for i, p in enumerate(full) if p[2]), None)
    if start is None:
        return []
    full = full[start:] + full[: start + 1]
    out: Path = [("m", *full[0][:2])]
    here, control = full[0], None
    for p in full[1:]:
        if not p[2]:
            control = p
            continue
        if control is None:
            out.append(("l", *p[:2]))
        else:
            (x0, y0), (x1, y1), (x2, y2) = here[:2], control[:2], p[:2]
            out.append(("c", x0 + (x1 - x0) * 2 / 3, y0 + (y1 - y0) * 2 / 3, x2 + (x1 - x2) * 2 / 3, y2 + (y1 - y2) * 2 / 3, x2, y2))
        here, control = p, None
    return [*out, ("h",)]


# --- charstrings ------------------------------------------------------------------------------------------------------


class _Pen:
    """A path drawn by steps from where the last one ended."""

    def __init__(self) -> None:
        self.path: Path = []
        self.x = self.y = 0.0
        self.open = False

    def move(self, dx: float, dy: float) -> None:
        self.close()
        self.x, self.y = self.x + dx, self.y + dy
        self.path.append(("m", self.x, self.y))
        self.open = True

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.path.append(("l", self.x, self.y))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        x1, y1 = self.x + a, self.y + b
        x2, y2 = x1 + c, y1 + d
        self.x, self.y = x2 + e, y2 + f
        self.path.append(("c", x1, y1, x2, y2, self.x, self.y))

    def close(self) -> None:
        if self.open:
            self.path.append(("h",))
        self.open = False


def _bias(subrs: list[bytes]) -> int:
    return 107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768


class _Type2:
    """The operators of a compact font's glyph."""

    def __init__(self, subrs: list[bytes], shared: list[bytes]):
        self.subrs, self.shared = subrs, shared
        self.pen, self.stack, self.hints, self.steps = _Pen(), [], 0, 0

    def run(self, code: bytes, depth: int = 0) -> bool:
        """Whether the glyph has ended."""
        at, stack, pen = 0, self.stack, self.pen
        while at < len(code):
            self.steps += 1
            if self.steps > MOST_STEPS or depth > MOST_DEPTH or len(stack) > 513:
                raise Invalid("glyph")
            b = code[at]
            at += 1
            if b >= 32 or b == 28:
                size = 1 if 32 <= b < 247 else 2 if b < 255 and b != 28 else 3 if b == 28 else 5
                raw = code[at - 1 : at - 1 + size]
                stack.append(_number(raw))
                at += size - 1
                continue
            if b in (1, 3, 18, 23):
                self.hints += len(stack) // 2
                stack.clear()
            elif b in (19, 20):
                self.hints += len(stack) // 2
                stack.clear()
                at += (self.hints + 7) // 8
            elif b in (10, 29):
                subrs = self.subrs if b == 10 else self.shared
                if self.run(subrs[int(stack.pop()) + _bias(subrs)], depth + 1):
                    return True
            elif b == 11:
                return False
            elif b == 14:
                pen.close()
                return True
            elif b == 12:
                self._flex(code[at])
                at += 1
            else:
                self._draw(b)
        return False

    def _draw(self, b: int) -> None:
        s, pen = self.stack, self.pen
        if b == 21:
            pen.move(*s[-2:])
        elif b == 22:
            pen.move(s[-1], 0)
        elif b == 4:
            pen.move(0, s[-1])
        elif b == 5:
            for i in range(0, len(s) - 1, 2):
                pen.line(s[i], s[i + 1])
        elif b in (6, 7):
            for i, v in enumerate(s):
                pen.line(*((v, 0) if (i % 2 == 0) == (b == 6) else (0, v)))
        elif b == 8:
            for i in range(0, len(s) - 5, 6):
                pen.curve(*s[i : i + 6])
        elif b == 24:
            for i in range(0, len(s) - 7, 6):
                pen.curve(*s[i : i + 6])
            pen.line(*s[-2:])
        elif b == 25:
            for i in range(0, len(s) - 7, 2):
                pen.line(s[i], s[i + 1])
            pen.curve(*s[-6:])
        elif b in (26, 27):
            lead = s.pop(0) if len(s) % 4 else 0.0
            for i in range(0, len(s) - 3, 4):
                a, c, d, e = s[i : i + 4]
                pen.curve(*((lead, a, c, d, 0, e) if b == 26 else (a, lead, c, d, e, 0)))
                lead = 0.0
        elif b in (30, 31):
            across = b == 31
            for i in range(0, len(s) - 3, 4):
                a, c, d, e = s[i : i + 4]
                last = s[i + 4] if len(s) - i == 5 else 0.0
                pen.curve(*((a, 0, c, d, last, e) if across else (0, a, c, d, e, last)))
                across = not across
        s.clear()

    def _flex(self, b: int) -> None:
        """The four forms of two curves that are nearly a line; other two-byte operators only empty the stack."""
        s, pen = self.stack, self.pen
        if b == 35:
            pen.curve(*s[:6])
            pen.curve(*s[6:12])
        elif b == 34:
            a, c, d, e, f, g, h = s[:7]
            pen.curve(a, 0, c, d, e, 0)
            pen.curve(f, 0, g, -d, h, 0)
        elif b == 36:
            a, c, d, e, f, g, h, i, j = s[:9]
            pen.curve(a, c, d, e, f, 0)
            pen.curve(g, 0, h, i, j, -(c + e + i))
        elif b == 37:
            x, y = sum(s[0:10:2]), sum(s[1:10:2])
            pen.curve(*s[:6])
            pen.curve(*s[6:10], *((s[10], -y) if abs(x) > abs(y) else (-x, s[10])))
        s.clear()


def _number(raw: bytes) -> float:
    b = raw[0]
    if b == 28:
        return float(struct.unpack(">h", raw[1:])[0])
    if b == 255:
        return struct.unpack(">i", raw[1:])[0] / 65536
    if b < 247:
        return b - 139.0
    return (b - 247) * 256.0 + raw[1] + 108 if b < 251 else -(b - 251) * 256.0 - raw[1] - 108


class Compact:
    """A CFF program: glyphs by number, names or character identifiers of glyphs."""

    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (struct.error, IndexError, KeyError) as e:
            raise Invalid("font program") from e

    def _read(self, data: bytes) -> None:
        self.data = data
        _, at = self._index(data[2])
        tops, at = self._index(at)
        strings, at = self._index(at)
        self.shared, _ = self._index(at)
        top = self._dict(tops[0])
        self.matrix = top.get(1207, [0.001, 0, 0, 0.001, 0, 0])
        self.glyphs, _ = self._index(int(top[17][0]))
        self.is_cid = 1230 in top
        numbers = self._charset(int(top.get(15, [0])[0]))
        known = standard_strings()
        self.cids = {c: g for g, c in enumerate(numbers)} if self.is_cid else {}
        name = lambda n: strings[n - 391].decode("latin-1") if 391 <= n < 391 + len(strings) else known.get(n, "")
        self.names = {} if self.is_cid else {name(n): g for g, n in reversed(list(enumerate(numbers)))}
        self.codes = {} if self.is_cid else self._encoding(int(top.get(16, [0])[0]))
        if self.is_cid:
            fonts = [self._dict(d) for d in self._index(int(top[1236][0]))[0]]
            self.subrs = [self._subrs(f) for f in fonts]
            self.select = self._select(int(top[1237][0]))
            if 1207 not in top and fonts and 1207 in fonts[0]:
                self.matrix = fonts[0][1207]
        else:
            self.subrs, self.select = [self._subrs(top)], None

    def _index(self, at: int) -> tuple[list[bytes], int]:
        n = struct.unpack_from(">H", self.data, at)[0]
        if not n:
            return [], at + 2
        size = self.data[at + 2]
        raw = self.data[at + 3 : at + 3 + (n + 1) * size]
        places = [int.from_bytes(raw[i : i + size], "big") for i in range(0, (n + 1) * size, size)]
        base = at + 2 + (n + 1) * size
        return [self.data[base + a : base + b] for a, b in zip(places, places[1:], strict=False)], base + places[-1]

    @staticmethod
    def _dict(d: bytes) -> dict[int, list[float]]:
        """Operands by operator; operators of two bytes count from 1200."""
        out, held, at = {}, [], 0
        while at < len(d):
            b = d[at]
            if b <= 21:
                key = 1200 + d[at + 1] if b == 12 else b
                at += 2 if b == 12 else 1
                out[key], held = held, []
            elif b == 30:
                digits = ""
                while "f" not in digits:
                    at += 1
                    digits += f"{d[at]:02x}"
                digits = digits[: digits.index("f")]
                held.append(float(digits.replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-")))
                at += 1
            elif b == 29:
                held.append(float(struct.unpack_from(">i", d, at + 1)[0]))
                at += 5
            else:
                size = 3 if b == 28 else 1 if b < 247 else 2
                held.append(_number(d[at : at + size]))
                at += size
        return out

    def _subrs(self, top: dict[int, list[float]]) -> list[bytes]:
        if 18 not in top:
            return []
        size, at = (int(x) for x in top[18])
        private = self._dict(self.data[at : at + size])
        return self._index(at + int(private[19][0]))[0] if 19 in private else []

    def _charset(self, at: int) -> list[int]:
        n = len(self.glyphs)
        if at <= 2:
            return list(range(n))
        out, form = [0], self.data[at]
        at += 1
        while len(out) < n:
            first = struct.unpack_from(">H", self.data, at)[0]
            more = 0 if form == 0 else self.data[at + 2] if form == 1 else struct.unpack_from(">H", self.data, at + 2)[0]
            at += 2 + form
            out += range(first, first + more + 1)
        return out[:n]

    def _encoding(self, at: int) -> dict[int, int]:
        if at <= 1:
            return {c: self.names[g] for c, g in table("Standard").items() if g in self.names}
        form, n = self.data[at] & 127, self.data[at + 1]
        if form == 0:
            return {c: g for g, c in enumerate(self.data[at + 2 : at + 2 + n], 1)}
        out: dict[int, int] = {}
        for i in range(n):
            first, more = self.data[at + 2 + 2 * i : at + 4 + 2 * i]
            out.update({first + k: len(out) + k + 1 for k in range(more + 1)})
        return out

    def _select(self, at: int) -> list[int]:
        n = len(self.glyphs)
        if self.data[at] == 0:
            return list(self.data[at + 1 : at + 1 + n])
        out: list[int] = []
        for i in range(struct.unpack_from(">H", self.data, at + 1)[0]):
            first, font, after = struct.unpack_from(">HBH", self.data, at + 3 + 3 * i)
            out += [font] * (min(after, n) - first)
        return out

    def glyph(self, number: int) -> Path:
        if not 0 <= number < len(self.glyphs):
            return []
        run = _Type2(self.subrs[self.select[number] if self.select else 0], self.shared)
        try:
            run.run(self.glyphs[number])
        except (Invalid, IndexError, TypeError, ValueError):
            return []
        run.pen.close()
        return run.pen.path


# --- Type 1 -----------------------------------------------------------------------------------------------------------


def decrypted(data: bytes, key: int, skip: int) -> bytes:
    """The running-key cipher of Type 1 programs, without the bytes in front."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


def encrypted(data: bytes, key: int) -> bytes:
    out = bytearray()
    for p in data:
        c = p ^ key >> 8
        out.append(c)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


class Type1:
    """A Type 1 program: glyphs by name, its own encoding."""

    def __init__(self, data: bytes):
        if data[:1] == b"\x80":  # segments with a length each
            parts, at = [], 0
            while data[at : at + 1] == b"\x80" and data[at + 1 : at + 2] in (b"\1", b"\2"):
                size = struct.unpack_from("<I", data, at + 2)[0]
                parts.append(data[at + 6 : at + 6 + size])
                at += 6 + size
            data = b"".join(parts)
        clear, mark, sealed = data.partition(b"eexec")
        if not mark:
            raise Invalid("font program")
        sealed = sealed.lstrip(b" \t\r\n")
        if re.match(rb"[0-9A-Fa-f\s]{8}", sealed[:8]):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", sealed)
            sealed = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = decrypted(sealed, 55665, 4)
        found = re.search(rb"/lenIV\s+(-?\d+)", private)
        skip = int(found[1]) if found else 4
        plain = (lambda d: decrypted(d, 4330, skip)) if skip >= 0 else (lambda d: d)
        self.subrs = {int(n): plain(body) for n, body in _binary(private, rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\|)\s")}
        self.glyphs = {n.decode("latin-1"): plain(body) for n, body in _binary(private, rb"/([^\s/{}\[\]()<>%]+)\s+(\d+)\s+(?:RD|-\|)\s")}
        m = re.search(rb"/FontMatrix\s*\[([^\]]*)\]", clear)
        self.matrix = [float(x) for x in m[1].split()] if m else [0.001, 0, 0, 0.001, 0, 0]
        own = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put", clear)}
        self.encoding = own or table("Standard")

    def glyph(self, name: str) -> Path:
        if name not in self.glyphs:
            return []
        run = _Type1Run(self)
        try:
            run.run(self.glyphs[name])
        except (Invalid, IndexError, KeyError, TypeError, ValueError, ZeroDivisionError):
            return []
        run.pen.close()
        return run.pen.path


def _binary(data: bytes, head: bytes):
    """Names and bodies of entries whose head tells their length."""
    at = 0
    while m := re.compile(head).search(data, at):
        size = int(m[2])
        yield m[1], data[m.end() : m.end() + size]
        at = m.end() + size


class _Type1Run:
    def __init__(self, font: Type1):
        self.font, self.pen, self.stack, self.given = font, _Pen(), [], []
        self.flex: list[tuple[float, float]] | None = None
        self.steps, self.side = 0, 0.0

    def run(self, code: bytes, depth: int = 0) -> bool:
        at, s, pen = 0, self.stack, self.pen
        while at < len(code):
            self.steps += 1
            if self.steps > MOST_STEPS or depth > MOST_DEPTH:
                raise Invalid("glyph")
            b = code[at]
            at += 1
            if b >= 32:
                size = 1 if b < 247 else 2 if b < 255 else 5
                raw = code[at - 1 : at - 1 + size]
                s.append(float(struct.unpack(">i", raw[1:])[0]) if b == 255 else _number(raw))
                at += size - 1
                continue
            if b == 12:
                b = 1200 + code[at]
                at += 1
            if b == 10:
                if self.run(self.font.subrs[int(s.pop())], depth + 1):
                    return True
                continue
            if b == 11:
                return False
            if b == 14:
                pen.close()
                return True
            if b == 1212:
                y, x = s.pop(), s.pop()
                s.append(x / y)
                continue
            if b == 1216:
                self._other()
                continue
            if b == 1217:
                s.append(self.given.pop() if self.given else 0.0)
                continue
            if b == 1206:
                self._accented(*s[:5], depth)
                return True
            self._draw(b)
            s.clear()
        return False

    def _draw(self, b: int) -> None:
        s, pen = self.stack, self.pen
        if b == 13:
            pen.x = self.side = s[0]
        elif b == 1207:
            pen.x, pen.y = self.side, _ = s[0], s[1]
        elif b in (21, 22, 4):
            dx, dy = (s[-2], s[-1]) if b == 21 else (s[-1], 0.0) if b == 22 else (0.0, s[-1])
            if self.flex is None:
                pen.move(dx, dy)
            else:
                pen.x, pen.y = pen.x + dx, pen.y + dy
        elif b == 5:
            pen.line(s[0], s[1])
        elif b == 6:
            pen.line(s[0], 0)
        elif b == 7:
            pen.line(0, s[0])
        elif b == 8:
            pen.curve(*s[:6])
        elif b == 30:
            pen.curve(0, s[0], s[1], s[2], s[3], 0)
        elif b == 31:
            pen.curve(s[0], 0, s[1], s[2], 0, s[3])
        elif b == 9:
            pen.close()
        elif b == 1233:
            pen.x, pen.y = s[0], s[1]

    def _other(self) -> None:
        """The shared procedures: 1, 2 and 0 gather the points of a flex, 3 asks for hints; others hand their operands back."""
        s, pen = self.stack, self.pen
        number, n = int(s.pop()), int(s.pop())
        operands = [s.pop() for _ in range(n)]
        if number == 1:
            self.flex = []
        elif number == 2 and self.flex is not None:
            self.flex.append((pen.x, pen.y))
        elif number == 0 and self.flex is not None:
            points, self.flex = self.flex, None
            if len(points) >= 7:
                for k in (1, 4):
                    pen.path.append(("c", *points[k], *points[k + 1], *points[k + 2]))
                pen.x, pen.y = points[6]
            self.given = [pen.y, pen.x]
        elif number == 3:
            self.given = [3.0]
        else:
            self.given = operands

    def _accented(self, asb: float, adx: float, ady: float, base: float, accent: float, depth: int) -> None:
        """Two glyphs of the standard encoding over one another."""
        names, side = table("Standard"), self.side
        parts = []
        for code in (base, accent):
            other = _Type1Run(self.font)
            other.run(self.font.glyphs[names[int(code)]], depth + 1)
            other.pen.close()
            parts.append(other.pen.path)
        dx = side + adx - asb
        self.pen.path = parts[0] + [(op, *(v + (dx, ady)[i % 2] for i, v in enumerate(p))) for op, *p in parts[1]]


def bounds(path: Path) -> tuple[float, float, float, float] | None:
    """The box of all points of a path."""
    points = np.array([p for _, *v in path for p in zip(v[::2], v[1::2], strict=True)])
    return None if not len(points) else (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())
