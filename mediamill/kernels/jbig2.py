"""JBIG2 (ITU-T T.88) in its embedded form: arithmetic-coded generic, symbol and text regions, and fax-coded generic ones.

Huffman-coded segments, refinement, halftones and patterns are refused.
"""

from __future__ import annotations

import struct

import numpy as np

from ..errors import Invalid, Limit
from . import ccitt

MOST_PIXELS, MOST_SYMBOLS = 64_000_000, 65_536

# The coder's states: probability, next state after the likelier and the less likely symbol, and whether their roles change.
_STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
# Each template's neighbours (column, row) as bits from the lowest; the adaptive ones by their usual places.
_TEMPLATES = [
    [(-1, 0), (-2, 0), (-3, 0), (-4, 0), "A0", (2, -1), (1, -1), (0, -1), (-1, -1), (-2, -1), "A1", "A2", (1, -2), (0, -2), (-1, -2), "A3"],
    [(-1, 0), (-2, 0), (-3, 0), "A0", (2, -1), (1, -1), (0, -1), (-1, -1), (-2, -1), (2, -2), (1, -2), (0, -2), (-1, -2)],
    [(-1, 0), (-2, 0), "A0", (1, -1), (0, -1), (-1, -1), (-2, -1), (1, -2), (0, -2), (-1, -2)],
    [(-1, 0), (-2, 0), (-3, 0), (-4, 0), "A0", (1, -1), (0, -1), (-1, -1), (-2, -1), (-3, -1)],
]
# The contexts that tell whether a row repeats the one above.
_REPEATS = (0x9B25, 0x0795, 0x00E5, 0x0195)
# Prefix lengths' value bits and offsets of coded integers.
_INTEGERS = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))


class Decoder:
    """The adaptive binary arithmetic decoder."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.c = (data[0] if data else 0xFF) << 16
        self.ct = 0
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        d, at = self.data, self.at
        here = d[at] if at < len(d) else 0xFF
        after = d[at + 1] if at + 1 < len(d) else 0xFF
        if here == 0xFF:
            if after > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += after << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += after << 8
            self.ct = 8

    def bit(self, contexts: bytearray, cx: int) -> int:
        """The next bit under a context; a context's byte holds its state and its likelier symbol."""
        v = contexts[cx]
        state, mps = v >> 1, v & 1
        q, after, less, change = _STATES[state]
        self.a -= q
        if (self.c >> 16) < q:
            if self.a < q:
                out, state = mps, after
            else:
                out, state, mps = 1 - mps, less, mps ^ change
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return mps
            if self.a < q:
                out, state, mps = 1 - mps, less, mps ^ change
            else:
                out, state = mps, after
        contexts[cx] = state << 1 | mps
        while True:
            if self.ct == 0:
                self._byte()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return out

    def integer(self, contexts: bytearray) -> int | None:
        """A coded integer; None is the out-of-band value."""
        prev = 1

        def take() -> int:
            nonlocal prev
            b = self.bit(contexts, prev)
            prev = prev << 1 | b if prev < 256 else ((prev << 1 | b) & 511) | 256
            return b

        sign = take()
        k = 0
        while k < 5 and take():
            k += 1
        n, offset = _INTEGERS[k]
        v = 0
        for _ in range(n):
            v = v << 1 | take()
        v += offset
        return v if not sign else -v if v else None

    def ident(self, contexts: bytearray, length: int) -> int:
        prev = 1
        for _ in range(length):
            prev = prev << 1 | self.bit(contexts, prev)
        return prev - (1 << length)


def generic(d: Decoder, contexts: bytearray, w: int, h: int, template: int, adaptive: list[tuple[int, int]], repeats: bool) -> np.ndarray:
    """A bitmap, pixel by pixel under the pixels before it."""
    if w * h > MOST_PIXELS:
        raise Limit("image size")
    pad = 128
    places = [adaptive[int(p[1])] if isinstance(p, str) else p for p in _TEMPLATES[template]]
    if any(y > 0 or (y == 0 and x >= 0) or not -pad <= x < pad or y < -pad for x, y in places):
        raise Invalid("adaptive pixel")
    empty = bytes(w + 2 * pad)
    rows: list[bytearray] = []
    same = 0
    for y in range(h):
        if repeats:
            same ^= d.bit(contexts, _REPEATS[template])
            if same:
                rows.append(bytearray(rows[-1]) if rows else bytearray(empty))
                continue
        row = bytearray(empty)
        rows.append(row)
        near = [(rows[y + dy] if y + dy >= 0 else empty, dx + pad, k) for k, (dx, dy) in enumerate(places)]
        bit = d.bit
        for x in range(w):
            cx = 0
            for line, dx, k in near:
                if line[x + dx]:
                    cx |= 1 << k
            if bit(contexts, cx):
                row[x + pad] = 1
    return np.array([np.frombuffer(bytes(r), np.uint8)[pad : pad + w] for r in rows], dtype=bool).reshape(h, w)


def _adaptive(data: bytes, at: int, template: int) -> tuple[list[tuple[int, int]], int]:
    n = 4 if template == 0 else 1
    return [struct.unpack_from(">bb", data, at + 2 * k) for k in range(n)], at + 2 * n


class Image:
    """A page put together from the segments of a stream and of its shared part."""

    def __init__(self) -> None:
        self.page: np.ndarray | None = None
        self.symbols: dict[int, list[np.ndarray]] = {}

    def read(self, data: bytes) -> None:
        at = 0
        while at + 11 <= len(data):
            number, flags, count = struct.unpack_from(">IBB", data, at)
            at += 5
            refs = count >> 5
            if refs == 7:
                refs = struct.unpack_from(">I", data, at)[0] & 0x1FFFFFFF
                at += 4 + (refs + 8) // 8
            else:
                at += 1
            size = 1 if number <= 256 else 2 if number <= 65536 else 4
            named = [int.from_bytes(data[at + size * k : at + size * (k + 1)], "big") for k in range(refs)]
            at += size * refs + (4 if flags & 0x40 else 1)
            length = struct.unpack_from(">I", data, at)[0]
            at += 4
            if length == 0xFFFFFFFF:
                length = len(data) - at
            self._segment(number, flags & 63, named, data[at : at + length])
            at += length

    def _segment(self, number: int, kind: int, refs: list[int], d: bytes) -> None:
        if kind == 48:
            w, h, _, _, flags = struct.unpack_from(">IIIIB", d)
            if h == 0xFFFFFFFF or not 0 < w * h <= MOST_PIXELS:
                raise Limit("image size")
            self.page = np.full((h, w), bool(flags & 4))
        elif kind in (36, 38, 39):
            self._place(d, self._generic(d))
        elif kind == 0:
            self.symbols[number] = self._dictionary(d, refs)
        elif kind in (4, 6, 7):
            self._place(d, self._text(d, refs))
        elif kind in (49, 50, 51, 52, 62):
            return
        else:
            raise Invalid("unsupported segment")

    def _place(self, d: bytes, bitmap: np.ndarray) -> None:
        w, h, x, y, flags = struct.unpack_from(">IIIIB", d)
        if self.page is None:
            raise Invalid("no page")
        _combine(self.page, bitmap, x, y, flags & 7)

    def _generic(self, d: bytes) -> np.ndarray:
        w, h = struct.unpack_from(">II", d)
        flags, at = d[17], 18
        if flags & 1:
            raw = ccitt.decode(d[at:], -1, w, h, black_is_1=True)
            return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, :w].astype(bool)
        template = flags >> 1 & 3
        adaptive, at = _adaptive(d, at, template)
        return generic(Decoder(d[at:]), bytearray(1 << 16), w, h, template, adaptive, bool(flags & 8))

    def _dictionary(self, d: bytes, refs: list[int]) -> list[np.ndarray]:
        flags, = struct.unpack_from(">H", d)
        if flags & 3:
            raise Invalid("unsupported symbol coding")
        template = flags >> 10 & 3
        adaptive, at = _adaptive(d, 2, template)
        exported, new = struct.unpack_from(">II", d, at)
        if max(exported, new) > MOST_SYMBOLS:
            raise Limit("symbols")
        given = [s for r in refs for s in self.symbols.get(r, [])]
        dec = Decoder(d[at + 8 :])
        heights, widths, exports, pixels = bytearray(512), bytearray(512), bytearray(512), bytearray(1 << 16)
        made: list[np.ndarray] = []
        height = 0
        while len(made) < new:
            height += dec.integer(heights) or 0
            width = 0
            while True:
                step = dec.integer(widths)
                if step is None:
                    break
                width += step
                if len(made) >= new or not (0 < height <= 65_535 and 0 <= width <= 65_535):
                    raise Invalid("symbol size")
                made.append(generic(dec, pixels, width, height, template, adaptive, False))
        every, out, on = given + made, [], False
        at = 0
        while at < len(every):
            run = dec.integer(exports)
            if run is None or run < 0 or at + run > len(every):
                raise Invalid("symbol export")
            if on:
                out += every[at : at + run]
            at, on = at + run, not on
        return out

    def _text(self, d: bytes, refs: list[int]) -> np.ndarray:
        w, h = struct.unpack_from(">II", d)
        if w * h > MOST_PIXELS:
            raise Limit("image size")
        flags, = struct.unpack_from(">H", d, 17)
        if flags & 3:
            raise Invalid("unsupported text coding")
        log_strip, corner, turned, op = flags >> 2 & 3, flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3
        offset = flags >> 10 & 31
        offset -= 32 if offset > 15 else 0
        count, = struct.unpack_from(">I", d, 19)
        symbols = [s for r in refs for s in self.symbols.get(r, [])]
        bits = max(0, (len(symbols) - 1).bit_length()) if symbols else 0
        dec = Decoder(d[23:])
        strip_t, first_s, step_s, step_t = (bytearray(512) for _ in range(4))
        names = bytearray(1 << (bits + 1))
        out = np.full((h, w), bool(flags >> 9 & 1))
        strips = 1 << log_strip
        t = -(dec.integer(strip_t) or 0) * strips
        s0, n = 0, 0
        while n < count:
            t += (dec.integer(strip_t) or 0) * strips
            s0 += dec.integer(first_s) or 0
            s = s0
            while True:
                here = t + ((dec.integer(step_t) or 0) if strips > 1 else 0)
                k = dec.ident(names, bits)
                if k >= len(symbols):
                    raise Invalid("symbol number")
                b = symbols[k]
                bh, bw = b.shape
                if not turned and corner > 1:
                    s += bw - 1
                elif turned and corner in (0, 2):
                    s += bh - 1
                x, y = (here, s) if turned else (s, here)
                # corners: 0 lower left, 1 upper left, 2 lower right, 3 upper right
                x -= bw - 1 if corner > 1 else 0
                y -= bh - 1 if corner in (0, 2) else 0
                _combine(out, b, x, y, op)
                if not turned and corner < 2:
                    s += bw - 1
                elif turned and corner in (1, 3):
                    s += bh - 1
                n += 1
                step = dec.integer(step_s)
                if step is None or n >= count:
                    break
                s += step + offset
        return out


def _combine(page: np.ndarray, b: np.ndarray, x: int, y: int, op: int) -> None:
    """Or, and, exclusive or, equal, or replace, as far as the bitmap lies on the page."""
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + b.shape[1], page.shape[1]), min(y + b.shape[0], page.shape[0])
    if x0 >= x1 or y0 >= y1:
        return
    part, here = b[y0 - y : y1 - y, x0 - x : x1 - x], page[y0:y1, x0:x1]
    page[y0:y1, x0:x1] = (here | part, here & part, here ^ part, here == part, part)[min(op, 4)]


def decode(data: bytes, shared: bytes = b"") -> np.ndarray:
    """The page of an embedded stream; True is black."""
    out = Image()
    try:
        for part in (shared, data):
            if part:
                out.read(part)
    except (struct.error, IndexError, ValueError):
        raise Invalid("damaged bilevel image") from None
    if out.page is None:
        raise Invalid("no page")
    return out.page
