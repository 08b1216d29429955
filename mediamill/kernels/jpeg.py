"""JPEG (ITU-T T.81): markers, headers, baseline and progressive Huffman decoding, a baseline encoder."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..errors import Deadline, Invalid
from .image import Image, check_dimensions

# The zigzag order of coefficients.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
# The standard's example quantisation tables (K.1, K.2), row by row.
LUMA_QUANT = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
CHROMA_QUANT = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32)
# The standard's example Huffman tables (K.3 to K.6): how many codes each length has, and their values in order.
DC_BITS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_BITS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
LUMA_AC = (
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98, 114, 130,
    9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99,
    100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152,
    153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210,
    211, 212, 213, 214, 215, 216, 217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
)
CHROMA_AC = (
    0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193, 9, 35, 51, 82, 240, 21, 98, 114, 209, 10, 22,
    36, 52, 225, 37, 241, 23, 24, 25, 26, 38, 39, 40, 41, 42, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99,
    100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151,
    152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202,
    210, 211, 212, 213, 214, 215, 216, 217, 218, 226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248, 249, 250,
)
#: The bound of scans, and of blocks in a unit.
MOST_SCANS, MOST_BLOCKS = 128, 10


def ac_values(k: int) -> bytes:
    """Values of the standard AC table for luma (0) or chroma (1)."""
    return bytes((LUMA_AC, CHROMA_AC)[k])


@dataclass
class Component:
    id: int
    h: int
    v: int
    tq: int
    blocks: np.ndarray | None = None  # rows, columns, 64 coefficients in natural order
    pred: int = 0
    dc: int = 0
    ac: int = 0


@dataclass
class Info:
    width: int = 0
    height: int = 0
    precision: int = 8
    sof: int = 0
    components: list[Component] = field(default_factory=list)
    jfif: bool = False
    adobe: int | None = None
    icc: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    comments: list[bytes] = field(default_factory=list)
    multi_picture: bytes | None = None

    @property
    def transform(self) -> str:
        n = len(self.components)
        if n == 3:
            if self.jfif:
                return "ycbcr"
            if self.adobe is not None:
                return "ycbcr" if self.adobe else "rgb"
            return "rgb" if [c.id for c in self.components] == [82, 71, 66] else "ycbcr"
        if n == 4:
            return "ycck" if self.adobe else "cmyk"
        return "gray"


def next_marker(data: bytes, at: int) -> tuple[int, int]:
    """The next marker from a place on and where it ends; stuffed zeros, fill bytes and stray bytes are passed over."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Invalid("truncated file")
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            raise Invalid("truncated file")
        if data[at + 1]:
            return data[at + 1], at + 2
        at += 2


def segments(data: bytes) -> list[tuple[int, int, bytes]]:
    """``(offset, marker, body)`` up to the first scan or the end."""
    if data[:3] != b"\xff\xd8\xff":
        raise Invalid("not a JPEG")
    out, at = [], 2
    while True:
        marker, at = next_marker(data, at)
        if marker == 0xD9:
            return out
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(data):
            raise Invalid("truncated file")
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            raise Invalid("truncated file")
        out.append((at - 2, marker, data[at + 2 : at + size]))
        if marker == 0xDA:
            return out
        at += size


def _frame(info: Info, marker: int, d: bytes) -> None:
    if len(d) < 6:
        raise Invalid("frame header")
    info.precision, info.height, info.width, n = struct.unpack_from(">BHHB", d)
    if info.components:
        raise Invalid("second frame")
    if not 1 <= n <= 4 or len(d) != 6 + 3 * n:
        raise Invalid("frame header")
    for i in range(n):
        cid, hv, tq = d[6 + 3 * i : 9 + 3 * i]
        h, v = hv >> 4, hv & 15
        if not (1 <= h <= 4 and 1 <= v <= 4) or tq > 3 or cid in [c.id for c in info.components]:
            raise Invalid("frame component")
        info.components.append(Component(cid, h, v, tq))
    info.sof = marker


def _application(info: Info, marker: int, d: bytes, profile: list[tuple[int, int, bytes]]) -> None:
    if marker == 0xE0 and d[:5] == b"JFIF\0":
        info.jfif = True
    elif marker == 0xE1 and d[:6] == b"Exif\0\0":
        info.exif = info.exif or d[6:]
    elif marker == 0xE1 and d.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
        info.xmp = info.xmp or d[29:]
    elif marker == 0xE2 and d[:12] == b"ICC_PROFILE\0" and len(d) >= 14:
        profile.append((d[12], d[13], d[14:]))
    elif marker == 0xE2 and d[:4] == b"MPF\0":
        info.multi_picture = d[4:]
    elif marker == 0xEE and d[:5] == b"Adobe" and len(d) >= 12:
        info.adobe = d[11]
    elif marker == 0xFE:
        info.comments.append(d)


def assemble_icc(parts: list[tuple[int, int, bytes]]) -> bytes | None:
    """A profile from its numbered parts, if all are there."""
    if not parts or len({t for _, t, _ in parts}) != 1 or sorted(s for s, _, _ in parts) != list(range(1, parts[0][1] + 1)):
        return None
    return b"".join(d for _, _, d in sorted(parts))


_SOF = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)


def read_info(data: bytes) -> Info:
    info, parts = Info(), []
    for _, marker, d in segments(data):
        if marker in _SOF:
            _frame(info, marker, d)
        else:
            _application(info, marker, d, parts)
    if not info.components:
        raise Invalid("no frame")
    info.icc = assemble_icc(parts)
    return info


class Huffman:
    """A table of 16-bit prefixes: each gives a symbol and its code's length."""

    def __init__(self, bits, values: bytes):
        table: list[int] = []
        code_value = 0
        code = 0
        for length in range(1, 17):
            for _ in range(bits[length - 1]):
                if code >= 1 << length:
                    raise Invalid("Huffman table")
                table += [values[code_value] << 5 | length] * (1 << (16 - length))
                code += 1
                code_value += 1
            code <<= 1
        if len(table) > 65536:
            raise Invalid("Huffman table")
        self.table = table + [0] * (65536 - len(table))
        self._fast: list[int] | None = None

    def fast(self) -> list[int]:
        """The table with runs and values, made when it is first asked for."""
        if self._fast is None:
            self._fast = _runs_and_values(self.table)
        return self._fast


class Bits:
    """Bits of one interval of entropy-coded data, byte stuffing taken out; zeros follow its end, up to a bound."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = self.acc = self.n = 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 16]
        if not part:
            if self.at > len(self.data) + 64:
                raise Invalid("truncated file")
            self.at += 16
            part = bytes(16)
            self.acc = (self.acc & ((1 << self.n) - 1)) << 128
            self.n += 128
            return
        self.at += len(part)
        self.acc = (self.acc & ((1 << self.n) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
        self.n += 8 * len(part)

    def symbol(self, table: list[int]) -> int:
        while self.n < 16:
            self.fill()
        e = table[self.acc >> (self.n - 16) & 0xFFFF]
        if not e:
            raise Invalid("Huffman code")
        self.n -= e & 31
        return e >> 5

    def bits(self, k: int) -> int:
        while self.n < k:
            self.fill()
        self.n -= k
        return self.acc >> self.n & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        v = self.bits(k)
        return v if v >> (k - 1) else v - (1 << k) + 1

    @property
    def overrun(self) -> bool:
        """Whether bits from behind the end were used."""
        return self.at - self.n // 8 > len(self.data) + 1


def _runs_and_values(table: list[int]) -> list[int]:
    """For each 16 bits that may come next: the length of code and value, how many places to go on, and the value plus 2**15, in 5, 7 and the other bits.

    A zero run goes on 16 places and the end of a block 64, both without a value.  Entries
    whose value reaches beyond 16 bits, and those of no code, are 0.
    """
    e = np.array(table, dtype=np.int64)
    window = np.arange(1 << 16, dtype=np.int64)
    length, symbol = e & 31, e >> 5
    run, size = symbol >> 4, symbol & 15
    total = length + size
    raw = window >> np.maximum(16 - total, 0) & (np.int64(1) << size) - 1
    value = np.where(raw >> np.maximum(size - 1, 0) > 0, raw, raw - (np.int64(1) << size) + 1)
    skip = np.where(size > 0, run + 1, np.where(symbol == 0xF0, 16, 64))
    out = total | skip << 5 | np.where(size > 0, value + (1 << 15), 0) << 12
    return np.where((e > 0) & (total <= 16), out, 0).tolist()


_ZIGZAG_LIST = ZIGZAG.tolist()


def _sequential(data: bytes, blocks: list[tuple["Component", int]], tables: dict[int, tuple[list[int], list[int], list[int]]]) -> None:
    """An interval of sequential blocks (its byte stuffing taken out), each a component and its place: values are gathered and put into the blocks at once."""
    end = len(data) * 8 + 16
    data += bytes(64)
    size = len(data)
    at = acc = n = 0
    found: dict[int, tuple[list[int], list[int], Component]] = {}
    for c, _ in blocks:
        found.setdefault(c.id, ([], [], c))
    for c, place in blocks:
        dc, ac, fast = tables[c.id]
        places, values, _ = found[c.id]
        if at * 8 - n > end:
            raise Invalid("truncated file")
        while n < 48:
            acc = (acc & ((1 << n) - 1)) << 128 | int.from_bytes(data[at : at + 16].ljust(16, b"\0"), "big")
            at, n = at + 16, n + 128
        e = dc[acc >> (n - 16) & 0xFFFF]
        if not e:
            raise Invalid("Huffman code")
        n -= e & 31
        s = e >> 5
        if s:
            if s > 15:
                raise Invalid("coefficient")
            n -= s
            v = acc >> n & ((1 << s) - 1)
            c.pred += v if v >> (s - 1) else v - (1 << s) + 1
        if c.pred:
            places.append(place)
            values.append(c.pred)
        k = 1
        while k < 64:
            if n < 48:
                acc = (acc & ((1 << n) - 1)) << 128 | int.from_bytes(data[at : at + 16].ljust(16, b"\0"), "big")
                at, n = at + 16, n + 128
                if at > size + 64:
                    raise Invalid("truncated file")
            window = acc >> (n - 16) & 0xFFFF
            e = fast[window]
            if e:
                n -= e & 31
                k += e >> 5 & 127
                e >>= 12
                if e:
                    if k > 64:
                        raise Invalid("coefficient")
                    places.append(place + _ZIGZAG_LIST[k - 1])
                    values.append(e - 32768)
                continue
            e = ac[window]
            if not e:
                raise Invalid("Huffman code")
            n -= e & 31
            s = e >> 5 & 15
            k += (e >> 9) + 1
            if k > 64:
                raise Invalid("coefficient")
            n -= s
            v = acc >> n & ((1 << s) - 1)
            places.append(place + _ZIGZAG_LIST[k - 1])
            values.append(v if v >> (s - 1) else v - (1 << s) + 1)
    if at * 8 - n > end:
        raise Invalid("truncated file")
    for places, values, c in found.values():
        if places:
            c.blocks.reshape(-1)[places] = np.array(values).astype(np.int16)


class Decoder:
    def __init__(self, data: bytes, deadline: Deadline | None = None, luma_only: bool = False):
        self.data, self.deadline, self.luma_only = data, deadline or Deadline(), luma_only
        self.quant: list[np.ndarray | None] = [None] * 4
        self.dc: list[Huffman | None] = [None] * 4
        self.ac: list[Huffman | None] = [None] * 4
        self.info, self.parts = Info(), []
        self.interval = self.scans = 0

    def run(self) -> Info:
        data, at = self.data, 2
        if data[:3] != b"\xff\xd8\xff":
            raise Invalid("not a JPEG")
        while True:
            try:
                marker, at = next_marker(data, at)
            except Invalid:
                if self.scans:
                    break  # no end marker, but pixels
                raise
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD8:
                continue
            size = struct.unpack_from(">H", data, at)[0] if at + 2 <= len(data) else 0
            if size < 2 or at + size > len(data):
                if self.scans:
                    break
                raise Invalid("truncated file")
            d = data[at + 2 : at + size]
            at += size
            if marker in _SOF:
                if marker not in (0xC0, 0xC1, 0xC2):
                    raise Invalid("unsupported coding process")
                _frame(self.info, marker, d)
                self._start()
            elif marker == 0xDB:
                self._quant(d)
            elif marker == 0xC4:
                self._huffman(d)
            elif marker == 0xDD:
                if len(d) != 2:
                    raise Invalid("restart interval")
                self.interval = struct.unpack(">H", d)[0]
            elif marker == 0xDC:
                raise Invalid("unsupported line count")
            elif marker == 0xDA:
                at = self._scan(d, at)
            else:
                _application(self.info, marker, d, self.parts)
        if not self.scans:
            raise Invalid("no scan")
        self.info.icc = assemble_icc(self.parts)
        return self.info

    def _quant(self, d: bytes) -> None:
        at = 0
        while at < len(d):
            wide, t = d[at] >> 4, d[at] & 15
            n = 128 if wide else 64
            if wide > 1 or t > 3 or at + 1 + n > len(d):
                raise Invalid("quantisation table")
            q = np.zeros(64, dtype=np.int32)
            q[ZIGZAG] = np.frombuffer(d[at + 1 : at + 1 + n], dtype=">u2" if wide else np.uint8)
            self.quant[t] = q
            at += 1 + n

    def _huffman(self, d: bytes) -> None:
        at = 0
        while at < len(d):
            kind, t = d[at] >> 4, d[at] & 15
            bits = d[at + 1 : at + 17]
            n = sum(bits)
            if kind > 1 or t > 3 or len(bits) < 16 or n > 256 or at + 17 + n > len(d):
                raise Invalid("Huffman table")
            (self.ac if kind else self.dc)[t] = Huffman(bits, d[at + 17 : at + 17 + n])
            at += 17 + n

    def _start(self) -> None:
        i = self.info
        if i.precision != 8 or len(i.components) == 2:
            raise Invalid("unsupported samples")
        check_dimensions(i.width, i.height)
        self.hmax, self.vmax = max(c.h for c in i.components), max(c.v for c in i.components)
        self.across, self.down = -(-i.width // (8 * self.hmax)), -(-i.height // (8 * self.vmax))
        for c in i.components:
            c.blocks = np.zeros((self.down * c.v, self.across * c.h, 64), dtype=np.int16)

    def _scan(self, d: bytes, at: int) -> int:
        i = self.info
        self.scans += 1
        if not i.components or not d or self.scans > MOST_SCANS or len(d) != 4 + 2 * d[0] or not 1 <= d[0] <= 4:
            raise Invalid("scan header")
        chosen = []
        for k in range(d[0]):
            c = next((c for c in i.components if c.id == d[1 + 2 * k]), None)
            if c is None or c in chosen:
                raise Invalid("scan component")
            c.dc, c.ac = d[2 + 2 * k] >> 4, d[2 + 2 * k] & 15
            if c.dc > 3 or c.ac > 3:
                raise Invalid("scan tables")
            chosen.append(c)
        first, last, approx = d[-3:]
        high, low = approx >> 4, approx & 15
        progressive = i.sof == 0xC2
        if progressive:
            if first > last or last > 63 or (first == 0 and last) or (first and len(chosen) > 1):
                raise Invalid("progressive scan")
        elif self.scans > len(i.components) or (self.scans > 1 and len(chosen) == len(i.components)):
            raise Invalid("extra scan")
        if len(chosen) > 1 and sum(c.h * c.v for c in chosen) > MOST_BLOCKS:
            raise Invalid("blocks in a unit")
        end = self._end(at)
        intervals = self._intervals(at, end)
        if len(chosen) == 1:
            c = chosen[0]
            w, h = -(-(-(-i.width * c.h // self.hmax)) // 8), -(-(-(-i.height * c.v // self.vmax)) // 8)
            units = [[(c, y, x)] for y in range(h) for x in range(w)]
        else:
            units = [[(c, y * c.v + v, x * c.h + h) for c in chosen for v in range(c.v) for h in range(c.h)] for y in range(self.down) for x in range(self.across)]
        step = self.interval or len(units)
        for n, lo in enumerate(range(0, len(units), step)):
            if n >= len(intervals):
                raise Invalid("truncated file")
            self.deadline.check()
            for c in chosen:
                c.pred = 0
            self._interval(Bits(intervals[n]), units[lo : lo + step], progressive, first, last, high, low)
        return end

    def _end(self, at: int) -> int:
        """Where entropy-coded data end: at the next marker that isn't a restart."""
        while True:
            at = self.data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(self.data):
                return len(self.data)
            m = self.data[at + 1]
            if m and m != 0xFF and not 0xD0 <= m <= 0xD7:
                return at
            at += 1 if m == 0xFF else 2

    def _intervals(self, at: int, end: int) -> list[bytes]:
        out, begin = [], at
        while self.interval:
            at = self.data.find(b"\xff", at, end)
            if at < 0 or at + 1 >= end:
                break
            m = self.data[at + 1]
            if 0xD0 <= m <= 0xD7:
                if m != 0xD0 + len(out) % 8:
                    raise Invalid("restart marker")
                out.append(self.data[begin:at])
                begin = at + 2
            at += 2 if m != 0xFF else 1
        return [*out, self.data[begin:end]]

    def _interval(self, r: Bits, units, progressive: bool, first: int, last: int, high: int, low: int) -> None:
        tables = {}
        for c, _, _ in units[0]:
            dc, ac = self.dc[c.dc], self.ac[c.ac]
            if (dc is None and not (progressive and (first or high))) or (ac is None and (first or not progressive)):
                raise Invalid("missing Huffman table")
            tables[c.id] = dc and dc.table, ac and ac.table, ac and not progressive and ac.fast()
        if not progressive:
            _sequential(r.data, [(c, (y * c.blocks.shape[1] + x) * 64) for unit in units for c, y, x in unit], tables)
            return
        run = 0
        for unit in units:
            for c, y, x in unit:
                dc, ac, _ = tables[c.id]
                target = c.blocks[y, x]
                if not first:
                    if high:
                        if r.bits(1):
                            target[0] |= 1 << low
                    else:
                        s = r.symbol(dc)
                        if s:
                            c.pred += r.signed(s)
                        target[0] = c.pred << low
                elif not high:
                    run = self._first(r, ac, target, first, last, low, run)
                else:
                    run = self._refine(r, ac, target, first, last, low, run)
            if r.overrun:
                raise Invalid("truncated file")

    @staticmethod
    def _first(r: Bits, ac: list[int], target: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        k = first
        while k <= last:
            rs = r.symbol(ac)
            n, s = rs >> 4, rs & 15
            if s:
                k += n
                if k > 63:
                    raise Invalid("coefficient")
                target[ZIGZAG[k]] = r.signed(s) << low
                k += 1
            elif n == 15:
                k += 16
            else:
                return (1 << n) + (r.bits(n) if n else 0) - 1
        return 0

    @staticmethod
    def _refine(r: Bits, ac: list[int], target: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        bit = 1 << low

        def correct(z: int) -> None:
            if r.bits(1) and not int(target[z]) & bit if target[z] >= 0 else r.bits(1) and not -int(target[z]) & bit:
                target[z] += bit if target[z] > 0 else -bit

        k = first
        if not run:
            while k <= last:
                rs = r.symbol(ac)
                n, s = rs >> 4, rs & 15
                value = 0
                if s:
                    if s != 1:
                        raise Invalid("coefficient")
                    value = bit if r.bits(1) else -bit
                elif n != 15:
                    run = (1 << n) + (r.bits(n) if n else 0)
                    break
                while k <= last:
                    z = ZIGZAG[k]
                    if target[z]:
                        correct(z)
                    elif n == 0:
                        if value:
                            target[z] = value
                        k += 1
                        break
                    else:
                        n -= 1
                    k += 1
        if run:
            while k <= last:
                z = ZIGZAG[k]
                if target[z]:
                    correct(z)
                k += 1
            run -= 1
        return run

    def planes(self) -> list[np.ndarray]:
        out = []
        for n, c in enumerate(self.info.components):
            if self.luma_only and n:
                break
            q = self.quant[c.tq]
            if q is None:
                raise Invalid("missing quantisation table")
            rows, cols, _ = c.blocks.shape
            px = idct(c.blocks.reshape(-1, 64).astype(np.int32) * q).reshape(rows, cols, 8, 8)
            plane = px.transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            w, h = -(-self.info.width * c.h // self.hmax), -(-self.info.height * c.v // self.vmax)
            out.append(enlarge(plane[:h, :w], self.hmax // c.h, self.vmax // c.v, self.hmax % c.h == 0 and self.vmax % c.v == 0, self.info.width, self.info.height))
        return out


def _pass(a: list[np.ndarray], shift: int, bias: int) -> list[np.ndarray]:
    """One dimension of the accurate integer inverse transform."""
    # The transform's constants in thirteen-bit fixed point.
    z1 = (a[2] + a[6]) * 4433
    t2, t3 = z1 - a[6] * 15137, z1 + a[2] * 6270
    t0, t1 = (a[0] + a[4]) << 13, (a[0] - a[4]) << 13
    e = t0 + t3, t1 + t2, t1 - t2, t0 - t3
    z5 = (a[7] + a[3] + a[5] + a[1]) * 9633
    p1, p2 = (a[7] + a[1]) * -7373, (a[5] + a[3]) * -20995
    p3, p4 = (a[7] + a[3]) * -16069 + z5, (a[5] + a[1]) * -3196 + z5
    o = a[7] * 2446 + p1 + p3, a[5] * 16819 + p2 + p4, a[3] * 25172 + p2 + p3, a[1] * 12299 + p1 + p4
    half = (1 << (shift - 1)) + (bias << shift)
    return [(e[k] + o[3 - k] + half) >> shift for k in range(4)] + [(e[3 - k] - o[k] + half) >> shift for k in range(4)]


def idct(blocks: np.ndarray) -> np.ndarray:
    """Samples of dequantised blocks (n by 64), all at once: columns first, then rows."""
    b = blocks.astype(np.int64).reshape(-1, 8, 8)
    cols = np.stack(_pass([b[:, k, :] for k in range(8)], 11, 0), axis=1)
    rows = np.stack(_pass([cols[:, :, k] for k in range(8)], 18, 128), axis=2)
    return np.clip(rows, 0, 255).astype(np.uint8)


def enlarge(p: np.ndarray, fx: int, fy: int, whole: bool, width: int, height: int) -> np.ndarray:
    """A plane at full size: triangle filter for two to one across (and down), repetition otherwise."""
    if not whole:
        y, x = (np.arange(height) * p.shape[0] // height), (np.arange(width) * p.shape[1] // width)
        return p[y][:, x]
    if (fx, fy) == (2, 1) and p.shape[1] > 2:
        s = p.astype(np.int32)
        before, after = np.hstack([s[:, :1], s[:, :-1]]), np.hstack([s[:, 1:], s[:, -1:]])
        out = np.empty((p.shape[0], p.shape[1] * 2), dtype=np.int32)
        out[:, ::2], out[:, 1::2] = (3 * s + before + 1) >> 2, (3 * s + after + 2) >> 2
        out[:, 0], out[:, -1] = s[:, 0], s[:, -1]
        return out[:height, :width].astype(np.uint8)
    if (fx, fy) == (2, 2) and p.shape[1] > 2:
        s = p.astype(np.int32)
        up, low = np.vstack([s[:1], s[:-1]]), np.vstack([s[1:], s[-1:]])
        sums = np.empty((p.shape[0] * 2, p.shape[1]), dtype=np.int32)
        sums[::2], sums[1::2] = 3 * s + up, 3 * s + low
        before, after = np.hstack([sums[:, :1], sums[:, :-1]]), np.hstack([sums[:, 1:], sums[:, -1:]])
        out = np.empty((sums.shape[0], sums.shape[1] * 2), dtype=np.int32)
        out[:, ::2], out[:, 1::2] = (3 * sums + before + 8) >> 4, (3 * sums + after + 7) >> 4
        out[:, 0], out[:, -1] = (4 * sums[:, 0] + 8) >> 4, (4 * sums[:, -1] + 7) >> 4
        return out[:height, :width].astype(np.uint8)
    return np.repeat(np.repeat(p, fy, axis=0), fx, axis=1)[:height, :width]


def _to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-range YCbCr to RGB in sixteen-bit fixed point."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    r = y + ((91881 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    g = y + ((-22554 * cb - 46802 * cr + 32768) >> 16)
    return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)


def decode(data: bytes, deadline: Deadline | None = None) -> tuple[Info, Image]:
    """All pixels: gray, RGB or CMYK (inks of Adobe files turned so that 255 is full ink)."""
    d = Decoder(data, deadline)
    info = d.run()
    p = d.planes()
    kind = info.transform
    if kind == "gray":
        out, fmt = p[0][:, :, None], "gray8"
    elif kind == "rgb":
        out, fmt = np.stack(p, axis=2), "rgb8"
    elif kind == "ycbcr":
        out, fmt = _to_rgb(*p), "rgb8"
    else:
        inks = np.stack(p, axis=2) if kind == "cmyk" else np.concatenate([255 - _to_rgb(*p[:3]), p[3][:, :, None]], axis=2)
        out, fmt = (255 - inks if info.adobe is not None else inks), "cmyk8"
    out = np.ascontiguousarray(out)
    return info, Image(info.width, info.height, fmt, out.reshape(info.height, -1))


def decode_luma(data: bytes, deadline: Deadline | None = None) -> tuple[Info, np.ndarray]:
    """The Y plane alone where there is one; other colours come by their luma."""
    d = Decoder(data, deadline, luma_only=True)
    info = d.run()
    if info.transform in ("gray", "ycbcr"):
        return info, d.planes()[0]
    from .image import luma

    return info, luma(decode(data, deadline)[1])


# --- encoder ----------------------------------------------------------------------------------------------------------


def quant_table(basic: np.ndarray, quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((basic * scale + 50) // 100, 1, 255)


def _forward(a: list[np.ndarray], first: bool) -> list[np.ndarray]:
    """One dimension of the accurate integer forward transform."""
    s = [a[k] + a[7 - k] for k in range(4)]
    d = [a[k] - a[7 - k] for k in range(4)]
    t10, t13, t11, t12 = s[0] + s[3], s[0] - s[3], s[1] + s[2], s[1] - s[2]
    shift = 11 if first else 15
    half = 1 << (shift - 1)
    even = ((t10 + t11) << 2, (t10 - t11) << 2) if first else ((t10 + t11 + 2) >> 2, (t10 - t11 + 2) >> 2)
    z = (t12 + t13) * 4433
    two, six = (z + t13 * 6270 + half) >> shift, (z - t12 * 15137 + half) >> shift
    t7, t6, t5, t4 = d[0], d[1], d[2], d[3]
    z1, z2, z3, z4 = (t4 + t7) * -7373, (t5 + t6) * -20995, t4 + t6, t5 + t7
    z5 = (z3 + z4) * 9633
    z3, z4 = z3 * -16069 + z5, z4 * -3196 + z5
    odd = (t7 * 12299 + z1 + z4, t6 * 25172 + z2 + z3, t5 * 16819 + z2 + z4, t4 * 2446 + z1 + z3)
    odd = [(x + half) >> shift for x in odd]
    return [even[0], odd[0], two, odd[1], even[1], odd[2], six, odd[3]]


def fdct(blocks: np.ndarray) -> np.ndarray:
    """Coefficients (times eight) of sample blocks (n by 8 by 8, already around zero)."""
    b = blocks.astype(np.int64)
    rows = np.stack(_forward([b[:, :, k] for k in range(8)], True), axis=2)
    return np.stack(_forward([rows[:, k, :] for k in range(8)], False), axis=1)


def _code_table(bits, values) -> np.ndarray:
    """Code and length of each symbol."""
    out, code, k = np.zeros((256, 2), dtype=np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            out[values[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of each number's absolute value."""
    return np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)


def _behind(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: of negative numbers, less one."""
    return np.where(v > 0, v, v + (np.int64(1) << size) - 1)


def _entropy_coded(blocks: np.ndarray, owner: np.ndarray, dc: list[np.ndarray], ac: list[np.ndarray]) -> bytes:
    """Blocks of zigzag coefficients in their order as Huffman codes, a chunk of blocks at a time."""
    diff = np.zeros(len(blocks), dtype=np.int64)
    for k in np.unique(owner):
        at = np.flatnonzero(owner == k)
        diff[at] = np.diff(blocks[at, 0], prepend=0)
    second = np.minimum(owner, 1)
    out, held = [], np.zeros(0, dtype=np.uint8)
    for lo in range(0, len(blocks), 8192):
        held = np.concatenate([held, _block_bits(blocks[lo : lo + 8192], diff[lo : lo + 8192], second[lo : lo + 8192], np.stack(dc), np.stack(ac))])
        whole = len(held) // 8 * 8
        out.append(np.packbits(held[:whole]).tobytes())
        held = held[whole:]
    if len(held):
        out.append(np.packbits(np.concatenate([held, np.ones(8 - len(held), dtype=np.uint8)])).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def _block_bits(blocks: np.ndarray, diff: np.ndarray, t: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Each block's difference, then runs with values, then the mark of trailing zeros, bit by bit."""
    n = len(blocks)
    size = _sizes(diff)
    entries = [(np.arange(n) * 256, dc[t, size, 0] << size | _behind(diff, size), dc[t, size, 1] + size)]
    b, k = np.nonzero(blocks[:, 1:])
    k += 1
    v = blocks[b, k].astype(np.int64)
    before = np.concatenate([[0], np.where(b[1:] == b[:-1], k[:-1], 0)]) if len(b) else k
    run = k - before - 1
    size = _sizes(v)
    symbol = (run & 15) << 4 | size
    entries.append((b * 256 + 2 * k + 1, ac[t[b], symbol, 0] << size | _behind(v, size), ac[t[b], symbol, 1] + size))
    long = np.repeat(np.arange(len(b)), run >> 4)
    entries.append((b[long] * 256 + 2 * k[long], ac[t[b[long]], 0xF0, 0], ac[t[b[long]], 0xF0, 1]))
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, b, k)
    short = np.flatnonzero(last < 63)
    entries.append((short * 256 + 255, ac[t[short], 0, 0], ac[t[short], 0, 1]))
    place, code, length = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(place, kind="stable")
    code, length = code[order], length[order]
    ends = np.cumsum(length)
    shift = np.repeat(ends, length) - 1 - np.arange(int(ends[-1]))
    return (np.repeat(code, length) >> shift & 1).astype(np.uint8)


def _ycc(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[:, :, k].astype(np.int64) for k in range(3))
    y = (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
    cb = (-11059 * r - 21709 * g + 32768 * b + (128 << 16) + 32767) >> 16
    cr = (32768 * r - 27439 * g - 5329 * b + (128 << 16) + 32767) >> 16
    return [y, cb, cr]


def _shrink(p: np.ndarray, fx: int, fy: int) -> np.ndarray:
    if fx == 1:
        return p
    if fy == 1:
        return (p[:, ::2] + p[:, 1::2] + np.arange(p.shape[1] // 2) % 2) >> 1
    return (p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2] + 1 + np.arange(p.shape[1] // 2) % 2) >> 2


def encode(img: Image, quality: int = 90, subsampling: str | None = None) -> bytes:
    """A baseline file without metadata; chroma at half size each way below quality 90 unless told otherwise."""
    if img.format not in ("gray8", "rgb8"):
        raise Invalid("pixel format")
    h, w = img.height, img.width
    check_dimensions(w, h, 65_500)
    gray = img.format == "gray8"
    sub = "444" if gray else subsampling or ("444" if quality >= 90 else "420")
    fx, fy = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}[sub]
    planes = [img.samples()[:, :, 0].astype(np.int64)] if gray else _ycc(img.samples())
    pad_y, pad_x = -h % (8 * fy), -w % (8 * fx)
    planes = [np.pad(p, ((0, pad_y), (0, pad_x)), mode="edge") for p in planes]
    planes = [p if k == 0 else _shrink(p, fx, fy) for k, p in enumerate(planes)]
    tables = [quant_table(LUMA_QUANT, quality), quant_table(CHROMA_QUANT, quality)]
    coded = []
    for k, p in enumerate(planes):
        q = tables[min(k, 1)].reshape(8, 8) * 8
        blocks = (p - 128).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        c = fdct(blocks.reshape(-1, 8, 8))
        c = np.sign(c) * ((np.abs(c) + q // 2) // q)
        coded.append(c.reshape(blocks.shape[0], blocks.shape[1], 64)[:, :, ZIGZAG])
    values = [bytes(range(12))] * 2
    factors = [(fx, fy)] + [(1, 1)] * (len(planes) - 1)
    down, across = coded[0].shape[0] // fy, coded[0].shape[1] // fx
    units = [c.reshape(down, by, across, bx, 64).transpose(0, 2, 1, 3, 4).reshape(down * across, by * bx, 64) for c, (bx, by) in zip(coded, factors, strict=True)]
    owner = np.tile(np.repeat(np.arange(len(units)), [u.shape[1] for u in units]), down * across)
    out = _entropy_coded(np.concatenate(units, axis=1).reshape(-1, 64), owner, [_code_table(DC_BITS[k], values[k]) for k in range(2)], [_code_table(AC_BITS[k], ac_values(k)) for k in range(2)])
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    count = len(planes)
    head = [b"\xff\xd8", seg(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    head += [seg(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist())) for k in range(min(count, 2))]
    head.append(seg(0xC0, struct.pack(">BHHB", 8, h, w, count) + b"".join(bytes([k + 1, factors[k][0] << 4 | factors[k][1], min(k, 1)]) for k in range(count))))
    for k in range(min(count, 2)):
        head += [seg(0xC4, bytes([k]) + bytes(DC_BITS[k]) + values[k]), seg(0xC4, bytes([0x10 | k]) + bytes(AC_BITS[k]) + ac_values(k))]
    head.append(seg(0xDA, bytes([count]) + b"".join(bytes([k + 1, min(k, 1) * 17]) for k in range(count)) + b"\0\x3f\0"))
    return b"".join(head) + out + b"\xff\xd9"
