"""CCITT fax data (T.4, T.6): one- and two-dimensional rows to packed bits."""

from __future__ import annotations

import numpy as np

from ..errors import Invalid, Limit

# Codes of run lengths 0 to 63, then of multiples of 64 up to 1728, white and black, and those above for both.
_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
_WHITE_FAR = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split()
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
_BLACK_FAR = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split()
_FAR = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# Codes of the two-dimensional modes; numbers are vertical offsets.
_MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def _table(near: list[str], far: list[str]) -> dict[tuple[int, int], int]:
    out = {c: i for i, c in enumerate(near)} | {c: 64 * (i + 1) for i, c in enumerate(far)} | {c: 1792 + 64 * i for i, c in enumerate(_FAR)}
    return {(len(c), int(c, 2)): n for c, n in out.items()}


_RUNS = _table(_WHITE, _WHITE_FAR), _table(_BLACK, _BLACK_FAR)
_TWO = {(len(c), int(c, 2)): m for c, m in _MODES.items()}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        first = self.at >> 3
        part = int.from_bytes(self.data[first : first + 5].ljust(5, b"\0"), "big")
        return part >> (40 - (self.at & 7) - n) & ((1 << n) - 1)

    def code(self, table: dict):
        for n in range(1, 14):
            got = table.get((n, self.peek(n)))
            if got is not None:
                self.at += n
                if self.at > self.end:
                    return None
                return got
        return None

    def run(self, color: int) -> int | None:
        total = 0
        while True:
            n = self.code(_RUNS[color])
            if n is None:
                return None
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """Passes over fill and an end-of-line code if one comes."""
        at = self.at
        while at + 12 <= self.end:
            probe, self.at = self.at, at
            zeros = self.peek(12)
            self.at = probe
            if zeros == 1:
                self.at = at + 12
                return True
            if zeros:
                return False
            at += 1
        return False


def decode(data: bytes, k: int, columns: int, rows: int = 0, black_is_1: bool = False, aligned: bool = False) -> bytes:
    """Rows of packed bits; ``k`` below zero: two-dimensional, zero: one-dimensional, above: mixed.  A damaged row ends the image."""
    if not 1 <= columns <= 65_535:
        raise Invalid("fax columns")
    r = _Reader(data)
    reference = [columns]
    lines: list[list[int]] = []
    while r.at < r.end and (not rows or len(lines) < rows):
        if len(lines) * columns > 1 << 30:
            raise Limit("fax size")
        if aligned:
            r.at = -(-r.at // 8) * 8
        if k < 0:
            if r.peek(24) == 0x001001:
                break
            flat = False
        else:
            ended = r.end_of_line()
            if ended and r.peek(12) == 1 and k == 0:
                break
            flat = True
            if k > 0:
                flat, r.at = bool(r.peek(1)), r.at + 1
        line = _flat(r, columns) if flat else _two(r, columns, reference)
        if line is None:
            break
        lines.append(line)
        reference = line
    height = rows or len(lines)
    out = np.zeros((height, columns), dtype=np.uint8)
    for y, line in enumerate(lines):
        for a, b in zip(line[::2], line[1::2], strict=False):
            out[y, a:b] = 1
    if not black_is_1:
        out ^= 1
    return np.packbits(out, axis=1).tobytes()


def _flat(r: _Reader, columns: int) -> list[int] | None:
    """Places where the colour changes, white first."""
    line, at, color = [], 0, 0
    while at < columns:
        n = r.run(color)
        if n is None:
            return None
        at = min(at + n, columns)
        line.append(at)
        color ^= 1
    return line + [columns] * (1 + len(line) % 2)


def _two(r: _Reader, columns: int, reference: list[int]) -> list[int] | None:
    line: list[int] = []
    at, color = -1, 0
    while at < columns:
        # the next change in the row above to the colour that isn't ours, and the one after it
        i = color
        while i < len(reference) and reference[i] <= at:
            i += 2
        b1 = reference[i] if i < len(reference) else columns
        b2 = reference[i + 1] if i + 1 < len(reference) else columns
        mode = r.code(_TWO)
        if mode is None:
            return None
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            one, two = r.run(color), r.run(color ^ 1)
            if one is None or two is None:
                return None
            start = max(at, 0)
            line += [min(start + one, columns), min(start + one + two, columns)]
            at = line[-1]
        else:
            at = min(max(b1 + mode, 0), columns)
            line.append(at)
            color ^= 1
    return line + [columns] * (1 + len(line) % 2)
