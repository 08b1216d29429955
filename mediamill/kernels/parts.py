"""Containers as sequences of parts: a head that names the part and says how long it is, a body, and padding.

A format is one function from the bytes and a place to a :class:`Part`; the walk itself,
its bound and what becomes of a part that the file's end cuts off are the same for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

MOST_PARTS = 65_536


class Part(NamedTuple):
    name: bytes
    begin: int
    size: int
    padding: int = 0
    final: bool = False


Head = Callable[[bytes, int], Part | None]


def iff(order: str) -> Head:
    """Four letters, a 32-bit length, bodies padded to an even length."""

    def head(d: bytes, at: int) -> Part | None:
        if at + 8 > len(d):
            return None
        size = int.from_bytes(d[at + 4 : at + 8], order)
        return Part(d[at : at + 4], at + 8, size, size & 1)

    return head


def flac_block(d: bytes, at: int) -> Part | None:
    """One byte (top bit: the last one; the rest: its kind) and a 24-bit length."""
    if at + 4 > len(d):
        return None
    return Part(bytes([d[at] & 0x7F]), at + 4, int.from_bytes(d[at + 1 : at + 4], "big"), 0, d[at] > 0x7F)


def wavpack_block(d: bytes, at: int) -> Part | None:
    """A block of 32 bytes of head, of which the length counts the last 24, and its sub-blocks."""
    if d[at : at + 4] != b"wvpk" or at + 32 > len(d):
        return None
    return Part(b"wvpk", at + 8, int.from_bytes(d[at + 4 : at + 8], "little"))


def wavpack_sub_block(d: bytes, at: int) -> Part | None:
    """A kind with two flags (long length, odd size) and a length in 16-bit words of one or three bytes."""
    wide = 3 if d[at : at + 1] >= b"\x80" else 1
    if at + 1 + wide > len(d):
        return None
    size = 2 * int.from_bytes(d[at + 1 : at + 1 + wide], "little")
    odd = 1 if d[at] & 0x40 and size else 0
    return Part(bytes([d[at] & 0x3F]), at + 1 + wide, size - odd, odd)


def atom(d: bytes, at: int) -> Part | None:
    """A 32-bit length that counts the head too (0: up to the end; 1: a 64-bit one follows the name) and four letters."""
    if at + 8 > len(d):
        return None
    size, head = int.from_bytes(d[at : at + 4], "big"), 8
    if size == 1:
        size, head = int.from_bytes(d[at + 8 : at + 16], "big"), 16
    elif size == 0:
        size = len(d) - at
    return Part(d[at + 4 : at + 8], at + head, size - head) if size >= head else None


def walk(d: bytes, at: int, head: Head, cut: Callable[[bytes], None] | None = None) -> Iterator[tuple[bytes, bytes]]:
    """Name and body of each whole part from a place on; the first that the end cuts off goes to ``cut`` by its name."""
    for _ in range(MOST_PARTS):
        part = head(d, at)
        if part is None:
            return
        end = part.begin + part.size
        if end > len(d):
            if cut:
                cut(part.name)
            return
        yield part.name, d[part.begin : end]
        if part.final:
            return
        at = end + part.padding
