"""Deflate streams under limits, on the standard library's codec."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from ..errors import Invalid, Limit


def inflate(data: bytes, limit: int, raw: bool = False, truncate: bool = False) -> tuple[bytes, int, bool]:
    """Output, bytes consumed, and whether the stream ended; more output than ``limit`` is an error or, with ``truncate``, cut."""
    d = zlib.decompressobj(-15 if raw else 15)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error:
        if not truncate:
            raise Invalid("damaged deflate stream") from None
        return salvage(data, limit, raw), len(data), False
    if len(out) > limit:
        if not truncate:
            raise Limit("inflated size exceeded")
        out = out[:limit]
    return out, len(data) - len(d.unused_data) - len(d.unconsumed_tail), d.eof


def salvage(data: bytes, limit: int, raw: bool) -> bytes:
    """What a damaged stream gives before its damage."""
    d, out = zlib.decompressobj(-15 if raw else 15), bytearray()
    try:
        for i in range(0, len(data), 64):
            out += d.decompress(data[i : i + 64])
            if len(out) > limit:
                break
    except zlib.error:
        pass
    return bytes(out[:limit])


def inflate_exact(data: bytes, expected: int) -> bytes:
    """A zlib stream of just so many bytes and nothing behind it."""
    out, used, whole = inflate(data, expected)
    if len(out) != expected or not whole or used != len(data):
        raise Invalid("inflated size differs")
    return out


def compress(data: bytes, level: int = 6) -> bytes:
    return zlib.compress(data, level)


class Compressor:
    """A zlib stream written part by part to ``out``."""

    def __init__(self, out: Callable[[bytes], object], level: int = 6):
        self.out, self.stream = out, zlib.compressobj(level)

    def write(self, data: bytes) -> None:
        if part := self.stream.compress(data):
            self.out(part)

    def finish(self) -> None:
        self.out(self.stream.flush())


def compress_pieces(data: bytes, piece: int = 1 << 20, level: int = 6, threads: int = 1) -> bytes:
    """A zlib stream made of pieces that are compressed by themselves, side by side where there are threads: each knows the 32 KiB before it.

    The cuts depend on the data's length alone, so the bytes are the same for any number of threads.
    """
    places = range(0, max(len(data), 1), piece)

    def one(at: int) -> bytes:
        before = {"zdict": data[max(0, at - 32768) : at]} if at else {}
        d = zlib.compressobj(level, zlib.DEFLATED, -15, **before)
        return d.compress(data[at : at + piece]) + d.flush(zlib.Z_FINISH if at + piece >= len(data) else zlib.Z_SYNC_FLUSH)

    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            parts = list(pool.map(one, places))
    else:
        parts = [one(at) for at in places]
    return b"\x78\x9c" + b"".join(parts) + zlib.adler32(data).to_bytes(4, "big")
