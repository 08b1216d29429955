"""A file's metadata without its samples: a small copy with the large parts cut out, read by seeking."""

from __future__ import annotations

import struct
from typing import BinaryIO

from ..errors import Limit
from . import audio, meta, parts
from .tags import Tags

# The largest part that is read, and the most of a file.
MOST_PART, MOST_FILE = 64 << 20, 128 << 20


class Source:
    def __init__(self, f: BinaryIO):
        self.f, self.used = f, 0
        f.seek(0, 2)
        self.size = f.tell()

    def at(self, offset: int, n: int) -> bytes:
        if n > MOST_PART or self.used + n > MOST_FILE:
            raise Limit("metadata size exceeded")
        self.used += n
        self.f.seek(offset)
        return self.f.read(n)


def compact(s: Source) -> bytes:
    """Bytes that the readers of :mod:`.meta` take for the whole file."""
    head = s.at(0, min(s.size, 64))
    kind = meta.detect(head)
    if kind is None and head[:3] == b"ID3":
        size = (audio.syncsafe(head[6:10]) or 0) + 10 + (10 if head[5] & 0x10 else 0)
        behind = s.at(size, 4) if size < s.size else b""
        kind = {b"fLaC": "flac", b"TTA1": "tta"}.get(behind)
    if kind == "wav":
        return _chunks(s, "<", b"data")
    if kind == "aiff":
        return _chunks(s, ">", b"SSND")
    if kind == "flac":
        return _flac(s)
    if kind == "mp4":
        return _mp4(s)
    if kind == "wavpack":
        return _wavpack(s)
    if kind == "tta":
        start = _id3(s)
        return s.at(0, start) + s.at(start, min(22, s.size - start)) + _tail(s, start + 22)
    return s.at(0, s.size)


def _id3(s: Source) -> int:
    head = s.at(0, min(10, s.size))
    size = audio.syncsafe(head[6:10]) if head[:3] == b"ID3" else None
    return min(s.size, 10 + size + (10 if head[5] & 0x10 else 0)) if size is not None else 0


def _chunks(s: Source, order: str, samples: bytes) -> bytes:
    """All chunks but the samples, whose header stays with no length; a 64-bit length comes from the chunk that holds it."""
    out, at, long_size = bytearray(s.at(0, 12)), 12, None
    for _ in range(parts.MOST_PARTS):
        if at + 8 > s.size:
            break
        name, size = s.at(at, 4), struct.unpack(order + "I", s.at(at + 4, 4))[0]
        if name == b"ds64":
            long_size = struct.unpack("<Q", s.at(at + 16, 8))[0]
        if name == samples:
            if size == 0xFFFFFFFF and long_size is not None:
                size = long_size
            out += name + bytes(4)
        else:
            body = s.at(at + 8, min(size, s.size - at - 8))
            out += name + struct.pack(order + "I", size) + body + (b"\0" if size & 1 else b"")
        at += 8 + size + (size & 1)
    return bytes(out)


def _flac(s: Source) -> bytes:
    at = _id3(s)
    out = bytearray(s.at(0, at + 4))
    at += 4
    while at + 4 <= s.size:
        head = s.at(at, 4)
        size = int.from_bytes(head[1:], "big")
        out += head + s.at(at + 4, min(size, s.size - at - 4))
        at += 4 + size
        if head[0] & 0x80:
            break
    return bytes(out)


def _mp4(s: Source) -> bytes:
    out, at = bytearray(), 0
    while at + 8 <= s.size:
        head = s.at(at, 8)
        size, head_size = struct.unpack(">I", head[:4])[0], 8
        if size == 1:
            size, head_size = struct.unpack(">Q", s.at(at + 8, 8))[0], 16
        elif size == 0:
            size = s.size - at
        if size < head_size or at + size > s.size:
            break
        if head[4:] in (b"ftyp", b"moov", b"meta", b"udta", b"uuid"):
            out += s.at(at, size)
        at += size
    return bytes(out)


def _wavpack(s: Source) -> bytes:
    """The first and the last block, and the tags behind."""
    at, last, first = 0, None, b""
    for _ in range(1 << 20):
        head = s.at(at, 8) if at + 32 <= s.size else b""
        if head[:4] != b"wvpk":
            break
        size = 8 + struct.unpack("<I", head[4:])[0]
        if at + size > s.size:
            break
        if at == 0:
            first = s.at(0, size)
        else:
            last = at, size
        at += size
    return first + (s.at(*last) if last else b"") + _tail(s, at)


def _tail(s: Source, least: int) -> bytes:
    """Tags at the end: an APE tag by its footer, and the fixed last 128 bytes."""
    end = s.size
    v1 = s.at(end - 128, 128) if end >= least + 128 else b""
    v1 = v1 if v1[:3] == b"TAG" else b""
    end -= len(v1)
    footer = s.at(end - 32, 32) if end >= least + 32 else b""
    if footer[:8] != b"APETAGEX":
        return v1
    size = struct.unpack_from("<I", footer, 12)[0]
    return s.at(end - size, size) + v1 if 32 <= size <= end - least else footer + v1


def read(f: BinaryIO) -> Tags:
    return meta.read(compact(Source(f)))
