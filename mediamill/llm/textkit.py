"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on UTF-8 bytes: a batch of texts is one byte buffer with
offsets, exactly as Arrow holds it, and words, word hashes, shingles and windows
come out of a few NumPy passes over that buffer.  The word rules of the operators
are classes of ASCII bytes (every byte from 0x80 up belongs to a word), so looking at
bytes gives the same words as looking at code points.

A batch is cut into slices of about :data:`SLICE_BYTES` of text before any
eight-byte-per-byte array is made, so memory follows the longest single text and not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WBASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()

#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters and every byte of a longer character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[65:91] = True
ALNUM[97:123] = True
ALNUM[128:] = True


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = self._grow(self.base, size), self._grow(self.inv, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.empty(n, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
            done += take
        return out


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WBASE)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), vectorised; returns a new array."""
    h = h ^ U64(salt & _MASK)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Words:
    """Words of a slice of texts.

    ``first`` has, for each text, the index of its first word (one more entry at the
    end), ``start`` and ``end`` are byte positions of each word in ``buf`` and ``hash``
    is a 64-bit hash of each word's (optionally lower-cased) bytes.
    """

    __slots__ = ("buf", "offsets", "first", "start", "end", "hash")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool, hashes: bool = True):
        offsets = offsets - offsets[0]
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        flag = np.zeros(n + 2, dtype=np.int8)
        flag[1:-1] = inside[buf]
        step = np.diff(flag)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(offsets) > 2:  # a word that runs over the border of two texts is two words
            inner = offsets[1:-1]
            inner = np.unique(inner[(inner > 0) & (inner < n)])
            inner = inner[inside[buf[inner]] & inside[buf[inner - 1]]]
            if len(inner):
                start = np.sort(np.concatenate([start, inner]))
                end = np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        if hashes:
            up, down = _BYTES.get(n + 1)
            run = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[LOWER[buf] if lower else buf] * up[:n], out=run[1:])
            self.hash = mix((run[end] - run[start]) * down[start])
        else:
            self.hash = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, as if all were one text; ``len(hashes) - k + 1`` of them."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.get(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=run[1:])
    return mix((run[k:] - run[:-k]) * down[: n - k + 1], salt=k * 0x2545F4914F6CDD1D)


def span_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the word hashes in each ``[lo, hi)``; equal sequences get equal hashes wherever they stand."""
    n = len(hashes)
    up, down = _WORDS.get(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=run[1:])
    return mix((run[hi] - run[lo]) * down[lo] + mix((hi - lo).astype(np.uint64)), salt=0x51ED270B)


def inside_one(first: np.ndarray, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``k`` words lie in one text: their start words and their texts' numbers."""
    counts = np.diff(first)
    many = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]])
    start = np.arange(int(many.sum())) - np.repeat(begin - first[:-1], many)
    return start, owner


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(lo, hi, buf, offsets)`` for runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    if len(texts) == 0:
        return
    raw, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
