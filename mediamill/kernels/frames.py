"""The byte form of a document's frames: a magic word, their number, then width, height and samples of each, integers lowest byte first."""

from __future__ import annotations

import struct

from ..errors import Invalid, Limit

# The magic word, and the bounds of a stream.
MAGIC, MOST_FRAMES, MOST_SIDE, MOST_PIXELS = b"APDFRGB1", 32, 2048, 40_000_000


def read(data: bytes) -> list[dict]:
    """Frames of a stream that is whole, within the bounds and has nothing behind it."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 4:
        raise Invalid("malformed frame stream")
    n = struct.unpack_from("<I", data, len(MAGIC))[0]
    if not 1 <= n <= MOST_FRAMES:
        raise Invalid("malformed frame stream")
    out, at, pixels = [], len(MAGIC) + 4, 0
    for number in range(1, n + 1):
        w, h = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        end = at + 8 + 3 * w * h
        if not (1 <= w <= MOST_SIDE and 1 <= h <= MOST_SIDE) or end > len(data):
            raise Invalid("malformed frame stream")
        pixels += w * h
        if pixels > MOST_PIXELS:
            raise Limit("document pixel budget exceeded")
        out.append({"page_no": number, "w": w, "h": h, "rgb": data[at + 8 : end]})
        at = end
    if at != len(data):
        raise Invalid("malformed frame stream")
    return out
