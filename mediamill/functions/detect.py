"""What kind of file some bytes are, and whether its dimensions are within limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a decode.
MAX_SIDE, MAX_PIXELS, MAX_ALLOC = 65_535, 40_000_000, 512 << 20

# Display names of file types, and container names of a probe.
TYPE_NAMES = {"jpeg": "JPEG", "png": "PNG", "wav": "WAV", "aiff": "AIFF", "mp4": "MP4", "wavpack": "WavPack", "flac": "FLAC", "tta": "TTA"}
PIPE_NAMES = {"png": "png_pipe", "jpeg": "jpeg_pipe"}
CHANNELS = {"gray8": 1, "gray_alpha8": 2, "rgb8": 3, "rgba8": 4, "cmyk8": 4}


def _hex(c: Column, at: int, n: int) -> Column:
    return F.hex(F.substring(c, at, n))


def uint(c: Column, at: int, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes from the 1-based place ``at``; null where the bytes end before."""
    return F.when(F.octet_length(c) >= at + n - 1, F.conv(_hex(c, at, n), 16, 10).cast("long"))


def syncsafe(c: Column, at: int) -> Column:
    """A four-byte integer of seven bits a byte; null if a byte's top bit is set or a byte is missing."""
    b = [uint(c, at + i, 1) for i in range(4)]
    value = F.shiftleft(b[0], 21) + F.shiftleft(b[1], 14) + F.shiftleft(b[2], 7) + b[3]
    return F.when((b[0] < 128) & (b[1] < 128) & (b[2] < 128) & (b[3] < 128), value)


def raster_format(c: Column) -> Column:
    """"png" or "jpeg" by their first bytes, else null."""
    return F.when(_hex(c, 1, 8) == "89504E470D0A1A0A", "png").when(_hex(c, 1, 3) == "FFD8FF", "jpeg")


def pipe_name(fmt: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PIPE_NAMES.items() for x in kv]), fmt)


def file_type(c: Column) -> Column:
    """One of eight file types by their first bytes (two of them may stand behind an ID3v2 tag), else null."""
    size = syncsafe(c, 7)
    skip = F.when((_hex(c, 1, 3) == "494433") & size.isNotNull(), size + 10 + F.when(F.shiftright(uint(c, 6, 1), 4).bitwiseAND(1) == 1, 10).otherwise(0)).otherwise(0)
    behind = F.hex(F.substring(c, (skip + 1).cast("int"), F.lit(4)))
    head, kind = _hex(c, 1, 4), _hex(c, 9, 4)
    return (
        F.when(_hex(c, 1, 3) == "FFD8FF", "jpeg")
        .when(_hex(c, 1, 8) == "89504E470D0A1A0A", "png")
        .when(head.isin("52494646", "52463634") & (kind == "57415645"), "wav")
        .when((head == "464F524D") & kind.isin("41494646", "41494643"), "aiff")
        .when((F.octet_length(c) >= 12) & (_hex(c, 5, 4) == "66747970"), "mp4")
        .when(head == "7776706B", "wavpack")
        .when(behind == "664C6143", "flac")
        .when(behind == "54544131", "tta")
    )


def type_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv]), kind)


def sanitizer_kind(mime: Column) -> Column:
    """What a MIME type is cleaned as; null means that it's refused."""
    return F.when(mime == "image/png", "png").when(mime == "image/jpeg", "jpeg").when(mime.rlike(r"^application/x-[a-z]+-signature\z"), "signature")


def channels(pixel_format: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), pixel_format)


def dimension_error(width: Column, height: Column, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> Column:
    """"Invalid" for an empty image, "Limit" for one too large, null for one that may be decoded."""
    w, h = width.cast("long"), height.cast("long")
    return F.when((w <= 0) | (h <= 0), "Invalid").when((w > max_side) | (h > max_side) | (w * h > max_pixels), "Limit")


def alloc_size(count: Column, size: Column, most: int = MAX_ALLOC) -> Column:
    """Bytes of an allocation, or null where it overflows or is over the limit."""
    total = F.try_multiply(count.cast("long"), size.cast("long"))
    return F.when(total <= most, total)


def png_header(c: Column) -> Column:
    """Width, height, bit depth, colour type and interlacing from a PNG's first chunk, without looking further."""
    ok = (raster_format(c) == "png") & (_hex(c, 13, 4) == "49484452")
    return F.when(ok, F.struct(uint(c, 17, 4).alias("width"), uint(c, 21, 4).alias("height"), uint(c, 25, 1).alias("depth"), uint(c, 26, 1).alias("color_type"), uint(c, 29, 1).alias("interlace")))


def adam7_passes(width: Column, height: Column) -> Column:
    """Sizes of the seven passes of an interlaced image: ``array<struct<pass,w,h>>``."""
    # First column, first row, column step, row step of each pass.
    grid = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]

    def size(full: Column, start: int, step: int) -> Column:
        return F.greatest(F.floor((full - start + step - 1) / step), F.lit(0)).cast("int")

    return F.array(*[F.struct(F.lit(i + 1).alias("pass"), size(width, x, dx).alias("w"), size(height, y, dy).alias("h")) for i, (x, y, dx, dy) in enumerate(grid)])
