"""Rules of QR symbols, JPEG tables, ICC headers and recognised words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qr_mask(mask: Column, i: Column, j: Column) -> Column:
    """Whether a mask pattern inverts the module in row ``i`` and column ``j``."""
    product = i * j
    # The eight mask patterns of the standard.
    rules = [(i + j) % 2, i % 2, j % 3, (i + j) % 3, (F.floor(i / 2) + F.floor(j / 3)) % 2, product % 2 + product % 3, (product % 2 + product % 3) % 2, (product % 3 + (i + j) % 2) % 2]
    out = rules[7] == 0
    for k in range(6, -1, -1):
        out = F.when(mask == k, rules[k] == 0).otherwise(out)
    return out


def alignment_centres(version: int) -> list[int]:
    """Rows (and columns) of alignment patterns: evenly spaced from the far side, by an even step, the first at 6."""
    if version == 1:
        return []
    count, size = version // 7 + 2, 17 + 4 * version
    step = 26 if version == 32 else (version * 4 + count * 2 + 1) // (count * 2 - 2) * 2
    return sorted({6, *(size - 7 - k * step for k in range(count - 1))})


def qr_reserved(version: Column, i: Column, j: Column) -> Column:
    """Whether a module belongs to finder, timing, alignment, format or version patterns rather than to data."""
    size = version * 4 + 17
    corners = ((i < 9) & (j < 9)) | ((i >= size - 8) & (j < 9)) | ((i < 9) & (j >= size - 8)) | (i == 6) | (j == 6)
    numbers = (version >= 7) & (((i < 6) & (j >= size - 11)) | ((i >= size - 11) & (j < 6)))
    centres = F.create_map(*[x for v in range(1, 41) for x in (F.lit(v), F.array(*[F.lit(c) for c in alignment_centres(v)]).cast("array<int>"))])
    at = F.element_at(centres, version.cast("int"))
    last = F.element_at(F.when(F.size(at) > 0, at), -1)

    def near(x: Column) -> Column:
        return F.element_at(F.concat(F.filter(at, lambda c: F.abs(c - x) < 3), F.array(F.lit(None).cast("int"))), 1)

    ci, cj = near(i), near(j)
    between = lambda c: (c > 6) & (c < last)
    aligned = ci.isNotNull() & cj.isNotNull() & (between(ci) | between(cj) | ((ci == last) & (cj == last)))
    return corners | numbers | F.coalesce(aligned, F.lit(False))


def format_words() -> list[int]:
    """The 32 code words of the BCH(15,5) code, by polynomial division."""
    out = []
    for data in range(32):
        word = data << 10
        for bit in range(14, 9, -1):
            if word >> bit & 1:
                word ^= 0x537 << (bit - 10)
        out.append(data << 10 | word)
    return out


def nearest_format(raw: Column) -> Column:
    """The code word nearest to a read one, the first on ties; null if more than three bits differ."""
    words = F.array(*[F.struct(F.bit_count(raw.cast("int").bitwiseXOR(F.lit(w))).alias("distance"), F.lit(i).alias("place"), F.lit(w).alias("word")) for i, w in enumerate(format_words())])
    best = F.array_min(words)
    return F.when(best["distance"] <= 3, best["word"])


def quantiser(basic: Column, quality: Column) -> Column:
    """A quantisation table scaled to a quality of 1 to 100."""
    q = F.least(F.greatest(quality, F.lit(1)), F.lit(100)).cast("int")
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q)
    return F.transform(basic, lambda v: F.least(F.greatest(F.floor((v * scale + 50) / 100), F.lit(1)), F.lit(255)).cast("int"))


def color_transform(ids: Column, jfif: Column, adobe: Column) -> Column:
    """How decoded components become colours, from their identifiers and the application markers."""
    three = F.when(jfif, "ycbcr").when(adobe.isNotNull(), F.when(adobe == 0, "rgb").otherwise("ycbcr")).when(ids == F.array(F.lit(82), F.lit(71), F.lit(66)), "rgb").otherwise("ycbcr")
    four = F.when(adobe.isNull() | (adobe == 0), "cmyk").otherwise("ycck")
    return F.when(F.size(ids) == 3, three).when(F.size(ids) == 4, four).otherwise("gray")


def icc_profile_id(icc: Column) -> Column:
    """The profile's own digest in its header, in lower-case hexadecimal digits."""
    return F.lower(F.hex(F.substring(icc, 85, 16)))


def icc_major_version(icc: Column) -> Column:
    return F.conv(F.hex(F.substring(icc, 9, 1)), 16, 10).cast("int")


def icc_is_v4(icc: Column) -> Column:
    return icc_major_version(icc) >= 4


def lab_to_xyz(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """CIE L*a*b* to XYZ under D50."""
    # The D50 white point.
    white = {"x": 0.9642, "y": 1.0, "z": 0.8249}
    fy = (l + 16) / 116
    f = {"x": fy + a / 500, "y": fy, "z": fy - b / 200}
    back = lambda t: F.when(t > 24 / 116, t * t * t).otherwise((t - 16 / 116) * 108 / 841)
    return F.struct(*[(F.lit(white[n]) * back(f[n])).alias(n) for n in "xyz"])


def confidence(certainty: Column) -> Column:
    """A word's confidence from 0 to 100."""
    return F.least(F.greatest(F.lit(100.0) + 5 * certainty, F.lit(0.0)), F.lit(100.0))
