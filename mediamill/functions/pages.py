"""Rules over page boxes and document information."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The side that pages are rendered to, and budgets of a document.
RENDER_SIDE, MAX_PAGES, MAX_TOTAL_PIXELS, MAX_INFO_BYTES = 2048, 32, 64_000_000, 64 * 1024
# Size of an A4 page in points.
A4 = (595.0, 842.0)


def render_size(w: Column, h: Column) -> Column:
    """Pixels of a page of ``w`` by ``h`` points: the long side to 2048, the short one in proportion, rounded up; null for a box without a size."""
    w, h = w.cast("float").cast("double"), h.cast("float").cast("double")
    finite = ~(F.isnan(w) | F.isnan(h)) & (F.abs(w) < float("inf")) & (F.abs(h) < float("inf")) & (w > 0) & (h > 0)
    short = F.greatest(F.lit(1), F.least(F.lit(RENDER_SIDE), F.ceil(F.least(w, h) * RENDER_SIDE / F.greatest(w, h)))).cast("int")
    side = F.lit(RENDER_SIDE)
    return F.when(finite, F.struct(F.when(w >= h, side).otherwise(short).alias("w"), F.when(w >= h, short).otherwise(side).alias("h")))


def page_box(media: Column, crop: Column) -> Column:
    """What a page shows: the crop box within the media box (each ``struct<x0,y0,x1,y1>``), A4 if that has no area."""
    box = F.struct(*[f(media[n], F.coalesce(crop[n], media[n])).alias(n) for n, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))])
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h"))).otherwise(F.struct(F.lit(A4[0]).alias("w"), F.lit(A4[1]).alias("h")))


def rotated(size: Column, rotate: Column) -> Column:
    """A page's size after its rotation in degrees."""
    turned = F.pmod(rotate, F.lit(180)) == 90
    return F.struct(F.when(turned, size["h"]).otherwise(size["w"]).alias("w"), F.when(turned, size["w"]).otherwise(size["h"]).alias("h"))


def info_pages(info: Column) -> Column:
    """Pages that an information text names: ``struct<pages,error_class,error>``; the last line of a name counts."""
    def field(name: str) -> Column:
        found = F.regexp_extract_all(info, F.lit(rf"(?m)^{name}:(.*)$"), F.lit(1))
        return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))

    pages = field("Pages").try_cast("int")
    good = F.coalesce(pages.between(1, MAX_PAGES) & field("Encrypted").startswith("no"), F.lit(False))
    long = F.octet_length(info) > MAX_INFO_BYTES
    return F.struct(
        F.when(~long & good, pages).alias("pages"),
        F.when(long, "Limit").when(~good, "Invalid").alias("error_class"),
        F.when(long, "document info exceeded limit").when(~good, "encrypted or oversized document").alias("error"),
    )


def render_arguments(pages: Column) -> Column:
    """Arguments of an external page renderer for the first pages of a document."""
    # The arguments that callers pass.
    fixed = ["-q", "-jpeg", "-r", "110", "-scale-to", "2048", "-f", "1", "-l"]
    return F.array(*[F.lit(x) for x in fixed], pages.cast("string"))


def pdf_version(content: Column) -> Column:
    """Version in a document's header."""
    found = F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"%PDF-(\d\.\d)", 1)
    return F.when(found != "", found)


def ascii_hex(data: Column) -> Column:
    """Bytes of a hexadecimal stream: digits up to ``>``, white space ignored, an odd last digit followed by zero; null for other characters."""
    body = F.regexp_replace(F.substring_index(F.decode(data, "ISO-8859-1"), ">", 1), r"[\x00\s]", "")
    return F.when(body.rlike(r"^[0-9A-Fa-f]*\z"), F.unhex(F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body)))


def exponential(x: Column, c0: Column, c1: Column, n: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Function type 2: an exponential between two arrays of values, the input kept within its domain."""
    t = F.pow(F.least(F.greatest(x, F.lit(low)), F.lit(high)), n)
    return F.zip_with(c0, c1, lambda a, b: a + t * (b - a))


def stitched(x: Column, bounds: list[float], encode: list[tuple[float, float]], parts: list, low: float, high: float) -> Column:
    """Function type 3: the part whose interval holds the input, given it in that part's own range."""
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    edges = [low, *bounds, high]
    out = None
    for i in range(len(parts) - 1, -1, -1):
        a, b = edges[i], edges[i + 1]
        e0, e1 = encode[i]
        inner = F.lit(e0) if a == b else F.lit(e0) + (x - a) * (e1 - e0) / (b - a)
        y = parts[i](inner)
        out = y if out is None else F.when(x < b, y).otherwise(out)
    return out
