"""Per-pixel rules as integer expressions over rows of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div255(v: Column) -> Column:
    """``round(v / 255)`` for 0 to 65025, in integers."""
    t = v.cast("int") + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Naive conversion: what ink leaves of the paper's white, channel by channel."""
    white = F.lit(255) - k.cast("int")
    return F.struct(*[(white - div255(x.cast("int") * white)).alias(n) for n, x in (("r", c), ("g", m), ("b", y))])


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 luma rounded to the nearest integer."""
    return F.floor((r.cast("int") * 299 + g.cast("int") * 587 + b.cast("int") * 114 + 500) / 1000).cast("int")


def oriented(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> Column:
    """Where a stored pixel goes in the upright image: ``struct<x,y>``; orientations outside 2 to 8 leave it."""
    right, down = w - 1 - x, h - 1 - y
    # The eight EXIF orientations.
    to = {2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}
    nx, ny = x, y
    for o, (a, b) in to.items():
        nx, ny = F.when(orientation == o, a).otherwise(nx), F.when(orientation == o, b).otherwise(ny)
    return F.struct(nx.cast("int").alias("x"), ny.cast("int").alias("y"))


def oriented_size(w: Column, h: Column, orientation: Column) -> Column:
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def over_white(sample: Column, alpha: Column) -> Column:
    """A sample with an alpha blended over white."""
    return F.lit(255) - div255((F.lit(255) - sample.cast("int")) * alpha.cast("int"))
