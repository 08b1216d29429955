"""Statistics over rows of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(pixels: DataFrame, image: str = "img_id", level: str = "level") -> DataFrame:
    """``image, threshold, total, below``: the level that separates two classes best, the lowest on ties.

    Levels are counted first (at most 256 rows an image, partly before the shuffle); the
    cumulative sums then run over those.  Images of a single level have no threshold and no row.
    """
    counts = pixels.groupBy(image, level).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(image).orderBy(level)
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(image)
    weighted = F.col(level).cast("double") * F.col("n")
    sums = counts.select(image, level, F.sum("n").over(so_far).alias("below"), F.sum("n").over(whole).alias("total"), F.sum(weighted).over(so_far).alias("mu"), F.sum(weighted).over(whole).alias("mu_all"))
    above = F.col("total") - F.col("below")
    gap = (F.col("mu_all") - F.col("mu")) / above - F.col("mu") / F.col("below")
    spread = gap * gap * F.col("below") * above
    scored = sums.where((F.col(level) < 255) & (above > 0)).withColumn("spread", spread)
    best = scored.groupBy(image).agg(F.max_by(F.struct(F.col(level).alias("threshold"), "total", "below"), F.struct("spread", -F.col(level))).alias("best"))
    return best.select(image, "best.threshold", "best.total", "best.below")


def polarity(thresholds: DataFrame, image: str = "img_id", channel: str = "channel") -> DataFrame:
    """``image, channel, threshold, hi``: which side of each channel's threshold is ink (0: above it is paper, 1: above it is ink, -1: the channel is left out).

    A channel is clear when over three quarters or under a quarter of its pixels lie below its
    threshold; without a clear channel, the one with the largest paper class decides.
    """
    share = F.col("below") / F.col("total")
    clear = F.when(share > 0.75, 0).when(share < 0.25, 1)
    guess = F.when(share < 0.5, 1).otherwise(0)
    size = F.when(share < 0.5, F.col("total") - F.col("below")).otherwise(F.col("below"))
    of_image = Window.partitionBy(image)
    known = thresholds.withColumns({"clear": clear, "guess": guess, "paper": size})
    ranked = known.withColumns({"any": F.max(F.col("clear").isNotNull()).over(of_image), "place": F.row_number().over(of_image.orderBy(F.desc("paper"), channel))})
    hi = F.when(F.col("any"), F.coalesce("clear", F.lit(-1))).otherwise(F.when(F.col("place") == 1, F.col("guess")).otherwise(-1))
    return ranked.select(image, channel, "threshold", hi.alias("hi"))


def binarised(pixels: DataFrame, thresholds: DataFrame, image: str = "img_id", level: str = "level") -> DataFrame:
    """Pixels with ``black``: on the ink side of the image's threshold."""
    hi = F.when(F.col("below") / F.col("total") < 0.5, 1).otherwise(0)
    sides = thresholds.select(image, "threshold", hi.alias("hi"))
    return pixels.join(sides, image, "left").withColumn("black", F.coalesce((F.col(level) > F.col("threshold")) == (F.col("hi") == 0), F.lit(False))).drop("threshold", "hi")


def halved(pixels: DataFrame, image: str = "img_id") -> DataFrame:
    """Each two by two pixels as their mean, rounded down; odd last rows and columns are left out."""
    cells = pixels.groupBy(image, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("s"))
    return cells.where("n = 4").select(image, "y", "x", F.floor(F.col("s") / 4).cast("int").alias("level"))


def runs(pixels: DataFrame, image: str = "img_id") -> DataFrame:
    """``image, y, x0, x1, black``: runs of equal pixels in each row, from one window over the row."""
    row = Window.partitionBy(image, "y").orderBy("x")
    change = F.when(F.lag("black").over(row) == F.col("black"), 0).otherwise(1)
    numbered = pixels.withColumn("c", change).withColumn("run", F.sum("c").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(image, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("black").alias("black")).drop("run")


def finder_runs(runs_: DataFrame, image: str = "img_id") -> DataFrame:
    """Places where five runs of a row stand to each other as 1:1:3:1:1 within three quarters of a module."""
    row = Window.partitionBy(image, "y").orderBy("x0")
    width = lambda k: F.lag(F.col("x1") - F.col("x0") + 1, k).over(row)
    w = runs_.withColumns({f"p{k}": width(4 - k) for k in range(5)} | {"left": F.lag("x0", 4).over(row)})
    unit = F.floor((F.col("p0") + F.col("p1") + F.col("p3") + F.col("p4")) / 4)
    slack = F.floor(unit * 3 / 4)
    good = F.col("black")
    for k, m in enumerate((1, 1, 3, 1, 1)):
        good = good & F.col(f"p{k}").between(unit * m - slack, unit * m + slack)
    return w.where(good).select(image, "y", F.col("left").alias("x0"), "x1", *[f"p{k}" for k in range(5)])
