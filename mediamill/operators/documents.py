"""Budgets and assembly of documents from rows of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import MAX_PAGES, MAX_TOTAL_PIXELS, render_size
from ..kernels.pdf_write import image_pdf


def page_budget(pages: DataFrame, doc: str = "doc", encrypted: str | None = None) -> DataFrame:
    """``doc, pages, pixels, error_class, error`` from page rows with ``w`` and ``h`` in points, before anything is drawn.

    A document of no page has no row here.  The sums are partial before the shuffle.
    """
    size = render_size(F.col("w"), F.col("h"))
    sums = pages.withColumn("size", size).groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("size.w").cast("long") * F.col("size.h")).alias("pixels"), F.max(F.col("size").isNull()).alias("bad"), *([F.max(encrypted).alias("locked")] if encrypted else [F.lit(False).alias("locked")])
    )
    refused, over = F.col("locked") | (F.col("pages") > MAX_PAGES), F.col("pixels") > MAX_TOTAL_PIXELS
    return sums.select(
        doc, "pages", F.coalesce("pixels", F.lit(0)).alias("pixels"),
        F.when(refused | F.col("bad"), "Invalid").when(over, "Limit").alias("error_class"),
        F.when(refused, "encrypted or oversized document").when(F.col("bad"), "page size").when(over, "document pixel budget exceeded").alias("error"),
    )


def assemble(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """``doc, pdf``: a document of images only from rows ``doc, page_no, w, h, jpeg``; at most 32 pages come together in a row."""
    good = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("pixels"), F.max("page_no").alias("last"), F.count_distinct("page_no").alias("distinct"))
    good = good.where((F.col("n") <= MAX_PAGES) & (F.col("pixels") <= MAX_TOTAL_PIXELS) & (F.col("distinct") == F.col("n")) & (F.col("last") == F.col("n"))).select(doc)
    lists = pages.join(good, doc, "left_semi").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("page_no", "w", "h", "jpeg"))).alias("parts"))

    @F.pandas_udf("binary")
    def write(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: image_pdf([(p["w"], p["h"], bytes(p["jpeg"])) for p in x]))

    return lists.select(doc, write("parts").alias("pdf"))


def frame_errors(frames: DataFrame, doc: str = "doc") -> DataFrame:
    """``doc, error_class, error``: what is wrong with a document's stream of frames (``page_no, w, h, rgb``); null if nothing."""
    checked = frames.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("pixels"),
        F.max((F.col("w") < 1) | (F.col("h") < 1) | (F.col("w") > 2048) | (F.col("h") > 2048)).alias("sides"),
        F.max(F.octet_length("rgb") != F.col("w").cast("long") * F.col("h") * 3).alias("short"),
        F.count_distinct("page_no").alias("distinct"), F.min("page_no").alias("first"), F.max("page_no").alias("last"),
    )
    bad = (F.col("n") > MAX_PAGES) | F.col("sides") | F.col("short") | (F.col("distinct") != F.col("n")) | (F.col("first") != 1) | (F.col("last") != F.col("n"))
    over = F.col("pixels") > MAX_TOTAL_PIXELS
    return checked.select(doc, F.when(bad, "Invalid").when(over, "Limit").alias("error_class"), F.when(bad, "malformed frame stream").when(over, "document pixel budget exceeded").alias("error"))


def frame_stream(frames: DataFrame, doc: str = "doc") -> DataFrame:
    """``doc, stream``: the byte form of a document's frames - a magic word, their number, then width, height and samples of each."""
    def word(c):
        """Four bytes, the lowest first, as hexadecimal digits."""
        digits = F.lpad(F.hex(c.cast("long")), 8, "0")
        return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])

    one = F.concat(word(F.col("w")), word(F.col("h")), F.hex("rgb"))
    rows = frames.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("page_no", one.alias("body")))).alias("all"))
    # Fixed value: the magic word of the stream.
    return rows.select(doc, F.concat(F.lit("APDFRGB1").cast("binary"), F.unhex(F.concat(word(F.size("all")), F.array_join(F.transform("all", lambda x: x["body"]), "")))).alias("stream"))
