"""A page's recognised words as a report of five levels: page, block, paragraph, line, word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_left(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box with its origin at the page's lower left, clipped to the page and counted from its upper left."""
    clip = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    left, top = clip(box["left"], F.lit(0), width), clip(height - box["top"], F.lit(0), height)
    right, bottom = clip(box["right"], left, width), clip(height - box["bottom"], top, height)
    return {"left": left, "top": top, "width": right - left, "height": bottom - top}


def tsv(words: DataFrame, page: str = "page") -> DataFrame:
    """Rows of all five levels from word rows ``page, block, line, word, x0, y0, x1, y1, certainty, text, page_w, page_h``.

    Blocks and lines are numbered as they come, those without words are not there to be
    numbered; a block has one paragraph with the block's box.  Columns: ``page, level,
    block_num, par_num, line_num, word_num, left, top, width, height, conf, text``.
    """
    in_page = Window.partitionBy(page)
    numbered = words.withColumn("block_num", F.dense_rank().over(in_page.orderBy("block")))
    numbered = numbered.withColumn("line_num", F.dense_rank().over(Window.partitionBy(page, "block").orderBy("line")))
    numbered = numbered.withColumn("word_num", F.row_number().over(Window.partitionBy(page, "block", "line").orderBy("word")))
    united = {"left": F.min("x0"), "bottom": F.min("y0"), "right": F.max("x1"), "top": F.max("y1"), "page_w": F.max("page_w"), "page_h": F.max("page_h")}
    zero, none, empty = F.lit(0), F.lit(-1.0), F.lit("")

    def level(n: int, df: DataFrame, par: Column, line: Column, word: Column, conf: Column, text: Column, box: dict[str, Column]) -> DataFrame:
        out = top_left(box, F.col("page_w"), F.col("page_h"))
        return df.select(page, F.lit(n).alias("level"), F.col("block_num").alias("block_num") if n > 1 else zero.alias("block_num"), par.alias("par_num"), line.alias("line_num"), word.alias("word_num"), *[c.cast("int").alias(k) for k, c in out.items()], conf.alias("conf"), text.alias("text"))

    by_line = numbered.groupBy(page, "block_num", "line_num").agg(*[c.alias(k) for k, c in united.items()])
    again = {"left": F.min("left"), "bottom": F.min("bottom"), "right": F.max("right"), "top": F.max("top"), "page_w": F.max("page_w"), "page_h": F.max("page_h")}
    by_block = by_line.groupBy(page, "block_num").agg(*[c.alias(k) for k, c in again.items()])
    whole = by_block.groupBy(page).agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    box = {k: F.col(k) for k in ("left", "bottom", "right", "top")}
    page_box = {"left": zero, "bottom": zero, "right": F.col("page_w"), "top": F.col("page_h")}
    word_box = {"left": F.col("x0"), "bottom": F.col("y0"), "right": F.col("x1"), "top": F.col("y1")}
    conf = F.least(F.greatest(F.lit(100.0) + 5 * F.col("certainty"), F.lit(0.0)), F.lit(100.0))
    out = level(1, whole, zero, zero, zero, none, empty, page_box)
    out = out.unionByName(level(2, by_block, zero, zero, zero, none, empty, box))
    out = out.unionByName(level(3, by_block, F.lit(1), zero, zero, none, empty, box))
    out = out.unionByName(level(4, by_line, F.lit(1), F.col("line_num"), zero, none, empty, box))
    return out.unionByName(level(5, numbered, F.lit(1), F.col("line_num"), F.col("word_num"), conf, F.col("text"), word_box))


def tsv_line(row: DataFrame, page_no: Column | None = None) -> DataFrame:
    """The report's rows as tab-separated lines, confidences with six decimals."""
    conf = F.when(F.col("level") == 5, F.format_string("%.6f", "conf")).otherwise("-1")
    fields = [F.col("level"), page_no if page_no is not None else F.lit(1), *[F.col(c) for c in ("block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")], conf, F.col("text")]
    return row.withColumn("tsv", F.concat_ws("\t", *[f.cast("string") for f in fields]))
