"""Reports over rows of metadata tags: ``file, pos, tag_group, name, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import COLOR_FIELDS, PROVENANCE_FIELDS, group_rank


def color_report(tags: DataFrame, file: str = "file") -> DataFrame:
    """``file, name, value``: of each colour field the value of the group that ranks first, the first extracted on ties.

    One grouped aggregation, partly done before its shuffle; tags of other names don't reach it.
    """
    wanted = tags.where(F.col("name").isin(*COLOR_FIELDS))
    return wanted.groupBy(file, "name").agg(F.min_by("value", F.struct(group_rank(F.col("tag_group")).alias("rank"), F.col("pos"))).alias("value"))


def color_columns(tags: DataFrame, file: str = "file") -> DataFrame:
    """The report with a column for each field, null where a file hasn't it."""
    return color_report(tags, file).groupBy(file).pivot("name", list(COLOR_FIELDS)).agg(F.first("value"))


def provenance_fields(tags: DataFrame, file: str = "file") -> DataFrame:
    """``file, field, value``: provenance tags under ``Group:Name``, repeats as ``Group-2:Name`` and so on in the order of extraction."""
    base = F.split_part(F.col("name"), F.lit("-"), F.lit(1))
    number = F.row_number().over(Window.partitionBy(file, "tag_group", "name").orderBy("pos"))
    kept = tags.where(base.isin(*PROVENANCE_FIELDS)).withColumn("number", number)
    field = F.concat("tag_group", F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise(""), F.lit(":"), F.col("name"))
    return kept.select(file, field.alias("field"), "value")


def as_json(rows: DataFrame, file: str, key: str, value: str, name: str = "report") -> DataFrame:
    """A report's rows as one JSON object a file."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    return rows.groupBy(file).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def first_tags(tags: DataFrame, names: list[str] | None = None, file: str = "file") -> DataFrame:
    """``file, key, value``: the first value of each ``Group:Name``, of the base names asked for in any case."""
    if names:
        tags = tags.where(F.lower("name").isin(*[n.lower() for n in names]))
    return tags.groupBy(file, F.concat_ws(":", "tag_group", "name").alias("key")).agg(F.min_by("value", "pos").alias("value"))


def capped(tags: DataFrame, file: str = "file", most_tags: int = 4096, most_value: int = 1 << 20, most_total: int = 8 << 20) -> DataFrame:
    """Tags up to the limits of a file: their number and the running size of their values; longer values are left out."""
    fitting = tags.where(F.octet_length(F.col("value")) <= most_value)
    order = Window.partitionBy(file).orderBy("pos")
    counted = fitting.withColumns({"_n": F.row_number().over(order), "_size": F.sum(F.octet_length("value")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return counted.where((F.col("_n") <= most_tags) & (F.col("_size") <= most_total)).drop("_n", "_size")


def assembled(parts: DataFrame, key: str = "file") -> DataFrame:
    """``key, profile``: numbered parts (``seq, total, data``) put together where all from 1 to one same total are there."""
    grouped = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"), F.min("total").alias("least"), F.max("total").alias("most"), F.count_distinct("seq").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    whole = grouped.where("least = most and n = least and first = 1 and last = least and size(parts) = n")
    return whole.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")).alias("profile"))
