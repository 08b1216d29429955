"""Reports of a file's tags as JSON texts, row by row: the tags are an array column, so nothing is shuffled.

Columns are those of ``media.metadata``: ``tags`` in the order of extraction, ``warnings``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import COLOR_FIELDS, PROVENANCE_FIELDS, group_rank, looks_numeric


def quoted(text: Column) -> Column:
    """A text as JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def tag_json(tag: Column, numbers: bool) -> Column:
    """A tag's value: an integer, a real, a list of strings or a string; with ``numbers``, a string that is written as a number is one."""
    real = F.to_json(F.array(tag["r"]))
    text = quoted(tag["s"])
    if numbers:
        text = F.when(looks_numeric(tag["s"]), tag["s"]).otherwise(text)
    return F.when(tag["kind"] == "int", tag["i"].cast("string")).when(tag["kind"] == "real", F.substring(real, F.lit(2), F.length(real) - 2)).when(tag["kind"] == "list", F.to_json(tag["l"])).otherwise(text)


def _object(entries: Column) -> Column:
    """An object of an array of ``"key":value`` texts in its order."""
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _key(tag: Column) -> Column:
    return F.concat_ws(":", tag["tag_group"], tag["name"])


def _base(tag: Column) -> Column:
    return F.split_part(tag["name"], F.lit("-"), F.lit(1))


def meta_json(path: Column, tags: Column, warnings: Column, names: list[str] | None = None) -> Column:
    """An array of one object: ``SourceFile``, the first value of each ``Group:Name`` (of the base names asked for, in any case), and warnings if there are any."""
    kept = F.filter(tags, lambda t: F.lower(_base(t)).isin(*[n.lower() for n in names])) if names else tags
    keys = F.transform(kept, _key)
    first = F.filter(kept, lambda t, i: F.array_position(keys, _key(t)) == i + 1)
    entries = F.transform(first, lambda t: F.concat(quoted(_key(t)), F.lit(":"), tag_json(t, False)))
    warned = F.when(F.size(warnings) > 0, F.array(F.concat(F.lit('"Warning":'), F.to_json(warnings)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("["), _object(F.concat(F.array(F.concat(F.lit('"SourceFile":'), quoted(path))), entries, warned)), F.lit("]"))


def color_json(tags: Column) -> Column:
    """The colour fields in their fixed order, each from the group that ranks first, the first extracted on ties."""

    def best(field: str) -> Column:
        held = F.filter(tags, lambda t: t["name"] == field)
        ranked = F.transform(held, lambda t: F.struct(group_rank(t["tag_group"]).alias("rank"), t["pos"].alias("pos"), tag_json(t, True).alias("value")))
        value = F.get(F.sort_array(ranked), F.lit(0))["value"]
        return F.concat(F.lit(f'"{field}":'), value)

    return _object(F.filter(F.array(*[best(f) for f in COLOR_FIELDS]), lambda e: e.isNotNull()))


def provenance_json(tags: Column) -> Column:
    """Provenance tags under ``Group:Name`` in the order of extraction, repeats under ``Group-2:Name`` and so on."""
    kept = F.filter(tags, lambda t: _base(t).isin(*PROVENANCE_FIELDS))
    keys = F.transform(kept, _key)

    def entry(t: Column, i: Column) -> Column:
        number = F.size(F.filter(F.slice(keys, F.lit(1), i + 1), lambda k: k == _key(t)))
        group = F.concat(t["tag_group"], F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(""))
        return F.concat(quoted(F.concat_ws(":", group, t["name"])), F.lit(":"), tag_json(t, True))

    return _object(F.transform(kept, entry))


def probe_json(path: Column, probe: Column) -> Column:
    """A picture's container and size in the shape of a media prober's report."""
    stream = F.struct(F.lit("video").alias("codec_type"), probe["width"].alias("width"), probe["height"].alias("height"))
    return F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(path.alias("filename"), probe["format"].alias("format_name")).alias("format")))


def cover_report(cover: Column) -> Column:
    """``media.cover``'s value as probe, colour and provenance reports and QR count; a scan that failed is an error of its own."""
    return F.struct(cover["probe"].alias("probe"), color_json(cover["tags"]).alias("color"), provenance_json(cover["tags"]).alias("provenance"), cover["qr"].alias("qr"))
