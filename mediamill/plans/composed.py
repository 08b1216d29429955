"""Queries over composed files (:mod:`mediamill.composers`): what the engine reads from them, and the SQL that says it from the rows.

Composers don't use the engine's readers, so a query fails if either side departs from the
format.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import composers
from ..functions import digests, encodings, media, report_json, tables
from ..sources.files import read_media
from .queries import query, spread, table

_VALUE = "coalesce(t.s, cast(t.i AS string), cast(t.r AS string), array_join(t.l, '|'))"


def _tags(files, *keys: str):
    """All tags of files as rows, read from their parts alone, with whether reading the whole file gives the same."""
    read = files.select(*keys, media.metadata_lean(F.col("content")).alias("lean"), media.metadata(F.col("content")).alias("whole"), F.octet_length("content").alias("size"))
    same = F.col("lean.value.tags") == F.col("whole.value.tags")
    each = read.select(*keys, same.alias("same"), (F.col("lean.value.bytes_read") < F.col("size")).alias("part"), F.explode("lean.value.tags").alias("t"))
    return each.select(*keys, "same", "part", F.col("t.pos").alias("pos"), F.concat_ws(":", "t.tag_group", "t.name").alias("tag"), F.expr(_VALUE).alias("value"))


def _expected(source: str, keys: str, rows: list[tuple[str, str]], part: str = "true") -> str:
    """SQL of tags in their order: names and expressions over a row."""
    values = ", ".join(f"({i}, '{tag}', ({value})::VARCHAR)" for i, (tag, value) in enumerate(rows))
    return f"SELECT {keys}, true AS same, {part} AS part, pos::INT AS pos, tag, value FROM {source}, LATERAL (VALUES {values}) AS v(pos, tag, value)"


_SUPPLIER = {"source": "supplier", "keys": "s_suppkey"}


def _supplier_files(spark, d, compose):
    rows = spread(table(spark, d, "supplier"))
    return rows.select("s_suppkey", composers.column(compose)(F.col("s_name"), F.col("s_suppkey")).alias("content"))


# --- tags of audio files -------------------------------------------------------------------------------------------


@query(_expected(**_SUPPLIER, rows=[("RIFF:Description", "s_name"), ("RIFF:Originator", "'by ' || s_suppkey"), ("RIFF:OriginatorReference", "'ref ' || s_suppkey"), ("RIFF:CodingHistory", "'made'"), ("RIFF:BitsPerSample", "24"), ("RIFF:Title", "s_name"), ("RIFF:IXYZ", "s_suppkey"), ("ID3v2_4:Title", "s_name")]))
def broadcast_wave_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.broadcast_wave), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("AIFF:Name", "s_name"), ("AIFF:Author", "'author ' || s_suppkey"), ("AIFF:Copyright", "'nobody'"), ("AIFF:Annotation", "'note ' || s_suppkey"), ("AIFF:Comment", "'one'"), ("AIFF:Comment", "s_name")]))
def aiff_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.aiff), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("ID3v2_2:Title", "s_name"), ("FLAC:BitsPerSample", "24"), ("Vorbis:Vendor", "'maker'"), ("Vorbis:Title", "s_name"), ("Vorbis:TrackNumber", "s_suppkey"), ("Vorbis:MyOwnKey", "'x'")]))
def flac_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.flac), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("ItemList:Title", "s_name"), ("ItemList:AlbumArtist", "s_suppkey || 'é'"), ("ItemList:OwnTag", "s_suppkey"), ("UserData:Comment", "s_name")]))
def mp4_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.mp4), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("RIFF:BitsPerSample", "16"), ("RIFF:Software", "s_name"), ("ID3v1:Title", "s_name"), ("ID3v1:Artist", "'artist'"), ("ID3v1:Year", "1999"), ("ID3v1:Comment", "'c' || s_suppkey"), ("APE:Title", "s_name"), ("APE:ToolName", "'tool ' || s_suppkey")]))
def wavpack_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.wavpack), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("ID3v2_3:UserDefinedText", "'(Encoder) ' || s_name"), ("ID3v2_3:Encoder", "s_name"), ("ID3v2_3:Comment", "s_name"), ("ID3v2_3:Track", "s_suppkey"), ("ID3v2_3:EncoderSettings", "'é' || s_suppkey"), ("ID3v2_3:Encoder", "'é' || s_suppkey"), ("ID3v2_3:TZZZ", "'ÿ'"), ("ID3v1:Album", "s_name"), ("APE:Comment", "s_name")]))
def tta_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.tta), "s_suppkey")


# --- tags of pictures ----------------------------------------------------------------------------------------------

_JPEG = [("File:EncodingProcess", "0"), ("File:BitsPerSample", "8"), ("File:ImageHeight", "8"), ("File:ImageWidth", "8"), ("File:ColorComponents", "1")]
_PNG = [("PNG:ImageWidth", "1"), ("PNG:ImageHeight", "1"), ("PNG:BitDepth", "8"), ("PNG:ColorType", "0"), ("PNG:Compression", "0"), ("PNG:Filter", "0"), ("PNG:Interlace", "0")]
_EXIF = [("JFIF:JFIFVersion", "'1.02'"), ("IFD0:BitsPerSample", "'8 8 ' || p_size"), ("IFD0:Make", "p_name"), ("IFD0:Orientation", "p_partkey % 8 + 1"), ("IFD0:XResolution", "CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE (p_size / 4)::VARCHAR END")]
_EXIF += [("ExifIFD:ISO", "100 + p_size"), ("ExifIFD:UserComment", "p_name"), ("ExifIFD:LensModel", "'lens ' || p_partkey"), ("IFD0:XPTitle", "p_name"), ("IFD1:Compression", "6"), ("File:Comment", "'note ' || p_partkey"), ("JFIF:JFIFVersion", "'1.01'"), *_JPEG]


@query(_expected("part", "p_partkey", _EXIF, "false"))
def exif_tags(spark, d):
    """Without the exposure time, whose decimal digits engines write differently; the places close up."""
    made = spread(table(spark, d, "part")).select("p_partkey", composers.column(composers.exif_jpeg)(F.col("p_name"), F.col("p_partkey"), F.col("p_size")).alias("content"))
    got = _tags(made, "p_partkey").where("tag != 'ExifIFD:ExposureTime'")
    return got.withColumn("pos", F.col("pos") - F.when(F.col("pos") > 5, 1).otherwise(0))


_XMP = [("XMP-xmp:CreatorTool", "'tool & ' || s_suppkey"), ("XMP-photoshop:Credit", "text"), ("XMP-dc:Title", "text"), ("XMP-dc:Title-de", "'T ' || s_suppkey"), ("XMP-dc:Subject", "'aA|' || text"), ("XMP-dc:Creator", "'c ' || s_suppkey")]
_ODD_TEXT = "(SELECT s_suppkey, '<' || s_name || ' & \"' || floor(s_acctbal)::BIGINT || '\"' AS text FROM supplier)"


def _odd_text_files(spark, d, compose):
    rows = spread(table(spark, d, "supplier"))
    text = F.concat(F.lit("<"), "s_name", F.lit(' & "'), F.floor("s_acctbal").cast("long").cast("string"), F.lit('"'))
    return rows.select("s_suppkey", composers.column(compose)(text, F.col("s_suppkey")).alias("content"))


@query(_expected(_ODD_TEXT, "s_suppkey", [*_PNG, *_XMP], "false"))
def xmp_tags(spark, d):
    return _tags(_odd_text_files(spark, d, composers.xmp_png), "s_suppkey")


@query(_expected(_ODD_TEXT, "s_suppkey", [("JFIF:JFIFVersion", "'1.01'"), *_JPEG, *_XMP], "false"))
def extended_xmp_tags(spark, d):
    return _tags(_odd_text_files(spark, d, composers.extended_xmp_jpeg), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[*_PNG, ("PNG:Comment", "s_name"), ("PNG:PromptText", "'packed ' || s_suppkey"), ("PNG:Title-de", "s_name"), ("PNG:Gamma", "'2.19998'"), ("PNG:SRGBRendering", "s_suppkey % 4"), ("IFD0:Software", "s_name")], part="false"))
def png_text_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.text_chunks_png), "s_suppkey")


_PROFILE = [("ICC_Profile:ProfileDescription", "s_name"), ("ICC-header:ProfileID", "'0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0'"), ("ICC-header:ColorSpaceData", "'RGB'")]
_RGB_PNG = [(t, "2" if t == "PNG:ColorType" else v) for t, v in _PNG]


@query(_expected(**_SUPPLIER, rows=[*_RGB_PNG, ("PNG:ProfileName", "'p' || s_suppkey"), *_PROFILE], part="false"))
def png_profile_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.profile_png), "s_suppkey")


@query(_expected(**_SUPPLIER, rows=[("JFIF:JFIFVersion", "'1.01'"), *_JPEG, *_PROFILE], part="false"))
def jpeg_profile_tags(spark, d):
    return _tags(_supplier_files(spark, d, composers.profile_jpeg), "s_suppkey")


@query("SELECT s_suppkey, s_name AS description, 'RGB ' AS space, false AS v4, name, idx::INT AS idx FROM supplier, LATERAL (VALUES (0, 'desc'), (1, 'wtpt'), (2, 'rXYZ'), (3, 'gXYZ'), (4, 'bXYZ'), (5, 'rTRC'), (6, 'gTRC'), (7, 'bTRC')) AS v(idx, name)")
def profile_tables(spark, d):
    files = _supplier_files(spark, d, composers.profile)
    facts = files.select("s_suppkey", "content", media.icc_info(F.col("content")).alias("r")).where("r.ok")
    facts.createOrReplaceTempView("profiles_here")
    spark.udtf.register("icc_tags", tables.IccTags)
    return spark.sql("SELECT s_suppkey, r.value.description AS description, r.value.space AS space, r.value.v4 AS v4, t.name, t.idx FROM profiles_here, LATERAL icc_tags(content) t")


@query("SELECT p_partkey, how, CASE WHEN how = 'many' THEN NULL WHEN p_partkey % 8 + 1 >= 5 THEN p_size ELSE p_size + 3 END::INT AS width, CASE WHEN how = 'many' THEN NULL WHEN p_partkey % 8 + 1 >= 5 THEN p_size + 3 ELSE p_size END::INT AS height, CASE WHEN how = 'many' THEN 'Invalid' END AS error_class FROM part, (VALUES ('exif'), ('xmp'), ('many')) AS h(how)")
def oriented_pictures(spark, d):
    """Turns from EXIF or, without it, XMP; a file of several pictures is refused."""
    rows = spread(table(spark, d, "part"))
    turn = (F.col("p_partkey") % 8 + 1).cast("int")
    made = [
        rows.select("p_partkey", F.lit(how).alias("how"), composers.column(composers.oriented_jpeg)(F.col("p_size") + 3, F.col("p_size"), turn, F.lit(how == "xmp")).alias("content")) for how in ("exif", "xmp")
    ]
    made.append(rows.select("p_partkey", F.lit("many").alias("how"), composers.column(composers.multi_picture_jpeg)(F.col("p_partkey") % 3 + 2).alias("content")))
    got = made[0].union(made[1]).union(made[2]).select("p_partkey", "how", media.pixels(F.col("content")).alias("r"))
    return got.select("p_partkey", "how", "r.value.width", "r.value.height", "r.error_class")


_J = "to_json({})::VARCHAR"
_META_JSON = "'[{{\"SourceFile\":' || " + _J.format("'a/' || s_suppkey || '.png'") + " || ',\"XMP-xmp:CreatorTool\":' || " + _J.format("'tool & ' || s_suppkey") + " || ',\"XMP-dc:Title\":' || " + _J.format("text") + " || ',\"XMP-dc:Title-de\":' || " + _J.format("'T ' || s_suppkey") + " || ',\"XMP-dc:Subject\":' || " + _J.format("['aA', text]") + " || '}}]'"


@query(f"SELECT s_suppkey, {_META_JSON.replace('{{', '{').replace('}}', '}')} AS json FROM {_ODD_TEXT}")
def meta_json(spark, d):
    """The first value of each tag asked for, as one object a file."""
    files = _odd_text_files(spark, d, composers.xmp_png)
    read = files.select("s_suppkey", media.metadata(F.col("content"))["value"].alias("m"))
    path = F.concat(F.lit("a/"), F.col("s_suppkey").cast("string"), F.lit(".png"))
    return read.select("s_suppkey", report_json.meta_json(path, F.col("m.tags"), F.col("m.warnings"), ["creatortool", "TITLE", "Subject"]).alias("json"))


@query("""SELECT p_partkey, '{"streams":[{"codec_type":"video","width":' || (p_size + 3) || ',"height":' || p_size || '}],"format":{"filename":"' || p_name || '","format_name":"jpeg_pipe"}}' AS probe,
'{"BitsPerSample":8,"ColorComponents":1,"Orientation":1}' AS color, '{}' AS provenance FROM part""")
def probe_json(spark, d):
    rows = spread(table(spark, d, "part"))
    made = rows.select("p_partkey", "p_name", composers.column(composers.oriented_jpeg)(F.col("p_size") + 3, F.col("p_size"), F.lit(1), F.lit(False)).alias("content"))
    got = made.select("p_partkey", "p_name", media.cover(F.col("content"))["value"].alias("c")).withColumn("report", report_json.cover_report(F.col("c")))
    return got.select("p_partkey", report_json.probe_json(F.col("p_name"), F.col("report.probe")).alias("probe"), "report.color", "report.provenance")


@query("""SELECT s_suppkey, '{"ColorType":2,"BitDepth":8,"ProfileDescription":"' || s_name || '","ProfileID":"0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0"}' AS color FROM supplier""")
def color_json(spark, d):
    got = _supplier_files(spark, d, composers.profile_png).select("s_suppkey", media.cover(F.col("content"))["value"].alias("c"))
    return got.select("s_suppkey", report_json.cover_report(F.col("c"))["color"].alias("color"))


@query("""SELECT s_suppkey, '{"PNG:Comment":"' || s_name || '","IFD0:Software":"' || s_name || '"}' AS provenance FROM supplier""")
def provenance_json(spark, d):
    got = _supplier_files(spark, d, composers.text_chunks_png).select("s_suppkey", media.cover(F.col("content"))["value"].alias("c"))
    return got.select("s_suppkey", report_json.cover_report(F.col("c"))["provenance"].alias("provenance"))


# --- pixels ----------------------------------------------------------------------------------------------------------

_HEX = "string_agg(printf('%02X', v::INT), '' ORDER BY y, x, c)"
_KINDS = "(VALUES (0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)) AS k(color, depth)"


@query(f"""WITH s AS (SELECT n_nationkey, color, depth, laced, y, x, c, (n_nationkey * 7 + x * 13 + y * 5 + (CASE WHEN color = 3 THEN 0 ELSE c END) * 3) % (1 << depth) AS s
FROM nation, {_KINDS}, (VALUES (false), (true)) AS l(laced), range(6) AS ys(y), range(9) AS xs(x), range(4) AS cs(c) WHERE c < CASE color WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 4 END),
v AS (SELECT *, CASE WHEN color = 3 THEN (3 * s + c) % 256 WHEN depth = 16 THEN s >> 8 ELSE s * 255 // ((1 << depth) - 1) END AS v FROM s)
SELECT n_nationkey, color::INT AS color, depth::INT AS depth, laced, CASE color WHEN 0 THEN 'gray8' WHEN 4 THEN 'gray_alpha8' WHEN 6 THEN 'rgba8' ELSE 'rgb8' END AS format, {_HEX} AS pixels FROM v GROUP BY ALL""")
def png_pixels(spark, d):
    """Every colour type and depth, all five filters, in one pass and in seven."""
    rows = table(spark, d, "nation").select("n_nationkey")
    kinds = spark.createDataFrame([(c, p, i) for c, depths in {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}.items() for p in depths for i in (False, True)], "color int, depth int, laced boolean")
    made = spread(rows.join(F.broadcast(kinds))).select("n_nationkey", "color", "depth", "laced", composers.column(composers.any_png)(F.col("n_nationkey"), F.col("color"), F.col("depth"), F.col("laced")).alias("content"))
    got = made.select("n_nationkey", "color", "depth", "laced", media.decode(F.col("content")).alias("r"))
    return got.select("n_nationkey", "color", "depth", "laced", "r.value.format", F.hex("r.value.data").alias("pixels"))


_GRAY = "SELECT n_nationkey, y, x, (n_nationkey * 7 + x * 13 + y * 29) % 256 AS g FROM nation, range(8) AS ys(y), range(12) AS xs(x)"
_AT = "(SELECT g FROM px AS p WHERE p.n_nationkey = o.n_nationkey AND p.y = least(7, greatest(0, {y})) AND p.x = least(11, greatest(0, {x})))"


@query(f"""WITH px AS ({_GRAY}),
halved AS (SELECT n_nationkey, 'halve' AS how, y // 2 AS y, x // 2 AS x, sum(g)::BIGINT // 4 AS v FROM px GROUP BY ALL),
area AS (SELECT n_nationkey, 'area' AS how, y // 4 AS y, x // 4 AS x, floor(sum(g) / 16.0 + 0.5)::BIGINT AS v FROM px GROUP BY ALL),
box AS (SELECT a.n_nationkey, a.y, a.x, sum(p.g)::BIGINT AS total FROM px AS a, range(-1, 2) AS dys(dy), range(-1, 2) AS dxs(dx), px AS p WHERE p.n_nationkey = a.n_nationkey AND p.y = least(7, greatest(0, a.y + dy)) AND p.x = least(11, greatest(0, a.x + dx)) GROUP BY ALL),
smooth AS (SELECT n_nationkey, 'smooth' AS how, y, x, (total + 4) // 9 AS v FROM box),
unsharp AS (SELECT n_nationkey, 'unsharp' AS how, y, x, least(255, greatest(0, floor(g + 0.5::DOUBLE * (g - (total + 4) // 9) + 0.5)))::BIGINT AS v FROM box JOIN px USING (n_nationkey, y, x)),
big AS (SELECT n_nationkey, y, x, y // 2 AS y0, least(7, y // 2 + 1) AS y1, 8 * (y % 2) AS yf, x // 2 AS x0, least(11, x // 2 + 1) AS x1, 8 * (x % 2) AS xf FROM nation, range(16) AS ys(y), range(24) AS xs(x)),
doubled AS (SELECT o.n_nationkey, 'linear' AS how, o.y, o.x, ((a.g * (16 - xf) + b.g * xf) * (16 - yf) + (c.g * (16 - xf) + e.g * xf) * yf + 128) // 256 AS v FROM big AS o
JOIN px AS a ON a.n_nationkey = o.n_nationkey AND a.y = y0 AND a.x = x0 JOIN px AS b ON b.n_nationkey = o.n_nationkey AND b.y = y0 AND b.x = x1 JOIN px AS c ON c.n_nationkey = o.n_nationkey AND c.y = y1 AND c.x = x0 JOIN px AS e ON e.n_nationkey = o.n_nationkey AND e.y = y1 AND e.x = x1),
every AS (SELECT * FROM halved UNION ALL SELECT * FROM area UNION ALL SELECT * FROM smooth UNION ALL SELECT * FROM unsharp UNION ALL SELECT * FROM doubled)
SELECT n_nationkey, how, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height, string_agg(printf('%02X', v::INT), '' ORDER BY y, x) AS pixels FROM every GROUP BY ALL""")
def resampled_pixels(spark, d):
    """Halving, area means, doubling between pixels, box means and sharpening, pixel by pixel."""
    made = spread(table(spark, d, "nation")).select("n_nationkey", composers.column(composers.gray_picture)(F.col("n_nationkey"), F.lit(12), F.lit(8)).alias("content"))
    steps = [("halve", 0.0, 0.0), ("area", 0.25, 0.25), ("smooth", 1.0, 0.0), ("unsharp", 1.0, 0.5), ("linear", 2.0, 2.0)]
    parts = [made.select("n_nationkey", F.lit(how).alias("how"), media.resampled(F.col("content"), F.lit(how), F.lit(x), F.lit(y)).alias("r")) for how, x, y in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("n_nationkey", "how", "r.value.width", "r.value.height", F.hex("r.value.data").alias("pixels"))


_FOUR = "p_partkey, p_size * 5 AS a, p_partkey % 256 AS b, p_size * 3 AS c, (p_partkey * 7) % 256 AS d"
_OVER = "(255 - (((255 - {v}) * {a} + 128 + (((255 - {v}) * {a} + 128) >> 8)) >> 8))"


@query(f"""WITH s AS (SELECT {_FOUR}, k AS channels FROM part, (VALUES (1), (2), (3), (4)) AS t(k)),
w AS (SELECT p_partkey, channels, CASE channels WHEN 2 THEN {_OVER.format(v="a", a="b")} WHEN 4 THEN {_OVER.format(v="a", a="d")} ELSE a END AS r, CASE channels WHEN 4 THEN {_OVER.format(v="b", a="d")} ELSE b END AS g, CASE channels WHEN 4 THEN {_OVER.format(v="c", a="d")} ELSE c END AS bl FROM s)
SELECT p_partkey, channels::INT AS channels, (CASE WHEN channels < 3 THEN r ELSE floor((0.3::FLOAT * r::FLOAT + 0.5::FLOAT * g::FLOAT + 0.2::FLOAT * bl::FLOAT)::DOUBLE + 0.5) END)::INT AS gray FROM w""")
def page_gray_pixels(spark, d):
    """Luminance of page pixels, alpha laid over white first."""
    rows = spread(table(spark, d, "part"))
    values = [F.col("p_size") * 5, F.col("p_partkey") % 256, F.col("p_size") * 3, (F.col("p_partkey") * 7) % 256]
    kinds = rows.select("p_partkey", *[v.cast("int").alias(n) for v, n in zip(values, "abcd", strict=True)], F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("channels"))
    made = kinds.select("p_partkey", "channels", composers.column(composers.one_pixel)("channels", "a", "b", "c", "d").alias("content"))
    got = made.select("p_partkey", "channels", media.page_gray(F.col("content")).alias("r"))
    return got.select("p_partkey", "channels", F.conv(F.hex("r.value.data"), 16, 10).cast("int").alias("gray"))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 5 + 1 AS n, p_size % 7 + 3 AS w, p_size % 11 + 3 AS h FROM part)
SELECT p_partkey, (n * w * h)::INT AS ink, (n * (w + 2) * (h + 2))::INT AS dilated, (n * (w - 2) * (h - 2))::INT AS eroded, (n * w * h)::INT AS opened, (n * w * h)::INT AS closed, (w * h)::INT AS filled, n::INT AS parts_4, n::INT AS parts_8, ((least(w, h) + 1) // 2)::INT AS deepest, n::INT AS outlines FROM b""")
def ink_morphology(spark, d):
    """Threshold, bricks, seed fill, parts, depths and outlines of boxes."""
    rows = spread(table(spark, d, "part"))
    made = rows.select("p_partkey", composers.column(composers.boxes_picture)((F.col("p_partkey") % 5 + 1).cast("int"), (F.col("p_size") % 7 + 3).cast("int"), (F.col("p_size") % 11 + 3).cast("int")).alias("content"))
    got = made.select("p_partkey", media.ink(F.col("content")).alias("r"))
    return got.select("p_partkey", *[f"r.value.{x}" for x in ("ink", "dilated", "eroded", "opened", "closed", "filled", "parts_4", "parts_8", "deepest", "outlines")])


@query("SELECT p_partkey, (p_partkey % 5 + 1)::INT AS parts, 0 AS rules, ((p_partkey % 5 + 1) * (p_size % 7 + 4) * (p_size % 11 + 6))::BIGINT AS ink, (40 * ((p_partkey % 5 + 1) // 2) + 20)::INT AS middle FROM part")
def page_parts(spark, d):
    """Ink parts of a page image once rules and pictures are away."""
    rows = spread(table(spark, d, "part"))
    made = rows.select("p_partkey", composers.column(composers.boxes_picture)((F.col("p_partkey") % 5 + 1).cast("int"), (F.col("p_size") % 7 + 4).cast("int"), (F.col("p_size") % 11 + 6).cast("int")).alias("content"))
    got = made.select("p_partkey", media.page_layout(F.col("content")).alias("r")).select("p_partkey", "r.value.*")
    lefts = F.sort_array(F.transform("parts", lambda p: p["left"]))
    return got.select("p_partkey", F.size("parts").alias("parts"), "rules", "ink", F.element_at(lefts, (F.size("parts") / 2).cast("int") + 1).alias("middle"))


@query("""WITH b AS (SELECT n_nationkey, how, 1 + n_nationkey % 9 AS n FROM nation, (VALUES ('baseline'), ('restart'), ('progressive')) AS h(how)),
px AS (SELECT n_nationkey, how, n, y, i, x, (n_nationkey * 7 + i * 13) % 200 + 28 AS v FROM b, range(8) AS ys(y), range(9) AS bs(i), range(8) AS xs(x) WHERE i < n)
SELECT n_nationkey, how, (8 * max(n))::INT AS width, string_agg(printf('%02X', v::INT), '' ORDER BY y, i, x) AS pixels FROM px GROUP BY ALL""")
def jpeg_blocks(spark, d):
    """Flat blocks in sequence, with restarts, and in four progressive scans."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(h) for h in ("baseline", "restart", "progressive")])).alias("how"))
    key = F.col("n_nationkey").cast("int")
    made = spread(rows).select("n_nationkey", "how", composers.column(composers.level_blocks)(key, key % 9 + 1, "how").alias("content"))
    got = made.select("n_nationkey", "how", media.decode(F.col("content")).alias("r"))
    return got.select("n_nationkey", "how", "r.value.width", F.hex("r.value.data").alias("pixels"))


@query("SELECT n_nationkey, turn::INT AS turn, (n_nationkey % 10 + 1)::INT AS version, 1 AS decoded FROM nation, range(8) AS t(turn)")
def turned_symbols(spark, d):
    """Symbols of versions 1 to 10, turned and mirrored, with modules to mend."""
    rows = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 10 + 1).cast("int").alias("version"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("turn"))
    made = spread(rows).select("n_nationkey", "turn", "version", composers.column(composers.turned_symbol)("version", "turn", (F.col("n_nationkey") % 5).cast("int")).alias("content"))
    return made.select("n_nationkey", "turn", "version", media.qr_scan(F.col("content")).alias("r")).select("n_nationkey", "turn", "version", "r.value.decoded")


@query("""SELECT p_partkey, pos::INT AS pos, code::INT AS code, cid::INT AS cid, text FROM part, LATERAL (VALUES (0, 32 + p_size, 100 + p_size, CASE WHEN p_size BETWEEN 16 AND 25 THEN chr((97 + p_size - 16)::INT) END), (1, 33089, p_partkey + 5, NULL), (2, 255, NULL, NULL)) AS v(pos, code, cid, text)""")
def character_maps(spark, d):
    """Codes of one and two bytes through an embedded character map, and one that it doesn't know."""
    rows = spread(table(spark, d, "part"))
    size = F.col("p_size").cast("int")
    made = rows.select("p_partkey", composers.column(composers.character_map)(F.lit(100), F.col("p_partkey") + 5).alias("content"), F.unhex(F.concat(F.lpad(F.hex(size + 32), 2, "0"), F.lit("8141FF"))).alias("text"))
    got = made.select("p_partkey", F.posexplode(media.character_codes(F.col("content"), F.col("text"))["value"]).alias("pos", "c"))
    return got.select("p_partkey", "pos", "c.code", "c.cid", "c.text")


@query("""SELECT p_partkey, kind, 'rgb8' AS format, true AS alike FROM part, (VALUES ('gray'), ('colour')) AS k(kind)""")
def profiled_pixels(spark, d):
    """Pixels through profiles of gammas 1.0 to 3.0: within one level of the gamma's curve and the target's."""
    rows = spread(table(spark, d, "part"))
    gamma = F.lit(1.0) + (F.col("p_partkey") % 5) * 0.5
    own = [(F.col("p_partkey") % 256).cast("int"), (F.col("p_size") * 5).cast("int"), ((F.col("p_partkey") * 7 + 1) % 256).cast("int")]
    parts = []
    for kind, values in (("gray", [own[0]] * 3), ("colour", own)):
        part = rows.select("p_partkey", F.lit(kind).alias("kind"), F.array(*values).alias("v"), gamma.alias("gamma"), composers.column(composers.profiled_pixel)(gamma, *values).alias("content"))
        parts.append(part.where("kind = 'gray' or not (v[0] = v[1] and v[1] = v[2])").select("p_partkey", "kind", "v", "gamma", media.pixels(F.col("content")).alias("r")))
    got = parts[0].union(parts[1])
    levels = [F.conv(F.substring(F.hex("r.value.data"), 2 * i + 1, 2), 16, 10).cast("double") for i in range(3)]
    linear = [F.pow(F.col("v")[i] / 255, F.col("gamma")) for i in range(3)]
    curve = [F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) for x in linear]
    alike = F.lit(True)
    for a, b in zip(levels, curve, strict=True):
        alike = alike & (F.abs(a - 255 * b) <= 1.5)
    return got.select("p_partkey", "kind", F.col("r.value.format").alias("format"), alike.alias("alike"))


@query("""WITH v AS (SELECT p_partkey, (p_size + 16.0)::DOUBLE / 116 AS fy, (p_partkey % 200 - 100)::DOUBLE / 500 AS a, (p_partkey % 160 - 80)::DOUBLE / 200 AS b FROM part)
SELECT p_partkey, round(0.9642 * CASE WHEN fy + a > 24.0 / 116 THEN pow(fy + a, 3) ELSE (fy + a - 16.0 / 116) * 108.0 / 841 END, 9) AS x, round(CASE WHEN fy > 24.0 / 116 THEN pow(fy, 3) ELSE (fy - 16.0 / 116) * 108.0 / 841 END, 9) AS y, round(0.8249 * CASE WHEN fy - b > 24.0 / 116 THEN pow(fy - b, 3) ELSE (fy - b - 16.0 / 116) * 108.0 / 841 END, 9) AS z FROM v""")
def lab_values(spark, d):
    """Lab colours as XYZ."""
    from ..functions import codes

    rows = table(spark, d, "part")
    xyz = codes.lab_to_xyz(F.col("p_size").cast("double"), (F.col("p_partkey") % 200 - 100).cast("double"), (F.col("p_partkey") % 160 - 80).cast("double"))
    return rows.select("p_partkey", *[F.round(xyz[n], 9).alias(n) for n in "xyz"])


@query("SELECT n_nationkey, color::INT AS color_type, depth::INT AS depth, 9::BIGINT AS width, 6::BIGINT AS height, 0 AS texts FROM nation, (VALUES (0, 16), (2, 8), (3, 2), (4, 8), (6, 16)) AS k(color, depth)")
def picture_facts(spark, d):
    """Headers of pictures read without their pixels."""
    kinds = spark.createDataFrame([(0, 16), (2, 8), (3, 2), (4, 8), (6, 16)], "color int, depth int")
    rows = spread(table(spark, d, "nation").select("n_nationkey").join(F.broadcast(kinds)))
    made = rows.select("n_nationkey", composers.column(composers.any_png)("n_nationkey", "color", "depth", F.lit(False)).alias("content"))
    got = made.select("n_nationkey", media.png_info(F.col("content"))["value"].alias("r"))
    return got.select("n_nationkey", "r.color_type", "r.depth", "r.width", "r.height", F.size("r.texts").alias("texts"))


@query("SELECT p_partkey, m.marker::INT AS marker, 1::BIGINT AS segments FROM part, (VALUES (225), (254), (196), (218), (192), (219)) AS m(marker) WHERE marker NOT IN (196) UNION ALL SELECT p_partkey, 224, 2 FROM part UNION ALL SELECT p_partkey, 196, 2 FROM part")
def jpeg_segment_counts(spark, d):
    """Segments up to the first scan, by marker."""
    made = spread(table(spark, d, "part")).select("p_partkey", composers.column(composers.exif_jpeg)(F.col("p_name"), F.col("p_partkey"), F.col("p_size")).alias("content"))
    made.createOrReplaceTempView("pictures_here")
    spark.udtf.register("jpeg_segments", tables.JpegSegments)
    return spark.sql("SELECT p_partkey, t.marker, count(*) AS segments FROM pictures_here, LATERAL jpeg_segments(content) t GROUP BY p_partkey, t.marker")


@query("SELECT s_suppkey, kind, NULL::VARCHAR AS error_class, kind IN ('wav', 'aiff', 'flac') AS warned FROM supplier, (VALUES ('wav'), ('aiff'), ('flac'), ('mp4')) AS k(kind)")
def cut_files(spark, d):
    """Files without their last bytes: what stands before is read, with a warning where the format tells that a part is cut off."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("wav", "aiff", "flac", "mp4")]))
    rows = spread(table(spark, d, "supplier").select("s_suppkey", "s_name", kinds.alias("kind")))
    cut = F.when(F.col("kind") == "flac", 3010).otherwise(3)
    made = rows.select("s_suppkey", "kind", composers.column(composers.cut_audio)("kind", "s_name", "s_suppkey", cut).alias("content"))
    got = made.select("s_suppkey", "kind", media.metadata(F.col("content")).alias("r"))
    return got.select("s_suppkey", "kind", "r.error_class", (F.size("r.value.warnings") > 0).alias("warned"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, sum(length(o_orderpriority)) OVER w AS total FROM orders WHERE length(o_orderpriority) <= 12 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE n <= 5 AND total <= 40")
def capped_tags(spark, d):
    """Tags of a file up to its limits of number, of one value and of all values."""
    from ..operators import reports

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    kept = reports.capped(rows, most_tags=5, most_value=12, most_total=40)
    return kept.select(F.col("file").alias("o_custkey"), F.col("pos").alias("o_orderkey"))


@query("""SELECT p_partkey, mime, CASE mime WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpeg' WHEN 'application/x-own-signature' THEN 'signature' END AS kind, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 4 END AS channels,
'-q -jpeg -r 110 -scale-to 2048 -f 1 -l ' || p_size AS arguments FROM part, (VALUES ('image/png'), ('image/jpeg'), ('application/x-own-signature'), ('image/gif')) AS m(mime)""")
def small_rules(spark, d):
    """Kinds of MIME types, channels of pixel formats, arguments of a page renderer."""
    from ..functions import detect, pages

    mimes = F.explode(F.array(*[F.lit(m) for m in ("image/png", "image/jpeg", "application/x-own-signature", "image/gif")]))
    rows = table(spark, d, "part").select("p_partkey", "p_size", mimes.alias("mime"))
    form = F.element_at(F.array(*[F.lit(x) for x in ("gray8", "gray_alpha8", "rgb8", "rgba8", "cmyk8")]), (F.col("p_size") % 5 + 1).cast("int"))
    return rows.select("p_partkey", "mime", detect.sanitizer_kind(F.col("mime")).alias("kind"), detect.channels(form).alias("channels"), F.array_join(pages.render_arguments(F.col("p_size")), " ").alias("arguments"))


# --- errors ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, fault, CASE WHEN fault = 'none' THEN NULL WHEN fault = 'wide' THEN 'Limit' ELSE 'Invalid' END AS error_class FROM nation, (VALUES ('none'), ('cut'), ('checksum'), ('header twice'), ('no data'), ('palette'), ('wide'), ('interlace')) AS f(fault)")
def png_faults(spark, d):
    """Damaged pictures are rows with the class of their error."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(x) for x in ("none", "cut", "checksum", "header twice", "no data", "palette", "wide", "interlace")])).alias("fault"))
    made = spread(rows).select("n_nationkey", "fault", composers.column(faulty_png)(F.col("n_nationkey"), F.col("fault")).alias("content"))
    return made.select("n_nationkey", "fault", media.decode(F.col("content")).alias("r")).select("n_nationkey", "fault", "r.error_class")


def faulty_png(key: int, fault: str) -> bytes:
    import struct
    import zlib

    good = composers.any_png(key, 2, 8, False)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = lambda w, h, color, laced: part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, laced))
    body = good[33:]
    made = {"none": good, "cut": good[: 60 + key], "checksum": good[:29] + bytes([good[29] ^ 1]) + good[30:], "header twice": good[:33] + good[8:], "no data": good[:33] + good[-12:]}
    made |= {"palette": good[:8] + head(9, 6, 3, 0) + body, "wide": good[:8] + head(65_000, 65_000, 2, 0) + body, "interlace": good[:8] + head(9, 6, 2, 2) + body}
    return made[fault]


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Invalid' END AS error_class, CASE WHEN p_partkey % 4 = 0 THEN p_size % 5 + 1 END::INT AS frames, CASE WHEN p_partkey % 4 = 0 THEN (p_size % 5 + 1) * 18 END::BIGINT AS bytes FROM part")
def frame_streams_read(spark, d):
    """Frame streams read back: whole ones, cut ones, ones with a byte behind them and ones of no frame."""
    rows = spread(table(spark, d, "part"))
    made = rows.select("p_partkey", composers.column(frames)((F.col("p_partkey") % 4).cast("int"), (F.col("p_size") % 5 + 1).cast("int")).alias("content"))
    got = made.select("p_partkey", media.frame_stream(F.col("content")).alias("r"))
    total = F.aggregate("r.value", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["rgb"]))
    return got.select("p_partkey", "r.error_class", F.when(F.col("r.ok"), F.size("r.value")).alias("frames"), F.when(F.col("r.ok"), total).alias("bytes"))


def frames(how: int, n: int) -> bytes:
    import struct

    body = b"".join(struct.pack("<II", 3, 2) + bytes(18) for _ in range(n))
    whole = b"APDFRGB1" + struct.pack("<I", n) + body
    return (whole, whole[:-1], whole + b"x", b"APDFRGB1" + bytes(4))[how]


# --- documents -------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, how::INT AS how, (n_nationkey % 7 + 1)::INT AS pages, false AS encrypted, how = 1 AS repaired FROM nation, (VALUES (0), (1), (2), (3)) AS h(how)")
def damaged_documents(spark, d):
    """Whole tables, none (found again by scanning at once), wrong ones (each object sought when it's asked for), and all objects in one packed stream."""
    n = (F.col("n_nationkey") % 7 + 1).cast("int")
    rows = table(spark, d, "nation").select("n_nationkey", n.alias("n"), F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3)])).alias("how"))
    packed = composers.column(lambda pages, how: composers.object_stream_document(pages) if how == 3 else composers.damaged_document(pages, how))
    made = spread(rows).select("n_nationkey", "how", packed("n", "how").alias("content"))
    got = made.select("n_nationkey", "how", media.pdf_info(F.col("content")).alias("r"), media.pdf_facts(F.col("content")).alias("f"))
    return got.select("n_nationkey", "how", "r.value.pages", "r.value.encrypted", "f.value.repaired")


@query("""WITH b AS (SELECT p_partkey, 100 + p_size AS w, 200 + p_size AS h, p_partkey % 4 * 90 AS turn, p_partkey % 3 = 0 AS crop FROM part),
s AS (SELECT *, CASE WHEN crop THEN w - 15 ELSE w END AS bw, CASE WHEN crop THEN h - 10 ELSE h END AS bh FROM b)
SELECT p_partkey, (CASE WHEN turn % 180 = 0 THEN bw ELSE bh END)::DOUBLE AS w, (CASE WHEN turn % 180 = 0 THEN bh ELSE bw END)::DOUBLE AS h FROM s""")
def inherited_boxes(spark, d):
    """Boxes and turns from two levels above; a crop box counts inside the media box alone."""
    rows = spread(table(spark, d, "part"))
    made = rows.select("p_partkey", composers.column(composers.inheriting_document)((F.col("p_size") + 100).cast("int"), (F.col("p_size") + 200).cast("int"), (F.col("p_partkey") % 4 * 90).cast("int"), F.col("p_partkey") % 3 == 0).alias("content"))
    got = made.select("p_partkey", F.explode(media.pdf_pages(F.col("content"))["value"]).alias("p"))
    return got.select("p_partkey", "p.w", "p.h")


@query("SELECT s_suppkey, s_name AS title, s_name AS author, '1.' || (s_suppkey % 8) AS version FROM supplier")
def document_facts(spark, d):
    rows = spread(table(spark, d, "supplier"))
    made = rows.select("s_suppkey", composers.column(composers.titled_document)(F.col("s_name"), F.concat(F.lit("1."), (F.col("s_suppkey") % 8).cast("string"))).alias("content"))
    return made.select("s_suppkey", media.pdf_facts(F.col("content")).alias("r")).select("s_suppkey", "r.value.title", "r.value.author", "r.value.version")


def _ops(spark, files, *keys):
    files.createOrReplaceTempView("documents_here")
    spark.udtf.register("pdf_ops", tables.PdfOps)
    return spark.sql(f"SELECT {', '.join(keys)}, t.seq, t.op, array_join(t.operands, ' ') AS operands FROM documents_here, LATERAL pdf_ops(content) t")


_CONTENT = "q 1 0 0 1 {0} {1} cm BT /F1 {0} Tf 1 2 Td (a\\(b) Tj ET Q"
_OPS_SQL = "LATERAL (VALUES (0, 'q', ''), (1, 'cm', '1 0 0 1 ' || a || ' ' || b), (2, 'BT', ''), (3, 'Tf', '\"/F1\" ' || a), (4, 'Td', '1 2'), (5, 'Tj', '\"a(b\"'), (6, 'ET', ''), (7, 'Q', '')) AS v(seq, op, operands)"


@query(f"SELECT n_nationkey, name, seq::INT AS seq, op, operands FROM (SELECT n_nationkey, n_nationkey + 1 AS a, n_nationkey * 2 AS b FROM nation), (VALUES ('ASCIIHexDecode'), ('ASCII85Decode'), ('RunLengthDecode'), ('LZWDecode'), ('FlateDecode'), ('A85 Fl'), ('predictor')) AS f(name), {_OPS_SQL}")
def filtered_contents(spark, d):
    """Operators of pages whose contents went through each filter."""
    names = [n for n in composers.FILTERS if n != "cut off"]
    content = F.format_string(_CONTENT.replace("{0}", "%1$d").replace("{1}", "%2$d"), F.col("n_nationkey") + 1, F.col("n_nationkey") * 2)
    rows = table(spark, d, "nation").select("n_nationkey", content.alias("text"), F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    made = spread(rows).select("n_nationkey", "name", composers.column(composers.filtered_document)("text", "name").alias("content"))
    return _ops(spark, made, "n_nationkey", "name")


@query(f"SELECT n_nationkey, revision::INT AS revision, seq::INT AS seq, op, operands FROM (SELECT n_nationkey, n_nationkey + 1 AS a, n_nationkey * 2 AS b FROM nation), (VALUES (2), (3), (4), (6)) AS r(revision), {_OPS_SQL}")
def sealed_contents(spark, d):
    """Operators of pages encrypted under an empty password, by RC4 and AES."""
    content = F.format_string(_CONTENT.replace("{0}", "%1$d").replace("{1}", "%2$d"), F.col("n_nationkey") + 1, F.col("n_nationkey") * 2)
    rows = table(spark, d, "nation").select("n_nationkey", content.alias("text"), F.explode(F.array(*[F.lit(n) for n in (2, 3, 4, 6)])).alias("revision"))
    made = spread(rows).select("n_nationkey", "revision", composers.column(composers.sealed_document)("text", "revision").alias("content"))
    return _ops(spark, made, "n_nationkey", "revision")


def _marks(made, *keys: str):
    got = made.select(*keys, F.explode(media.pdf_marks(F.col("content"))["value"]).alias("m"))
    return got.select(*keys, "m.*")


def _each(values: tuple[str, ...]) -> str:
    return ", ".join(f"('{v}')" for v in values)


@query(f"""WITH b AS (SELECT n_nationkey, kind, 10 + n_nationkey AS x, 10 * (1 + n_nationkey % 3) AS size, n_nationkey % 4 AS spread FROM nation, (VALUES {_each(composers.FONT_KINDS)}) AS k(kind))
SELECT n_nationkey, kind, '00FF00' AS colour, (3 * size * size // 2)::INT AS pixels, x::INT AS left, (40 - size)::INT AS top, (x + size * 6 // 10 + spread + greatest(size // 2, size // 2 + size * 4 // 10 - spread) - 1)::INT AS right, (49 + size)::INT AS bottom FROM b""")
def text_painted(spark, d):
    """Letters of embedded fonts of every kind: where they stand, how far they advance, where the next line begins."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(k) for k in composers.FONT_KINDS])).alias("kind"))
    key = F.col("n_nationkey").cast("int")
    made = spread(rows).select("n_nationkey", "kind", composers.column(composers.text_page)("kind", key + 10, (key % 3 + 1) * 10, key % 4).alias("content"))
    return _marks(made, "n_nationkey", "kind")


@query("""WITH b AS (SELECT n_nationkey, mode, 20 * (1 + n_nationkey % 2) AS size FROM nation, range(8) AS m(mode))
SELECT n_nationkey, mode::INT AS mode, (CASE WHEN mode < 4 THEN 5000 ELSE 10 * size END)::INT AS red FROM b""")
def text_modes(spark, d):
    """Text that is filled, stroked, not shown, or kept as the clip of what follows."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mode"))
    made = spread(rows).select("n_nationkey", "mode", composers.column(composers.text_mode_page)("mode", ((F.col("n_nationkey") % 2 + 1) * 20).cast("int")).alias("content"))
    return _marks(made, "n_nationkey", "mode").where("colour = 'FF0000'").select("n_nationkey", "mode", F.col("pixels").alias("red"))


@query(f"""WITH b AS (SELECT n_nationkey, how, 5 * (n_nationkey % 5 + 1) AS a, 5 * (n_nationkey % 7 + 1) AS b FROM nation, (VALUES {_each(composers.DRAWN)}) AS h(how))
SELECT n_nationkey, how, '00FF00' AS colour, (a * b)::INT AS pixels, 20 AS left, (70 - b)::INT AS top, (19 + a)::INT AS right, 69 AS bottom FROM b""")
def drawn_areas(spark, d):
    """One area painted in many ways: paths, clips, strokes, forms, groups, images, masks, patterns, shadings, colour spaces, layers, annotations."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(k) for k in composers.DRAWN])).alias("how"))
    key = F.col("n_nationkey").cast("int")
    made = spread(rows).select("n_nationkey", "how", composers.column(composers.drawn_page)("how", (key % 5 + 1) * 5, (key % 7 + 1) * 5).alias("content"))
    return _marks(made, "n_nationkey", "how")


_BLENDS = {
    "Normal": "s", "Multiply": "b * s", "Screen": "b + s - b * s", "Darken": "least(b, s)", "Lighten": "greatest(b, s)", "Difference": "abs(b - s)", "Exclusion": "b + s - 2 * b * s",
    "HardLight": "CASE WHEN s <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END", "Overlay": "CASE WHEN b <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END",
    "ColorDodge": "CASE WHEN b = 0 THEN 0 WHEN s >= 1 THEN 1 ELSE least(1, b / (1 - s)) END", "ColorBurn": "CASE WHEN b >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE 1 - least(1, (1 - b) / s) END",
    "SoftLight": "CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) WHEN b <= 0.25 THEN b + (2 * s - 1) * (((16 * b - 12) * b + 4) * b - b) ELSE b + (2 * s - 1) * (sqrt(b) - b) END",
}
_BLEND_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BLENDS.items())


@query(f"""WITH c AS (SELECT n_nationkey, mode, i, (((n_nationkey * 37 + i * 61) % 256) / 255.0)::DOUBLE AS b, (((n_nationkey * 53 + i * 29 + 11) % 256) / 255.0)::DOUBLE AS s FROM nation, (VALUES {_each(tuple(_BLENDS))}) AS m(mode), range(3) AS t(i)),
v AS (SELECT n_nationkey, mode, i, 255 * (b + 0.75 * ((CASE mode {_BLEND_SQL} END) - b)) AS v FROM c)
SELECT n_nationkey, mode, i::INT AS channel, true AS alike, round(v / 8)::INT >= 0 AS known FROM v""")
def blended_colours(spark, d):
    """Twelve blend modes under an alpha: every channel within one level of the formula, worked out again here in columns."""
    key = F.col("n_nationkey").cast("int")
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(k) for k in _BLENDS])).alias("mode"))
    back, front = F.array(*[(key * 37 + i * 61) % 256 for i in range(3)]), F.array(*[(key * 53 + i * 29 + 11) % 256 for i in range(3)])
    made = spread(rows).select("n_nationkey", "mode", back.alias("back"), front.alias("front"), composers.column(composers.blended_page)("mode", back, front, F.lit(0.75)).alias("content"))
    marks = made.select("n_nationkey", "mode", "back", "front", media.pdf_marks(F.col("content"))["value"].alias("marks"))
    # the area's colour is the one that ends before the page does, unless it is the same as the page's
    area = F.filter("marks", lambda m: m["right"] == 39)
    inner = marks.withColumn("colour", F.when(F.size(area) > 0, F.get(area, F.lit(0))["colour"]).otherwise(F.get("marks", F.lit(0))["colour"]))
    each = inner.select("n_nationkey", "mode", "colour", "back", "front", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    b, s = (F.element_at(c, F.col("channel") + 1) / 255 for c in ("back", "front"))
    formula = F.expr(f"CASE mode {_BLEND_SQL} END")
    got = each.withColumns({"b": b, "s": s}).withColumn("v", 255 * (F.col("b") + 0.75 * (formula - F.col("b"))))
    level = F.conv(F.expr("substring(colour, 2 * channel + 1, 2)"), 16, 10).cast("double")
    return got.select("n_nationkey", "mode", "channel", (F.abs(level - F.col("v")) <= 1).alias("alike"), (F.col("v") >= -0.5).alias("known"))


# --- files, checksums, names -----------------------------------------------------------------------------------------


@query("SELECT s_suppkey, 'RIFF:Title' AS tag, s_name AS value, 3756 + 2 * (length(s_suppkey::VARCHAR) > 2)::INT AS length FROM supplier ORDER BY 1")
def media_files(spark, d):
    """Files written by the sink, read whole by one source and by their tags alone by the other."""
    from ..sources import files as sink
    from ..sources import tags as tag_source

    sink.register(spark)
    tag_source.register(spark)
    folder = _shared_folder(spark)
    made = _supplier_files(spark, d, composers.broadcast_wave)
    made.select(F.concat(F.lit("a/"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("name"), "content").write.format("mediafiles").mode("append").save(folder)
    key = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    whole = read_media(spark, folder, glob="*.wav").select(key.alias("s_suppkey"), F.col("length").cast("int").alias("length"))
    in_tags = F.regexp_extract("file", r"([0-9]+)\.wav$", 1).cast("long")
    tags = spark.read.format("mediatags").load(folder + "/a").where("tag_group = 'RIFF' AND name = 'Title'").select(in_tags.alias("s_suppkey"), F.concat_ws(":", "tag_group", "name").alias("tag"), F.col("s").alias("value"))
    return tags.join(whole, "s_suppkey")


def _shared_folder(spark) -> str:
    """A new folder where driver and executors both write: below the checkpoint folder if there is one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp()).rstrip('/')}/mediamill-files-{uuid.uuid4().hex}"


@query("""SELECT n_nationkey, n_name AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(n_name[i])::BIGINT for i in range(1, length(n_name) + 1)]),
lambda a, b: list_reduce([xor(a, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295::BIGINT) AS crc,
upper(lpad(to_hex(((1 + list_sum([unicode(n_name[i]) for i in range(1, length(n_name) + 1)])) % 65521 + 65536 * ((length(n_name) + list_sum([unicode(n_name[i]) * (length(n_name) + 1 - i) for i in range(1, length(n_name) + 1)])) % 65521))::BIGINT), 8, '0')) AS trailer FROM nation""")
def crc_and_trailer(spark, d):
    """CRC-32 and the end of a zlib stream."""
    name = F.col("n_name").cast("binary")
    return table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("text"), digests.crc32(name).alias("crc"), F.hex(digests.zlib_trailer(digests.adler32(name))).alias("trailer"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN repeat(o_orderpriority, 50) END AS text, CASE WHEN o_orderkey % 2 = 1 THEN 'Invalid' END AS error_class FROM orders WHERE o_orderkey < 2000")
def exact_inflate(spark, d):
    """Texts packed in pieces and unpacked to their exact size; a byte more behind them is an error."""
    rows = table(spark, d, "orders").where("o_orderkey < 2000").select("o_orderkey", F.repeat("o_orderpriority", F.lit(50)).alias("text"))
    packed = rows.select("o_orderkey", F.length("text").alias("n"), media.compress_pieces(F.col("text").cast("binary"), F.lit(100))["value"].alias("z"))
    odd = F.when(F.col("o_orderkey") % 2 == 1, F.concat("z", F.lit("x").cast("binary"))).otherwise(F.col("z"))
    got = packed.select("o_orderkey", media.inflate_exact(odd, F.col("n")).alias("r"))
    return got.select("o_orderkey", F.col("r.value").cast("string").alias("text"), "r.error_class")


@query("SELECT n_nationkey, encoding, code::INT AS code, chr(code::INT) AS name FROM nation, (VALUES ('Standard'), ('WinAnsi'), ('MacRoman')) AS e(encoding), range(65, 123) AS c(code) WHERE code NOT BETWEEN 91 AND 96 AND n_nationkey = code % 25")
def letter_glyphs(spark, d):
    """Letters are named by themselves in every predefined encoding."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(65), F.lit(122))).alias("code")).where("code NOT BETWEEN 91 AND 96 AND n_nationkey = code % 25")
    parts = [rows.select("n_nationkey", F.lit(e).alias("encoding"), "code", encodings.glyph_name(F.col("code"), e).alias("name")) for e in ("Standard", "WinAnsi", "MacRoman")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpeg' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'png_pipe' ELSE 'jpeg_pipe' END AS format, p_size AS width, p_size + 1 AS height FROM part")
def converted(spark, d):
    """Pictures converted to the other format, or through it to their own."""
    from .. import synth

    rows = spread(table(spark, d, "part")).select("p_partkey", synth.flat_png(F.col("p_size"), F.col("p_size") + 1, F.lit(90)).alias("content"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "png").otherwise("jpeg")
    target = F.when(F.col("p_partkey") % 2 == 0, "png").otherwise("jpg")
    got = rows.select("p_partkey", kind.alias("kind"), media.convert(F.col("content"), target, F.lit(90))["value"].alias("content"))
    got = got.select("p_partkey", "kind", media.probe(F.col("content")).alias("r"))
    return got.select("p_partkey", "kind", "r.value.format", "r.value.width", "r.value.height")


