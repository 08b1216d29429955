"""Rules over metadata tags: names, text, numbers, groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of the two reports.
COLOR_FIELDS = ("ColorSpace", "ColorType", "PhotometricInterpretation", "SamplesPerPixel", "BitsPerSample", "BitDepth", "ColorComponents", "ProfileDescription", "ProfileID", "Orientation")
PROVENANCE_FIELDS = ("Software", "CreatorTool", "DigitalSourceType", "Description", "Comment", "Encoder", "UserComment", "Parameters", "GenerationParameters", "Prompt", "Workflow")

# Names of XMP namespaces.
XMP_GROUPS = {
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://ns.adobe.com/xap/1.0/": "xmp",
    "http://ns.adobe.com/xap/1.0/mm/": "xmpMM",
    "http://ns.adobe.com/xap/1.0/rights/": "xmpRights",
    "http://ns.adobe.com/xap/1.0/bj/": "xmpBJ",
    "http://ns.adobe.com/xap/1.0/t/pg/": "xmpTPg",
    "http://ns.adobe.com/tiff/1.0/": "tiff",
    "http://ns.adobe.com/exif/1.0/": "exif",
    "http://cipa.jp/exif/1.0/": "exifEX",
    "http://ns.adobe.com/exif/1.0/aux/": "aux",
    "http://ns.adobe.com/photoshop/1.0/": "photoshop",
    "http://ns.adobe.com/camera-raw-settings/1.0/": "crs",
    "http://ns.adobe.com/pdf/1.3/": "pdf",
    "http://ns.adobe.com/xmp/1.0/DynamicMedia/": "xmpDM",
    "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "iptcCore",
    "http://iptc.org/std/Iptc4xmpExt/2008-02-29/": "iptcExt",
    "http://ns.useplus.org/ldf/xmp/1.0/": "plus",
    "http://ns.google.com/photos/1.0/image/": "GImage",
    "http://ns.google.com/photos/1.0/camera/": "GCamera",
    "http://ns.adobe.com/photoshop/1.0/panorama-profile": "GPano",
}

# Names of EXIF tags.
EXIF_NAMES = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x011A: "XResolution",
    0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x013C: "HostComputer",
    0x0213: "YCbCrPositioning", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x9000: "ExifVersion",
    0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor",
    0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
    0xA420: "ImageUniqueID", 0xA430: "OwnerName", 0xA433: "LensMake", 0xA434: "LensModel",
}

NUMBER = r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,16})?([eE][+-]?[0-9]{1,3})?\z"


def looks_numeric(s: Column) -> Column:
    """Whether a text is written as a JSON number: at most 15 digits, no leading zero, at most 16 decimals and 3 exponent digits."""
    return s.rlike(NUMBER)


def json_scalar(s: Column) -> Column:
    """A text as an integer, a real or a string: ``struct<kind,i,r,s>``."""
    whole, real = F.expr("try_cast(NULL AS BIGINT)"), F.lit(None).cast("double")
    number = looks_numeric(s)
    integer = number & ~s.rlike("[.eE]")
    return F.struct(
        F.when(integer, "int").when(number, "real").otherwise("text").alias("kind"),
        F.when(integer, s.try_cast("bigint")).otherwise(whole).alias("i"),
        F.when(number & ~integer, s.try_cast("double")).otherwise(real).alias("r"),
        F.when(~number, s).alias("s"),
    )


def group_rank(group: Column) -> Column:
    """Which group's value wins when several have a field: the lowest rank."""
    return F.when(group.isin("File", "PNG"), 0).when(group.isin("IFD0", "ExifIFD"), 1).when(group.isin("ICC_Profile", "ICC-header"), 2).when(group.startswith("XMP-"), 3).when(group == "IFD1", 9).otherwise(5)


def tag_name(raw: Column) -> Column:
    """A tag's name from a free text: words of letters, digits, - and _, each with a capital first, run together."""
    words = F.filter(F.split(raw, "[^A-Za-z0-9_-]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    return F.when((F.length(joined) < 2) | joined.rlike("^[0-9]"), F.concat(F.lit("Tag"), joined)).otherwise(joined)


def clean(s: Column) -> Column:
    """Text without NULs and white space at its end."""
    return F.regexp_replace(s, r"[\x{0}\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z", "")


def utf8_or_latin1(b: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    text = b.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(b, "ISO-8859-1"))


def xmp_group(namespace: Column, declared: Column) -> Column:
    """``XMP-`` and the usual prefix of a namespace, or the one that the packet declares."""
    known = F.create_map(*[F.lit(x) for kv in XMP_GROUPS.items() for x in kv])
    return F.concat(F.lit("XMP-"), F.coalesce(F.try_element_at(known, namespace), declared))


def exif_name(tag: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXIF_NAMES.items() for x in kv])
    return F.try_element_at(known, tag.cast("int"))


def xmp_orientation(packet: Column) -> Column:
    """``tiff:Orientation`` of a packet, as attribute or element; null without one."""
    found = F.regexp_extract(packet, r"tiff:Orientation[=>\"'\s]*([0-9]+)", 1)
    return F.when(found != "", found.try_cast("bigint"))


def raw_profile(text: Column) -> Column:
    """Bytes of a hexadecimal raw-profile text (a name, a length and digits, on lines); null if the length differs."""
    lines = F.split(text, "\n", 4)
    length = F.trim(F.get(lines, F.lit(2))).try_cast("int")
    data = F.try_to_binary(F.regexp_replace(F.get(lines, F.lit(3)), "[^0-9A-Fa-f]", ""), F.lit("hex"))
    return F.when(F.octet_length(data) >= length, F.substring(data, F.lit(1), length))
