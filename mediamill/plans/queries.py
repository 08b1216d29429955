"""Queries over the engine's operators, each with the SQL that says from the raw rows what must come out.

Media are made of table rows (:mod:`mediamill.synth`), read back by the engine, and compared
with those rows; rules over tags, pixels, words and pages run on values of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..functions import codes, detect, digests, media, pages, pixels, tables, tags
from ..kernels import jpeg, postscript
from ..operators import documents, pixel_stats, reports, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Small tables dealt to all cores before work that costs milliseconds a row."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# --- containers and probing -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'png_pipe' AS format, p_size AS width, p_size + 1 AS height FROM part")
def probe_png(spark, d):
    made = spread(table(spark, d, "part")).select("p_partkey", synth.flat_png(F.col("p_size"), F.col("p_size") + 1, F.lit(200)).alias("content"))
    got = made.select("p_partkey", media.probe(F.col("content")).alias("r"))
    return got.select("p_partkey", "r.value.format", "r.value.width", "r.value.height")


@query("SELECT p_partkey, p_size::BIGINT AS width, (p_size + 1)::BIGINT AS height, 8::BIGINT AS depth, 0::BIGINT AS color_type FROM part")
def png_header_sql(spark, d):
    made = spread(table(spark, d, "part")).select("p_partkey", synth.flat_png(F.col("p_size"), F.col("p_size") + 1, F.lit(200)).alias("content"))
    return made.select("p_partkey", detect.png_header(F.col("content")).alias("h")).select("p_partkey", "h.width", "h.height", "h.depth", "h.color_type")


@query("SELECT p_partkey, 'jpeg_pipe' AS format, p_size AS width, 9 AS height, true AS verified FROM part")
def probe_jpeg(spark, d):
    made = spread(table(spark, d, "part")).select("p_partkey", synth.gray_jpeg(F.col("p_size"), F.lit(9), F.lit(90)).alias("content"))
    got = made.select("p_partkey", media.verify(F.col("content")).alias("r"))
    return got.select("p_partkey", "r.value.format", "r.value.width", "r.value.height", F.col("r.ok").alias("verified"))


@query("SELECT k AS kind, count(*) AS n, true AS all_ok FROM part, (VALUES ('IHDR'), ('iTXt'), ('IDAT'), ('IEND')) AS t(k) GROUP BY k")
def png_chunks_agg(spark, d):
    made = spread(table(spark, d, "part")).select(synth.text_png(F.lit("Comment"), F.col("p_brand")).alias("content"))
    rows = made.lateralJoin(tables.PngChunks(F.col("content").outer()))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("crc_ok").alias("all_ok"))


@query("SELECT doc_id, 'PNG' AS tag_group, 'Software' AS name, lang || ':' || source AS value FROM documents")
def meta_text_tags(spark, d):
    made = spread(table(spark, d, "documents")).select("doc_id", synth.text_png(F.lit("Software"), F.concat_ws(":", "lang", "source")).alias("content"))
    got = made.select("doc_id", F.inline(media.metadata(F.col("content"))["value"]["tags"]))
    return got.where("name = 'Software'").select("doc_id", "tag_group", "name", F.col("s").alias("value"))


@query("SELECT s_suppkey, s_name AS software, 16::BIGINT AS bits FROM supplier")
def wave_tags(spark, d):
    made = spread(table(spark, d, "supplier")).select("s_suppkey", synth.wave(F.col("s_name"), F.lit(16)).alias("content"))
    got = made.select("s_suppkey", F.inline(media.metadata(F.col("content"))["value"]["tags"]))
    return got.groupBy("s_suppkey").agg(F.max(F.when(F.col("name") == "Software", F.col("s"))).alias("software"), F.max(F.when(F.col("name") == "BitsPerSample", F.col("i"))).alias("bits"))


@query(
    "SELECT n_nationkey, k AS file_type, n AS type_name FROM (SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'wav' WHEN 3 THEN 'aiff' WHEN 4 THEN 'mp4' WHEN 5 THEN 'wavpack' WHEN 6 THEN 'flac' WHEN 7 THEN 'tta' END AS k FROM nation) "
    "LEFT JOIN (VALUES ('jpeg', 'JPEG'), ('png', 'PNG'), ('wav', 'WAV'), ('aiff', 'AIFF'), ('mp4', 'MP4'), ('wavpack', 'WavPack'), ('flac', 'FLAC'), ('tta', 'TTA')) AS t(t, n) ON k = t"
)
def detect_types(spark, d):
    heads = ["89504E470D0A1A0A", "FFD8FFE0", "5249464600000000574156450000", "464F524D0000000041494643", "00000018667479706D703432", "7776706B00000000", "49443303000000000002AAAA664C6143", "54544131", "25504446"]
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("n_nationkey") % 9 + 1).cast("int")))
    kind = detect.file_type(F.col("content"))
    return table(spark, d, "nation").select("n_nationkey", content.alias("content")).select("n_nationkey", kind.alias("file_type"), detect.type_name(kind).alias("type_name"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN w < 1 OR h < 1 THEN 'Invalid' WHEN w > 65535 OR h > 65535 OR w * h > 40000000 THEN 'Limit' END AS error_class, CASE WHEN w * h * 3 <= 536870912 THEN w * h * 3 END AS bytes "
    "FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 300 - 300 AS w, l_linenumber::BIGINT * 1200 AS h FROM lineitem)"
)
def dimension_limits(spark, d):
    sized = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 300 - 300).alias("w"), (F.col("l_linenumber").cast("long") * 1200).alias("h"))
    return sized.select("l_orderkey", "l_linenumber", detect.dimension_error(F.col("w"), F.col("h")).alias("error_class"), detect.alloc_size(F.col("w") * F.col("h"), F.lit(3)).alias("bytes"))


@query(
    "SELECT p_partkey, p AS pass, greatest((p_size - x + dx - 1) // dx, 0)::INT AS w, greatest((p_size * 2 - y + dy - 1) // dy, 0)::INT AS h "
    "FROM part, (VALUES (1, 0, 0, 8, 8), (2, 4, 0, 8, 8), (3, 0, 4, 4, 8), (4, 2, 0, 4, 4), (5, 0, 2, 2, 4), (6, 1, 0, 2, 2), (7, 0, 1, 1, 2)) AS g(p, x, y, dx, dy)"
)
def adam7_passes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.inline(detect.adam7_passes(F.col("p_size"), F.col("p_size") * 2)))


# --- tags and reports ---------------------------------------------------------------------------------------------------

_GROUPS = ["PNG", "IFD0", "XMP-tiff", "IFD1", "ICC_Profile", "JFIF"]
_FIELDS = ["ColorSpace", "ColorType", "BitDepth", "Orientation", "Make"]


def _tag_rows(spark, d) -> DataFrame:
    """Tags of made-up files out of events: the file is the user, the order that of the events."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % len(names) + 1).cast("int"))
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), pick(_GROUPS, F.col("event_id")).alias("tag_group"), pick(_FIELDS, F.floor(F.col("event_id") / 7)).alias("name"), F.col("event_type").alias("value"))


_TAG_SQL = "SELECT user_id AS file, event_id AS pos, (['PNG', 'IFD0', 'XMP-tiff', 'IFD1', 'ICC_Profile', 'JFIF'])[event_id % 6 + 1] AS tag_group, (['ColorSpace', 'ColorType', 'BitDepth', 'Orientation', 'Make'])[event_id // 7 % 5 + 1] AS name, event_type AS value FROM events"


@query(f"SELECT file, name, arg_min(value, CASE tag_group WHEN 'PNG' THEN 0 WHEN 'IFD0' THEN 1 WHEN 'ICC_Profile' THEN 2 WHEN 'XMP-tiff' THEN 3 WHEN 'IFD1' THEN 9 ELSE 5 END * 1000000000000 + pos) AS value FROM ({_TAG_SQL}) WHERE name <> 'Make' GROUP BY file, name")
def color_report_dedupe(spark, d):
    return reports.color_report(_tag_rows(spark, d))


@query("SELECT user_id AS file, 'G' || event_type || CASE WHEN n > 1 THEN '-' || n::VARCHAR ELSE '' END || ':' || name AS field, value FROM (SELECT user_id, event_type, name, value::VARCHAR AS value, row_number() OVER (PARTITION BY user_id, event_type, name ORDER BY event_id) AS n FROM (SELECT *, (['Comment-en', 'Software', 'Title'])[event_id % 3 + 1] AS name, event_id::VARCHAR AS value FROM (SELECT user_id, event_id, event_type FROM events)) WHERE name <> 'Title')")
def provenance_keys(spark, d):
    e = table(spark, d, "events")
    name = F.element_at(F.array(F.lit("Comment-en"), F.lit("Software"), F.lit("Title")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.concat(F.lit("G"), "event_type").alias("tag_group"), name.alias("name"), F.col("event_id").cast("string").alias("value"))
    return reports.provenance_fields(rows)


@query("SELECT user_id AS file, event_type || ':T' || (event_id % 4)::VARCHAR AS key, min(event_id) AS value FROM events WHERE event_id % 4 IN (1, 2) GROUP BY ALL")
def first_tag_wins(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.col("event_type").alias("tag_group"), F.concat(F.lit("T"), (F.col("event_id") % 4).cast("string")).alias("name"), F.col("event_id").alias("value"))
    return reports.first_tags(rows, ["t1", "T2"])


_NUMERIC = r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,16})?([eE][+-]?[0-9]{1,3})?$"
_FORMS = "CASE o_orderkey % 8 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '0' || o_orderkey::VARCHAR WHEN 2 THEN o_orderkey::VARCHAR || '.5' WHEN 3 THEN '-' || o_orderkey::VARCHAR WHEN 4 THEN o_orderkey::VARCHAR || '.' WHEN 5 THEN o_orderkey::VARCHAR || 'e2' WHEN 6 THEN o_orderstatus ELSE '+' || o_orderkey::VARCHAR END"


@query(f"SELECT o_orderkey, regexp_full_match(s, '{_NUMERIC[1:-1]}') AS numeric, CASE WHEN NOT regexp_full_match(s, '{_NUMERIC[1:-1]}') THEN 'text' WHEN regexp_matches(s, '[.eE]') THEN 'real' ELSE 'int' END AS kind, CASE WHEN regexp_full_match(s, '{_NUMERIC[1:-1]}') AND NOT regexp_matches(s, '[.eE]') THEN s::BIGINT END AS i FROM (SELECT o_orderkey, {_FORMS} AS s FROM orders)")
def number_rule(spark, d):
    k = F.col("o_orderkey").cast("string")
    s = F.col("o_orderstatus")
    forms = {0: k, 1: F.concat(F.lit("0"), k), 2: F.concat(k, F.lit(".5")), 3: F.concat(F.lit("-"), k), 4: F.concat(k, F.lit(".")), 5: F.concat(k, F.lit("e2")), 6: s}
    text = F.concat(F.lit("+"), k)
    for n, c in forms.items():
        text = F.when(F.col("o_orderkey") % 8 == n, c).otherwise(text)
    v = tags.json_scalar(F.col("s"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("s")).select("o_orderkey", tags.looks_numeric(F.col("s")).alias("numeric"), v["kind"].alias("kind"), v["i"].alias("i"))


@query("SELECT p_partkey, CASE WHEN length(n) < 2 OR regexp_matches(n, '^[0-9]') THEN 'Tag' || n ELSE n END AS tag FROM (SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(raw, '[^A-Za-z0-9_-]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), '') AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN p_size::VARCHAR || ' ' || p_brand ELSE '!' END AS raw FROM part))")
def tag_name(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_type")).when(k == 1, F.col("p_name")).when(k == 2, F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand")).otherwise("!")
    return table(spark, d, "part").select("p_partkey", tags.tag_name(raw).alias("tag"))


@query("SELECT n_nationkey, rtrim(n_name) AS cleaned, 'XMP-' || CASE WHEN n_nationkey % 3 = 0 THEN 'dc' WHEN n_nationkey % 3 = 1 THEN 'tiff' ELSE 'own' END AS xmp_group, CASE n_nationkey % 2 WHEN 0 THEN 'Orientation' END AS exif, n_name AS text, n_nationkey % 8 + 1 AS orientation FROM nation")
def tag_rules(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    ns = F.when(k % 3 == 0, "http://purl.org/dc/elements/1.1/").when(k % 3 == 1, "http://ns.adobe.com/tiff/1.0/").otherwise("urn:own")
    packet = F.concat(F.lit("<x tiff:Orientation=\""), (k % 8 + 1).cast("string"), F.lit("\"/>"))
    return n.select(
        "n_nationkey", tags.clean(F.concat("n_name", F.lit("\u0000 \n\u0000"))).alias("cleaned"), tags.xmp_group(ns, F.lit("own")).alias("xmp_group"),
        tags.exif_name(F.when(k % 2 == 0, 0x0112).otherwise(1)).alias("exif"), tags.utf8_or_latin1(F.col("n_name").cast("binary")).alias("text"), tags.xmp_orientation(packet).cast("int").alias("orientation"),
    )


@query("SELECT s_suppkey, s_suppkey % 268435456 AS value, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS profile FROM supplier")
def byte_rules(spark, d):
    k = F.col("s_suppkey")
    seven = F.concat(*[F.lpad(F.hex(F.shiftright(k, s).bitwiseAND(127)), 2, "0") for s in (21, 14, 7, 0)])
    text = F.concat(F.lit("\nname\n   "), F.when(k % 2 == 0, F.octet_length("s_name")).otherwise(1000).cast("string"), F.lit("\n"), F.lower(F.hex("s_name")))
    return table(spark, d, "supplier").select("s_suppkey", detect.syncsafe(F.unhex(seven), 1).alias("value"), tags.raw_profile(text).cast("string").alias("profile"))


# --- digests and streams ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def sha256_md5(spark, d):
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", digests.md5(b).alias("md5"), digests.sha256(b).alias("sha256"))


@query("SELECT doc_id, true AS same_adler, true AS same_sha384, strlen(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND strlen(text) > 1")
def checksums(spark, d):
    b = F.col("text").cast("binary")
    half = (F.octet_length("text") / 2).cast("int")
    docs = table(spark, d, "documents").where("text is not null and octet_length(text) > 1")
    one, two = F.substring(b, F.lit(1), half), F.substring(b, half + 1, F.octet_length("text"))
    parts = docs.select("doc_id", digests.adler32(b).alias("whole"), digests.adler32(one).alias("a"), digests.adler32(two).alias("b"), F.octet_length(two).alias("n2"), digests.sha384(b).alias("s"), digests.sha384(F.concat(one, two)).alias("t"), F.octet_length(b).cast("long").alias("n"))
    return parts.select("doc_id", (digests.adler32_combine(F.col("a"), F.col("b"), F.col("n2")) == F.col("whole")).alias("same_adler"), (F.col("s") == F.col("t")).alias("same_sha384"), "n")


@query("SELECT doc_id, text AS back, strlen(text)::BIGINT AS n, true AS complete FROM documents WHERE text IS NOT NULL")
def zlib_roundtrip(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    packed = docs.select("doc_id", media.compress(F.col("text").cast("binary"), F.lit(6))["value"].alias("z"))
    got = packed.select("doc_id", media.inflate(F.col("z"), F.lit(1 << 24))["value"].alias("v"))
    return got.select("doc_id", F.col("v.data").cast("string").alias("back"), F.octet_length("v.data").cast("long").alias("n"), "v.complete")


@query("SELECT c_custkey, c_name AS back, c_name AS hex_back FROM customer")
def ciphers_and_filters(spark, d):
    key, iv = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    c = table(spark, d, "customer")
    sealed = F.aes_encrypt(F.col("c_name").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    stream = F.concat(F.lower(F.hex("c_name")), F.lit(">junk")).cast("binary")
    return c.select("c_custkey", digests.aes_cbc_decrypt(sealed, key).cast("string").alias("back"), pages.ascii_hex(stream).cast("string").alias("hex_back"))


# --- pixels -------------------------------------------------------------------------------------------------------------


def _samples(spark, d) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), F.col("l_partkey").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.pmod(q * m + k * n, F.lit(256)).alias(c) for c, m, n in (("c", 5, 1), ("m", 3, 7), ("y", 2, 11), ("k", 1, 13))])


_SAMPLES = "SELECT l_orderkey, l_linenumber, (l_quantity::INT * 5 + l_partkey) % 256 AS c, (l_quantity::INT * 3 + l_partkey * 7) % 256 AS m, (l_quantity::INT * 2 + l_partkey * 11) % 256 AS y, (l_quantity::INT + l_partkey * 13) % 256 AS k FROM lineitem"
_INK = "255 - k - (({v} * (255 - k) + 128 + (({v} * (255 - k) + 128) >> 8)) >> 8)"


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"({_INK.format(v=v)})::BIGINT AS {n}" for v, n in (("c", "r"), ("m", "g"), ("y", "b"))) + f" FROM ({_SAMPLES})")
def cmyk_pixels(spark, d):
    return _samples(spark, d).select("l_orderkey", "l_linenumber", pixels.cmyk_to_rgb(F.col("c"), F.col("m"), F.col("y"), F.col("k")).alias("p")).select("l_orderkey", "l_linenumber", *[F.col(f"p.{x}").cast("long").alias(x) for x in "rgb"])


@query(f"SELECT l_orderkey, l_linenumber, ((c * 299 + m * 587 + y * 114 + 500) // 1000)::BIGINT AS luma FROM ({_SAMPLES})")
def luma_pixels(spark, d):
    return _samples(spark, d).select("l_orderkey", "l_linenumber", pixels.luma(F.col("c"), F.col("m"), F.col("y")).cast("long").alias("luma"))


_TURNS = {"x": ["x", "x", "99 - x", "99 - x", "x", "y", "49 - y", "49 - y", "y"], "y": ["y", "y", "y", "49 - y", "49 - y", "x", "x", "99 - x", "99 - x"]}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join("CASE o " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(v)) + f" END::BIGINT AS n{k}" for k, v in _TURNS.items()) + " FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS x, l_suppkey % 50 AS y, l_orderkey % 9 AS o FROM lineitem)")
def orient_map(spark, d):
    p = pixels.oriented(F.col("l_partkey") % 100, F.col("l_suppkey") % 50, F.lit(100), F.lit(50), F.col("l_orderkey") % 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p["x"].cast("long").alias("nx"), p["y"].cast("long").alias("ny"))


_LEVELS = "SELECT c_nationkey AS img_id, (abs(c_acctbal)::BIGINT // 40) % 256 AS level FROM customer"
_OTSU = (
    f"WITH n AS (SELECT img_id, level, count(*) AS n FROM ({_LEVELS}) GROUP BY ALL), "
    "s AS (SELECT img_id, level, (sum(n) OVER w)::BIGINT AS below, (sum(n) OVER p)::BIGINT AS total, (sum(level * n) OVER w)::DOUBLE AS mu, (sum(level * n) OVER p)::DOUBLE AS mu_all FROM n WINDOW w AS (PARTITION BY img_id ORDER BY level), p AS (PARTITION BY img_id)), "
    "v AS (SELECT *, pow((mu_all - mu) / (total - below) - mu / below, 2) * below * (total - below) AS spread FROM s WHERE level < 255 AND total > below) "
    "SELECT img_id, level AS threshold, total, below FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY spread DESC, level) AS r FROM v) WHERE r = 1"
)


@query(_OTSU)
def otsu(spark, d):
    px = table(spark, d, "customer").select(F.col("c_nationkey").alias("img_id"), (F.floor(F.abs("c_acctbal").cast("decimal(18,2)").cast("double").cast("decimal(18,0)").cast("long") / 40) % 256).alias("level"))
    return pixel_stats.otsu(px)


@query("SELECT vec_id, list_transform(embedding, lambda v: (floor(least(greatest(v, -1), 1) * 127)::INT + 128)) AS samples FROM embeddings")
def embedding_image(spark, d):
    level = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v, F.lit(-1.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(127).cast("float")).cast("int") + 128)
    made = spread(table(spark, d, "embeddings")).select("vec_id", synth.gray_png(level).alias("content"))
    data = media.pixels(F.col("content"))["value"]["data"]
    third = F.transform(F.sequence(F.lit(0), (F.octet_length("data") / 3).cast("int") - 1), lambda i: F.conv(F.hex(F.substring(F.col("data"), (i * 3 + 1).cast("int"), F.lit(1))), 16, 10).cast("int"))
    return made.select("vec_id", data.alias("data")).select("vec_id", third.alias("samples"))


@query("SELECT p_partkey, p_size AS width, 4 AS height, p_size * 4 * 3 AS n_bytes, (p_size * 5) % 256 AS level FROM part")
def png_roundtrip(spark, d):
    made = spread(table(spark, d, "part")).select("p_partkey", synth.flat_png(F.col("p_size"), F.lit(4), F.col("p_size") * 5 % 256).alias("content"))
    cleaned = made.select("p_partkey", media.clean(F.col("content"), F.lit("png"))["value"].alias("content"))
    got = cleaned.select("p_partkey", media.pixels(F.col("content"))["value"].alias("v"))
    return got.select("p_partkey", "v.width", "v.height", F.octet_length("v.data").alias("n_bytes"), F.conv(F.hex(F.substring("v.data", 1, 1)), 16, 10).cast("int").alias("level"))


@query("SELECT p_partkey, p_size AS width, 12 AS height, true AS close FROM part")
def jpeg_gray_roundtrip(spark, d):
    made = spread(table(spark, d, "part")).select("p_partkey", (F.col("p_size") * 5 % 256).alias("level"), synth.gray_jpeg(F.col("p_size"), F.lit(12), F.col("p_size") * 5 % 256).alias("content"))
    got = made.select("p_partkey", "level", media.luma(F.col("content"))["value"].alias("v"))
    first = F.conv(F.hex(F.substring("v.data", 1, 1)), 16, 10).cast("int")
    return got.select("p_partkey", "v.width", "v.height", (F.abs(first - F.col("level")) <= 1).alias("close"))


@query("SELECT n_nationkey, n_nationkey % 5 <> 0 AS ok, CASE WHEN n_nationkey % 5 = 0 THEN 'signature metadata or invalid chunk' END AS error FROM nation")
def signature_verdict(spark, d):
    n = spread(table(spark, d, "nation")).withColumn("k", F.col("n_nationkey"))
    good, bad = synth.flat_png(F.lit(32), F.lit(10), F.lit(255)), synth.text_png(F.lit("Comment"), F.col("n_name"))
    made = n.select("n_nationkey", F.when(F.col("k") % 5 == 0, bad).otherwise(good).alias("content"))
    return made.select("n_nationkey", media.signature(F.col("content")).alias("r")).select("n_nationkey", "r.ok", "r.error")


# --- QR, ICC, JPEG rules --------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, (s_suppkey % 3)::INT AS symbols FROM supplier")
def qr_symbols(spark, d):
    made = spread(table(spark, d, "supplier")).select("s_suppkey", synth.qr_png(F.col("s_name"), F.col("s_suppkey") % 3).alias("content"))
    return made.select("s_suppkey", media.qr_count(F.col("content"))["value"].alias("symbols"))


@query("SELECT s_suppkey, 'png_pipe' AS format, true AS qr_ok, 1 AS symbols, 8::BIGINT AS depth FROM supplier")
def cover_inspection(spark, d):
    made = spread(table(spark, d, "supplier")).select("s_suppkey", synth.qr_png(F.col("s_name"), F.lit(1)).alias("content"))
    got = made.select("s_suppkey", media.cover(F.col("content"))["value"].alias("v"))
    depth = F.filter("v.tags", lambda t: t["name"] == "BitDepth")[0]["i"]
    return got.select("s_suppkey", "v.probe.format", F.col("v.qr.ok").alias("qr_ok"), F.col("v.qr.value").alias("symbols"), depth.alias("depth"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE m WHEN 0 THEN (i + j) % 2 WHEN 1 THEN i % 2 WHEN 2 THEN j % 3 WHEN 3 THEN (i + j) % 3 WHEN 4 THEN (i // 2 + j // 3) % 2 WHEN 5 THEN (i * j) % 2 + (i * j) % 3 WHEN 6 THEN ((i * j) % 2 + (i * j) % 3) % 2 ELSE ((i * j) % 3 + (i + j) % 2) % 2 END = 0 AS bit "
    "FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS m, l_partkey % 177 AS i, l_suppkey % 177 AS j FROM lineitem)"
)
def qr_mask_bits(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.qr_mask(F.col("l_orderkey") % 8, F.col("l_partkey") % 177, F.col("l_suppkey") % 177).alias("bit"))


@query(
    "WITH RECURSIVE w AS (SELECT d, d << 10 AS r, 14 AS b FROM range(32) t(d) UNION ALL SELECT d, CASE WHEN (r >> b) & 1 = 1 THEN xor(r, 1335 << (b - 10)) ELSE r END, b - 1 FROM w WHERE b >= 10), "
    "c AS (SELECT d, (d << 10) | r AS word FROM w WHERE b = 9), o AS (SELECT o_orderkey, o_orderkey % 32768 AS raw FROM orders), "
    "m AS (SELECT o_orderkey, word, bit_count(xor(word, raw)) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY bit_count(xor(word, raw)), d) AS r FROM o, c) "
    "SELECT o_orderkey, CASE WHEN n <= 3 THEN word END::INT AS word FROM m WHERE r = 1"
)
def qr_format_word(spark, d):
    return table(spark, d, "orders").select("o_orderkey", codes.nearest_format(F.col("o_orderkey") % 32768).alias("word"))


_BASIC = jpeg.LUMA_QUANT.tolist()


@query(f"SELECT p_partkey, list_transform({_BASIC}, lambda v: least(greatest((v * s + 50) // 100, 1), 255)::INT) AS quant FROM (SELECT p_partkey, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS s FROM (SELECT p_partkey, least(greatest(p_partkey % 110, 1), 100) AS q FROM part))")
def quant_tables(spark, d):
    return table(spark, d, "part").select("p_partkey", codes.quantiser(F.array(*[F.lit(v) for v in _BASIC]), F.col("p_partkey") % 110).alias("quant"))


@query("SELECT n_nationkey, (['gray', 'ycbcr', 'rgb', 'cmyk', 'ycck'])[n_nationkey % 5 + 1] AS transform FROM nation")
def jpeg_color_transform(spark, d):
    k = F.col("n_nationkey") % 5
    n = F.when(k == 0, 1).when(k < 3, 3).otherwise(4)
    ids = F.when(k == 2, F.array(F.lit(82), F.lit(71), F.lit(66))).otherwise(F.sequence(F.lit(1), n))
    return table(spark, d, "nation").select("n_nationkey", codes.color_transform(ids, k == 1, F.when(k == 4, 2)).alias("transform"))


@query("SELECT n_nationkey, lower(hex(n_name))[1:8] AS id_start, n_nationkey % 5 >= 4 AS v4, n_nationkey % 5 AS major FROM nation")
def icc_header_fields(spark, d):
    k = F.col("n_nationkey")
    header = F.unhex(F.concat(F.lit("00" * 8), F.lpad(F.hex(k % 5), 2, "0"), F.lit("00" * 75), F.rpad(F.hex("n_name"), 32, "0"), F.lit("00" * 28)))
    return table(spark, d, "nation").select("n_nationkey", F.substring(codes.icc_profile_id(header), 1, 8).alias("id_start"), codes.icc_is_v4(header).alias("v4"), codes.icc_major_version(header).alias("major"))


@query("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS profile FROM nation GROUP BY n_regionkey")
def icc_reassembly(spark, d):
    n = table(spark, d, "nation")
    counts = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("int").alias("total"))
    smaller = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("other"))
    seq = n.join(smaller, (F.col("n_regionkey") == F.col("r")) & (F.col("other") <= F.col("n_nationkey"))).groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count(F.lit(1)).cast("int").alias("seq"))
    parts = seq.join(counts, "n_regionkey").select("n_regionkey", "seq", "total", F.col("n_name").cast("binary").alias("data"))
    return reports.assembled(parts, "n_regionkey").select("n_regionkey", F.col("profile").cast("string").alias("profile"))


# --- pages and documents --------------------------------------------------------------------------------------------------

_SIDES = "SELECT l_orderkey, l_linenumber, (l_quantity * 20)::FLOAT::DOUBLE AS w, (l_quantity * 10 + l_linenumber * 100)::FLOAT::DOUBLE AS h FROM lineitem"
_SHORT = "greatest(1, least(2048, ceil(least(w, h) * 2048::DOUBLE / greatest(w, h))))::INT"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN w >= h THEN 2048 ELSE {_SHORT} END AS w, CASE WHEN w >= h THEN {_SHORT} ELSE 2048 END AS h FROM ({_SIDES})")
def render_size(spark, d):
    size = pages.render_size(F.col("l_quantity") * 20, F.col("l_quantity") * 10 + F.col("l_linenumber") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.w", "s.h")


@query(f"SELECT l_partkey AS doc, count(*) AS pages, sum(pw::BIGINT * ph)::BIGINT AS pixels, CASE WHEN count(*) > 32 THEN 'Invalid' WHEN sum(pw::BIGINT * ph) > 64000000 THEN 'Limit' END AS error_class FROM (SELECT l_partkey, CASE WHEN w >= h THEN 2048 ELSE {_SHORT} END AS pw, CASE WHEN w >= h THEN {_SHORT} ELSE 2048 END AS ph FROM (SELECT l_partkey, (l_quantity * 20)::FLOAT::DOUBLE AS w, (l_quantity * 10 + l_linenumber * 100)::FLOAT::DOUBLE AS h FROM lineitem)) GROUP BY l_partkey")
def page_budget(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc"), (F.col("l_quantity") * 20).alias("w"), (F.col("l_quantity") * 10 + F.col("l_linenumber") * 100).alias("h"))
    return documents.page_budget(rows).select("doc", "pages", "pixels", "error_class")


@query("SELECT p_partkey, CASE WHEN p_partkey % 180 = 90 THEN h ELSE w END AS w, CASE WHEN p_partkey % 180 = 90 THEN w ELSE h END AS h FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN 600.0 - p_size ELSE 595.0 END::DOUBLE AS w, CASE WHEN p_size > 10 THEN 700.0 - 10 ELSE 842.0 END::DOUBLE AS h FROM part)")
def page_geometry(spark, d):
    s = F.col("p_size").cast("double")
    box = lambda a, b, c, e: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), e.alias("y1"))
    zero = F.lit(0.0)
    media_box = box(s, zero, F.when(s > 10, F.lit(600.0)).otherwise(s), F.lit(690.0))
    crop = box(zero, zero, F.lit(2000.0), F.lit(1000.0))
    size = pages.rotated(pages.page_box(media_box, crop), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.w", "s.h")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 32 AND o_orderstatus <> 'P' THEN (o_orderkey % 40)::INT END AS pages, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 32 AND o_orderstatus <> 'P' THEN NULL ELSE 'Invalid' END AS error_class FROM orders")
def pdfinfo_pages(spark, d):
    text = F.concat(F.lit("Title: a\nPages:  99\nPages: "), (F.col("o_orderkey") % 40).cast("string"), F.lit("\nEncrypted: "), F.when(F.col("o_orderstatus") == "P", "yes").otherwise("no"), F.lit("\n"))
    return table(spark, d, "orders").select("o_orderkey", pages.info_pages(text).alias("r")).select("o_orderkey", "r.pages", "r.error_class")


@query("SELECT r_regionkey, count(*)::INT AS pages, false AS encrypted, '1.4' AS version, (count(*) * 4)::BIGINT AS operators, (count(*) * 3 + 2)::BIGINT AS objects FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def pdf_roundtrip(spark, d):
    n = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n"))
    made = spread(n).select("r_regionkey", synth.n_page_pdf(F.col("n")).alias("content"))
    info = made.select("r_regionkey", media.pdf_info(F.col("content"))["value"].alias("v"), pages.pdf_version(F.col("content")).alias("version"))
    ops = made.lateralJoin(tables.PdfOps(F.col("content").outer())).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("operators"))
    objects = made.lateralJoin(tables.PdfObjects(F.col("content").outer())).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("objects"))
    return info.join(ops, "r_regionkey").join(objects, "r_regionkey").select("r_regionkey", "v.pages", "v.encrypted", "version", "operators", "objects")


@query("SELECT r_regionkey, count(*) AS pages, 2048 AS w, 1024 AS h, true AS gray FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def pdf_sanitized(spark, d):
    n = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n"))
    made = spread(n).select("r_regionkey", synth.n_page_pdf(F.col("n")).alias("content"))
    frames = made.lateralJoin(tables.PdfFrames(F.col("content").outer()))
    middle = F.conv(F.hex(F.substring("rgb", 3_000_001, 1)), 16, 10).cast("int")
    return frames.groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("pages"), F.max("w").alias("w"), F.max("h").alias("h"), F.min(F.abs(middle - 128) <= 2).alias("gray"))


@query("SELECT n_regionkey AS doc, (12 + sum(8 + 4 * (n_nationkey % 5 + 1) * 3))::BIGINT AS n_bytes, count(*) AS pages, NULL::VARCHAR AS error_class FROM nation GROUP BY n_regionkey")
def frame_streams(spark, d):
    n = table(spark, d, "nation")
    other = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("o"))
    placed = n.join(other, (F.col("r") == F.col("n_regionkey")) & (F.col("o") <= F.col("n_nationkey"))).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("page_no"))
    w = F.col("n_nationkey") % 5 + 1
    frames = placed.select(F.col("n_regionkey").alias("doc"), "page_no", w.alias("w"), F.lit(4).alias("h"), F.unhex(F.repeat(F.lit("7F"), (w * 12).cast("int"))).alias("rgb"))
    sizes = documents.frame_stream(frames).select("doc", F.octet_length("stream").cast("long").alias("n_bytes"))
    errors = documents.frame_errors(frames).select("doc", "error_class")
    return sizes.join(frames.groupBy("doc").agg(F.count(F.lit(1)).alias("pages")), "doc").join(errors, "doc")


@query("SELECT l_orderkey, l_linenumber, 1 + pow(least(greatest(x, 0), 1), 2) * (3 - 1) AS two, CASE WHEN x < 0.5 THEN x / 0.5 ELSE 1 - (x - 0.5) / 0.5 END AS three, CASE WHEN x > 0.25 THEN x * x ELSE 1 - x END AS four FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x FROM lineitem)")
def page_functions(spark, d):
    x = F.col("x")
    two = pages.exponential(x, F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.lit(2.0))[0]
    three = pages.stitched(x, [0.5], [(0.0, 1.0), (1.0, 0.0)], [lambda t: t, lambda t: t], 0.0, 1.0)
    four = postscript.column(postscript.tokens(b"{ dup 0.25 gt { dup mul } { 1 exch sub } ifelse }"), [x])[0]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", two.alias("two"), three.alias("three"), four.alias("four"))


# --- recognised words -------------------------------------------------------------------------------------------------------


@query(
    "WITH w AS (SELECT conv_id AS page, turn AS block, (i - 1) // 5 AS line, i AS word, t AS text, (i - 1) % 5 * 100 AS x0, 900 - turn * 100 - (i - 1) // 5 * 20 AS y0 FROM (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\\s+') AS l FROM conversations WHERE trim(text) <> ''))), "
    "n AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY block) AS b, dense_rank() OVER (PARTITION BY page, block ORDER BY line) AS ln FROM w) "
    "SELECT page, level, count(*) AS n, sum(\"left\")::BIGINT AS lefts, sum(top)::BIGINT AS tops FROM ("
    "SELECT page, 5 AS level, least(x0, 1000) AS \"left\", greatest(0, least(1000, 1000 - (y0 + 15))) AS top FROM n UNION ALL "
    "SELECT page, 4, min(x0), greatest(0, least(1000, 1000 - (max(y0) + 15))) FROM n GROUP BY page, b, ln UNION ALL "
    "SELECT page, 3, min(x0), greatest(0, least(1000, 1000 - (max(y0) + 15))) FROM n GROUP BY page, b UNION ALL "
    "SELECT page, 2, min(x0), greatest(0, least(1000, 1000 - (max(y0) + 15))) FROM n GROUP BY page, b UNION ALL "
    "SELECT DISTINCT page, 1, 0, 0 FROM n) GROUP BY page, level"
)
def tsv_rollup(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), F.split(F.trim("text"), r"\s+").alias("l")).where("trim(element_at(l, 1)) <> ''")
    rows = c.select("page", "block", F.posexplode("l").alias("i", "text"))
    y0 = 900 - F.col("block") * 100 - F.floor(F.col("i") / 5) * 20
    placed = rows.select("page", "block", F.floor(F.col("i") / 5).alias("line"), F.col("i").alias("word"), "text", (F.col("i") % 5 * 100).alias("x0"), y0.alias("y0"), (F.col("i") % 5 * 100 + 90).alias("x1"), (y0 + 15).alias("y1"), F.lit(-1.5).alias("certainty"), F.lit(1000).alias("page_w"), F.lit(1000).alias("page_h"))
    out = words.tsv(placed)
    return out.groupBy("page", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("lefts"), F.sum("top").alias("tops"))


@query("SELECT event_id, least(greatest(100 + 5 * (value / -50), 0), 100) AS conf FROM events")
def word_confidence(spark, d):
    return table(spark, d, "events").select("event_id", codes.confidence(F.col("value") / -50).alias("conf"))
