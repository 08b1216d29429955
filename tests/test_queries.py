"""Every query with SQL against that SQL on the smallest tables, and a few properties that SQL doesn't show."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mediamill.functions import detect, media, pixels
from mediamill.kernels import image, jpeg, pdf_write, png
from mediamill.operators import documents, pixel_stats, reports
from mediamill.plans import composed  # noqa: F401
from mediamill.plans.queries import ORACLES, QUERIES
from mediamill.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    expected = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(plain(v) for v in r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


@needs_data
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"s_suppkey", "format", "qr_ok", "symbols", "depth"}


def test_names_of_queries_and_sql():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bad_files_are_rows_with_errors(spark):
    good = png.encode(image.Image(4, 3, "gray8", np.zeros((3, 4), np.uint8)))
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, None), (4, good[:-6])], "id int, content binary")
    got = {r.id: r.r for r in df.select("id", media.probe(F.col("content")).alias("r")).collect()}
    assert got[1].ok and got[1].value.width == 4
    assert (got[2].ok, got[2].error_class) == (False, "Invalid") and got[4].error_class == "Invalid"
    assert got[3].ok is None


def test_one_evaluation_for_several_fields(spark):
    df = spark.createDataFrame([(b"x",)], "content binary").select(media.probe(F.col("content")).alias("r")).select("r.ok", "r.error", "r.value.width")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_length_filter_reaches_the_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 1000)
    from mediamill.sources.files import read_media

    df = read_media(spark, str(tmp_path), most_bytes=100)
    assert df.count() == 1 and "LessThanOrEqual(length,100)" in df._jdf.queryExecution().executedPlan().toString()


def test_tag_source_and_file_sink(spark, tmp_path):
    made = png.encode(image.Image(1, 1, "gray8", np.zeros((1, 1), np.uint8)), extra=[(b"tEXt", b"Software\0Suno")])
    rows = spark.createDataFrame([("a/one.png", made), ("two.bin", b"junk")], "name string, content binary")
    rows.write.format("mediafiles").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/a/one.png").read_bytes() == made
    tags = spark.read.format("mediatags").load(str(tmp_path / "out")).collect()
    assert any(t.name == "Software" and t.s == "Suno" for t in tags) and any(t.error for t in tags if t.file.endswith("two.bin"))


def test_stream_drops_copies(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    a = png.encode(image.Image(2, 2, "gray8", np.zeros((2, 2), np.uint8)))
    for n, d in (("1.png", a), ("2.png", a), ("3.jpg", jpeg.encode(image.Image(2, 2, "gray8", np.zeros((2, 2), np.uint8))))):
        (src / n).write_bytes(d)
    seen = []
    q = ingest.run(ingest.inspected(ingest.arrivals(spark, str(src))), lambda df, _: seen.extend(df.collect()), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(r.file_type for r in seen) == ["jpeg", "png"] and all(r.probe.ok for r in seen)


def test_color_report_takes_the_first_of_the_lowest_rank(spark):
    rows = [("f", 0, "IFD1", "Orientation", "1"), ("f", 1, "IFD0", "Orientation", "6"), ("f", 2, "ExifIFD", "Orientation", "3"), ("f", 3, "IFD0", "Make", "x")]
    df = spark.createDataFrame(rows, "file string, pos int, tag_group string, name string, value string")
    assert [tuple(r) for r in reports.color_report(df).collect()] == [("f", "Orientation", "6")]
    assert reports.color_columns(df).first()["Orientation"] == "6"
    assert reports.capped(df, most_tags=2).count() == 2


def test_finder_runs_in_rows(spark):
    row = [0] * 3 + [1] * 2 + [0] * 2 + [1] * 6 + [0] * 2 + [1] * 2 + [0] * 3
    df = spark.createDataFrame([(1, 0, x, bool(v)) for x, v in enumerate(row)], "img_id int, y int, x int, black boolean")
    got = pixel_stats.finder_runs(pixel_stats.runs(df)).collect()
    assert [(r.x0, r.x1) for r in got] == [(3, 16)]


def test_orientation_columns_agree_with_the_kernel(spark):
    img = image.Image(3, 2, "gray8", np.arange(6, dtype=np.uint8).reshape(2, 3))
    df = spark.createDataFrame([(o, x, y) for o in range(1, 10) for x in range(3) for y in range(2)], "o int, x int, y int")
    for r in df.select("*", pixels.oriented(F.col("x"), F.col("y"), F.lit(3), F.lit(2), F.col("o")).alias("n")).collect():
        up = image.upright(img, r.o)
        assert up.samples()[r.n.y, r.n.x, 0] == img.samples()[r.y, r.x, 0]


def test_assembly_and_frames(spark):
    part = jpeg.encode(image.Image(16, 8, "gray8", np.zeros((8, 16), np.uint8)))
    rows = [("a", 2, 16, 8, part), ("a", 1, 16, 8, part), ("gap", 1, 16, 8, part), ("gap", 3, 16, 8, part)]
    df = spark.createDataFrame(rows, "doc string, page_no int, w int, h int, jpeg binary")
    got = {r.doc: bytes(r.pdf) for r in documents.assemble(df).collect()}
    assert got == {"a": pdf_write.image_pdf([(16, 8, part)] * 2)}
    frames = spark.createDataFrame([("a", 1, 2, 1, bytes(6)), ("b", 1, 2, 1, bytes(5)), ("c", 2, 1, 1, bytes(3))], "doc string, page_no int, w int, h int, rgb binary")
    assert {r.doc: r.error_class for r in documents.frame_errors(frames).collect()} == {"a": None, "b": "Invalid", "c": "Invalid"}
    stream = documents.frame_stream(frames).where("doc = 'a'").first().stream
    assert bytes(stream) == b"APDFRGB1" + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(6)


def test_file_types_in_sql_agree_with_the_kernel(spark):
    from mediamill.kernels import meta

    heads = [b"\xff\xd8\xff", png.SIGNATURE, b"RIFF\0\0\0\0WAVE", b"RF64\0\0\0\0WAVE", b"FORM\0\0\0\0AIFC", b"\0\0\0\0ftypxxxx", b"wvpk", b"fLaC", b"ID3\3\0\0\0\0\0\1xTTA1", b"ID3\4\0\x10\0\0\0\1x" + bytes(10) + b"fLaC", b"", b"RIFF"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    assert [r[0] for r in df.select(detect.file_type(F.col("c"))).collect()] == [meta.detect(h) for h in heads]


def test_media_files_with_long_keys(spark, tmp_path):
    """the SQL's length holds for keys of any number of digits."""
    duckdb = pytest.importorskip("duckdb")
    keys = [7, 42, 999, 1000, 9999, 10000, 59999, 123456, 7654321, 2**62]
    spark.createDataFrame([(k, f"Supplier#{k % 10**9:09d}") for k in keys], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    df = QUERIES["media_files"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("s_suppkey", "tag", "value", "length").collect())
    assert got == sorted(con.sql(ORACLES["media_files"]).fetchall()) and len(got) == len(keys)
