"""Table functions: parts of a file as rows, for use with LATERAL."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from ..errors import MediaError
from ..kernels import icc, jpeg, meta, pdf, pdf_render, png


@udtf(returnType="idx int, offset int, kind string, length int, crc_ok boolean, data binary")
class PngChunks:
    """Chunks of a PNG, checksums told but not asked for."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for i, c in enumerate(png.chunks(bytes(content or b""), check=False)):
                yield i, c.offset, c.kind.decode("latin-1"), len(c.data), c.crc_ok, c.data
        except MediaError:
            return


@udtf(returnType="idx int, offset int, marker int, length int, data binary")
class JpegSegments:
    """Segments of a JPEG up to its first scan."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = jpeg.segments(bytes(content or b""))
        except MediaError:
            return
        for i, (offset, marker, data) in enumerate(found):
            yield i, offset, marker, len(data), data


@udtf(returnType="pos int, tag_group string, name string, kind string, i bigint, r double, s string, l array<string>")
class MetaTags:
    """Tags of a file in the order of extraction."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            tags = meta.read(bytes(content or b"")).tags
        except MediaError:
            return
        for t in tags:
            yield tuple(t.values())


@udtf(returnType="idx int, name string, length int, data binary")
class IccTags:
    """Tags of a colour profile."""

    def eval(self, profile: bytes) -> Iterator[tuple]:
        try:
            tags = icc.Profile(bytes(profile or b"")).tags
        except MediaError:
            return
        for i, (name, data) in enumerate(tags.items()):
            yield i, name.decode("latin-1"), len(data), data


@udtf(returnType="obj_no int, kind string, json string, stream binary")
class PdfObjects:
    """Objects of a document."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            doc = pdf.Document(bytes(content or b""))
        except MediaError:
            return
        for n, obj in doc.objects():
            kind = {dict: "dict", list: "array", bytes: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}.get(type(obj), "stream" if isinstance(obj, pdf.Stream) else "name")
            yield n, kind, json.dumps(pdf.printable(obj)), obj.raw if isinstance(obj, pdf.Stream) else None


@udtf(returnType="page_no int, w double, h double, rotate int, ops int")
class PdfPages:
    """Pages of a document with the size that they show and the number of their operators."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            doc = pdf.Document(bytes(content or b""))
            pages = doc.pages()
        except MediaError:
            return
        for i, p in enumerate(pages):
            w, h = doc.size(p)
            turn = doc.get(p.get("Rotate"))
            yield i + 1, w, h, int(turn) if isinstance(turn, int | float) else 0, sum(1 for _ in pdf.operators(doc.content(p)))


@udtf(returnType="page_no int, seq int, op string, operands array<string>")
class PdfOps:
    """Content operators of all pages, operands as JSON texts."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            doc = pdf.Document(bytes(content or b""))
            pages = doc.pages()
        except MediaError:
            return
        for i, p in enumerate(pages):
            for k, (op, operands) in enumerate(pdf.operators(doc.content(p))):
                yield i + 1, k, op, [json.dumps(pdf.printable(o)) for o in operands]


@udtf(returnType="page_no int, w int, h int, rgb binary")
class PdfFrames:
    """Pages of a document as pixels; a document that's refused gives no row."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            yield from pdf_render.frames(bytes(content or b""))
        except MediaError:
            return


ALL = {"png_chunks": PngChunks, "jpeg_segments": JpegSegments, "meta_tags": MetaTags, "icc_tags": IccTags, "pdf_objects": PdfObjects, "pdf_pages": PdfPages, "pdf_ops": PdfOps, "pdf_frames": PdfFrames}


def register(spark) -> None:
    for name, f in ALL.items():
        spark.udtf.register(name, f)
