"""Media kernels as Arrow-batched column functions.

Every function takes a binary column and gives ``struct<ok,error_class,error,value>``: one
bad file is a row with an error and not a failed task.  A struct is made in one pass, so
several of its fields cost one evaluation.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Deadline, Invalid, guarded
from ..kernels import cmap, deflate, frames, icc, image, jpeg, morph, pdf, pdf_filters, pdf_render, png, qr, sanitize, skim
from ..kernels import meta as meta_kernel
from ..kernels.image import Image

TAG = "struct<pos:int,tag_group:string,name:string,kind:string,i:bigint,r:double,s:string,l:array<string>>"
IMAGE = "struct<width:int,height:int,format:string,data:binary>"
SECONDS = 120.0


def result(value: str) -> str:
    return f"ok boolean, error_class string, error string, value {value}"


@cache
def _udf(name: str, value: str) -> Callable[..., Column]:
    kernel = _KERNELS[name][1]

    @F.pandas_udf(result(value))
    def run(data: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        rows = [
            {"ok": None, "error_class": None, "error": None, "value": None} if data.iloc[k] is None else guarded(kernel, bytes(data.iloc[k]), *[r.iloc[k] for r in rest])
            for k in range(len(data))
        ]
        return pd.DataFrame(rows, columns=["ok", "error_class", "error", "value"])

    return run


def call(name: str, content: Column, *args: Column) -> Column:
    """A kernel by name; null bytes give a null struct's fields."""
    return _udf(name, _KERNELS[name][0])(content, *args)


def _image(img: Image) -> dict[str, Any]:
    return {"width": img.width, "height": img.height, "format": img.format, "data": img.data.tobytes()}


def _meta(data: bytes) -> dict[str, Any]:
    t = meta_kernel.read(data)
    return {"tags": t.tags, "warnings": t.warnings, "icc": t.icc}


def _lean(data: bytes) -> dict[str, Any]:
    source = skim.Source(io.BytesIO(data))
    t = meta_kernel.read(skim.compact(source))
    return {"tags": t.tags, "warnings": t.warnings, "icc": t.icc, "bytes_read": source.used}


def _resampled(data: bytes, how: str, x: float, y: float) -> dict[str, Any]:
    """Gray pixels after one of the steps of page scaling."""
    gray = image.luma(sanitize.decoded(data)[0])
    out = {"halve": lambda: image.halve(gray), "linear": lambda: image.scale_linear(gray, x, y), "area": lambda: image.scale_area(gray, x, y), "smooth": lambda: image.smooth(gray, int(x)), "unsharp": lambda: image.unsharp(gray, int(x), y), "scale": lambda: image.scale_gray(gray, x, y)}[how]()
    return {"width": out.shape[1], "height": out.shape[0], "data": np.ascontiguousarray(out).tobytes()}


def _ink(data: bytes) -> dict[str, int]:
    """Counts of a binary page after each step of morphology."""
    a = morph.binarise([image.page_luminance(sanitize.decoded(data)[0])])
    labels = [morph.components(a, k)[1] for k in (4, 8)]
    seed = np.zeros_like(a)
    first = np.argwhere(a)[:1]
    seed[tuple(first.T)] = True
    facts = {"dilated": morph.dilate(a, 3, 3), "eroded": morph.erode(a, 3, 3), "opened": morph.opened(a, 3, 3), "closed": morph.closed(a, 3, 3), "filled": morph.seed_fill(seed, a), "reduced": morph.reduce_rank(a, 1)}
    return {"ink": int(a.sum()), **{k: int(v.sum()) for k, v in facts.items()}, "parts_4": labels[0], "parts_8": labels[1], "deepest": int(morph.distance(a).max()), "outlines": len(morph.outlines(a))}


def _icc(data: bytes) -> dict[str, Any]:
    p = icc.Profile(data)
    return {"description": p.description, "id": p.id_hex, "space": p.space.decode("latin-1"), "version": p.version, "v4": p.is_v4, "tags": [k.decode("latin-1") for k in p.tags]}


def _png_info(data: bytes) -> dict[str, Any]:
    i = png.read_info(data)
    return {"width": i.width, "height": i.height, "depth": i.depth, "color_type": i.color_type, "interlace": i.interlace, "frames": i.frames, "texts": [{"key": k, "lang": g, "text": t} for k, g, t in i.texts], "trailing": i.trailing}


def _jpeg_info(data: bytes) -> dict[str, Any]:
    i = jpeg.read_info(data)
    return {"width": i.width, "height": i.height, "sof": i.sof, "components": len(i.components), "jfif": i.jfif, "adobe": i.adobe, "transform": i.transform, "comments": [c.decode("latin-1") for c in i.comments]}


def _inflate(data: bytes, limit: int) -> dict[str, Any]:
    out, used, whole = deflate.inflate(data, int(limit))
    return {"data": out, "consumed": used, "complete": whole}


def _pdf_facts(data: bytes) -> dict[str, Any]:
    d = pdf.Document(data)
    info = d.info()
    return {"version": d.version(), "title": info.get("Title"), "author": info.get("Author"), "repaired": d.repaired}


def _pdf_pages(data: bytes) -> list[dict[str, float]]:
    d = pdf.Document(data)
    return [dict(zip(("w", "h"), d.size(p), strict=True)) for p in d.pages()]


def _page_layout(data: bytes) -> dict[str, Any]:
    """Ink parts of a page image: threshold, rules and pictures away, then connected parts."""
    from ..kernels.image import page_luminance, to_rgb

    img = sanitize.decoded(data)[0]
    planes = [page_luminance(img)] if img.channels < 3 else list(np.moveaxis(to_rgb(img).samples(), 2, 0))
    ink = morph.binarise(planes)
    ink, across, down = morph.remove_lines(ink)
    ink &= ~morph.photo_mask(ink)
    parts = morph.boxes(ink, 8)
    return {"width": img.width, "height": img.height, "ink": int(ink.sum()), "rules": len(morph.boxes(across)) + len(morph.boxes(down)), "parts": [dict(zip(("left", "top", "width", "height"), p, strict=True)) for p in parts]}


def _page(data: bytes, number: int) -> dict[str, Any]:
    doc, pages, sizes = pdf_render.checked(data)
    if not 1 <= number <= len(pages):
        raise Invalid("page number")
    return _image(pdf_render.render(doc, pages[int(number) - 1], _budget(), sizes[int(number) - 1]))


def _marks(data: bytes) -> list[dict[str, Any]]:
    """Colours of the first page but white, at one pixel a point: how many pixels, and their box."""
    doc = pdf.Document(data)
    first = doc.pages()[0]
    w, h = (max(1, min(2048, round(x))) for x in doc.size(first))
    px = pdf_render.render(doc, first, _budget(), (w, h)).samples().astype(np.int64)
    value = px[:, :, 0] << 16 | px[:, :, 1] << 8 | px[:, :, 2]
    out = []
    for v in np.unique(value[value != 0xFFFFFF])[:256].tolist():
        y, x = np.nonzero(value == v)
        out.append({"colour": f"{v:06X}", "pixels": len(x), "left": int(x.min()), "top": int(y.min()), "right": int(x.max()), "bottom": int(y.max())})
    return out


def _codes(data: bytes, text: bytes) -> list[dict[str, Any]]:
    """A string's codes through a character map: identifier and text of each, null where the map has none."""
    m = cmap.parse(data)
    return [{"code": c, "cid": m.cid(c, n), "text": m.text(c, n)} for c, n in m.split(bytes(text))]


def _filter(data: bytes, name: str) -> bytes:
    return pdf_filters.apply(name, data, {})


def _budget() -> Deadline:
    return Deadline(SECONDS)


_BOX = "struct<left:int,top:int,width:int,height:int>"
_KERNELS: dict[str, tuple[str, Callable[..., Any]]] = {
    "probe": ("struct<format:string,width:int,height:int>", sanitize.probe),
    "verify": ("struct<format:string,width:int,height:int>", lambda d: sanitize.verify(d, _budget())),
    "metadata": (f"struct<tags:array<{TAG}>,warnings:array<string>,icc:binary>", _meta),
    "metadata_lean": (f"struct<tags:array<{TAG}>,warnings:array<string>,icc:binary,bytes_read:bigint>", _lean),
    "resampled": ("struct<width:int,height:int,data:binary>", _resampled),
    "ink": ("struct<ink:int,dilated:int,eroded:int,opened:int,closed:int,filled:int,reduced:int,parts_4:int,parts_8:int,deepest:int,outlines:int>", _ink),
    "page_gray": ("struct<width:int,height:int,data:binary>", lambda d: (lambda y: {"width": y.shape[1], "height": y.shape[0], "data": np.ascontiguousarray(y).tobytes()})(image.page_luminance(sanitize.decoded(d)[0]))),
    "pdf_facts": ("struct<version:string,title:string,author:string,repaired:boolean>", _pdf_facts),
    "frame_stream": ("array<struct<page_no:int,w:int,h:int,rgb:binary>>", frames.read),
    "inflate_exact": ("binary", lambda d, n: deflate.inflate_exact(d, int(n))),
    "compress_pieces": ("binary", lambda d, n: deflate.compress_pieces(d, int(n))),
    "cover": (f"struct<probe:struct<format:string,width:int,height:int>,tags:array<{TAG}>,warnings:array<string>,qr:struct<ok:boolean,error:string,value:int>>", lambda d: sanitize.inspect(d, _budget())),
    "qr_count": ("int", lambda d: sanitize.qr_count(d, _budget())),
    "qr_scan": ("struct<candidates:int,decoded:int>", lambda d: qr.scan(sanitize.intensity(d, _budget()), _budget())),
    "decode": (IMAGE, lambda d: _image(sanitize.decoded(d, _budget())[0])),
    "pixels": (IMAGE, lambda d: _image(sanitize.pixels(d, _budget()))),
    "luma": ("struct<width:int,height:int,data:binary>", lambda d: (lambda y: {"width": y.shape[1], "height": y.shape[0], "data": y.tobytes()})(sanitize.intensity(d, _budget()))),
    "sanitize": ("binary", lambda d, kind: sanitize.sanitize(d, kind, _budget())),
    "convert": ("binary", lambda d, target, quality: sanitize.convert(d, target, int(quality), _budget())),
    "signature": ("boolean", png.validate_signature),
    "png_info": ("struct<width:bigint,height:bigint,depth:int,color_type:int,interlace:int,frames:bigint,texts:array<struct<key:string,lang:string,text:string>>,trailing:int>", _png_info),
    "jpeg_info": ("struct<width:int,height:int,sof:int,components:int,jfif:boolean,adobe:int,transform:string,comments:array<string>>", _jpeg_info),
    "icc": ("struct<description:string,id:string,space:string,version:int,v4:boolean,tags:array<string>>", _icc),
    "inflate": ("struct<data:binary,consumed:bigint,complete:boolean>", _inflate),
    "compress": ("binary", lambda d, level: deflate.compress(d, int(level))),
    "pdf_info": ("struct<pages:int,encrypted:boolean>", pdf.inspect),
    "pdf_pages": ("array<struct<w:double,h:double>>", _pdf_pages),
    "pdf_filter": ("binary", _filter),
    "pdf_page": (IMAGE, _page),
    "pdf_marks": ("array<struct<colour:string,pixels:int,left:int,top:int,right:int,bottom:int>>", _marks),
    "character_codes": ("array<struct<code:int,cid:int,text:string>>", _codes),
    "pdf_sanitize": ("binary", lambda d: pdf_render.sanitize(d, _budget())),
    "page_layout": (f"struct<width:int,height:int,ink:bigint,rules:int,parts:array<{_BOX}>>", _page_layout),
}


def encode_png(image: Column) -> Column:
    """A PNG of an image struct."""
    return _encoder("png", 0)(image)


def encode_jpeg(image: Column, quality: int = 90) -> Column:
    """A JPEG of an image struct (gray or RGB)."""
    return _encoder("jpeg", quality)(image)


@cache
def _encoder(kind: str, quality: int) -> Callable[..., Column]:
    @F.pandas_udf(result("binary"))
    def run(image: pd.DataFrame) -> pd.DataFrame:
        return _encoded(image, png.encode if kind == "png" else lambda i: jpeg.encode(i, quality))

    return run


def _encoded(image: pd.DataFrame, encode: Callable[[Image], bytes]) -> pd.DataFrame:
    def one(r: Any) -> bytes:
        px = np.frombuffer(r.data, dtype=np.uint8)
        return encode(Image(int(r.width), int(r.height), r.format, px.reshape(int(r.height), -1)))

    return pd.DataFrame([guarded(one, r) for r in image.itertuples()], columns=["ok", "error_class", "error", "value"])


def _named(name: str) -> Callable[..., Column]:
    def f(content: Column, *args: Column) -> Column:
        return call(name, content, *args)

    f.__name__ = name
    f.__doc__ = f"``{name}`` of a binary column: ``struct<{result(_KERNELS[name][0])}>``."
    return f


probe, verify, metadata, cover, qr_count, qr_scan = (_named(n) for n in ("probe", "verify", "metadata", "cover", "qr_count", "qr_scan"))
decode, pixels, luma, clean, convert, signature = (_named(n) for n in ("decode", "pixels", "luma", "sanitize", "convert", "signature"))
png_info, jpeg_info, icc_info, inflate, compress = (_named(n) for n in ("png_info", "jpeg_info", "icc", "inflate", "compress"))
pdf_info, pdf_pages, pdf_filter, page_layout = (_named(n) for n in ("pdf_info", "pdf_pages", "pdf_filter", "page_layout"))
metadata_lean, resampled, ink, page_gray, pdf_facts = (_named(n) for n in ("metadata_lean", "resampled", "ink", "page_gray", "pdf_facts"))
pdf_marks, character_codes = _named("pdf_marks"), _named("character_codes")
inflate_exact, compress_pieces, frame_stream = (_named(n) for n in ("inflate_exact", "compress_pieces", "frame_stream"))
pdf_page, pdf_sanitize = (_named(n) for n in ("pdf_page", "pdf_sanitize"))


def register(spark) -> None:
    """All kernels under their names with ``media_`` in front, for SQL."""
    for name, (value, _) in _KERNELS.items():
        spark.udf.register(f"media_{name}", _udf(name, value))
