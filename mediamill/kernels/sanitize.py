"""Whole-file operations: probing, decoding, cleaning and converting images."""

from __future__ import annotations

import numpy as np

from ..errors import Deadline, Invalid, Limit
from . import exif, icc, jpeg, meta, png, qr
from .image import Image, luma, to_rgb, upright

# The largest side of a cleaned image and the largest cleaned file.
MOST_SIDE, MOST_OUTPUT = 8000, 20 << 20


def raster(data: bytes) -> str:
    kind = "png" if data[:8] == png.SIGNATURE else "jpeg" if data[:3] == b"\xff\xd8\xff" else None
    if kind is None:
        raise Invalid("unsupported image")
    return kind


def probe(data: bytes) -> dict:
    """Container and size from headers; a PNG's checksums are all looked at."""
    kind = raster(data)
    info = png.read_info(data) if kind == "png" else jpeg.read_info(data)
    return {"format": f"{kind}_pipe", "width": info.width, "height": info.height}


def _orientation(data: bytes, info, kind: str) -> int:
    found = exif.orientation(info.exif) if info.exif else None
    packet = getattr(info, "xmp", None)
    if kind == "png":
        for key, _, text in info.texts:
            if found is None and key in ("Raw profile type exif", "Raw profile type APP1"):
                body = meta.raw_profile(text)
                found = exif.orientation(body.removeprefix(b"Exif\0\0")) if body else None
            elif key == "XML:com.adobe.xmp":
                packet = packet or text.encode()
    if found is None and packet:
        _, sep, rest = packet.partition(b"tiff:Orientation")
        digits = rest.lstrip(b"=>\"' \t\r\n")[:8] if sep else b""
        head = digits[: len(digits) - len(digits.lstrip(b"0123456789"))]
        found = int(head) if head else None
    return found if found is not None else 1


def decoded(data: bytes, deadline: Deadline | None = None) -> tuple[Image, bytes | None, int]:
    """Pixels, profile and orientation; animations and multi-picture files are refused."""
    kind = raster(data)
    if kind == "png":
        info, img = png.decode(data, deadline)
        if info.frames is not None and info.frames != 1:
            raise Invalid("animated image")
    else:
        info, img = jpeg.decode(data, deadline)
        if info.multi_picture is not None and (exif.picture_count(info.multi_picture) or 2) > 1:
            raise Invalid("multi-picture image")
    return img, info.icc, _orientation(data, info, kind)


def pixels(data: bytes, deadline: Deadline | None = None) -> Image:
    """Upright sRGB pixels without anything else."""
    img, profile, orientation = decoded(data, deadline)
    img = upright(img, orientation)
    if max(img.width, img.height) > MOST_SIDE:
        raise Limit("image dimensions exceeded")
    if profile is not None:
        n = {"gray8": 1, "gray_alpha8": 1, "rgb8": 3, "rgba8": 3, "cmyk8": 4}[img.format]
        px = img.samples()[:, :, :n].reshape(-1, n)
        return Image(img.width, img.height, "rgb8", icc.to_srgb(profile, n).convert(px).reshape(img.height, -1))
    return to_rgb(img)


def verify(data: bytes, deadline: Deadline | None = None) -> dict:
    """A probe whose pixels decode to the size that it says."""
    out = probe(data)
    if out["format"] == "png_pipe":
        img = png.decode(data, deadline)[1]
        size = img.width, img.height
    else:
        size = jpeg.decode_luma(data, deadline)[1].shape[::-1]
    if size != (out["width"], out["height"]):
        raise Invalid("image size differs")
    return out


def intensity(data: bytes, deadline: Deadline | None = None) -> np.ndarray:
    """A brightness for each pixel: the Y plane, or luma."""
    if raster(data) == "jpeg":
        return jpeg.decode_luma(data, deadline)[1]
    return luma(decoded(data, deadline)[0])


def sanitize(data: bytes, kind: str, deadline: Deadline | None = None) -> bytes:
    """A clean file of the same pixels: PNG, or JPEG at quality 95; a signature is checked first and stays a PNG."""
    if kind == "signature":
        png.validate_signature(data)
    elif kind not in ("png", "jpeg"):
        raise Invalid("unsupported media type")
    elif raster(data) != kind:
        raise Invalid("media type differs")
    img = pixels(data, deadline)
    out = jpeg.encode(img, 95, "444") if kind == "jpeg" else png.encode(img)
    if len(out) > MOST_OUTPUT:
        raise Limit("output exceeded limit")
    return out


def convert(data: bytes, target: str, quality: int = 90, deadline: Deadline | None = None) -> bytes:
    img = pixels(data, deadline)
    return jpeg.encode(img, quality) if target in ("jpg", "jpeg") else png.encode(img)


def qr_count(data: bytes, deadline: Deadline | None = None) -> int:
    return qr.scan(intensity(data, deadline), deadline)["decoded"]


def inspect(data: bytes, deadline: Deadline | None = None) -> dict:
    """Probe, tags and QR symbols in one go; symbols that can't be read for are an error of their own field."""
    from ..errors import guarded

    out = probe(data)
    tags = meta.read(data)
    found = guarded(qr_count, data, deadline)
    return {"probe": out, "tags": tags.tags, "warnings": tags.warnings, "qr": {"ok": found["ok"], "error": found["error"], "value": found["value"]}}
