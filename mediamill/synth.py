"""Deterministic media made of table rows, so that a query over files can be checked against the rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .kernels import jpeg, pdf_write, png, qr
from .kernels.image import Image

__all__ = ["flat_png", "gray_jpeg", "gray_png", "n_page_pdf", "photo", "qr_png", "text_png", "wave"]


@F.pandas_udf(BinaryType())
def flat_png(w: pd.Series, h: pd.Series, level: pd.Series) -> pd.Series:
    """A gray PNG of one level."""
    return pd.Series([png.encode(Image(int(a), int(b), "gray8", np.full((int(b), int(a)), int(v), np.uint8))) for a, b, v in zip(w, h, level, strict=True)])


@F.pandas_udf(BinaryType())
def text_png(key: pd.Series, text: pd.Series) -> pd.Series:
    """A PNG of one pixel with a text chunk."""
    one = Image(1, 1, "gray8", np.zeros((1, 1), np.uint8))
    return pd.Series([png.encode(one, extra=[(b"iTXt", k.encode("latin-1") + b"\0\0\0\0\0" + t.encode())]) for k, t in zip(key, text, strict=True)])


@F.pandas_udf(BinaryType())
def gray_png(samples: pd.Series) -> pd.Series:
    """A PNG of one row of gray samples."""
    return pd.Series([png.encode(Image(len(s), 1, "gray8", np.asarray(s, dtype=np.uint8).reshape(1, -1))) for s in samples])


@F.pandas_udf(BinaryType())
def gray_jpeg(w: pd.Series, h: pd.Series, level: pd.Series) -> pd.Series:
    """A gray JPEG of one level, at quality 100."""
    return pd.Series([jpeg.encode(Image(int(a), int(b), "gray8", np.full((int(b), int(a)), int(v), np.uint8)), 100) for a, b, v in zip(w, h, level, strict=True)])


@F.pandas_udf(BinaryType())
def qr_png(text: pd.Series, copies: pd.Series) -> pd.Series:
    """A PNG of a text's QR symbol, so many times side by side (none: a blank image)."""
    def one(t: str, n: int) -> bytes:
        tile = qr.picture(qr.encode(t.encode(), 1), 3)
        px = np.hstack([tile] * n) if n else np.full(tile.shape, 255, np.uint8)
        return png.encode(Image(px.shape[1], px.shape[0], "gray8", np.ascontiguousarray(px)))

    return pd.Series([one(t, int(n)) for t, n in zip(text, copies, strict=True)])


@F.pandas_udf(BinaryType())
def n_page_pdf(pages: pd.Series) -> pd.Series:
    """A document of so many pages of one small picture."""
    part = jpeg.encode(Image(16, 8, "gray8", np.full((8, 16), 128, np.uint8)), 85)
    return pd.Series([pdf_write.image_pdf([(16, 8, part)] * int(n)) for n in pages])


@F.pandas_udf(BinaryType())
def wave(software: pd.Series, bits: pd.Series) -> pd.Series:
    """A WAVE file with a program's name in its information list, behind the samples."""
    def one(text: str, n: int) -> bytes:
        body = text.encode()
        info = b"INFO" + b"ISFT" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        parts = [(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, n // 8, n)), (b"data", bytes(32)), (b"LIST", info)]
        chunks = b"".join(k + struct.pack("<I", len(d)) + d for k, d in parts)
        return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks

    return pd.Series([one(t, int(n)) for t, n in zip(software, bits, strict=True)])


def photo(w: int, h: int, seed: int) -> Image:
    """Gradients, rings and noise, the same for a seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    y, x = np.mgrid[0:h, 0:w]
    ring = np.hypot(x - w / 2, y - h / 2)
    planes = [x * 255 / max(w - 1, 1), y * 255 / max(h - 1, 1), 127 + 120 * np.sin(ring / 7)]
    px = np.stack(planes, axis=2) + rng.normal(0, 6, (h, w, 3))
    return Image(w, h, "rgb8", np.clip(px, 0, 255).astype(np.uint8).reshape(h, -1))


