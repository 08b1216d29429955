"""Pixels in memory: formats, conversions, orientation, scaling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import Invalid, Limit

CHANNELS = {"gray8": 1, "gray_alpha8": 2, "rgb8": 3, "rgba8": 4, "cmyk8": 4}
MAX_SIDE, MAX_PIXELS, MAX_ALLOC = 65_535, 40_000_000, 512 << 20


def check_dimensions(w: int, h: int, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> None:
    if w < 1 or h < 1:
        raise Invalid("empty image")
    if w > max_side or h > max_side or w * h > max_pixels:
        raise Limit("image dimensions exceeded")


@dataclass
class Image:
    """``data`` has a row for each line, ``width * channels`` unsigned bytes each."""

    width: int
    height: int
    format: str
    data: np.ndarray

    @property
    def channels(self) -> int:
        return CHANNELS[self.format]

    def samples(self) -> np.ndarray:
        return self.data.reshape(self.height, self.width, self.channels)


def div255(v: np.ndarray) -> np.ndarray:
    t = v.astype(np.uint32) + 128
    return (t + (t >> 8)) >> 8


def to_rgb(img: Image) -> Image:
    """Gray is repeated, alpha left out, inks subtracted from white."""
    s = img.samples()
    if img.format == "rgb8":
        return img
    if img.format in ("gray8", "gray_alpha8"):
        out = np.repeat(s[:, :, :1], 3, axis=2)
    elif img.format == "rgba8":
        out = s[:, :, :3]
    else:
        white = 255 - s[:, :, 3:].astype(np.uint32)
        out = (white - div255(s[:, :, :3].astype(np.uint32) * white)).astype(np.uint8)
    return Image(img.width, img.height, "rgb8", np.ascontiguousarray(out).reshape(img.height, -1))


def luma(img: Image) -> np.ndarray:
    """Rec. 601 luma of each pixel in integers; gray stays as it is."""
    if img.format in ("gray8", "gray_alpha8"):
        return img.samples()[:, :, 0]
    s = to_rgb(img).samples().astype(np.uint32)
    return ((s[:, :, 0] * 299 + s[:, :, 1] * 587 + s[:, :, 2] * 114 + 500) // 1000).astype(np.uint8)


def page_luminance(img: Image) -> np.ndarray:
    """The recogniser's luminance: alpha over white, then 0.3, 0.5 and 0.2 parts in single precision."""
    s = img.samples()
    if img.format in ("gray_alpha8", "rgba8"):
        a = s[:, :, -1:].astype(np.uint32)
        s = (255 - div255((255 - s[:, :, :-1].astype(np.uint32)) * a)).astype(np.uint8)
    if s.shape[2] == 1:
        return s[:, :, 0]
    if img.format == "cmyk8":
        s = to_rgb(img).samples()
    f = s.astype(np.float32)
    total = np.float32(0.3) * f[:, :, 0] + np.float32(0.5) * f[:, :, 1] + np.float32(0.2) * f[:, :, 2]
    return (total.astype(np.float64) + 0.5).astype(np.uint8)


def upright(img: Image, orientation: int) -> Image:
    """The image turned and mirrored as an EXIF orientation of 2 to 8 says."""
    s = img.samples()
    turns = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.transpose(1, 0, 2), 6: lambda a: a[::-1].transpose(1, 0, 2), 7: lambda a: a[::-1, ::-1].transpose(1, 0, 2), 8: lambda a: a[:, ::-1].transpose(1, 0, 2)}
    if orientation not in turns:
        return img
    out = np.ascontiguousarray(turns[orientation](s))
    return Image(out.shape[1], out.shape[0], img.format, out.reshape(out.shape[0], -1))


def halve(gray: np.ndarray) -> np.ndarray:
    """Two by two pixels as their mean, rounded down."""
    h, w = gray.shape[0] // 2 * 2, gray.shape[1] // 2 * 2
    g = gray[:h, :w].astype(np.uint32)
    return ((g[::2, ::2] + g[::2, 1::2] + g[1::2, ::2] + g[1::2, 1::2]) // 4).astype(np.uint8)


def scale_linear(gray: np.ndarray, fx: float, fy: float) -> np.ndarray:
    """Bilinear resampling on a grid of sixteenths of a pixel."""
    h, w = gray.shape
    nw, nh = max(1, int(fx * w + 0.5)), max(1, int(fy * h + 0.5))
    x, y = (16 * w * np.arange(nw) // nw).astype(np.int64), (16 * h * np.arange(nh) // nh).astype(np.int64)
    x0, y0, xf, yf = x >> 4, y >> 4, x & 15, y & 15
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    g = gray.astype(np.int64)
    top = g[y0][:, x0] * (16 - xf) + g[y0][:, x1] * xf
    low = g[y1][:, x0] * (16 - xf) + g[y1][:, x1] * xf
    return ((top * (16 - yf)[:, None] + low * yf[:, None] + 128) // 256).astype(np.uint8)


def scale_area(gray: np.ndarray, fx: float, fy: float) -> np.ndarray:
    """Each new pixel is the mean of the area it covers."""
    h, w = gray.shape
    nw, nh = max(1, int(fx * w + 0.5)), max(1, int(fy * h + 0.5))

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(n + 1) * (m / n)
        cell = np.arange(m)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, 1)

    a, b = weights(nh, h), weights(nw, w)
    out = a @ gray.astype(np.float64) @ b.T
    return (out / (a.sum(1)[:, None] * b.sum(1)[None, :]) + 0.5).astype(np.uint8)


def smooth(gray: np.ndarray, half: int) -> np.ndarray:
    """Box mean of ``2 * half + 1`` pixels a side, edges repeated."""
    n = 2 * half + 1
    p = np.pad(gray.astype(np.int64), half, mode="edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return ((c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n] + n * n // 2) // (n * n)).astype(np.uint8)


def unsharp(gray: np.ndarray, half: int, fraction: float) -> np.ndarray:
    """The image with its difference from its box mean added in part."""
    g = gray.astype(np.float64)
    return np.clip(g + fraction * (g - smooth(gray, half)) + 0.5, 0, 255).astype(np.uint8)


def scale_gray(gray: np.ndarray, fx: float, fy: float) -> np.ndarray:
    """Area mapping below 0.7, linear interpolation above, sharpened a little in between and at up to 1.4."""
    if fx == 1.0 and fy == 1.0:
        return gray.copy()
    if max(fx, fy) < 0.7:
        out = scale_area(gray, fx, fy)
        return unsharp(out, 1, 0.2) if min(fx, fy) > 0.2 else out
    out = scale_linear(gray, fx, fy)
    return unsharp(out, 2, 0.4) if max(fx, fy) < 1.4 else out
