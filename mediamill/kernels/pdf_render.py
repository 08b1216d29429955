"""Pages as pixels: paths, text, clips, images, forms, shadings and transparency of a content stream.

The painter covers filled and stroked paths under both rules, text in embedded fonts in all
modes, clips, image and form XObjects, inline images, stencil and soft masks, axial, radial
and function shadings, tiling and shading patterns, constant alpha, groups, the blend modes,
embedded profiles and the appearances of annotations.
Edges are smoothed by four samples a pixel each way.
"""

from __future__ import annotations

import math
import struct
from typing import Any

import numpy as np

from ..errors import Deadline, Invalid, Limit, MediaError
from . import fonts, icc, jpeg, pdf, postscript
from .image import Image, to_rgb

SIDE, MOST_PAGES, MOST_TOTAL = 2048, 32, 64_000_000
SUB = 4
MOST_FORMS = 12


def render_size(w: float, h: float) -> tuple[int, int]:
    w, h = float(np.float32(w)), float(np.float32(h))
    if not (math.isfinite(w) and math.isfinite(h) and w > 0 and h > 0):
        raise Invalid("page size")
    short = int(min(max(math.ceil(min(w, h) * SIDE / max(w, h)), 1), SIDE))
    return (SIDE, short) if w >= h else (short, SIDE)


def matrix(v: list[float]) -> np.ndarray:
    a, b, c, d, e, f = map(float, v)
    return np.array([[a, b, 0], [c, d, 0], [e, f, 1]])


def blend(mode: str, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A blend of backdrop and source colours, both from 0 to 1."""
    if mode == "Multiply":
        return b * s
    if mode == "Screen":
        return b + s - b * s
    if mode == "Overlay":
        return blend("HardLight", s, b)
    if mode == "Darken":
        return np.minimum(b, s)
    if mode == "Lighten":
        return np.maximum(b, s)
    if mode == "ColorDodge":
        return np.where(b == 0, 0, np.where(s >= 1, 1, np.minimum(1, b / np.maximum(1 - s, 1e-9))))
    if mode == "ColorBurn":
        return np.where(b >= 1, 1, np.where(s <= 0, 0, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-9))))
    if mode == "HardLight":
        return np.where(s <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s))
    if mode == "SoftLight":
        d = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
        return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (d - b))
    if mode == "Difference":
        return np.abs(b - s)
    if mode == "Exclusion":
        return b + s - 2 * b * s
    if mode == "Luminosity":
        return _with_light(b, _light(s))
    if mode == "Color":
        return _with_light(s, _light(b))
    if mode == "Hue":
        return _with_light(_with_range(s, b), _light(b))
    if mode == "Saturation":
        return _with_light(_with_range(b, s), _light(b))
    return s


_WEIGHTS = np.array([0.3, 0.59, 0.11])


def _light(c: np.ndarray) -> np.ndarray:
    return (c @ _WEIGHTS)[..., None]


def _with_light(c: np.ndarray, light: np.ndarray) -> np.ndarray:
    """A colour moved to a lightness and drawn towards it as far as it leaves 0 to 1."""
    c = c + light - _light(c)
    low, high = c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    c = np.where(low < 0, light + (c - light) * light / np.maximum(light - low, 1e-9), c)
    return np.where(high > 1, light + (c - light) * (1 - light) / np.maximum(high - light, 1e-9), c)


def _with_range(c: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A colour whose components spread as far as another's."""
    low, high = c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    spread = of.max(axis=-1, keepdims=True) - of.min(axis=-1, keepdims=True)
    return np.where(high > low, (c - low) / np.maximum(high - low, 1e-9) * spread, 0)


def flatten(path: list[tuple], m: np.ndarray) -> list[np.ndarray]:
    """Sub-paths as polygons in device space; curves in chords."""
    out, current = [], []

    def point(x, y):
        return np.array([x, y, 1.0]) @ m

    for op, *v in path:
        if op == "m":
            if len(current) > 1:
                out.append(np.array(current))
            current = [point(*v)[:2]]
        elif op == "l":
            current.append(point(*v)[:2])
        elif op == "c" and current:
            p0 = current[-1]
            p1, p2, p3 = (point(*v[k : k + 2])[:2] for k in (0, 2, 4))
            span = np.abs(np.array([p1 - p0, p2 - p1, p3 - p2])).sum()
            n = int(min(max(span / 3, 4), 64))
            t = np.linspace(0, 1, n + 1)[1:, None]
            current += list((1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t**2 * p2 + t**3 * p3)
        elif op == "h" and current:
            current.append(current[0])
            out.append(np.array(current))
            current = [current[0]]
    if len(current) > 1:
        out.append(np.array(current))
    return out


def coverage(polygons: list[np.ndarray], w: int, h: int, even_odd: bool) -> np.ndarray:
    """How much of each pixel the polygons cover, 0 to 1."""
    out = np.zeros((h, w), dtype=np.float32)
    edges = []
    for p in polygons:
        q = np.vstack([p, p[:1]])
        edges.append(np.column_stack([q[:-1], q[1:]]))
    if not edges:
        return out
    e = np.concatenate(edges)
    e = e[np.isfinite(e).all(axis=1) & (e[:, 1] != e[:, 3])]
    if not len(e):
        return out
    up = np.where(e[:, 1] < e[:, 3], 1, -1)
    lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first, last = max(0, int(math.floor(lo.min()))), min(h, int(math.ceil(hi.max())))
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    for y in range(first, last):
        row = np.zeros(w * SUB + 1, dtype=np.int32)
        hit = False
        for k in range(SUB):
            sy = y + (k + 0.5) / SUB
            on = np.flatnonzero((lo <= sy) & (hi > sy))
            if not len(on):
                continue
            x = e[on, 0] + (sy - e[on, 1]) * slope[on]
            order = np.argsort(x, kind="stable")
            x, turn = x[order], up[on][order]
            wind = np.cumsum(turn) if not even_odd else np.arange(1, len(x) + 1) % 2
            starts, ends = x[:-1][wind[:-1] != 0], x[1:][wind[:-1] != 0]
            a = np.clip(np.ceil(starts * SUB - 0.5), 0, w * SUB).astype(int)
            b = np.clip(np.ceil(ends * SUB - 0.5), 0, w * SUB).astype(int)
            np.add.at(row, a, 1)
            np.add.at(row, b, -1)
            hit = True
        if hit:
            out[y] = np.cumsum(row[:-1]).reshape(w, SUB).sum(axis=1) / (SUB * SUB)
    return np.minimum(out, 1)


def stroke(path: list[np.ndarray], width: float, cap: int, join: int, dash: tuple[list[float], float] | None, miter: float = 10.0) -> list[np.ndarray]:
    """Polygons (of one turn) whose union is the stroked path, in its own space."""
    half, out = width / 2, []

    def disc(p):
        t = np.linspace(0, 2 * np.pi, 17)[:-1]
        out.append(p + half * np.column_stack([np.cos(t), np.sin(t)]))

    for line in path:
        for part in _dashed(line, dash) if dash and sum(dash[0]) > 0 else [line]:
            d = np.diff(part, axis=0)
            keep = np.hypot(*d.T) > 1e-9
            pts = np.vstack([part[:1], part[1:][keep]])
            if len(pts) < 2:
                if cap == 1:
                    disc(part[0])
                continue
            d = np.diff(pts, axis=0)
            unit = d / np.hypot(*d.T)[:, None]
            closed = np.allclose(pts[0], pts[-1])
            for i, u in enumerate(unit):
                n = np.array([-u[1], u[0]]) * half
                a, b = pts[i].copy(), pts[i + 1].copy()
                if cap == 2 and not closed:
                    a = a - u * half if i == 0 else a
                    b = b + u * half if i == len(unit) - 1 else b
                out.append(np.array([a + n, a - n, b - n, b + n]))
            corners = range(1, len(unit)) if not closed else range(len(unit))
            for i in corners:
                u, v, p = unit[i - 1], unit[i], pts[i]
                cross = u[0] * v[1] - u[1] * v[0]
                if abs(cross) < 1e-6:
                    continue
                if join == 1:
                    disc(p)
                    continue
                side = -np.sign(cross)
                a, b = p + side * half * np.array([-u[1], u[0]]), p + side * half * np.array([-v[1], v[0]])
                tip = [a, p, b]
                if join == 0 and 1 + u @ v > 2 / max(miter, 1.0) ** 2:
                    mid = (a + b) / 2 - p
                    tip = [a, p, b, p + mid * (half * half / max(mid @ mid, 1e-12))]
                tip = np.array(tip)
                out.append(tip if _turn(tip) > 0 else tip[::-1])
            if cap == 1 and not closed:
                disc(pts[0])
                disc(pts[-1])
    return [p if _turn(p) > 0 else p[::-1] for p in out]


def _turn(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum())


def _dashed(line: np.ndarray, dash: tuple[list[float], float]) -> list[np.ndarray]:
    lengths, phase = dash
    out, k, left = [], 0, phase
    while left >= lengths[k % len(lengths)]:
        left -= lengths[k % len(lengths)]
        k += 1
    left = lengths[k % len(lengths)] - left
    current = [line[0]]
    for a, b in zip(line[:-1], line[1:], strict=True):
        size = float(np.hypot(*(b - a)))
        at = 0.0
        while size - at > left:
            if len(out) > 20_000:
                return out
            at += left
            p = a + (b - a) * at / size
            if k % 2 == 0:
                out.append(np.array([*current, p]))
            current, k = [p], k + 1
            left = max(lengths[k % len(lengths)], 1e-6)
        left -= size - at
        current.append(b)
    if k % 2 == 0 and len(current) > 1:
        out.append(np.array(current))
    return out


class State:
    def __init__(self):
        self.ctm = np.eye(3)
        self.clip: np.ndarray | None = None
        self.fill = self.line = (0.0, 0.0, 0.0)
        self.fill_space = self.line_space = "DeviceGray"
        self.fill_alpha = self.line_alpha = 1.0
        self.width, self.cap, self.join, self.dash = 1.0, 0, 0, None
        self.mode, self.mask = "Normal", None
        self.fill_pattern: str | None = None
        self.miter = 10.0
        # the text's font and size, spaces between characters and words, stretch, leading, mode and rise
        self.font: fonts.Font | None = None
        self.size, self.spread, self.word_spread, self.stretch, self.leading, self.text_mode, self.rise = 0.0, 0.0, 0.0, 1.0, 0.0, 0, 0.0

    def copy(self) -> "State":
        new = State.__new__(State)
        new.__dict__ = dict(self.__dict__)
        return new


#: Operators that set text up or show it, and those that a glyph of shape alone doesn't carry out.
TEXT_OPERATORS = frozenset(("BT", "ET", "Tc", "Tw", "Tz", "TL", "Tf", "Tr", "Ts", "Td", "TD", "Tm", "T*", "Tj", "'", '"', "TJ"))
COLOUR_OPERATORS = frozenset(("g", "G", "rg", "RG", "k", "K", "cs", "CS", "sc", "SC", "scn", "SCN", "sh"))


class _Text:
    """Where a text object's line and its next glyph begin, and the outlines that will clip."""

    def __init__(self) -> None:
        self.line = self.place = np.eye(3)
        self.clip: list[np.ndarray] = []
        self.uncoloured = False

    def next(self, x: float, y: float) -> None:
        self.line = self.place = np.array([[1, 0, 0], [0, 1, 0], [x, y, 1]]) @ self.line

    def advance(self, x: float, y: float) -> None:
        self.place = np.array([[1, 0, 0], [0, 1, 0], [x, y, 1]]) @ self.place


class Painter:
    """A page's pixels while its operators are carried out."""

    def __init__(self, doc: pdf.Document, w: int, h: int, deadline: Deadline):
        self.doc, self.w, self.h, self.deadline = doc, w, h, deadline
        self.px = np.ones((h, w, 3), dtype=np.float32)
        self.hidden = 0
        self.uncoloured = 0
        self.fonts: dict[int, fonts.Font | None] = {}
        self.profiles: dict[int, icc.Transform | None] = {}
        self.base = np.eye(3)  # from page space to pixels, which patterns refer to

    # -- colours -------------------------------------------------------------------------------------------------------

    def space(self, obj: Any, resources: dict[str, Any]) -> Any:
        obj = self.doc.get(obj)
        named = self.doc.get(resources.get("ColorSpace"))
        if isinstance(obj, str) and isinstance(named, dict) and obj in named:
            obj = self.doc.get(named[obj])
        if isinstance(obj, list) and len(obj) == 1:
            obj = self.doc.get(obj[0])
        return {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "CalGray": "DeviceGray", "CalRGB": "DeviceRGB"}.get(str(obj), str(obj)) if isinstance(obj, str) else obj

    def channels(self, space: Any) -> int:
        if isinstance(space, str):
            return {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(space, 1)
        kind = str(self.doc.get(space[0]))
        if kind == "ICCBased":
            return int(self.doc.get(self.doc.get(space[1]).dict.get("N", 3)))
        if kind == "DeviceN":
            return len(self.doc.get(space[1]))
        return {"Indexed": 1, "I": 1, "Separation": 1, "CalGray": 1, "CalRGB": 3, "Lab": 3}.get(kind, 1)

    def rgb(self, space: Any, v: np.ndarray) -> np.ndarray:
        """Rows of components (0 to 1, indices as they are) to rows of red, green and blue."""
        kind = space if isinstance(space, str) else str(self.doc.get(space[0]))
        if kind in ("ICCBased", "CalGray", "CalRGB") and not isinstance(space, str):
            made = self._profiled(space, v) if kind == "ICCBased" else self._calibrated(space, v)
            if made is not None:
                return made
            kind = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(self.channels(space), "DeviceGray")
        if kind == "DeviceGray":
            return np.repeat(v[:, :1], 3, axis=1)
        if kind == "DeviceRGB":
            return v[:, :3]
        if kind == "DeviceCMYK":
            return (1 - v[:, :3]) * (1 - v[:, 3:4])
        if kind in ("Indexed", "I"):
            base, table = self.space(space[1], {}), self.doc.get(space[3])
            raw = self.doc.decode(table) if isinstance(table, pdf.Stream) else bytes(table)
            n = self.channels(base)
            rows = np.frombuffer(raw[: len(raw) // n * n], np.uint8).reshape(-1, n) / 255
            return self.rgb(base, rows)[np.clip(v[:, 0].astype(int), 0, len(rows) - 1)]
        if kind == "Lab":
            return icc.srgb_encode(icc.lab_to_xyz(v) @ np.linalg.inv(icc.SRGB).T)
        if kind in ("Separation", "DeviceN"):
            base = self.space(space[2], {})
            uniq, back = np.unique(np.round(v, 4), axis=0, return_inverse=True)
            made = np.array([postscript.evaluate(self.doc, space[3], u.tolist()) for u in uniq])
            return self.rgb(base, made)[back.ravel()]
        return np.zeros((len(v), 3))

    def _profiled(self, space: list[Any], v: np.ndarray) -> np.ndarray | None:
        """Colours through an embedded profile; None where it can't be used."""
        held = self.doc.get(space[1])
        if id(held) not in self.profiles:
            try:
                self.profiles[id(held)] = icc.to_srgb(self.doc.decode(held), self.channels(space))
            except (MediaError, ValueError, IndexError, KeyError, TypeError, struct.error):
                self.profiles[id(held)] = None
        transform = self.profiles[id(held)]
        return None if transform is None else transform.convert(np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)) / 255

    def _calibrated(self, space: list[Any], v: np.ndarray) -> np.ndarray | None:
        """Colours of a gamma and, with three channels, a matrix, adapted from their white."""
        d = self.doc.get(space[1])
        numbers = lambda key, n, other: [float(self.doc.get(x)) for x in (lambda g: g if isinstance(g, list) else [g] * n)(self.doc.get(d.get(key)))] if d.get(key) is not None else other
        if not isinstance(d, dict):
            return None
        if self.channels(space) == 1:
            return np.repeat(icc.srgb_encode(np.clip(v[:, :1], 0, 1) ** numbers("Gamma", 1, [1.0])[0]), 3, axis=1)
        linear = np.clip(v[:, :3], 0, 1) ** np.array(numbers("Gamma", 3, [1.0] * 3))
        xyz = linear @ np.array(numbers("Matrix", 9, np.eye(3).ravel().tolist())).reshape(3, 3)
        xyz = xyz @ icc.bradford(np.array(numbers("WhitePoint", 3, list(icc.D50))), np.array(icc.D50)).T
        return icc.srgb_encode(np.clip(xyz @ np.linalg.inv(icc.SRGB).T, 0, 1))

    def colour(self, space: Any, operands: list[Any]) -> tuple[float, float, float]:
        v = [float(x) for x in operands if isinstance(x, int | float)]
        n = self.channels(space)
        v = (v + [0.0] * n)[:n]
        return tuple(np.clip(self.rgb(space, np.array([v]))[0], 0, 1).tolist())

    # -- painting ------------------------------------------------------------------------------------------------------

    def paint(self, s: State, cover: np.ndarray, colour: np.ndarray, alpha: float) -> None:
        if self.hidden:
            return
        a = cover * alpha
        if s.clip is not None:
            a = a * s.clip
        if s.mask is not None:
            a = a * s.mask
        rows = np.flatnonzero(a.any(axis=1))
        if not len(rows):
            return
        y = slice(rows[0], rows[-1] + 1)
        back, source = self.px[y], np.broadcast_to(colour, self.px.shape)[y]
        mixed = source if s.mode == "Normal" else blend(s.mode, back, source)
        self.px[y] = back + a[y, :, None] * (mixed - back)

    def run(self, content: bytes, resources: dict[str, Any], s: State, depth: int = 0) -> None:
        doc, stack, path, clip_rule = self.doc, [], [], None
        marked: list[bool] = []
        start = (0.0, 0.0)
        text = _Text()
        for k, (op, v) in enumerate(pdf.operators(content)):
            if k % 256 == 0:
                self.deadline.check()
            try:
                n = [float(x) for x in v if isinstance(x, int | float) and not isinstance(x, bool)]
                if op == "q":
                    stack.append(s.copy())
                elif op == "Q" and stack:
                    s = stack.pop()
                elif op == "cm":
                    s.ctm = matrix(n) @ s.ctm
                elif op in ("m", "l"):
                    path.append((op, *n[:2]))
                    start = tuple(n[:2])
                elif op == "c":
                    path.append(("c", *n[:6]))
                    start = tuple(n[4:6])
                elif op == "v":
                    path.append(("c", *start, *n[:4]))
                    start = tuple(n[2:4])
                elif op == "y":
                    path.append(("c", *n[:4], *n[2:4]))
                    start = tuple(n[2:4])
                elif op == "h":
                    path.append(("h",))
                elif op == "re":
                    x, y, w, h = n[:4]
                    path += [("m", x, y), ("l", x + w, y), ("l", x + w, y + h), ("l", x, y + h), ("h",)]
                elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n"):
                    if op in ("b", "b*", "s"):
                        path.append(("h",))
                    shape = flatten(path, s.ctm)
                    if op[0] in "fFBb":
                        cover = coverage(shape, self.w, self.h, op.endswith("*"))
                        if s.fill_pattern is not None:
                            self._pattern(doc.get(doc.get(resources.get("Pattern"))[s.fill_pattern]), resources, s, cover, depth)
                        else:
                            self.paint(s, cover, np.array(s.fill), s.fill_alpha)
                    if op[0] in "BbSs":
                        self.paint(s, self._stroked(path, s), np.array(s.line), s.line_alpha)
                    if clip_rule is not None:
                        c = coverage(shape, self.w, self.h, clip_rule)
                        s.clip = c if s.clip is None else s.clip * c
                    path, clip_rule = [], None
                elif op in ("W", "W*"):
                    clip_rule = op == "W*"
                elif op in TEXT_OPERATORS:
                    self._text(op, v, n, resources, s, text, depth)
                elif op == "d1":
                    self.uncoloured += 1
                    text.uncoloured = True
                elif self.uncoloured and op in COLOUR_OPERATORS:
                    continue  # a glyph of shape alone is painted in the text's colour
                elif op == "w":
                    s.width = n[0]
                elif op == "M":
                    s.miter = n[0]
                elif op == "J":
                    s.cap = int(n[0])
                elif op == "j":
                    s.join = int(n[0])
                elif op == "d":
                    lengths = [float(x) for x in v[0]]
                    s.dash = (lengths * (1 + len(lengths) % 2), float(v[1])) if lengths and min(lengths) >= 0 else None
                elif op in ("g", "rg", "k"):
                    s.fill_space = {"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}[op]
                    s.fill, s.fill_pattern = self.colour(s.fill_space, v), None
                elif op in ("G", "RG", "K"):
                    s.line_space = {"G": "DeviceGray", "RG": "DeviceRGB", "K": "DeviceCMYK"}[op]
                    s.line = self.colour(s.line_space, v)
                elif op == "cs":
                    s.fill_space, s.fill, s.fill_pattern = self.space(v[0], resources), (0.0, 0.0, 0.0), None
                elif op == "CS":
                    s.line_space, s.line = self.space(v[0], resources), (0.0, 0.0, 0.0)
                elif op in ("sc", "scn"):
                    s.fill_pattern = str(v[-1]) if isinstance(v[-1], pdf.Name) else None
                    space = s.fill_space
                    if s.fill_pattern is not None and not isinstance(space, str) and len(space) > 1:
                        space = self.space(space[1], resources)  # the colour of an uncoloured pattern
                    s.fill = self.colour(space, v)
                elif op in ("SC", "SCN"):
                    s.line = self.colour(s.line_space, v)
                elif op == "gs":
                    self._graphics(s, doc.get(doc.get(resources.get("ExtGState"))[v[0]]), depth)
                elif op == "Do":
                    self._object(doc.get(doc.get(resources.get("XObject"))[v[0]]), resources, s, depth)
                elif op == "BI":
                    d, raw = v
                    long = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "IM": "ImageMask", "F": "Filter", "DP": "DecodeParms"}
                    self._image(pdf.Stream({long.get(a, a): b for a, b in d.items()}, raw), resources, s)
                elif op == "sh":
                    self._shading(doc.get(doc.get(resources.get("Shading"))[v[0]]), resources, s)
                elif op in ("BMC", "BDC"):
                    off = op == "BDC" and v and v[0] == "OC" and not self._visible(doc.get((doc.get(resources.get("Properties")) or {}).get(v[1]) if isinstance(v[1], str) else None))
                    marked.append(off)
                    self.hidden += off
                elif op == "EMC" and marked:
                    self.hidden -= marked.pop()
            except (MediaError, IndexError, KeyError, ValueError, TypeError, AttributeError) as e:
                if isinstance(e, Limit):
                    raise
                path = [] if op in ("f", "S", "B", "n") else path
        self.hidden -= sum(marked)
        self.uncoloured -= text.uncoloured

    # -- text ----------------------------------------------------------------------------------------------------------

    def _text(self, op: str, v: list[Any], n: list[float], resources: dict[str, Any], s: State, text: "_Text", depth: int) -> None:
        if op == "BT":
            text.line = text.place = np.eye(3)
            text.clip = []
        elif op == "ET":
            if text.clip:
                c = coverage(text.clip, self.w, self.h, False)
                s.clip = c if s.clip is None else s.clip * c
            text.clip = []
        elif op in ("Tc", "Tw", "TL", "Ts"):
            setattr(s, {"Tc": "spread", "Tw": "word_spread", "TL": "leading", "Ts": "rise"}[op], n[0])
        elif op == "Tz":
            s.stretch = n[0] / 100
        elif op == "Tr":
            s.text_mode = int(n[0])
        elif op == "Tf":
            s.font, s.size = self._font(v[0], resources), n[0]
        elif op == "Tm":
            text.line = text.place = matrix(n)
        elif op in ("Td", "TD", "T*"):
            if op == "TD":
                s.leading = -n[1]
            text.next(*((0.0, -s.leading) if op == "T*" else n[:2]))
        elif op == "TJ":
            self._show(v[0], resources, s, text, depth)
        else:
            if op == '"':
                s.word_spread, s.spread = n[:2]
            if op in ("'", '"'):
                text.next(0.0, -s.leading)
            self._show(v[-1:], resources, s, text, depth)

    def _font(self, name: Any, resources: dict[str, Any]) -> fonts.Font | None:
        d = self.doc.get((self.doc.get(resources.get("Font")) or {}).get(name))
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            try:
                self.fonts[id(d)] = fonts.Font(self.doc, d)
            except (MediaError, ValueError, TypeError, KeyError, IndexError, AttributeError):
                self.fonts[id(d)] = None
        return self.fonts[id(d)]

    def _show(self, parts: list[Any], resources: dict[str, Any], s: State, text: "_Text", depth: int) -> None:
        """Glyphs of strings, with shifts in thousandths between them; all outlines of an operator are painted as one shape."""
        if s.font is None:
            return
        shapes: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        down = s.font.vertical
        for part in parts:
            if isinstance(part, int | float):
                shift = -part / 1000 * s.size
                text.advance(*((0.0, shift) if down else (shift * s.stretch, 0.0)))
                continue
            for g in s.font.split(bytes(part)):
                at = np.array([[s.size * s.stretch, 0, 0], [0, s.size, 0], [0, s.rise, 1]]) @ text.place
                if g.procedure is not None:
                    self._procedure(g.procedure, s, at, resources, depth)
                elif g.path:
                    m = at if not down else np.array([[1, 0, 0], [0, 1, 0], [-g.advance / 2000, -0.88, 1]]) @ at
                    shapes += flatten(g.path, m @ s.ctm)
                    if s.text_mode in (1, 2, 5, 6):
                        lines += flatten(g.path, m)
                space = s.spread + (s.word_spread if (g.code, g.n_bytes) == (32, 1) else 0.0)
                text.advance(*((0.0, -s.size + space) if down else ((g.advance / 1000 * s.size + space) * s.stretch, 0.0)))
        if not shapes:
            return
        if s.text_mode in (0, 2, 4, 6):
            cover = coverage(shapes, self.w, self.h, False)
            if s.fill_pattern is not None:
                self._pattern(self.doc.get(self.doc.get(resources.get("Pattern"))[s.fill_pattern]), resources, s, cover, depth)
            else:
                self.paint(s, cover, np.array(s.fill), s.fill_alpha)
        if lines:
            path = [step for p in lines for step in [("m", *p[0]), *[("l", *q) for q in p[1:-1]], ("h",)]]
            self.paint(s, self._stroked(path, s), np.array(s.line), s.line_alpha)
        if s.text_mode >= 4:
            text.clip += shapes

    def _procedure(self, body: pdf.Stream, s: State, at: np.ndarray, resources: dict[str, Any], depth: int) -> None:
        """A Type 3 glyph: its own content under the font's matrix."""
        if depth > MOST_FORMS or s.text_mode == 3:
            return
        inner = s.copy()
        inner.ctm = matrix(list(s.font.matrix)) @ at @ s.ctm
        own = s.font.get("Resources")
        self.run(self.doc.decode(body), own if isinstance(own, dict) else resources, inner, depth + 1)

    def _visible(self, group: Any) -> bool:
        """Whether an optional-content group or membership is on."""
        if not isinstance(group, dict):
            return True
        config = self.doc.get((self.doc.get(self.doc.get(self.doc.trailer.get("Root")).get("OCProperties")) or {}).get("D")) or {}
        off = [x for x in self.doc.get(config.get("OFF")) or []]
        groups = group.get("OCGs") if group.get("Type") == "OCMD" else None
        if group.get("Type") != "OCMD":
            return not any(self.doc.get(x) is group for x in off)
        listed = self.doc.get(groups)
        listed = listed if isinstance(listed, list) else [groups] if groups is not None else []
        on = [not any(self.doc.get(x) is self.doc.get(g) for x in off) for g in listed]
        policy = str(group.get("P", "AnyOn"))
        return not on or {"AnyOn": any(on), "AllOn": all(on), "AnyOff": not all(on), "AllOff": not any(on)}.get(policy, any(on))

    def _stroked(self, path: list[tuple], s: State) -> np.ndarray:
        scale = math.sqrt(abs(np.linalg.det(s.ctm[:2, :2]))) or 1.0
        width = max(s.width, 1 / scale)
        own = flatten(path, np.eye(3))
        shapes = stroke(own, width, s.cap, s.join, s.dash, s.miter)
        turned = [np.column_stack([p, np.ones(len(p))]) @ s.ctm for p in shapes]
        return coverage([p[:, :2] for p in turned], self.w, self.h, False)

    def _graphics(self, s: State, d: dict[str, Any], depth: int) -> None:
        get = lambda k: self.doc.get(d.get(k))
        for key, name in (("LW", "width"), ("CA", "line_alpha"), ("ca", "fill_alpha"), ("ML", "miter")):
            if isinstance(get(key), int | float):
                setattr(s, name, float(get(key)))
        for key, name in (("LC", "cap"), ("LJ", "join")):
            if isinstance(get(key), int):
                setattr(s, name, get(key))
        mode = get("BM")
        if mode is not None:
            s.mode = str(self.doc.get(mode[0]) if isinstance(mode, list) else mode)
        mask = get("SMask")
        if isinstance(mask, dict):
            s.mask = self._soft_mask(mask, s, depth)
        elif mask is not None:
            s.mask = None

    def _object(self, obj: Any, resources: dict[str, Any], s: State, depth: int) -> None:
        if not isinstance(obj, pdf.Stream) or not self._visible(self.doc.get(obj.dict.get("OC"))):
            return
        kind = self.doc.get(obj.dict.get("Subtype"))
        if kind == "Form":
            group = self.doc.get(obj.dict.get("Group"))
            plain = s.fill_alpha >= 1 and s.mode == "Normal" and s.mask is None
            if isinstance(group, dict) and group.get("S") == "Transparency" and not plain:
                alpha, colour = self._apart(lambda inner, t: inner._form(obj, resources, t, depth + 1), s)
                self.paint(s, alpha, colour, s.fill_alpha)
            else:
                self._form(obj, resources, s.copy(), depth + 1)
        elif kind == "Image":
            self._image(obj, resources, s)

    def _apart(self, work: Any, s: State) -> tuple[np.ndarray, np.ndarray]:
        """How much of each pixel a painting covers, and in which colour: it is done over white and over black."""
        made = []
        for ground in (1.0, 0.0):
            inner = Painter(self.doc, self.w, self.h, self.deadline)
            inner.px[:] = ground
            inner.base, inner.fonts, inner.profiles, inner.hidden = self.base, self.fonts, self.profiles, self.hidden
            t = s.copy()
            t.fill_alpha = t.line_alpha = 1.0
            t.mode, t.mask, t.clip = "Normal", None, None
            work(inner, t)
            made.append(inner.px)
        alpha = np.clip(1 - (made[0] - made[1]).mean(axis=2), 0, 1)
        return alpha, np.clip(np.where(alpha[..., None] > 0, made[1] / np.maximum(alpha[..., None], 1e-6), 0), 0, 1)

    def _soft_mask(self, mask: dict[str, Any], s: State, depth: int) -> np.ndarray:
        """A mask from a group: its coverage, or its luminosity over a backdrop (black if none is named), through a transfer function."""
        form = self.doc.get(mask.get("G"))
        if self.doc.get(mask.get("S")) == "Alpha":
            out, _ = self._apart(lambda inner, t: inner._form(form, {}, t, depth + 1), s)
        else:
            inner = Painter(self.doc, self.w, self.h, self.deadline)
            group = self.doc.get(form.dict.get("Group")) or {}
            back = self.doc.get(mask.get("BC"))
            space = self.space(group.get("CS"), {}) if group.get("CS") is not None else "DeviceGray"
            inner.px[:] = self.colour(space, [self.doc.get(x) for x in back]) if isinstance(back, list) else 0
            inner.base = self.base
            t = State()
            t.ctm = s.ctm
            inner._form(form, {}, t, depth + 1)
            out = inner.px @ np.array([0.3, 0.59, 0.11], dtype=np.float32)
        transfer = self.doc.get(mask.get("TR"))
        if transfer is not None and not isinstance(transfer, str):
            levels = np.array([postscript.evaluate(self.doc, transfer, [x / 255])[0] for x in range(256)], dtype=np.float32)
            out = np.clip(levels, 0, 1)[np.floor(np.clip(out, 0, 1) * 255 + 0.5).astype(int)]
        return out

    def annotations(self, page: dict[str, Any], s: State) -> None:
        """Appearances of a page's annotations: each form's box, turned by its matrix, comes to the annotation's rectangle."""
        for a in self.doc.get(page.get("Annots")) or []:
            try:
                a = self.doc.get(a)
                flags = int(self.doc.get(a.get("F")) or 0)
                if flags & 0x22 or a.get("Subtype") == "Popup" or not self._visible(self.doc.get(a.get("OC"))):
                    continue
                form = self.doc.get((self.doc.get(a.get("AP")) or {}).get("N"))
                if isinstance(form, dict):
                    form = self.doc.get(form.get(self.doc.get(a.get("AS"))))
                if not isinstance(form, pdf.Stream):
                    continue
                rect, box, m = self.doc.box(a, "Rect"), self.doc.box(form.dict, "BBox"), self.doc.get(form.dict.get("Matrix"))
                m = matrix([self.doc.get(x) for x in m]) if isinstance(m, list) else np.eye(3)
                corners = np.array([[x, y, 1] for x in box[::2] for y in box[1::2]]) @ m
                low, high = corners[:, :2].min(axis=0), corners[:, :2].max(axis=0)
                sx, sy = (rect[2] - rect[0]) / (high[0] - low[0]), (rect[3] - rect[1]) / (high[1] - low[1])
                t = s.copy()
                t.ctm = np.array([[sx, 0, 0], [0, sy, 0], [rect[0] - low[0] * sx, rect[1] - low[1] * sy, 1]]) @ s.ctm
                self._form(form, {}, t, 1)
            except (MediaError, IndexError, KeyError, ValueError, TypeError, AttributeError, ZeroDivisionError) as e:
                if isinstance(e, Limit):
                    raise

    def _form(self, obj: pdf.Stream, resources: dict[str, Any], s: State, depth: int) -> None:
        if depth > MOST_FORMS:
            return
        m = self.doc.get(obj.dict.get("Matrix"))
        if isinstance(m, list):
            s.ctm = matrix([self.doc.get(x) for x in m]) @ s.ctm
        box = self.doc.box(obj.dict, "BBox")
        if box:
            x0, y0, x1, y1 = box
            c = coverage(flatten([("m", x0, y0), ("l", x1, y0), ("l", x1, y1), ("l", x0, y1), ("h",)], s.ctm), self.w, self.h, False)
            s.clip = c if s.clip is None else s.clip * c
        own = self.doc.get(obj.dict.get("Resources"))
        self.run(self.doc.decode(obj), own if isinstance(own, dict) else resources, s, depth)

    def _pattern(self, p: Any, resources: dict[str, Any], s: State, cover: np.ndarray, depth: int) -> None:
        """A covered area filled with a shading, or with tiles: one is painted over white and over black, which gives its colours and where it is empty."""
        d = p.dict if isinstance(p, pdf.Stream) else p
        get = lambda k: self.doc.get(d.get(k))
        own = get("Matrix")
        m = (matrix([self.doc.get(x) for x in own]) if isinstance(own, list) else np.eye(3)) @ self.base
        if get("PatternType") == 2:
            t = s.copy()
            t.ctm, t.clip = m, cover if s.clip is None else cover * s.clip
            self._shading(get("Shading"), resources, t)
            return
        if depth > MOST_FORMS or not isinstance(p, pdf.Stream):
            return
        x0, y0, x1, y1 = self.doc.box(d, "BBox")
        across, down = abs(float(get("XStep"))), abs(float(get("YStep")))
        w = int(min(max(math.ceil((x1 - x0) * np.hypot(*m[0, :2])), 1), SIDE))
        h = int(min(max(math.ceil((y1 - y0) * np.hypot(*m[1, :2])), 1), SIDE))
        tiles = []
        for ground in (1.0, 0.0):
            inner = Painter(self.doc, w, h, self.deadline)
            inner.px[:] = ground
            t = State()
            t.ctm = np.array([[w / (x1 - x0), 0, 0], [0, -h / (y1 - y0), 0], [-x0 * w / (x1 - x0), y1 * h / (y1 - y0), 1]])
            inner.base, t.fill, t.line = t.ctm, s.fill, s.fill
            tile_resources = get("Resources")
            inner.run(self.doc.decode(p), tile_resources if isinstance(tile_resources, dict) else resources, t, depth + 1)
            tiles.append(inner.px)
        alpha = np.clip(1 - (tiles[0] - tiles[1]).mean(axis=2), 0, 1)
        colour = np.where(alpha[..., None] > 0, tiles[1] / np.maximum(alpha[..., None], 1e-6), 0)
        yy, xx = np.mgrid[0 : self.h, 0 : self.w]
        uv = np.column_stack([xx.ravel() + 0.5, yy.ravel() + 0.5, np.ones(xx.size)]) @ np.linalg.inv(m)
        u, v = np.mod(uv[:, 0] - x0, across), np.mod(uv[:, 1] - y0, down)
        inside = (u < x1 - x0) & (v < y1 - y0)
        ix = np.clip((u / (x1 - x0) * w).astype(int), 0, w - 1)
        iy = np.clip(((1 - v / (y1 - y0)) * h).astype(int), 0, h - 1)
        part = np.where(inside, alpha[iy, ix], 0).reshape(self.h, self.w)
        self.paint(s, cover * part.astype(np.float32), np.clip(colour[iy, ix], 0, 1).reshape(self.h, self.w, 3), s.fill_alpha)

    # -- images and shadings -------------------------------------------------------------------------------------------------

    def samples(self, obj: pdf.Stream, resources: dict[str, Any], mask: bool) -> np.ndarray:
        """An image's colours (or a mask's coverage) row by row, from 0 to 1."""
        get = lambda k: self.doc.get(obj.dict.get(k))
        w, h = int(get("Width")), int(get("Height"))
        if not 0 < w * h <= 128_000_000:
            raise Limit("image size")
        names = get("Filter")
        last = str(self.doc.get(names[-1])) if isinstance(names, list) and names else str(names)
        if last in ("DCTDecode", "DCT") and not mask:
            head = dict(obj.dict)
            if isinstance(names, list):
                head["Filter"] = names[:-1]
                data = self.doc.decode(pdf.Stream(head, obj.raw))
            else:
                data = obj.raw
            info, img = jpeg.decode(data, self.deadline)
            named = obj.dict.get("ColorSpace")
            if named is None or img.format in ("rgb8", "cmyk8") or self.channels(self.space(named, resources)) != img.channels:
                return to_rgb(img).samples().astype(np.float32) / 255
            bits, raw = 8, img.data.tobytes()
        else:
            bits, raw = 1 if mask else int(get("BitsPerComponent") or 8), self.doc.decode(obj)
        space = "DeviceGray" if mask else self.space(obj.dict.get("ColorSpace"), resources)
        n = self.channels(space)
        line = (w * n * bits + 7) // 8
        body = np.frombuffer(raw[: line * h].ljust(line * h, b"\0"), dtype=np.uint8).reshape(h, line)
        if bits == 8:
            v = body[:, : w * n].astype(np.float32)
        elif bits == 16:
            v = body.reshape(h, -1, 2)[:, : w * n, 0].astype(np.float32)
            bits = 8
        else:
            v = (np.unpackbits(body, axis=1)[:, : w * n * bits].reshape(h, w * n, bits) * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.float32)
        indexed = not isinstance(space, str) and str(self.doc.get(space[0])) in ("Indexed", "I")
        dec = get("Decode")
        top = (1 << bits) - 1
        if isinstance(dec, list) and len(dec) >= 2 * n:
            d = np.array([float(self.doc.get(x)) for x in dec[: 2 * n]]).reshape(n, 2)
            v = (d[:, 0] + v.reshape(h, w, n) / top * (d[:, 1] - d[:, 0])).reshape(h, w * n)
        elif not indexed:
            v = v / top
        v = v.reshape(h * w, n)
        return v.reshape(h, w) if mask else np.clip(self.rgb(space, v), 0, 1).reshape(h, w, 3).astype(np.float32)

    def _keyed(self, obj: pdf.Stream, key: list[int]) -> np.ndarray | None:
        """Coverage under a colour key: samples whose components all lie in its ranges are left out."""
        get = lambda k: self.doc.get(obj.dict.get(k))
        w, h, n = int(get("Width")), int(get("Height")), len(key) // 2
        if int(get("BitsPerComponent") or 8) != 8 or not n:
            return None
        raw = self.doc.decode(obj)
        px = np.frombuffer(raw[: w * h * n].ljust(w * h * n, b"\0"), dtype=np.uint8).reshape(h, w, n)
        low, high = np.array(key[::2]), np.array(key[1::2])
        return 1.0 - ((px >= low) & (px <= high)).all(axis=2)

    def _image(self, obj: pdf.Stream, resources: dict[str, Any], s: State) -> None:
        stencil = self.doc.get(obj.dict.get("ImageMask")) is True
        px = self.samples(obj, resources, stencil)
        alpha = None
        soft, hard = self.doc.get(obj.dict.get("SMask")), self.doc.get(obj.dict.get("Mask"))
        if isinstance(soft, pdf.Stream):
            alpha = self.samples(soft, resources, False)[:, :, 0]
        elif isinstance(hard, pdf.Stream):
            alpha = 1 - self.samples(hard, resources, True)
        elif isinstance(hard, list) and not stencil:
            alpha = self._keyed(obj, [int(self.doc.get(x)) for x in hard])
        corners = np.array([[0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1.0]]) @ s.ctm
        x0, x1 = max(0, int(corners[:, 0].min())), min(self.w, int(math.ceil(corners[:, 0].max())))
        y0, y1 = max(0, int(corners[:, 1].min())), min(self.h, int(math.ceil(corners[:, 1].max())))
        if x0 >= x1 or y0 >= y1:
            return
        back = np.linalg.inv(s.ctm)
        # a picture drawn smaller than it is gets averaged down first, so no sample is passed over
        step = [max(1, int(round(k))) for k in (px.shape[0] / max(np.hypot(*s.ctm[1, :2]), 1), px.shape[1] / max(np.hypot(*s.ctm[0, :2]), 1))]
        px, alpha = _averaged(px, step), None if alpha is None else _averaged(alpha, [max(1, step[0] * alpha.shape[0] // (px.shape[0] * step[0])), max(1, step[1] * alpha.shape[1] // (px.shape[1] * step[1]))])
        yy, xx = np.mgrid[y0:y1, x0:x1]
        uv = np.column_stack([xx.ravel() + 0.5, yy.ravel() + 0.5, np.ones(xx.size)]) @ back
        inside = ((uv[:, :2] >= 0) & (uv[:, :2] < 1)).all(axis=1)

        def at(a: np.ndarray) -> np.ndarray:
            iy = np.clip(((1 - uv[:, 1]) * a.shape[0]).astype(int), 0, a.shape[0] - 1)
            ix = np.clip((uv[:, 0] * a.shape[1]).astype(int), 0, a.shape[1] - 1)
            return a[iy, ix]

        cover = np.zeros((self.h, self.w), dtype=np.float32)
        part = inside.astype(np.float32)
        colour: np.ndarray = np.array(s.fill)
        if stencil:
            part = part * (1 - at(px))
        else:
            colour = np.zeros((self.h, self.w, 3), dtype=np.float32)
            colour[y0:y1, x0:x1] = at(px).reshape(y1 - y0, x1 - x0, 3)
            if alpha is not None:
                part = part * at(alpha)
        cover[y0:y1, x0:x1] = part.reshape(y1 - y0, x1 - x0)
        self.paint(s, cover, colour, s.fill_alpha)

    def _shading(self, sh: Any, resources: dict[str, Any], s: State) -> None:
        d = sh.dict if isinstance(sh, pdf.Stream) else sh
        get = lambda k: self.doc.get(d.get(k))
        kind = get("ShadingType")
        if kind not in (1, 2, 3):
            return
        space = self.space(d.get("ColorSpace"), resources)
        if kind == 1:
            self._plane(d, space, s)
            return
        coords = [float(self.doc.get(x)) for x in get("Coords")]
        lo, hi = [float(self.doc.get(x)) for x in get("Domain") or [0, 1]]
        ext = [self.doc.get(x) is True for x in get("Extend") or [False, False]]
        fn = get("Function")
        steps = np.linspace(lo, hi, 257)
        fns = fn if isinstance(fn, list) else [fn]
        table = self.rgb(space, np.array([[c for f in fns for c in postscript.evaluate(self.doc, f, [float(t)])] for t in steps]))
        yy, xx = np.mgrid[0 : self.h, 0 : self.w]
        p = (np.column_stack([xx.ravel() + 0.5, yy.ravel() + 0.5, np.ones(xx.size)]) @ np.linalg.inv(s.ctm))[:, :2]
        if kind == 2:
            a, b = np.array(coords[:2]), np.array(coords[2:4])
            t = (p - a) @ (b - a) / max((b - a) @ (b - a), 1e-12)
            ok = np.ones(len(t), dtype=bool)
        else:
            c0, r0, c1, r1 = np.array(coords[:2]), coords[2], np.array(coords[3:5]), coords[5]
            dc, dr = c1 - c0, r1 - r0
            qa = dc @ dc - dr * dr
            qb = (p - c0) @ dc + r0 * dr
            qc = ((p - c0) ** 2).sum(axis=1) - r0 * r0
            with np.errstate(all="ignore"):
                if abs(qa) < 1e-12:
                    roots = [qc / (2 * qb)]
                else:
                    root = np.sqrt(qb * qb - qa * qc)
                    roots = sorted([(qb + root) / qa, (qb - root) / qa], key=lambda r: -np.nanmean(r))
                t, ok = np.zeros(len(p)), np.zeros(len(p), dtype=bool)
                for r in roots:
                    good = np.isfinite(r) & (r0 + r * dr >= 0) & ((r >= 0) | ext[0]) & ((r <= 1) | ext[1]) & ~ok
                    t[good], ok = r[good], ok | good
        ok &= ((t >= 0) | ext[0]) & ((t <= 1) | ext[1])
        colour = table[np.clip(np.nan_to_num(t) * 256, 0, 256).astype(int)].reshape(self.h, self.w, 3)
        self.paint(s, ok.reshape(self.h, self.w).astype(np.float32), colour, s.fill_alpha)


    def _plane(self, d: dict[str, Any], space: Any, s: State) -> None:
        """A shading whose colours are a function of both coordinates, sampled on a grid of its domain."""
        x0, x1, y0, y1 = [float(self.doc.get(x)) for x in self.doc.get(d.get("Domain")) or [0, 1, 0, 1]]
        own = self.doc.get(d.get("Matrix"))
        m = (matrix([self.doc.get(x) for x in own]) if isinstance(own, list) else np.eye(3)) @ s.ctm
        fn = self.doc.get(d.get("Function"))
        fns, n = fn if isinstance(fn, list) else [fn], 48
        grid = [[c for f in fns for c in postscript.evaluate(self.doc, f, [x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * j / n])] for j in range(n + 1) for i in range(n + 1)]
        table = self.rgb(space, np.array(grid)).reshape(n + 1, n + 1, 3)
        yy, xx = np.mgrid[0 : self.h, 0 : self.w]
        p = np.column_stack([xx.ravel() + 0.5, yy.ravel() + 0.5, np.ones(xx.size)]) @ np.linalg.inv(m)
        u, v = (p[:, 0] - x0) / (x1 - x0), (p[:, 1] - y0) / (y1 - y0)
        ok = (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
        colour = table[np.clip(np.rint(v * n), 0, n).astype(int), np.clip(np.rint(u * n), 0, n).astype(int)]
        self.paint(s, ok.reshape(self.h, self.w).astype(np.float32), np.clip(colour, 0, 1).reshape(self.h, self.w, 3), s.fill_alpha)


def _averaged(a: np.ndarray, step: list[int]) -> np.ndarray:
    sy, sx = max(1, min(step[0], a.shape[0])), max(1, min(step[1], a.shape[1]))
    if sy == sx == 1:
        return a
    h, w = a.shape[0] // sy * sy, a.shape[1] // sx * sx
    return a[:h, :w].reshape(h // sy, sy, w // sx, sx, *a.shape[2:]).mean(axis=(1, 3))


def render(doc: pdf.Document, page: dict[str, Any], deadline: Deadline | None = None, size: tuple[int, int] | None = None) -> Image:
    """A page on white, its long side 2048 pixels."""
    width, height = doc.size(page)
    w, h = size or render_size(width, height)
    media = doc.box(page, "MediaBox") or pdf.A4
    crop = doc.box(page, "CropBox") or media
    x0, y0, x1, y1 = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
    if x1 <= x0 or y1 <= y0:
        x0, y0, x1, y1 = pdf.A4
    turn = doc.get(page.get("Rotate"))
    turn = int(turn) % 360 if isinstance(turn, int | float) else 0
    # page space to a unit square with its origin at the upper left, turned, then to pixels
    unit = np.array([[1 / (x1 - x0), 0, 0], [0, -1 / (y1 - y0), 0], [-x0 / (x1 - x0), y1 / (y1 - y0), 1]])
    turned = {90: [[0, 1, 0], [-1, 0, 0], [1, 0, 1]], 180: [[-1, 0, 0], [0, -1, 0], [1, 1, 1]], 270: [[0, -1, 0], [1, 0, 0], [0, 1, 1]]}.get(turn, np.eye(3))
    s = State()
    s.ctm = unit @ np.array(turned, dtype=float) @ np.diag([w, h, 1.0])
    p = Painter(doc, w, h, deadline or Deadline())
    p.base = s.ctm
    resources = doc.get(page.get("Resources"))
    fresh = s.copy()
    p.run(doc.content(page), resources if isinstance(resources, dict) else {}, s)
    p.annotations(page, fresh)
    out = np.floor(np.clip(p.px, 0, 1) * 255 + 0.5).astype(np.uint8)
    return Image(w, h, "rgb8", out.reshape(h, -1))


def checked(data: bytes) -> tuple[pdf.Document, list[dict[str, Any]], list[tuple[int, int]]]:
    """A document and its pages' sizes, refused before anything is drawn if it's encrypted or too large."""
    doc = pdf.Document(data)
    pages = doc.pages()
    if not 1 <= len(pages) <= MOST_PAGES or doc.encrypted:
        raise Invalid("encrypted or oversized document")
    sizes = [render_size(*doc.size(p)) for p in pages]
    if sum(w * h for w, h in sizes) > MOST_TOTAL:
        raise Limit("document pixel budget exceeded")
    return doc, pages, sizes


def frames(data: bytes, deadline: Deadline | None = None):
    """Number, width, height and samples of each page."""
    doc, pages, _ = checked(data)
    for i, page in enumerate(pages):
        img = render(doc, page, deadline)
        yield i + 1, img.width, img.height, img.data.tobytes()


def sanitize(data: bytes, deadline: Deadline | None = None) -> bytes:
    """The document as pictures of its pages and nothing else."""
    from .pdf_write import image_pdf

    return image_pdf([(w, h, jpeg.encode(Image(w, h, "rgb8", np.frombuffer(px, np.uint8).reshape(h, -1)), 85, "420")) for _, w, h, px in frames(data, deadline)])
