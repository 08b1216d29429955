"""ICC profiles: header, tags, curves, tables, and conversion of device pixels to sRGB."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import Invalid

D50 = np.array([0.9642, 1.0, 0.8249])
# sRGB's primaries adapted to D50 (columns red, green, blue).
SRGB = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
MOST_TAGS = 256
NODES, NODES_INK = 33, 17


def bradford(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrix that adapts colours from one white to another."""
    a, b = BRADFORD @ source, BRADFORD @ target
    return np.linalg.inv(BRADFORD) @ np.diag(b / a) @ BRADFORD


def lab_to_xyz(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    return np.where(f > 24 / 116, f**3, (f - 16 / 116) * 108 / 841) * D50


def xyz_to_lab(xyz: np.ndarray) -> np.ndarray:
    t = xyz / D50
    f = np.where(t > (24 / 116) ** 3, np.cbrt(t), t * 841 / 108 + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def srgb_encode(linear: np.ndarray) -> np.ndarray:
    v = np.clip(linear, 0, 1)
    return np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055)


class Profile:
    def __init__(self, data: bytes):
        if len(data) < 132 or data[36:40] != b"acsp":
            raise Invalid("not a colour profile")
        size, = struct.unpack_from(">I", data)
        if not 132 <= size <= len(data):
            raise Invalid("profile size")
        self.data = data[:size]
        self.version, self.kind, self.space, self.pcs = data[8], data[12:16], data[16:20], data[20:24]
        count, = struct.unpack_from(">I", data, 128)
        if count > MOST_TAGS or 132 + 12 * count > size:
            raise Invalid("profile tags")
        self.tags: dict[bytes, bytes] = {}
        for i in range(count):
            name, at, n = struct.unpack_from(">4sII", data, 132 + 12 * i)
            if at + n > size:
                raise Invalid("profile tag bounds")
            self.tags.setdefault(name, self.data[at : at + n])

    @property
    def is_v4(self) -> bool:
        return self.version >= 4

    @property
    def id_hex(self) -> str:
        return self.data[84:100].hex()

    @property
    def description(self) -> str | None:
        d = self.tags.get(b"desc", b"")
        if d[:4] == b"desc" and len(d) >= 12:
            n, = struct.unpack_from(">I", d, 8)
            return d[12 : 12 + n].split(b"\0", 1)[0].decode("latin-1")
        if d[:4] == b"mluc" and len(d) >= 28:
            n, = struct.unpack_from(">I", d, 8)
            records = [struct.unpack_from(">2s2sII", d, 16 + 12 * i) for i in range(min(n, (len(d) - 16) // 12))]
            records.sort(key=lambda r: (r[:2] != (b"en", b"US")))
            if records:
                _, _, size, at = records[0]
                return d[at : at + size // 2 * 2].decode("utf-16-be", "replace").rstrip("\0")
        return None

    def xyz(self, name: bytes) -> np.ndarray:
        d = self.tags.get(name, b"")
        if d[:4] != b"XYZ " or len(d) < 20:
            raise Invalid("profile colorant")
        return np.array(struct.unpack_from(">3i", d, 8)) / 65536

    def curve(self, name: bytes) -> "Curve":
        if name not in self.tags:
            raise Invalid("profile curve")
        return Curve.parse(self.tags[name], 0)[0]


class Curve:
    """A tone curve on 0 to 1: a gamma, a table or a parametric form."""

    def __init__(self, gamma: float | None = None, table: np.ndarray | None = None, params: tuple | None = None):
        self.gamma, self.table, self.params = gamma, table, params

    @staticmethod
    def parse(d: bytes, at: int) -> tuple["Curve", int]:
        """The curve at a place and its length in bytes."""
        kind = d[at : at + 4]
        if kind == b"curv" and len(d) >= at + 12:
            n, = struct.unpack_from(">I", d, at + 8)
            if at + 12 + 2 * n > len(d):
                raise Invalid("profile curve")
            values = np.frombuffer(d, dtype=">u2", count=n, offset=at + 12)
            curve = Curve(gamma=1.0) if n == 0 else Curve(gamma=values[0] / 256) if n == 1 else Curve(table=values / 65535)
            return curve, 12 + 2 * n
        if kind == b"para" and len(d) >= at + 12:
            form, = struct.unpack_from(">H", d, at + 8)
            count = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(form)
            if count is None or at + 12 + 4 * count > len(d):
                raise Invalid("profile curve")
            return Curve(params=(form, *(v / 65536 for v in struct.unpack_from(f">{count}i", d, at + 12)))), 12 + 4 * count
        raise Invalid("profile curve")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, 1)
        if self.table is not None:
            return np.interp(x, np.linspace(0, 1, len(self.table)), self.table)
        if self.params is None:
            return x**self.gamma
        form, g, *p = self.params
        a, b, c, d, e, f = (*p, *([0.0] * (6 - len(p))))
        if form == 0:
            return x**g
        power = np.maximum(a * x + b, 0) ** g
        if form in (1, 2):
            extra = c if form == 2 else 0.0
            return np.clip(np.where(x >= -b / a, power + extra, extra), 0, 1)
        return np.clip(np.where(x >= d, power + (e if form == 4 else 0), c * x + (f if form == 4 else 0)), 0, 1)

    def inverse(self, steps: int = 4096) -> "Curve":
        """A table of the curve turned round."""
        x = np.linspace(0, 1, steps)
        y = np.maximum.accumulate(self(x))
        return Curve(table=np.interp(x, y, x))


class Table:
    """A multi-dimensional table with its curves: lut8, lut16 or mAB."""

    def __init__(self, d: bytes):
        kind = d[:4]
        if kind in (b"mft1", b"mft2") and len(d) >= 52:
            i, o, g = d[8], d[9], d[10]
            wide = kind == b"mft2"
            n_in, n_out = struct.unpack_from(">HH", d, 48) if wide else (256, 256)
            at, form, size, top = (52, ">u2", 2, 65535) if wide else (48, np.uint8, 1, 255)
            total = i * n_in + g**i * o + o * n_out
            if not (1 <= i <= 4 and 1 <= o <= 4 and g >= 2) or at + total * size > len(d):
                raise Invalid("profile table")
            v = np.frombuffer(d, dtype=form, count=total, offset=at) / top
            self.before = [Curve(table=v[k * n_in : (k + 1) * n_in]) for k in range(i)]
            self.grid = v[i * n_in : i * n_in + g**i * o].reshape(*[g] * i, o)
            tail = v[i * n_in + g**i * o :]
            self.after = [Curve(table=tail[k * n_out : (k + 1) * n_out]) for k in range(o)]
            self.middle, self.matrix = None, None
            self.legacy = wide
        elif kind == b"mAB " and len(d) >= 32:
            i, o = d[8], d[9]
            b_at, m_at, mid_at, grid_at, a_at = struct.unpack_from(">5I", d, 12)
            self.before = self._curves(d, a_at, i) if a_at else None
            self.middle = self._curves(d, mid_at, o) if mid_at else None
            self.after = self._curves(d, b_at, o)
            self.matrix = np.array(struct.unpack_from(">12i", d, m_at)) / 65536 if m_at else None
            self.grid = self._grid(d, grid_at, i, o) if grid_at else None
            self.legacy = False
        else:
            raise Invalid("profile table")

    @staticmethod
    def _curves(d: bytes, at: int, n: int) -> list[Curve]:
        out = []
        for _ in range(n):
            curve, size = Curve.parse(d, at)
            out.append(curve)
            at += size + (-size % 4)
        return out

    @staticmethod
    def _grid(d: bytes, at: int, i: int, o: int) -> np.ndarray:
        sizes, wide = list(d[at : at + i]), d[at + 16] == 2
        n = int(np.prod(sizes)) * o
        if min(sizes) < 2 or n > 1 << 24 or at + 20 + n * (2 if wide else 1) > len(d):
            raise Invalid("profile table")
        v = np.frombuffer(d, dtype=">u2" if wide else np.uint8, count=n, offset=at + 20)
        return (v / (65535 if wide else 255)).reshape(*sizes, o)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.before:
            x = np.stack([c(x[:, k]) for k, c in enumerate(self.before)], axis=1)
        if self.grid is not None:
            x = interpolate(self.grid, x)
        if self.middle:
            x = np.stack([c(x[:, k]) for k, c in enumerate(self.middle)], axis=1)
        if self.matrix is not None:
            x = np.clip(x @ self.matrix[:9].reshape(3, 3).T + self.matrix[9:], 0, 1)
        return np.stack([c(x[:, k]) for k, c in enumerate(self.after)], axis=1)


def interpolate(grid: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between the nodes of a grid: tetrahedral over three inputs, multilinear over others."""
    n = x.shape[1]
    top = np.array(grid.shape[:n]) - 1
    at = np.clip(x, 0, 1) * top
    low = np.minimum(at.astype(np.int64), np.maximum(top - 1, 0))
    frac = at - low
    if n == 3:
        # the cell's diagonal is walked along the axes from the largest fraction to the least
        order = np.argsort(-frac, axis=1, kind="stable")
        rows = np.arange(len(x))
        place = low.copy()
        previous = grid[tuple(place.T)]
        out = previous.copy()
        for k in range(3):
            axis = order[:, k]
            place[rows, axis] += 1
            here = grid[tuple(place.T)]
            out += frac[rows, axis][:, None] * (here - previous)
            previous = here
        return out
    out = np.zeros((len(x), grid.shape[-1]))
    for corner in range(1 << n):
        bits = np.array([corner >> k & 1 for k in range(n)])
        w = np.prod(np.where(bits, frac, 1 - frac), axis=1)
        out += w[:, None] * grid[tuple(np.minimum(low + bits, top).T)]
    return out


class Transform:
    """Device samples of eight bits to sRGB, perceptual with black-point compensation."""

    def __init__(self, profile: Profile, channels: int):
        expected = {b"GRAY": 1, b"RGB ": 3, b"CMYK": 4}.get(profile.space)
        if expected != channels:
            raise Invalid("profile colour space")
        self.channels, self.matrix, self.grid = channels, None, None
        back = np.linalg.inv(SRGB)
        if b"A2B0" in profile.tags:
            table = Table(profile.tags[b"A2B0"])
            nodes = NODES_INK if channels == 4 else NODES if channels == 3 else 256
            axes = np.stack(np.meshgrid(*[np.linspace(0, 1, nodes)] * channels, indexing="ij"), axis=-1).reshape(-1, channels)
            xyz = self._connection(table(axes), profile.pcs, table.legacy)
            black = self._black(xyz, axes, profile)
            # the darkest colour goes to black, white stays
            scale = 1 / (1 - black[1]) if black[1] < 1 else 1.0
            xyz = xyz * scale + D50 * (1 - scale)
            self.grid = srgb_encode(xyz @ back.T).reshape(*[nodes] * channels, 3)
            white = (0,) * channels if channels == 4 else (-1,) * channels
            self.grid[white] = 1.0
        elif channels == 3:
            self.curves = [profile.curve(n) for n in (b"rTRC", b"gTRC", b"bTRC")]
            self.matrix = back @ np.stack([profile.xyz(n) for n in (b"rXYZ", b"gXYZ", b"bXYZ")], axis=1)
        elif channels == 1:
            self.curves = [profile.curve(b"kTRC")]
            self.matrix = np.ones((3, 1))
        else:
            raise Invalid("profile without table")
        if self.grid is None:
            self.tables = np.stack([c(np.arange(256) / 255) for c in self.curves])
            self.out = np.floor(srgb_encode(np.arange(16385) / 16384) * 255 + 0.5).astype(np.uint8)
            self.fixed = np.floor(self.matrix * 16384 + 0.5).astype(np.int64)

    @staticmethod
    def _connection(v: np.ndarray, pcs: bytes, legacy: bool) -> np.ndarray:
        if pcs == b"Lab ":
            top = 65280 / 65535 if legacy else 1.0
            lab = np.stack([v[:, 0] / top * 100, v[:, 1] / top * 255 - 128, v[:, 2] / top * 255 - 128], axis=1)
            return lab_to_xyz(lab)
        return v * (1 + 32767 / 32768)

    @staticmethod
    def _black(xyz: np.ndarray, axes: np.ndarray, profile: Profile) -> np.ndarray:
        if profile.is_v4:
            return lab_to_xyz(np.array([3.1373, 0.0, 0.0]))
        lab = xyz_to_lab(xyz[[0 if axes.shape[1] < 4 else -1]])[0]
        return lab_to_xyz(np.array([min(max(lab[0], 0), 50), 0.0, 0.0]))

    def convert(self, px: np.ndarray) -> np.ndarray:
        """Rows of samples to rows of red, green and blue."""
        if self.grid is not None:
            return np.floor(np.clip(interpolate(self.grid, px / 255), 0, 1) * 255 + 0.5).astype(np.uint8)
        linear = np.stack([np.floor(self.tables[k] * 16384 + 0.5).astype(np.int64)[px[:, k]] for k in range(self.channels)], axis=1)
        rgb = (linear @ self.fixed.T + 0x2000) >> 14
        return self.out[np.clip(rgb, 0, 16384)]


_cache: dict[tuple[bytes, int], Transform] = {}


def to_srgb(icc: bytes, channels: int) -> Transform:
    """A profile's transform, kept for the worker's next images."""
    key = icc, channels
    if key not in _cache:
        if len(_cache) > 16:
            _cache.clear()
        _cache[key] = Transform(Profile(icc), channels)
    return _cache[key]


def matrix_profile(description: str, colorants: np.ndarray, gamma: float, space: bytes = b"RGB ") -> bytes:
    """A version 2 display profile of colorants (columns) and a gamma, or a gray one of a gamma alone."""
    def xyz(v) -> bytes:
        return b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(x * 65536) for x in v])

    text = description.encode("latin-1") + b"\0"
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256)) + b"\0\0"
    tags = [(b"desc", b"desc\0\0\0\0" + struct.pack(">I", len(text)) + text + bytes(78)), (b"wtpt", xyz(D50))]
    if space == b"GRAY":
        tags.append((b"kTRC", curve))
    else:
        tags += [(n + b"XYZ", xyz(colorants[:, k])) for k, n in enumerate((b"r", b"g", b"b"))] + [(n + b"TRC", curve) for n in (b"r", b"g", b"b")]
    body, index, at = b"", b"", 132 + 12 * len(tags)
    for name, d in tags:
        index += struct.pack(">4sII", name, at, len(d))
        d += b"\0" * (-len(d) % 4)
        body, at = body + d, at + len(d)
    head = struct.pack(">I4sI4s4s4s", at, b"none", 0x02400000, b"mntr", space, b"XYZ ") + bytes(12) + b"acsp" + bytes(28) + struct.pack(">3i", *[round(x * 65536) for x in D50]) + bytes(48)
    return head + struct.pack(">I", len(tags)) + index + body
