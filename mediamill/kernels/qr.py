"""QR symbols (ISO/IEC 18004): finding and counting those that decode, and an encoder to make test images."""

from __future__ import annotations

import numpy as np

from ..errors import Deadline
from ..functions.codes import alignment_centres, format_words
from .joining import joined

# For levels L, M, Q, H and versions 1 to 40, error-correction words a block and blocks.
_ECC_WORDS = (
    (7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28, 28, 28, 30, 30, 26, 28, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30),
    (10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26, 26, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28),
    (13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30, 28, 30, 30, 30, 30, 28, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30),
    (17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28, 30, 24, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30),
)
_BLOCKS = (
    (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8, 8, 9, 9, 10, 12, 12, 12, 13, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 24, 25),
    (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16, 17, 17, 18, 20, 21, 23, 25, 26, 28, 29, 31, 33, 35, 37, 38, 40, 43, 45, 47, 49),
    (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20, 23, 23, 25, 27, 29, 34, 34, 35, 38, 40, 43, 45, 48, 51, 53, 56, 59, 62, 65, 68),
    (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25, 25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81),
)
_LEVELS = {1: 0, 0: 1, 3: 2, 2: 3}  # two bits of the format word to the tables' rows
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
FORMAT_MASK = 0x5412
MOST_CAPSTONES, MOST_GRIDS = 256, 64


def mask(pattern: int, size: int) -> np.ndarray:
    i, j = np.mgrid[0:size, 0:size]
    p = i * j
    rule = [(i + j) % 2, i % 2, j % 3, (i + j) % 3, (i // 2 + j // 3) % 2, p % 2 + p % 3, (p % 2 + p % 3) % 2, (p % 3 + (i + j) % 2) % 2][pattern]
    return rule == 0


def reserved(version: int) -> np.ndarray:
    """Modules that hold no data."""
    n = 17 + 4 * version
    out = np.zeros((n, n), dtype=bool)
    out[:9, :9] = out[-8:, :9] = out[:9, -8:] = out[6, :] = out[:, 6] = True
    if version >= 7:
        out[:6, -11:-8] = out[-11:-8, :6] = True
    c = alignment_centres(version)
    for a in c:
        for b in c:
            if (a, b) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                out[a - 2 : a + 3, b - 2 : b + 3] = True
    return out


def placement(version: int) -> list[tuple[int, int]]:
    """Data modules in the order of reading: pairs of columns from the right, up and down by turns."""
    free, n, out = ~reserved(version), 17 + 4 * version, []
    up, x = True, n - 1
    while x > 0:
        if x == 6:
            x -= 1
        for y in range(n - 1, -1, -1) if up else range(n):
            for c in (x, x - 1):
                if free[y, c]:
                    out.append((y, c))
        up, x = not up, x - 2
    return out


# --- Reed-Solomon -----------------------------------------------------------------------------------------------------

_EXP = [1]
for _ in range(254):
    _v = _EXP[-1] << 1
    _EXP.append(_v ^ 0x11D if _v > 255 else _v)
_LOG = {v: i for i, v in enumerate(_EXP)}
_EXP += _EXP


def _mul(a: int, b: int) -> int:
    return _EXP[_LOG[a] + _LOG[b]] if a and b else 0


def _eval(poly: list[int], x: int) -> int:
    """Value of a polynomial, highest power first."""
    out = 0
    for c in poly:
        out = _mul(out, x) ^ c
    return out


def rs_encode(data: list[int], n: int) -> list[int]:
    gen = [1]
    for k in range(n):
        gen = [a ^ _mul(b, _EXP[k]) for a, b in zip([*gen, 0], [0, *gen], strict=True)]
    rest = [*data, *[0] * n]
    for i in range(len(data)):
        lead = rest[i]
        for j, g in enumerate(gen):
            rest[i + j] ^= _mul(g, lead)
    return rest[len(data) :]


def rs_correct(block: list[int], n: int) -> bool:
    """Mend up to n/2 wrong words of a block in place; False if that can't be done."""
    synd = [_eval(block, _EXP[k]) for k in range(n)]
    if not any(synd):
        return True
    # Berlekamp-Massey, lowest power first
    c, b, length, m, last = [1], [1], 0, 1, 1
    for k in range(n):
        d = synd[k]
        for i in range(1, length + 1):
            d ^= _mul(c[i] if i < len(c) else 0, synd[k - i])
        if not d:
            m += 1
            continue
        t = list(c)
        scale = _EXP[(_LOG[d] - _LOG[last]) % 255]
        c += [0] * (len(b) + m - len(c))
        for i, v in enumerate(b):
            c[i + m] ^= _mul(scale, v)
        if 2 * length <= k:
            length, b, last, m = k + 1 - length, t, d, 1
        else:
            m += 1
    if length > n // 2:
        return False
    places = [i for i in range(len(block)) if _eval(c[::-1], _EXP[(255 - (len(block) - 1 - i)) % 255]) == 0]
    if len(places) != length:
        return False
    omega = [0] * n
    for i, s in enumerate(synd):
        for j, v in enumerate(c):
            if i + j < n:
                omega[i + j] ^= _mul(s, v)
    for i in places:
        power = len(block) - 1 - i
        inv = _EXP[(255 - power) % 255]
        slope = 0
        for j in range(1, len(c), 2):
            slope ^= _mul(c[j], _EXP[_LOG[inv] * (j - 1) % 255])
        if not slope:
            return False
        top = _eval(omega[::-1], inv)
        if top:
            block[i] ^= _mul(_EXP[power % 255], _EXP[(_LOG[top] - _LOG[slope]) % 255])
    return not any(_eval(block, _EXP[k]) for k in range(n))


def _layout(version: int, level: int) -> tuple[int, list[int]]:
    """Error words a block, and data words of each block."""
    total = len(placement(version)) // 8
    e, n = _ECC_WORDS[level][version - 1], _BLOCKS[level][version - 1]
    data = total - e * n
    return e, [data // n + (i >= n - data % n) for i in range(n)]


# --- decoding a grid of modules -----------------------------------------------------------------------------------------


def _format(grid: np.ndarray) -> list[int]:
    """Both copies of the format word as they are read."""
    n = len(grid)
    one = [grid[8, i] for i in (0, 1, 2, 3, 4, 5, 7, 8)] + [grid[i, 8] for i in (7, 5, 4, 3, 2, 1, 0)]
    two = [grid[n - 1 - i, 8] for i in range(7)] + [grid[8, n - 8 + i] for i in range(8)]
    return [int("".join("1" if b else "0" for b in bits), 2) for bits in (one, two)]


def decode_grid(grid: np.ndarray) -> bool:
    """Whether a square of modules (True is dark) holds a payload that can be read."""
    n = len(grid)
    if n % 4 != 1 or not 21 <= n <= 177:
        return False
    version = (n - 17) // 4
    words = format_words()
    places = placement(version)
    for raw in _format(grid):
        distance, word = min(((raw ^ FORMAT_MASK ^ w).bit_count(), w) for w in words)
        if distance > 3:
            continue
        level, pattern = _LEVELS[word >> 13], word >> 10 & 7
        plain = grid ^ mask(pattern, n)
        bits = [plain[y, x] for y, x in places]
        raw_words = [int("".join("1" if b else "0" for b in bits[i : i + 8]), 2) for i in range(0, len(bits) // 8 * 8, 8)]
        e, sizes = _layout(version, level)
        blocks: list[list[int]] = [[] for _ in sizes]
        at = 0
        for k in range(max(sizes)):
            for b, size in zip(blocks, sizes, strict=True):
                if k < size:
                    b.append(raw_words[at])
                    at += 1
        for _ in range(e):
            for b in blocks:
                b.append(raw_words[at])
                at += 1
        if all(rs_correct(b, e) for b in blocks) and payload_ok(bytes(v for b, s in zip(blocks, sizes, strict=True) for v in b[:s]), version):
            return True
    return False


def payload_ok(data: bytes, version: int) -> bool:
    """Whether segments of known modes fill the payload; an unknown mode ends it."""
    total, at, value = len(data) * 8, 0, int.from_bytes(data, "big")

    def take(n: int) -> int | None:
        nonlocal at
        if at + n > total:
            return None
        at += n
        return value >> (total - at) & ((1 << n) - 1)

    band = 0 if version < 10 else 1 if version < 27 else 2
    while at + 4 <= total:
        mode = take(4)
        if mode in (1, 2, 4, 8):
            count = take({1: (10, 12, 14), 2: (9, 11, 13), 4: (8, 16, 16), 8: (8, 10, 12)}[mode][band])
            if count is None:
                return False
            if mode == 1:
                parts = [(10, 1000)] * (count // 3) + {0: [], 1: [(4, 10)], 2: [(7, 100)]}[count % 3]
            elif mode == 2:
                parts = [(11, 2025)] * (count // 2) + [(6, 45)] * (count % 2)
            else:
                parts = [(8 if mode == 4 else 13, 1 << 13)] * count
            for n, limit in parts:
                v = take(n)
                if v is None or v >= limit:
                    return False
        elif mode == 7:
            lead = take(8)
            if lead is None or (lead & 0x80 and take(8 if lead & 0xC0 == 0x80 else 16) is None):
                return False
        elif mode == 3:
            if take(16) is None:
                return False
        elif mode == 9:
            if take(8) is None:
                return False
        elif mode != 5:
            return True
    return True


# --- finding --------------------------------------------------------------------------------------------------------------


def threshold(gray: np.ndarray) -> np.ndarray:
    """Dark pixels by two running averages along each row, one each way, carried from row to row."""
    h, w = gray.shape
    s = max(w // 8, 1)
    keep = (s - 1) / s
    powers = keep ** np.arange(w + 1)
    out = np.zeros((h, w), dtype=bool)
    left = right = 0.0
    block = max(1, int(-600 / np.log(keep)) if s > 1 else 1)

    def run(x: np.ndarray, start: float) -> np.ndarray:
        """y[i] = y[i-1] * keep + x[i], in blocks short enough for the powers."""
        y = np.empty(w)
        for a in range(0, w, block):
            part = x[a : a + block]
            p = powers[: len(part)]
            y[a : a + len(part)] = p * (np.cumsum(part / p) + start * keep)
            start = y[a + len(part) - 1]
        return y

    for y in range(h):
        row = gray[y].astype(np.float64)
        if y & 1:
            left, right = right, left
        a, b = run(row, left), run(row[::-1], right)[::-1]
        left, right = a[-1], b[0]
        out[y] = row < (a + b) * 95 / (200 * s)
    return out


def label(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions of equal pixels that touch by a side: a number for each pixel and the size of each region."""
    h, w = dark.shape
    change = np.ones((h, w), dtype=bool)
    change[:, 1:] = dark[:, 1:] != dark[:, :-1]
    run = np.cumsum(change.ravel()).reshape(h, w) - 1
    same = dark[1:] == dark[:-1]
    _, names = np.unique(joined(int(run[-1, -1]) + 1, run[:-1][same], run[1:][same]), return_inverse=True)
    labels = names[run]
    return labels, np.bincount(labels.ravel())


def finders(dark: np.ndarray, deadline: Deadline) -> list[dict]:
    """Finder patterns: runs of 1:1:3:1:1 whose stone and ring are regions of the right sizes."""
    labels, sizes = label(dark)
    seen: dict[int, int] = {}
    h, w = dark.shape
    for y in range(h):
        if y % 64 == 0:
            deadline.check()
        edges = np.flatnonzero(np.diff(dark[y].astype(np.int8))) + 1
        starts = np.concatenate([[0], edges])
        lengths = np.diff(np.append(starts, w))
        if len(lengths) < 5:
            continue
        p = np.lib.stride_tricks.sliding_window_view(lengths, 5)
        unit = (p[:, 0] + p[:, 1] + p[:, 3] + p[:, 4]) // 4
        slack = unit * 3 // 4
        good = dark[y, starts[: len(p)]]
        for k, m in enumerate((1, 1, 3, 1, 1)):
            good &= (p[:, k] >= unit * m - slack) & (p[:, k] <= unit * m + slack)
        for k in np.flatnonzero(good).tolist():
            left, stone, right = (labels[y, starts[k]], labels[y, starts[k + 2]], labels[y, starts[k + 4]])
            if left == right and left != stone and 10 <= sizes[stone] * 100 // sizes[left] <= 70:
                seen.setdefault(int(left), int(stone))
            if len(seen) >= MOST_CAPSTONES:
                break
    out = []
    wanted = np.zeros(len(sizes), dtype=bool)
    wanted[[*seen.keys(), *seen.values()]] = True
    places = np.flatnonzero(wanted[labels.ravel()])
    order = np.argsort(labels.ravel()[places], kind="stable")
    places, names = places[order], labels.ravel()[places[order]]
    for ring, stone in seen.items():
        (py, px), (sy, sx) = (np.divmod(places[np.searchsorted(names, x) : np.searchsorted(names, x, "right")], w) for x in (ring, stone))
        centre = np.array([sx.mean() + 0.5, sy.mean() + 0.5])
        points = np.stack([px + 0.5, py + 0.5], axis=1) - centre
        # the ring's first corner lies farthest out; the others are extreme along and across it
        far = points[(points**2).sum(1).argmax()]
        along = points @ far
        across = points @ np.array([-far[1], far[0]])
        corners = np.stack([points[i] for i in (along.argmax(), across.argmax(), along.argmin(), across.argmin())]) + centre
        side = np.sqrt(((corners - np.roll(corners, 1, axis=0)) ** 2).sum(1)).mean()
        out.append({"centre": centre, "corners": corners, "module": (side + 1) / 7})
    return out


def _homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map of four points to four others."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1).reshape(3, 3)


def _map(m: np.ndarray, pts: np.ndarray) -> np.ndarray:
    q = np.column_stack([pts, np.ones(len(pts))]) @ m.T
    return q[:, :2] / q[:, 2:]


def _sample(dark: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """A module each, by the majority of nine points in it; outside the image is light."""
    y, x = np.mgrid[0:n, 0:n]
    votes = np.zeros(n * n, dtype=int)
    for dy in (0.3, 0.5, 0.7):
        for dx in (0.3, 0.5, 0.7):
            p = np.floor(_map(m, np.column_stack([x.ravel() + dx, y.ravel() + dy]))).astype(int)
            ok = (p[:, 0] >= 0) & (p[:, 1] >= 0) & (p[:, 0] < dark.shape[1]) & (p[:, 1] < dark.shape[0])
            votes[ok] += np.where(dark[p[ok, 1], p[ok, 0]], 1, 0)
    return (votes > 4).reshape(n, n)


def _fitness(dark: np.ndarray, m: np.ndarray, version: int, frame: np.ndarray, known: np.ndarray) -> int:
    y, x = np.nonzero(known)
    p = np.floor(_map(m, np.column_stack([x + 0.5, y + 0.5]))).astype(int)
    ok = (p[:, 0] >= 0) & (p[:, 1] >= 0) & (p[:, 0] < dark.shape[1]) & (p[:, 1] < dark.shape[0])
    got = np.zeros(len(p), dtype=bool)
    got[ok] = dark[p[ok, 1], p[ok, 0]]
    return int((got == frame[y, x]).sum()) - int((~ok).sum())


def patterns(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Modules whose colour is the same in every symbol of a version, and which they are."""
    n = 17 + 4 * version
    g, known = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    g[6, 8:-8:2] = g[8:-8:2, 6] = True
    known[6, 8:-8] = known[8:-8, 6] = True
    eye = np.zeros((9, 9), dtype=bool)
    eye[1:8, 1:8] = True
    eye[2:7, 2:7] = False
    eye[3:6, 3:6] = True
    for ys, xs, part in ((slice(0, 8), slice(0, 8), eye[1:, 1:]), (slice(0, 8), slice(n - 8, n), eye[1:, :8]), (slice(n - 8, n), slice(0, 8), eye[:8, 1:])):
        g[ys, xs], known[ys, xs] = part, True
    mark = np.ones((5, 5), dtype=bool)
    mark[1:4, 1:4] = False
    mark[2, 2] = True
    c = alignment_centres(version)
    for a in c:
        for b in c:
            if (a, b) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                g[a - 2 : a + 3, b - 2 : b + 3], known[a - 2 : a + 3, b - 2 : b + 3] = mark, True
    g[n - 8, 8] = known[n - 8, 8] = True
    return g, known


def _climb(dark: np.ndarray, m: np.ndarray, version: int) -> np.ndarray:
    """The map with its numbers nudged as long as the fixed patterns fit better."""
    frame, known = patterns(version)
    best = _fitness(dark, m, version, frame, known)
    for step in (0.02, 0.01, 0.005, 0.0025, 0.001):
        for k in range(8):
            for sign in (1, -1):
                t = m.copy()
                t.flat[k] *= 1 + sign * step
                f = _fitness(dark, t, version, frame, known)
                if f > best:
                    best, m = f, t
    return m


def _grids(dark: np.ndarray, caps: list[dict], deadline: Deadline) -> list[tuple[float, dict, dict, dict]]:
    """Triples of finders that stand as a symbol's corners: best match for each corner first."""
    out = []
    centres, modules = np.array([c["centre"] for c in caps]).reshape(-1, 2), np.array([c["module"] for c in caps])
    for i, a in enumerate(caps):
        deadline.check()
        arm = centres - centres[i]
        length = np.hypot(*arm.T)
        length[i] = np.nan
        j, k = (x.ravel() for x in np.indices((len(caps), len(caps))))
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = length[j] / length[k]
            slant = np.abs((arm[j] * arm[k]).sum(axis=1)) / (length[j] * length[k])
            sizes = np.stack([np.full(len(j), modules[i]), modules[j], modules[k]])
            spread = sizes.max(axis=0) / sizes.min(axis=0)
            turn = arm[j, 0] * arm[k, 1] - arm[j, 1] * arm[k, 0]
            good = (j != k) & (turn > 0) & (ratio > 0.6) & (ratio < 1.67) & (slant <= 0.45) & (spread <= 1.7) & (np.minimum(length[j], length[k]) >= 11 * sizes.min(axis=0))
            score = np.where(good, np.abs(1 - ratio) + slant + spread - 1, np.inf)
        best = int(score.argmin())
        if np.isfinite(score[best]):
            out.append((float(score[best]), a, caps[j[best]], caps[k[best]]))
    out.sort(key=lambda t: t[0])
    return out[:MOST_GRIDS]


def scan(gray: np.ndarray, deadline: Deadline | None = None) -> dict:
    """``candidates`` and ``decoded``: corners that look like symbols, and symbols that can be read (mirrored ones too)."""
    deadline = deadline or Deadline()
    if min(gray.shape) < 21:
        return {"candidates": 0, "decoded": 0}
    dark = threshold(gray)
    caps = finders(dark, deadline)
    used: set[int] = set()
    candidates = decoded = 0
    for _, a, b, c in _grids(dark, caps, deadline):
        if used & {id(a), id(b), id(c)}:
            continue
        candidates += 1
        deadline.check()
        module = (a["module"] + b["module"] + c["module"]) / 3
        across = (np.hypot(*(b["centre"] - a["centre"])) + np.hypot(*(c["centre"] - a["centre"]))) / 2
        guess = round((across / module + 7 - 17) / 4)
        for version in sorted({v for v in range(guess - 2, guess + 3) if 1 <= v <= 40}, key=lambda v: abs(v - guess)):
            if _try(dark, a["centre"], b["centre"], c["centre"], version):
                decoded += 1
                used |= {id(a), id(b), id(c)}
                break
    return {"candidates": candidates, "decoded": decoded}


def _try(dark: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, version: int) -> bool:
    n = 17 + 4 * version
    src = np.array([[3.5, 3.5], [n - 3.5, 3.5], [3.5, n - 3.5], [n - 3.5, n - 3.5]])
    m = _homography(src, np.array([a, b, c, b + c - a]))
    maps = [m]
    if version > 1 and (corner := _alignment(dark, m, n)) is not None:
        # a perspective has four points: the fourth is the alignment pattern nearest the corner without a finder
        maps.insert(0, _homography(np.vstack([src[:3], [n - 6.5, n - 6.5]]), np.vstack([a, b, c, corner])))
    for found in (*maps, *(lambda t=t: _climb(dark, t, version) for t in maps)):
        grid = _sample(dark, found() if callable(found) else found, n)
        if decode_grid(grid) or decode_grid(grid.T):
            return True
    return False


def _alignment(dark: np.ndarray, m: np.ndarray, n: int) -> np.ndarray | None:
    """Where the last alignment pattern stands, sought around the place that the finders give; None if nothing looks like one."""
    cells = np.array([(x, y) for y in range(-2, 3) for x in range(-2, 3)], dtype=float)
    ring = np.abs(cells).max(axis=1)
    wanted = ring != 1  # dark at the centre and in the outer ring
    reach = min(8.0, 2 + n / 12)
    steps = np.arange(-reach, reach + 0.01, 0.25)
    offsets = np.array([(x, y) for y in steps for x in steps])
    offsets = offsets[np.argsort((offsets**2).sum(axis=1), kind="stable")]  # nearer places win ties
    points = np.floor(_map(m, (n - 6.5 + offsets[:, None, :] + cells[None]).reshape(-1, 2))).astype(int)
    ok = (points >= 0).all(axis=1) & (points[:, 0] < dark.shape[1]) & (points[:, 1] < dark.shape[0])
    seen = np.zeros(len(points), dtype=bool)
    seen[ok] = dark[points[ok, 1], points[ok, 0]]
    score = (seen.reshape(-1, 25) == wanted).sum(axis=1)
    top = score.max()
    if top < 22:
        return None
    # the middle of the places that fit as well as the best and touch it
    best = offsets[score.argmax()]
    near = offsets[(score == top) & (np.abs(offsets - best).max(axis=1) <= 1)]
    return _map(m, (n - 6.5 + near.mean(axis=0))[None])[0]


# --- encoder --------------------------------------------------------------------------------------------------------------


def encode(data: bytes, level: int = 1, pattern: int = 0, version: int | None = None) -> np.ndarray:
    """A symbol of bytes as a square of modules (True is dark), without a quiet zone."""
    for v in [version] if version else range(1, 41):
        e, sizes = _layout(v, level)
        head = 4 + (8 if v < 10 else 16)
        if head + 8 * len(data) <= 8 * sum(sizes):
            break
    else:
        raise ValueError("too much data")
    bits = f"{4:04b}{len(data):0{head - 4}b}" + "".join(f"{x:08b}" for x in data)
    bits += "0" * min(4, 8 * sum(sizes) - len(bits))
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    words += [(0xEC, 0x11)[i % 2] for i in range(sum(sizes) - len(words))]
    blocks, at = [], 0
    for s in sizes:
        blocks.append((words[at : at + s], rs_encode(words[at : at + s], e)))
        at += s
    stream = [d[k] for k in range(max(sizes)) for d, _ in blocks if k < len(d)] + [x[k] for k in range(e) for _, x in blocks]
    grid, _ = patterns(v)
    n = len(grid)
    m = mask(pattern, n)
    flow = "".join(f"{x:08b}" for x in stream)
    for k, (y, x) in enumerate(placement(v)):
        grid[y, x] = (k < len(flow) and flow[k] == "1") ^ m[y, x]
    code = {v2: k2 for k2, v2 in _LEVELS.items()}[level]
    word = f"{format_words()[code << 3 | pattern] ^ FORMAT_MASK:015b}"
    one = [(8, i) for i in (0, 1, 2, 3, 4, 5, 7, 8)] + [(i, 8) for i in (7, 5, 4, 3, 2, 1, 0)]
    two = [(n - 1 - i, 8) for i in range(7)] + [(8, n - 8 + i) for i in range(8)]
    for places in (one, two):
        for bit, (y, x) in zip(word, places, strict=True):
            grid[y, x] = bit == "1"
    if v >= 7:
        rest = v << 12
        for b in range(17, 11, -1):
            if rest >> b & 1:
                rest ^= 0x1F25 << (b - 12)
        info = v << 12 | rest
        for k in range(18):
            grid[k // 3, n - 11 + k % 3] = grid[n - 11 + k % 3, k // 3] = info >> k & 1
    return grid


def picture(grid: np.ndarray, scale: int = 4, quiet: int = 4) -> np.ndarray:
    """A symbol as gray pixels."""
    return np.kron(np.where(np.pad(grid, quiet), 0, 255).astype(np.uint8), np.ones((scale, scale), dtype=np.uint8))
