"""Binary images as arrays of truth values (True is ink): morphology, components, distances, thresholds, lines."""

from __future__ import annotations

import numpy as np

from .joining import joined


def _shifted_any(a: np.ndarray, size: int, axis: int, origin: int) -> np.ndarray:
    """Whether any of ``size`` neighbours along an axis is set; ``origin`` is the brick's centre."""
    lo, hi = origin, size - 1 - origin
    pad = [(0, 0), (0, 0)]
    pad[axis] = (hi + 1, lo)
    c = np.cumsum(np.pad(a, pad).astype(np.int32), axis=axis)
    n = a.shape[axis]
    take = lambda s: np.take(c, np.arange(s, s + n), axis=axis)
    return take(size) > take(0)


def dilate(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Dilation by a brick centred at half its sides."""
    return _shifted_any(_shifted_any(a, width, 1, width // 2), height, 0, height // 2)


def erode(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Erosion by a brick; beyond the edge counts as ink."""
    out = ~_shifted_any(~a, width, 1, width - 1 - width // 2)
    return ~_shifted_any(~out, height, 0, height - 1 - height // 2)


def opened(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilate(erode(a, width, height), width, height)


def closed(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Closing with a border wide enough that edges don't count as ink."""
    p = np.pad(a, ((height, height), (width, width)))
    return erode(dilate(p, width, height), width, height)[height:-height, width:-width]


def seed_fill(seed: np.ndarray, mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """The parts of the mask that the seed reaches."""
    names, n = components(mask, connectivity)
    hit = np.zeros(n + 1, dtype=bool)
    hit[np.unique(names[seed & mask])] = True
    hit[0] = False
    return hit[names]


def components(a: np.ndarray, connectivity: int = 4) -> tuple[np.ndarray, int]:
    """A number from 1 for each connected part, in the order of their first pixels; 0 is background."""
    h, w = a.shape
    start = a.copy()
    start[:, 1:] &= ~a[:, :-1]
    run = np.cumsum(start.ravel()).reshape(h, w) * a
    total = int(run.max()) if a.size else 0
    pairs = [np.stack([run[:-1][m], run[1:][m]]) for m in [a[:-1] & a[1:]]]
    if connectivity == 8:
        pairs += [np.stack([run[:-1, :-1][m], run[1:, 1:][m]]) for m in [a[:-1, :-1] & a[1:, 1:]]]
        pairs += [np.stack([run[:-1, 1:][m], run[1:, :-1][m]]) for m in [a[:-1, 1:] & a[1:, :-1]]]
    x, y = np.concatenate(pairs, axis=1)
    roots = joined(total + 1, x, y)
    _, names = np.unique(roots, return_inverse=True)
    return names[run], int(names.max()) if total else 0


def boxes(a: np.ndarray, connectivity: int = 4) -> list[tuple[int, int, int, int]]:
    """Left, top, width and height of each part."""
    names, n = components(a, connectivity)
    if not n:
        return []
    y, x = np.nonzero(names)
    k = names[y, x]
    x0, y0 = np.full(n + 1, a.shape[1]), np.full(n + 1, a.shape[0])
    x1, y1 = np.zeros(n + 1, int), np.zeros(n + 1, int)
    np.minimum.at(x0, k, x)
    np.minimum.at(y0, k, y)
    np.maximum.at(x1, k, x)
    np.maximum.at(y1, k, y)
    return [(int(x0[i]), int(y0[i]), int(x1[i] - x0[i] + 1), int(y1[i] - y0[i] + 1)) for i in range(1, n + 1)]


def reduce_rank(a: np.ndarray, level: int) -> np.ndarray:
    """Half size: a pixel is set if ``level`` of its four are."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    b = a[:h, :w].astype(np.uint8)
    return b[::2, ::2] + b[::2, 1::2] + b[1::2, ::2] + b[1::2, 1::2] >= level


def distance(a: np.ndarray, most: int = 254) -> np.ndarray:
    """Steps from each ink pixel to the nearest background, by sides, up to a bound."""
    out = np.zeros(a.shape, dtype=np.int32)
    h, w = a.shape
    big = h + w + 2
    y = np.arange(h)[:, None]
    ink = a
    up = y - np.maximum.accumulate(np.where(ink, -1, y), axis=0)
    down = np.minimum.accumulate(np.where(ink, h, y)[::-1], axis=0)[::-1] - y
    g = np.minimum(up, down).astype(np.int64)
    x = np.arange(w)
    left = np.minimum.accumulate(g - x, axis=1) + x
    right = np.minimum.accumulate((g + x)[:, ::-1], axis=1)[:, ::-1] - x
    edge = np.minimum(x + 1, w - x)[None, :]
    out = np.minimum(np.minimum(np.minimum(left, right), edge), big)
    return np.where(ink, np.minimum(out, most), 0).astype(np.uint8)


def otsu(levels: np.ndarray) -> tuple[int, int, int]:
    """Threshold, pixels, and pixels at or below it, from a histogram of 256 levels; -1 where there is one class only."""
    n = levels.astype(np.float64)
    total, weighted = int(levels.sum()), float((n * np.arange(256)).sum())
    below, mu = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (weighted - mu) / (total - below) - mu / below
        spread = gap * gap * below * (total - below)
    spread[(below == 0) | (below == total)] = -1
    spread[255] = -1
    best = int(spread.argmax())
    return (best, total, int(below[best])) if spread[best] >= 0 else (-1, total, 0)


def binarise(planes: list[np.ndarray]) -> np.ndarray:
    """Ink of a page of one or three planes: a pixel is ink if any clear channel puts it on its ink side."""
    found = []
    for p in planes:
        t, total, below = otsu(np.bincount(p.ravel(), minlength=256))
        if t < 0 or below in (0, total):
            found.append((-1, -1, 0.0, 1))
            continue
        guess = int(below < total * 0.5)
        clear = 0 if below > total * 0.75 else 1 if below < total * 0.25 else -1
        found.append((t, clear, float(total - below if guess else below), guess))
    if not any(c >= 0 for _, c, _, _ in found):
        k = max(range(len(found)), key=lambda i: found[i][2])
        t, _, d, guess = found[k]
        found[k] = (t, guess, d, guess)
    out = np.zeros(planes[0].shape, dtype=bool)
    for p, (t, hi, _, _) in zip(planes, found, strict=True):
        if hi >= 0:
            out |= (p > t) == (hi == 0)
    return out


def remove_lines(a: np.ndarray, resolution: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The image without long thin rules, and the horizontal and vertical rules found."""
    length, thick = max(20, resolution // 4), max(3, resolution // 20)
    across = opened(a, length, 1) & ~opened(a, length, thick)
    down = opened(a, 1, length) & ~opened(a, thick, length)
    return a & ~across & ~down, across, down


def photo_mask(a: np.ndarray) -> np.ndarray:
    """Large dense regions: pictures rather than text."""
    if min(a.shape) < 16:
        return np.zeros(a.shape, dtype=bool)
    small = reduce_rank(reduce_rank(a, 1), 4)
    seed = opened(closed(small, 5, 5), 9, 9)
    grown = seed_fill(seed, closed(small, 5, 5), 8)
    big = np.kron(grown, np.ones((4, 4), dtype=bool))
    out = np.zeros(a.shape, dtype=bool)
    out[: big.shape[0], : big.shape[1]] = big[: a.shape[0], : a.shape[1]]
    return out


def outlines(a: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed borders of ink along pixel edges, ink to their left, as corner points."""
    p = np.pad(a, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(a), strict=True):
        py, px = y + 1, x + 1
        for cond, s, e in ((not p[py - 1, px], (x + 1, y), (x, y)), (not p[py, px - 1], (x, y), (x, y + 1)), (not p[py + 1, px], (x, y + 1), (x + 1, y + 1)), (not p[py, px + 1], (x + 1, y + 1), (x + 1, y))):
            if cond:
                edges.setdefault((int(s[0]), int(s[1])), []).append((int(e[0]), int(e[1])))
    out = []
    while edges:
        first = min(edges, key=lambda q: (q[1], q[0]))
        at, path, came = first, [], (0, 0)
        while at in edges:
            options = edges[at]
            # at a crossing the path turns left, so parts that touch by a corner stay apart
            k = max(range(len(options)), key=lambda i: came[1] * (options[i][0] - at[0]) - came[0] * (options[i][1] - at[1]))
            to = options.pop(k)
            if not options:
                del edges[at]
            path.append(at)
            came = (to[0] - at[0], to[1] - at[1])
            at = to
            if at == first:
                break
        out.append(path)
    return out


def stroke_widths(a: np.ndarray) -> tuple[float, float]:
    """Median widths of strokes across and down, from twice the distances along the middle of the ink."""
    d = distance(a).astype(np.int32)
    if not d.any():
        return 0.0, 0.0
    mid_x = a & (d >= np.pad(d, ((0, 0), (1, 0)))[:, :-1]) & (d >= np.pad(d, ((0, 0), (0, 1)))[:, 1:])
    mid_y = a & (d >= np.pad(d, ((1, 0), (0, 0)))[:-1]) & (d >= np.pad(d, ((0, 1), (0, 0)))[1:])
    width = lambda m: float(np.median(2 * d[m] - 1)) if m.any() else 0.0
    return width(mid_x), width(mid_y)
