"""Array kernels over one raster, in NumPy, and their fused Arrow functions.

Rasters stay inside one Python function from decode to features; only narrow rows
(labels, counts, features) leave it, so that no raster is ever shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def moved(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``, ``fill`` outside."""
    h, w = a.shape
    out = np.full_like(a, fill)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = a[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def kernel_offsets(shape: str, size: int) -> list[tuple[int, int]]:
    """Offsets of an odd ``rectangle``, ``ellipse`` or ``cross``."""
    r = size // 2
    square = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    if shape == "cross":
        return [(y, x) for y, x in square if 0 in (y, x)]
    if shape == "ellipse":
        reach = [int(math.floor(r * math.sqrt(max(0.0, 1 - (y / r) ** 2)) + 0.5)) if r else 0 for y in range(-r, r + 1)]
        return [(y, x) for y, x in square if abs(x) <= reach[y + r]]
    return square


def erode(mask: np.ndarray, offsets: list[tuple[int, int]], times: int = 1, outside: bool = True) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce([moved(mask, dy, dx, outside) for dy, dx in offsets])
    return mask


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([moved(mask, -dy, -dx, False) for dy, dx in offsets])
    return mask


def fill_polygons(polygons: list[list[tuple[float, float]]], height: int, width: int, even_odd: bool = False, clip: bool = True) -> np.ndarray:
    """Filled polygons, edges included: their union, or by the parity of all of them."""
    total = np.zeros((height, width), np.int32)
    edges = np.zeros((height, width), bool)
    for poly in polygons:
        pts = np.rint(np.asarray(poly, float)).astype(int)
        if len(pts) < 3:
            continue
        if clip:
            pts = np.column_stack([pts[:, 0].clip(0, width - 1), pts[:, 1].clip(0, height - 1)])
        one = np.zeros((height, width), np.int32)
        for (x0, y0), (x1, y1) in zip(pts, np.roll(pts, -1, 0), strict=True):
            steps = max(abs(x1 - x0), abs(y1 - y0), 1)
            xs, ys = np.rint(np.linspace(x0, x1, steps + 1)).astype(int), np.rint(np.linspace(y0, y1, steps + 1)).astype(int)
            ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
            edges[ys[ok], xs[ok]] = True
            for y in range(max(min(y0, y1), 0), min(max(y0, y1), height)):  # half-open: a vertex counts once
                x = x0 + (y - y0) * (x1 - x0) / (y1 - y0)
                one[y, max(0, math.ceil(x)) :] += 1
        if even_odd:
            total += one
        else:
            total |= one % 2
    return (total % 2 == 1) | edges


def blur(a: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    """Separable Gaussian with mirrored borders; sigma 0 follows from the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n, r = a.shape[axis], size // 2
        i = np.abs(np.arange(-r, n + r))
        period = max(1, 2 * (n - 1))
        i = i % period
        padded = np.take(a, np.where(i >= n, period - i, i) if n > 1 else np.zeros(n + 2 * r, int), axis)
        a = sum(w * np.take(padded, np.arange(j, j + n), axis) for j, w in enumerate(k))
    return a


def corrected(gray: np.ndarray, mask: np.ndarray, size: int = 151, sigma: float = 0.0, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Background within a mask, and what stands out from it."""
    m = mask.astype(float)
    weight = blur(m, size, sigma)
    back = np.where(weight > eps, blur(gray * m, size, sigma) / np.maximum(weight, eps), 0.0) * m
    return back, (gray - back) * m


def convolve(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Correlation with mirrored borders, by FFT."""
    r0, r1 = k.shape[0] // 2, k.shape[1] // 2
    p = np.pad(a, ((r0, r0), (r1, r1)), "reflect" if min(a.shape) > max(r0, r1) else "edge")
    full = np.fft.irfft2(np.fft.rfft2(p) * np.conj(np.fft.rfft2(k, p.shape)), p.shape)
    return full[: a.shape[0], : a.shape[1]]


def gabor(a: np.ndarray, mask: np.ndarray, angles: int = 12, size: int = 31, sigma: float = 3.0, wavelength: float = 6.0, gamma: float = 0.5, mode: str = "absolute") -> tuple[np.ndarray, np.ndarray]:
    """Best response over directions, and the angle of it (-1 where there is none)."""
    y, x = np.mgrid[-(size // 2) : size // 2 + 1, -(size // 2) : size // 2 + 1].astype(float)
    best, at = np.zeros(a.shape), np.full(a.shape, -1.0)
    for i in range(angles):
        t = math.pi * i / angles
        u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
        k = np.exp(-(u * u + gamma * gamma * v * v) / (2 * sigma * sigma)) * np.cos(2 * math.pi * u / wavelength)
        k -= k.mean()
        r = convolve(a, k / (np.sqrt((k * k).sum()) or 1.0))
        s = np.abs(r) if mode == "absolute" else np.maximum(r if mode == "positive" else -r, 0)
        better = (s > best) & mask
        best[better], at[better] = s[better], 180.0 * i / angles
    return best, at


def frangi(a: np.ndarray, mask: np.ndarray, sigmas: tuple[float, ...] = (2.0, 2.5), beta: float = 0.2, gamma: float | None = None, dark: bool = True, bright: bool = True) -> np.ndarray:
    """Multi-scale ridge filter on Hessian eigenvalues (Frangi et al. 1998).

    It looks at the mask's bounding box with a margin of ``ceil(4 * max(sigmas))`` pixels; without
    a ``gamma`` the scale is half the greatest Hessian norm there.
    """
    box = bounds(mask)
    if box is None:
        return np.zeros(a.shape)
    margin = math.ceil(4 * max(sigmas))
    y0, x0, y1, x1 = max(0, box[0] - margin), max(0, box[1] - margin), box[2] + margin, box[3] + margin
    if (y0, x0) != (0, 0) or y1 < a.shape[0] or x1 < a.shape[1]:
        whole = np.zeros(a.shape)
        whole[y0:y1, x0:x1] = frangi(a[y0:y1, x0:x1], mask[y0:y1, x0:x1], sigmas, beta, gamma, dark, bright)
        return whole
    out = np.zeros(a.shape)
    for s in sigmas:
        g = blur(a, 2 * int(math.ceil(4 * s)) + 1, s)
        gy, gx = np.gradient(g)
        hyy, hyx = np.gradient(gy)
        _, hxx = np.gradient(gx)
        root = np.sqrt((hxx - hyy) ** 2 + 4 * hyx * hyx)
        l1, l2 = (hxx + hyy + root) / 2 * s * s, (hxx + hyy - root) / 2 * s * s
        swap = np.abs(l1) > np.abs(l2)
        l1, l2 = np.where(swap, l2, l1), np.where(swap, l1, l2)
        size2 = l1 * l1 + l2 * l2
        c = gamma if gamma is not None else (math.sqrt(size2.max()) / 2 or 1.0)
        r = np.exp(-(l1 / np.where(l2 == 0, 1e-10, l2)) ** 2 / (2 * beta * beta)) * (1 - np.exp(-size2 / (2 * c * c)))
        keep = np.zeros(a.shape, bool)
        if bright:
            keep |= l2 < 0
        if dark:
            keep |= l2 > 0
        out = np.maximum(out, np.where(keep, r, 0))
    return out * mask


def bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """``y0, x0, y1, x1`` (ends excluded) of the set pixels; None where there are none."""
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(ys[0]), int(xs[0]), int(ys[-1]) + 1, int(xs[-1]) + 1) if len(ys) else None


def components(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Least row-major index of each pixel's component, -1 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    offsets = EIGHT if connectivity == 8 else FOUR
    while True:
        low = label
        for dy, dx in offsets:
            low = np.minimum(low, moved(label, dy, dx, h * w))
        low = np.where(mask, low, h * w)
        flat = np.append(low.ravel(), h * w)
        low = np.where(mask, flat[flat[low]], h * w)  # halve the way to the root
        if np.array_equal(low, label):
            return np.where(mask, label, -1)
        label = low


def hysteresis(a: np.ndarray, mask: np.ndarray, percentile: float = 97.0, ratio: float = 0.4, eps: float = 1e-12, connectivity: int = 8) -> tuple[np.ndarray, float, float]:
    """Weak pixels in components that hold a strong one; empty where the high threshold vanishes."""
    if not np.isfinite(a).all():
        raise ValueError("response must be finite")
    high = float(np.percentile(a[mask], percentile)) if mask.any() else 0.0
    low = high * ratio
    if high <= eps:
        return np.zeros(a.shape, bool), low, high
    weak, strong = mask & (a >= low), mask & (a >= high)
    label = components(weak, connectivity)
    return weak & np.isin(label, np.unique(label[strong])), low, high


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning by Zhang and Suen (1984)."""
    img = np.pad(mask.astype(np.uint8), 1)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for first in (True, False):
            p = [moved(img, dy, dx) for dy, dx in ring]
            count = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            free = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
            gone = (img == 1) & (count >= 2) & (count <= 6) & (turns == 1) & free
            changed |= bool(gone.any())
            img = np.where(gone, 0, img).astype(np.uint8)
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def thinned(mask: np.ndarray) -> np.ndarray:
    """Thinning by border direction, pixel by pixel, in the manner of Lee, Kashyap and Chu (1994) in the plane.

    A border pixel goes if it is simple (its 8-neighbours stay one piece) and not an end.
    """
    img = np.pad(mask.astype(bool), 1)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]

    def simple(y: int, x: int) -> bool:
        p = [bool(img[y + dy, x + dx]) for dy, dx in ring]
        if sum(p) < 2:
            return False
        pieces = sum(1 for i in (0, 2, 4, 6) if not p[i] and (p[(i + 1) % 8] or p[(i + 2) % 8]))
        return pieces == 1

    changed = True
    while changed:
        changed = False
        for dy, dx in ((-1, 0), (1, 0), (0, 1), (0, -1)):
            border = img & ~moved(img, dy, dx, False)
            for y, x in np.argwhere(border).tolist():
                if simple(y, x):
                    img[y, x] = False
                    changed = True
    return img[1:-1, 1:-1]


def morphological_skeleton(mask: np.ndarray) -> np.ndarray:
    """Union of what each opening by a cross takes away; may be disconnected."""
    cross, out = kernel_offsets("cross", 3), np.zeros(mask.shape, bool)
    while mask.any():
        small = erode(mask, cross, outside=False)
        out |= mask & ~dilate(small, cross)
        mask = small
    return out


def _to_unset(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest unset pixel of the same column, infinite where there is none."""
    out = np.full(mask.shape, np.inf)
    for rows in (range(mask.shape[0]), range(mask.shape[0])[::-1]):
        run = np.full(mask.shape[1], np.inf)
        for y in rows:
            run = np.where(mask[y], run + 1, 0.0)
            out[y] = np.minimum(out[y], run)
    return out


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest unset pixel (Felzenszwalb and Huttenlocher 2012).

    Columns by two sweeps, then the lower envelope of each row's parabolas, all rows at once:
    memory is a few numbers a pixel. A mask without unset pixels is far from all of them.
    """
    h, w = mask.shape
    far = float(mask.size * 4 + 1)
    if not h or not w:
        return np.zeros(mask.shape)
    f = np.minimum(_to_unset(mask), far) ** 2
    rows = np.arange(h)
    vertex, edge, top = np.zeros((h, w), np.int64), np.full((h, w + 1), np.inf), np.zeros(h, np.int64)
    edge[:, 0] = -np.inf
    for q in range(1, w):
        live = rows
        cut = np.empty(h)
        while len(live):
            v = vertex[live, top[live]]
            cut[live] = (f[live, q] + q * q - f[live, v] - v * v) / (2.0 * (q - v))
            live = live[cut[live] <= edge[live, top[live]]]
            top[live] -= 1
        top += 1
        vertex[rows, top], edge[rows, top], edge[rows, top + 1] = q, cut, np.inf
    out, at = np.empty((h, w)), np.zeros(h, np.int64)
    for x in range(w):
        live = rows
        while len(live):
            live = live[edge[live, at[live] + 1] < x]
            at[live] += 1
        v = vertex[rows, at]
        out[:, x] = (x - v) ** 2 + f[rows, v]
    return np.sqrt(np.minimum(out, far * far))


def chamfer(mask: np.ndarray, a: float = 1.0, b: float = 1.4, c: float = 2.1969) -> np.ndarray:
    """Two-pass 5 x 5 chamfer distance (Borgefors 1986), a row at a time."""
    h, w = mask.shape
    d = np.pad(np.where(mask, np.inf, 0.0), 2, constant_values=np.inf)
    above = [(-1, 0, a), (-1, -1, b), (-1, 1, b), (-2, -1, c), (-2, 1, c), (-1, -2, c), (-1, 2, c)]
    along = a * np.arange(w)
    for turned in (d, d[::-1, ::-1]):
        for y in range(2, h + 2):
            row = turned[y, 2 : w + 2]
            for dy, dx, v in above:
                row = np.minimum(row, turned[y + dy, 2 + dx : w + 2 + dx] + v)
            turned[y, 2 : w + 2] = np.minimum.accumulate(row - along) + along
    return d[2:-2, 2:-2]


def _sweep(points: set[tuple[int, int]], start: tuple[int, int]) -> tuple[tuple[int, int], float, dict]:
    dist, back, queue = {start: 0.0}, {start: None}, [(0.0, start)]
    best, far = start, 0.0
    while queue:
        d, p = heapq.heappop(queue)
        if d > dist[p]:
            continue
        if d > far:
            best, far = p, d
        for dy, dx in EIGHT:
            q = (p[0] + dy, p[1] + dx)
            if q in points:
                e = d + (math.sqrt(2) if dy and dx else 1.0)
                if e < dist.get(q, math.inf) - 1e-12:
                    dist[q], back[q] = e, p
                    heapq.heappush(queue, (e, q))
    return best, far, back


def longest_path(skel: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Length in pixels and pixels of the longest path, by two sweeps a component."""
    label, best, path = components(skel), 0.0, []
    for k in np.unique(label[label >= 0]):
        points = set(map(tuple, np.argwhere(label == k).tolist()))
        a, _, _ = _sweep(points, min(points))
        b, far, back = _sweep(points, a)
        if far + 1 >= best:
            best, path = far + 1, []
            at = b
            while at is not None:
                path.append(at)
                at = back[at]
    return best, path


def min_area_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Longer side, shorter side, ratio of the least rotated rectangle around pixels."""
    if not len(points):
        return 0.0, 0.0, 0.0
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) == 1:
        return 1.0, 1.0, 1.0

    def turn(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    hull = []
    for order in (pts, pts[::-1]):
        side: list[np.ndarray] = []
        for p in order:
            while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        hull += side[:-1]
    hull_a = np.array(hull)
    best = None
    for e in np.roll(hull_a, -1, 0) - hull_a:
        n = np.hypot(*e)
        if n:
            u = e / n
            x, y = hull_a @ u, hull_a @ np.array([-u[1], u[0]])
            sides = sorted((float(np.ptp(x)), float(np.ptp(y))))
            if best is None or sides[0] * sides[1] < best[0] * best[1] - 1e-12:
                best = sides
    return best[1] + 1, best[0] + 1, (best[1] + 1) / (best[0] + 1)


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int]:
    """``y, x, height, width`` of the largest set rectangle (the first of equals)."""
    best, at, heights = 0, None, np.zeros(mask.shape[1], int)
    for y, row in enumerate(mask):
        heights = np.where(row, heights + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, v in enumerate([*heights.tolist(), 0]):
            start = x
            while stack and stack[-1][1] >= v:
                start, tall = stack.pop()
                if tall * (x - start) > best:
                    best, at = tall * (x - start), (y - tall + 1, start, tall, x - start)
            stack.append((start, v))
    if at is None:
        raise ValueError("an empty mask has no rectangle")
    return at


def rotate_points(points: np.ndarray, angle: float, width: int, height: int) -> np.ndarray:
    t = math.radians(angle)
    d = np.asarray(points, float) - (width / 2, height / 2)
    return np.column_stack([math.cos(t) * d[:, 0] + math.sin(t) * d[:, 1], -math.sin(t) * d[:, 0] + math.cos(t) * d[:, 1]]) + (width / 2, height / 2)


def clip_polygon(points: list[tuple[float, float]], width: int, height: int) -> list[tuple[float, float]]:
    """Polygon within 0..width-1, 0..height-1 (Sutherland and Hodgman)."""
    for axis, bound, sign in ((0, 0, 1), (0, width - 1, -1), (1, 0, 1), (1, height - 1, -1)):
        out = []
        for a, b in zip(points, [*points[1:], *points[:1]], strict=True):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia:
                out.append(a)
            if ia != ib:
                r = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(p + r * (q - p) for p, q in zip(a, b, strict=True)))
        points = out
        if not points:
            break
    return points


def turned_polygon(points: list[tuple[float, float]], angle: int, flip: str | None, width: int, height: int) -> list[tuple[float, float]] | None:
    """A polygon after rotation, flip and clipping; None with fewer than three points before or after."""
    if len(points) < 3:
        return None
    pts = np.asarray(points, float)
    if angle == 180:
        pts = (width - 1, height - 1) - pts
    elif angle % 360:
        pts = rotate_points(pts, angle, width, height)
    if flip == "hflip":
        pts = np.column_stack([width - 1 - pts[:, 0], pts[:, 1]])
    elif flip == "vflip":
        pts = np.column_stack([pts[:, 0], height - 1 - pts[:, 1]])
    out = list(map(tuple, pts.tolist()))
    if pts.min() < 0 or pts[:, 0].max() > width - 1 or pts[:, 1].max() > height - 1:
        out = clip_polygon(out, width, height)
    return out if len(out) >= 3 else None


def clip_polygons(x: np.ndarray, y: np.ndarray, size: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``clip_polygon`` of many polygons, whose points follow one another; ``size`` counts each one's points."""
    for axis, bound, sign in ((0, 0, 1), (0, width - 1, -1), (1, 0, 1), (1, height - 1, -1)):
        which = np.repeat(np.arange(len(size)), size)
        after = np.arange(1, len(x) + 1)
        ends = np.cumsum(size)
        after[(ends - 1)[size > 0]] = (ends - size)[size > 0]
        c = (x, y)[axis]
        inside = sign * (c - bound) >= 0
        cut = inside != inside[after]
        r = np.zeros(len(x))
        r[cut] = (bound - c[cut]) / (c[after][cut] - c[cut])
        keep = np.column_stack([inside, cut]).ravel()
        x, y = (np.column_stack([v, v + r * (v[after] - v)]).ravel()[keep] for v in (x, y))
        size = np.bincount(np.repeat(which, 2)[keep], minlength=len(size))
    return x, y, size


def turned_polygons(x: np.ndarray, y: np.ndarray, size: np.ndarray, angle: int, flip: str | None, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``turned_polygon`` of many polygons, whose points follow one another; size 0 where none is left."""
    whole = size >= 3
    x, y = (v[np.repeat(whole, size)] for v in (x, y))
    size = np.where(whole, size, 0)
    if angle == 180:
        x, y = width - 1 - x, height - 1 - y
    elif angle % 360:
        x, y = rotate_points(np.column_stack([x, y]), angle, width, height).T
    x, y = (width - 1 - x if flip == "hflip" else x), (height - 1 - y if flip == "vflip" else y)
    x, y, size = clip_polygons(x, y, size, width, height)
    whole = size >= 3
    return *(v[np.repeat(whole, size)] for v in (x, y)), np.where(whole, size, 0)


def over_rasters(vectors: DataFrame, id_col: str, values: str, width: int, one: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Apply ``one(raster) -> rows`` to every row-major array; ``schema`` names its columns."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = one(np.asarray(v, float).reshape(-1, width)) if v else []
                ids += [i] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), kinds[f[1]]) for c, f in zip(cols, fields, strict=True))], names=["image_id", *(f[0] for f in fields)])

    return vectors.select(F.col(id_col).cast("long"), F.col(values)).mapInArrow(run, f"image_id long, {schema}")


def labelled(vectors: DataFrame, id_col: str, values: str, width: int, p: float) -> DataFrame:
    """``image_id, y, x, label`` of the pixels at or above an image's percentile."""

    def one(a: np.ndarray) -> list[tuple]:
        k = components(a >= np.percentile(a, p * 100))
        return [(int(y), int(x), int(k[y, x] // width * 1_000_000 + k[y, x] % width)) for y, x in np.argwhere(k >= 0)]

    return over_rasters(vectors, id_col, values, width, one, "y int, x int, label long")


def hysteresis_counts(vectors: DataFrame, id_col: str, values: str, width: int, p: float, ratio: float) -> DataFrame:
    def one(a: np.ndarray) -> list[tuple]:
        at = np.flatnonzero(hysteresis(a, np.ones(a.shape, bool), p * 100, ratio)[0])
        return [(len(at), int((at * at).sum()))] if len(at) else []

    return over_rasters(vectors, id_col, values, width, one, "kept long, sum_sq long")


def topology(skel: np.ndarray) -> tuple[int, int, int]:
    """Pixels with one neighbour, with three or more, and all."""
    near = sum(moved(skel.astype(int), dy, dx) for dy, dx in EIGHT)
    return int((skel & (near == 1)).sum()), int((skel & (near >= 3)).sum()), int(skel.sum())


def graph_length(skel: np.ndarray) -> float:
    """One more than the lengths of all links between neighbouring pixels; 0 without pixels."""
    if not skel.any():
        return 0.0
    straight = sum(int((skel & moved(skel, dy, dx, False)).sum()) for dy, dx in ((0, 1), (1, 0)))
    slant = sum(int((skel & moved(skel, 1, dx, False)).sum()) for dx in (-1, 1))
    return 1 + straight + slant * math.sqrt(2)


def plane(values: np.ndarray, where: np.ndarray, most: int = 5000) -> tuple[float, ...] | np.ndarray:
    """Least-squares ``x, y, 1`` coefficients over the set pixels, at most ``most`` evenly spaced ones."""
    ys, xs = np.nonzero(where)
    if len(xs) > most:
        some = np.linspace(0, len(xs) - 1, most).astype(int)
        ys, xs = ys[some], xs[some]
    if not len(xs):
        return np.zeros((3, *values.shape[2:]))
    return np.linalg.lstsq(np.column_stack([xs, ys, np.ones(len(xs))]), values[ys, xs].astype(float), rcond=None)[0]


def tiled(image: np.ndarray, patch: np.ndarray, mask: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """``image`` with ``patch`` repeated inside ``mask`` from its corner; pixels of ``keep`` stay as they were."""
    out, box = image.copy(), bounds(mask)
    if box is None:
        return out
    ys, xs = np.nonzero(mask if keep is None else mask & ~keep)
    out[ys, xs] = patch[(ys - box[0]) % patch.shape[0], (xs - box[1]) % patch.shape[1]]
    return out
