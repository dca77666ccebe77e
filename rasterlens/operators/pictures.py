"""Array operators over whole pictures (RGB or one channel): moves, turns, blends, previews."""

from __future__ import annotations

import math

import numpy as np

from rasterlens.operators import kernels as k

#: Fixed value: what gray stands for no difference in 8-bit previews and subtractions.
MIDDLE = 128


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255).astype(np.uint8)


def rgb(bgr: np.ndarray) -> np.ndarray:
    """RGB of BGR, BGRA or one channel."""
    return np.repeat(bgr, 3, 2) if bgr.shape[2] == 1 else bgr[..., 2::-1]


def inset(mask: np.ndarray, pixels: float) -> np.ndarray:
    """Pixels further than ``pixels`` from the edge of the mask, where the picture's border counts as edge."""
    return k.chamfer(np.pad(mask, 1))[1:-1, 1:-1] > pixels


def fill_floats(polygons: list[list[tuple[float, float]]], height: int, width: int) -> np.ndarray:
    """Filled polygons with vertices as they are: no rounding, no clipping; the pixel centre decides, outlines included."""
    out = np.zeros((height, width), bool)
    for poly in polygons:
        pts = np.asarray(poly, float).reshape(-1, 2)
        for y in range(height):
            a, b = pts, np.roll(pts, -1, 0)
            cross = (a[:, 1] <= y) != (b[:, 1] <= y)
            xs = np.sort(a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
            for lo, hi in zip(xs[::2], xs[1::2], strict=False):
                out[y, max(0, math.ceil(lo - 0.5)) : max(0, math.floor(hi + 0.5) + 1)] = True
    return out


def outside_black(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask[..., None] if image.ndim == 3 else mask, image, 0).astype(image.dtype)


def subtracted(gray: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Gray less its Gaussian background around ``MIDDLE``, inside the mask."""
    return np.where(mask, _bytes(np.rint(gray - k.blur(gray.astype(float), size) + MIDDLE)), 0).astype(np.uint8)


def scaled_response(gray: np.ndarray, mask: np.ndarray, angles: int, size: int, sigma: float, wavelength: float, gamma: float) -> np.ndarray:
    """Greatest absolute Gabor response without normalisation of the kernel, spread over 0..255 within the mask."""
    y, x = np.mgrid[-(size // 2) : size // 2 + 1, -(size // 2) : size // 2 + 1].astype(float)
    best = np.zeros(gray.shape)
    for i in range(angles):
        t = math.pi * i / angles
        u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
        tap = np.exp(-(u * u + gamma * gamma * v * v) / (2 * sigma * sigma)) * np.cos(2 * math.pi * u / wavelength)
        best = np.maximum(best, np.abs(k.convolve(gray.astype(float), tap - tap.mean())))
    if not mask.any():
        return np.zeros(gray.shape, np.uint8)
    lo, hi = best[mask].min(), best[mask].max()
    return np.where(mask, _bytes(np.rint((best - lo) * 255 / (hi - lo)) if hi > lo else best * 0), 0).astype(np.uint8)


def texture(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lightness blurred by 3 pixels, gradient magnitude of it, and eight times what the blur takes away."""
    light = lightness(image)
    low = k.blur(light, 19, 3.0)
    p = np.pad(light, 1, "reflect" if min(light.shape) > 1 else "edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return tuple(_bytes(np.rint(x)) for x in (low, np.hypot(gx, gy), np.abs(light - low) * 8))


def lightness(image: np.ndarray) -> np.ndarray:
    """L of CIE Lab (sRGB, D65) in 0..255."""
    c = image[..., :3].astype(float) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    y = c @ np.array([0.212671, 0.715160, 0.072169])
    return np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y) * 2.55


def _sampled(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, order: int) -> np.ndarray:
    """Values at real places, 0 outside: nearest (0) or bicubic (3, a = -0.5)."""
    h, w = image.shape[:2]
    wide = (slice(None), slice(None), *(None,) * (image.ndim - 2))
    inside = (ys >= -0.5) & (ys < h - 0.5) & (xs >= -0.5) & (xs < w - 0.5)
    if order == 0:
        got = image[np.clip(np.rint(ys).astype(int), 0, h - 1), np.clip(np.rint(xs).astype(int), 0, w - 1)]
        return np.where(inside[wide], got, 0).astype(image.dtype)

    def tap(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))

    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    total = 0.0
    for dy in (-1, 0, 1, 2):
        for dx in (-1, 0, 1, 2):
            weight = tap(ys - y0 - dy) * tap(xs - x0 - dx)
            total = total + weight[wide] * image[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)].astype(float)
    return np.where(inside[wide], _bytes(np.rint(total)), 0).astype(image.dtype)


def rotated(image: np.ndarray, angle: float, order: int = 3) -> np.ndarray:
    """The picture turned counter-clockwise on a black canvas of the same size; whole turns are copies."""
    if angle % 360 == 0:
        return image.copy()
    h, w = image.shape[:2]
    if angle % 360 == 180:
        return image[::-1, ::-1].copy()
    t = math.radians(angle)
    y, x = np.mgrid[:h, :w] + 0.5
    dx, dy = x - w / 2, y - h / 2
    return _sampled(image, math.sin(t) * dx + math.cos(t) * dy + h / 2 - 0.5, math.cos(t) * dx - math.sin(t) * dy + w / 2 - 0.5, order)


def flipped(image: np.ndarray, flip: str | None) -> np.ndarray:
    return image[::-1].copy() if flip == "vflip" else image[:, ::-1].copy() if flip == "hflip" else image


def turned_patch(image: np.ndarray, mask: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """A patch and its mask turned on a canvas that holds all of it, nearest pixel, cut to the mask."""
    h, w = mask.shape
    t = math.radians(angle)
    nh, nw = math.ceil(abs(h * math.cos(t)) + abs(w * math.sin(t)) - 1e-9), math.ceil(abs(w * math.cos(t)) + abs(h * math.sin(t)) - 1e-9)
    y, x = np.mgrid[:nh, :nw] + 0.5
    dx, dy = x - nw / 2, y - nh / 2
    sy, sx = math.sin(t) * dx + math.cos(t) * dy + h / 2 - 0.5, math.cos(t) * dx - math.sin(t) * dy + w / 2 - 0.5
    turned = _sampled(mask.astype(np.uint8), sy, sx, 0) > 0
    mirror = lambda v, n: np.abs((np.rint(v).astype(int) + n - 1) % max(1, 2 * (n - 1)) - (n - 1)) if n > 1 else np.zeros(v.shape, int)
    colours = image[mirror(sy, h), mirror(sx, w)]
    box = k.bounds(turned)
    return (colours[:0, :0], turned[:0, :0]) if box is None else (colours[box[0] : box[2], box[1] : box[3]], turned[box[0] : box[2], box[1] : box[3]])


def rectangle_centre(polygons: list[list[tuple[float, float]]]) -> tuple[float, float]:
    """Centre of the least rotated rectangle around the points of all polygons."""
    pts = np.unique(np.array([p for poly in polygons for p in poly], float).reshape(-1, 2), axis=0)
    if not len(pts):
        raise ValueError("no points")
    if len(pts) < 3:
        return tuple(pts.mean(0))
    best = None
    for i in range(len(pts)):
        d = pts - pts[i]
        for e in d[np.hypot(*d.T) > 0]:
            u = e / np.hypot(*e)
            v = np.array([-u[1], u[0]])
            side = d @ v
            if side.min() < -1e-9:  # not an edge of the hull
                continue
            x, y = pts @ u, pts @ v
            area = np.ptp(x) * np.ptp(y)
            if best is None or area < best[0] - 1e-9:
                best = (area, (x.min() + x.max()) / 2 * u + (y.min() + y.max()) / 2 * v)
    return float(best[1][0]), float(best[1][1])


def centred(image: np.ndarray, mask: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The masked object moved on black; losing a pixel of it, or a frame left empty, is an error."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    if abs(dx) >= w or abs(dy) >= h:
        raise ValueError("nothing of the picture is left")
    if len(ys) and (ys.min() + dy < 0 or xs.min() + dx < 0 or ys.max() + dy >= h or xs.max() + dx >= w):
        raise ValueError("the object would be cut")
    out = np.zeros_like(image)
    out[ys + dy, xs + dx] = image[ys, xs]
    return out


def cropped(images: list[np.ndarray], mask: np.ndarray, padding: int = 0) -> list[np.ndarray]:
    """Pictures cut to the box of a mask with padding; an empty mask is an error."""
    box = k.bounds(mask)
    if box is None:
        raise ValueError("an empty mask has no box")
    y0, x0 = max(0, box[0] - padding), max(0, box[1] - padding)
    return [a[y0 : box[2] + padding, x0 : box[3] + padding] for a in images]


def upright(image: np.ndarray, orientation: int = 1) -> np.ndarray:
    """A picture as its EXIF orientation (1..8) asks."""
    image = image[:, ::-1] if orientation in (2, 4, 5, 7) else image
    turns = {1: 0, 2: 0, 3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}[orientation]
    return np.rot90(image, turns)


def assembled(left: np.ndarray, right: np.ndarray, orientations: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Two upright pictures side by side, black below the lower one."""
    parts = [upright(a, o) for a, o in zip((left, right), orientations, strict=True)]
    out = np.zeros((max(p.shape[0] for p in parts), sum(p.shape[1] for p in parts), *left.shape[2:]), left.dtype)
    at = 0
    for p in parts:
        out[: p.shape[0], at : at + p.shape[1]] = p
        at += p.shape[1]
    return out


def pasted(shape: tuple[int, int], mask: np.ndarray, x: int, y: int) -> tuple[np.ndarray, tuple[slice, slice], tuple[slice, slice]] | None:
    """A mask set on an empty canvas, with the places in canvas and patch; None where nothing falls on it."""
    y0, x0, y1, x1 = max(0, y), max(0, x), min(shape[0], y + mask.shape[0]), min(shape[1], x + mask.shape[1])
    if y0 >= y1 or x0 >= x1:
        return None
    there, here = (slice(y0, y1), slice(x0, x1)), (slice(y0 - y, y1 - y), slice(x0 - x, x1 - x))
    out = np.zeros(shape, bool)
    out[there] = mask[here]
    return out, there, here


def whitening(mask: np.ndarray, base: float, gradient: float) -> np.ndarray:
    """Share of white: ``base`` at the edge of an object, ``base + gradient`` on its skeleton."""
    alpha, box = np.zeros(mask.shape), k.bounds(mask)
    if box is None:
        return alpha
    part = mask[box[0] : box[2], box[1] : box[3]]
    away = k.chamfer(~k.morphological_skeleton(part))
    most = away[part].max()
    weight = np.clip(1 - away / most, 0, 1) if most > 0 else np.ones(part.shape)
    alpha[box[0] : box[2], box[1] : box[3]][part] = np.clip(base + gradient * weight, 0, 1)[part]
    return alpha


def whitened(image: np.ndarray, objects: list[tuple[str, np.ndarray]], base: dict[str, float], gradient: dict[str, float]) -> np.ndarray:
    """Objects (category, mask) blended towards white, the greatest share where they overlap; other categories stay."""
    alpha = np.zeros(image.shape[:2])
    for category, mask in objects:
        if category in base:
            alpha = np.maximum(alpha, whitening(mask, base[category], gradient[category]))
    a = alpha[..., None] if image.ndim == 3 else alpha
    return _bytes(np.rint(image * (1 - a) + 255.0 * a))


def checked_strengths(given: dict[str, float], required: tuple[str, ...], allowed: tuple[str, ...] | None = None) -> None:
    """Strengths for exactly the required categories (or within the allowed), each in 0..1."""
    missing, extra = sorted(set(required) - set(given)), sorted(set(given) - set(allowed or required))
    if missing or extra:
        raise ValueError(f"missing: {missing}, unknown: {extra}")
    if any(not 0 <= v <= 1 for v in given.values()):
        raise ValueError("strengths lie in 0..1")


def regions(parts: dict[str, np.ndarray]) -> list[dict]:
    """Outer outlines of the union of masks, holes filled: box, mask, categories, thickness; by (y, x)."""
    union = np.logical_or.reduce(list(parts.values()))
    out = []
    label = k.components(union)
    for c in np.unique(label[label >= 0]).tolist():
        box = k.bounds(label == c)
        mask = (label == c)[box[0] : box[2], box[1] : box[3]]
        sea = k.components(~np.pad(mask, 1), 4)
        mask = (sea != sea[0, 0])[1:-1, 1:-1]
        here = {name for name, p in parts.items() if (p[box[0] : box[2], box[1] : box[3]] & mask).any()}
        out.append({"y": box[0], "x": box[1], "mask": mask, "categories": here, "thickness": thickness(mask)})
    return sorted(out, key=lambda r: (r["y"], r["x"]))


def thickness(mask: np.ndarray) -> float:
    """Twice the greatest chamfer distance to the outside."""
    return 2 * float(k.chamfer(np.pad(mask, 1)).max()) if mask.any() else 0.0


def skeleton_width(mask: np.ndarray, skel: np.ndarray) -> float:
    """Twice the greatest chamfer distance along the skeleton."""
    return 2 * float(k.chamfer(np.pad(mask, 1))[1:-1, 1:-1][skel].max()) if skel.any() else 0.0


def stretched(a: np.ndarray, mask: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """Values between two percentiles spread over 0..255 (cut off, not rounded); a flat one is black."""
    if not mask.any():
        return np.zeros(a.shape, np.uint8)
    lo, hi = np.percentile(a[mask], [low, high])
    return np.where(mask, _bytes((a - lo) * 255 / (hi - lo)), 0).astype(np.uint8) if hi > lo else np.zeros(a.shape, np.uint8)


def shown(a: np.ndarray, signed: bool = False) -> np.ndarray:
    """A preview of gray or background values, or of signed ones around ``MIDDLE``."""
    return _bytes(a + MIDDLE if signed else a)


def outline(mask: np.ndarray) -> np.ndarray:
    """Set pixels with an unset neighbour above, below or beside."""
    return mask & ~k.erode(mask, k.kernel_offsets("cross", 3), outside=False)


def overlaid(image: np.ndarray, layers: list[tuple[np.ndarray, tuple[int, int, int]]], thick: int = 1) -> np.ndarray:
    """A picture with masks painted over it in order, each grown to ``thick`` pixels."""
    out = image.copy()
    for mask, colour in layers:
        out[k.dilate(mask, k.kernel_offsets("rectangle", thick | 1)) if thick > 1 else mask] = colour
    return out


def contours(image: np.ndarray, masks: list[tuple[np.ndarray, tuple[int, int, int]]]) -> np.ndarray:
    return overlaid(image, [(outline(m), c) for m, c in masks])


def red_annotation(image: np.ndarray, mask: np.ndarray, grow: int = 5, wide: int = 2) -> np.ndarray:
    """A red outline around a mask that is grown before."""
    return overlaid(image, [(outline(k.dilate(mask, k.kernel_offsets("ellipse", 2 * grow + 1))), (255, 0, 0))], wide)
