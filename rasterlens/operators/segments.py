"""Linking of skeleton pieces inside one raster: ends, tangents, proposals, selection, drawing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from rasterlens.operators import kernels as k

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Linking:
    """Settings of the linker; checked when they are made."""

    enabled: bool = True
    gap: float = 20.0
    radius: int = 7
    direction: float = 20.0
    connection: float = 25.0
    lateral: float = 4.0
    response: float = 0.25
    mutual: bool = True
    thickness: int = 1

    def __post_init__(self):
        if self.gap <= 0 or self.radius < 1 or self.thickness < 1:
            raise ValueError("gap, radius and thickness are positive")
        if not 0 <= self.direction <= 90 or not 0 <= self.connection <= 90 or self.lateral < 0 or not 0 <= self.response <= 1:
            raise ValueError("angles lie in 0..90, the lateral offset is not negative, the response share lies in 0..1")


def ends(skel: np.ndarray, radius: int = 7) -> list[tuple[int, int, int, int, float, float]]:
    """``id, component, x, y, tx, ty`` of the end pixels, row by row.

    The tangent is the main axis of the component's pixels within ``radius``, pointing away
    from their mean; an end with fewer than two such pixels is left out.
    """
    label = k.components(skel)
    near = sum(k.moved(skel.astype(int), dy, dx) for dy, dx in k.EIGHT)
    out = []
    for y, x in np.argwhere(skel & (near == 1)).tolist():
        y0, x0 = max(0, y - radius), max(0, x - radius)
        ys, xs = np.nonzero(label[y0 : y + radius + 1, x0 : x + radius + 1] == label[y, x])
        close = (ys + y0 - y) ** 2 + (xs + x0 - x) ** 2 <= radius * radius
        pts = np.column_stack([xs[close] + x0, ys[close] + y0]).astype(float)
        if len(pts) < 2:
            continue
        away = np.array([x, y]) - pts.mean(0)
        axis = np.linalg.eigh(np.cov(pts.T, bias=True))[1][:, 1]
        axis = -axis if axis @ away < 0 else axis
        out.append((len(out), int(label[y, x]), x, y, float(axis[0]), float(axis[1])))
    return out


def between(ax: int, ay: int, bx: int, by: int) -> np.ndarray:
    """Distinct sample points of a gap, sorted by (x, y), without the first and the last of more than two."""
    n = max(math.ceil(math.hypot(bx - ax, by - ay)) + 1, 2)
    pts = np.unique(np.rint(np.column_stack([np.linspace(ax, bx, n), np.linspace(ay, by, n)])).astype(int), axis=0)
    return pts[1:-1] if len(pts) > 2 else pts


def proposals(found: list[tuple], response: np.ndarray, mask: np.ndarray, threshold: float, how: Linking) -> list[tuple]:
    """``score, a, b, gap, turn, connection, lateral, share`` of the links that no rule rejects."""
    if len(found) < 2:
        return []
    e = np.array([f[2:] for f in found], float)
    part = np.array([f[1] for f in found])
    cell = np.floor(e[:, :2] / how.gap).astype(int)
    at: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(map(tuple, cell.tolist())):
        at.setdefault(c, []).append(i)
    angle = lambda dot: math.degrees(math.acos(min(1.0, abs(dot))))
    out = []
    for a in range(len(e)):
        cx, cy = cell[a]
        for b in sorted(j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in at.get((cx + dx, cy + dy), ()) if j > a):
            step = e[b, :2] - e[a, :2]
            gap = float(np.hypot(*step))
            if part[a] == part[b] or gap <= EPS or gap > how.gap:
                continue
            unit, ta, tb = step / gap, e[a, 2:], e[b, 2:]
            turn = angle(ta @ tb)
            connection = max(angle(ta @ unit), angle(tb @ unit))
            lateral = max(abs(float(ta[0] * step[1] - ta[1] * step[0])), abs(float(tb[0] * step[1] - tb[1] * step[0])))
            if turn > how.direction or connection > how.connection or lateral > how.lateral:
                continue
            pts = between(*e[a, :2].astype(int), *e[b, :2].astype(int))
            if not mask[pts[:, 1], pts[:, 0]].all():
                continue
            share = float((response[pts[:, 1], pts[:, 0]] >= threshold).mean())
            if share < how.response:
                continue
            score = gap / how.gap + turn / max(how.direction, EPS) + connection / max(how.connection, EPS) + lateral / max(how.lateral, EPS) + 1 - share
            out.append((score, a, b, gap, turn, connection, lateral, share))
    return out


def selected(links: list[tuple], component: list[int], mutual: bool = True) -> list[tuple]:
    """Links by ascending score: an end is used once and components are joined once.

    With ``mutual`` only links that are the best of both their ends stand for choice.
    """
    ranked = sorted(links, key=lambda x: x[0])
    if mutual:
        best: dict[int, int] = {}
        for i, x in enumerate(ranked):
            best.setdefault(x[1], i)
            best.setdefault(x[2], i)
        ranked = [x for i, x in enumerate(ranked) if best[x[1]] == best[x[2]] == i]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    used, out = set(), []
    for x in ranked:
        a, b = find(component[x[1]]), find(component[x[2]])
        if a != b and not used & {x[1], x[2]}:
            root[a] = b
            used |= {x[1], x[2]}
            out.append(x)
    return out


def line(shape: tuple[int, int], ax: int, ay: int, bx: int, by: int, thickness: int = 1) -> np.ndarray:
    """An 8-connected line as a mask."""
    out = np.zeros(shape, bool)
    n = max(abs(bx - ax), abs(by - ay)) + 1
    out[np.rint(np.linspace(ay, by, n)).astype(int), np.rint(np.linspace(ax, bx, n)).astype(int)] = True
    return k.dilate(out, k.kernel_offsets("ellipse", thickness | 1)) if thickness > 1 else out


def linked(skel: np.ndarray, response: np.ndarray, mask: np.ndarray, threshold: float, how: Linking | None = None) -> tuple[np.ndarray, list[tuple], list[tuple]]:
    """The skeleton with its links drawn inside ``mask``, the links, and the ends they join."""
    how = how or Linking()
    if not how.enabled or not skel.any():
        return skel.copy(), [], []
    found = ends(skel, how.radius)
    links = selected(proposals(found, response, mask, threshold, how), [f[1] for f in found], how.mutual)
    drawn = np.zeros(skel.shape, bool)
    for x in links:
        drawn |= line(skel.shape, *found[x[1]][2:4], *found[x[2]][2:4], how.thickness)
    return skel | drawn & mask, links, found


def filtered(label: np.ndarray, skel: np.ndarray, paths: dict[int, list[tuple[int, int]]], kept: dict[int, str], enabled: bool = True) -> np.ndarray:
    """Skeleton after the verdicts ``kept`` (label to length group): whole where long, the longest path where short."""
    out = skel & np.isin(label, [c for c, g in kept.items() if g == "long" or not enabled])
    if enabled:
        for c, group in kept.items():
            if group == "short" and paths.get(c):
                ys, xs = np.array(paths[c]).T
                out[ys, xs] = True
    return out
