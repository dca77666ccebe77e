"""Repair of defects in a picture: donors from clean texture, skeleton patches, inpainting."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from rasterlens.operators import kernels as k
from rasterlens.operators import pictures as p

# Weights of the scores.
PLAIN = {"low": 1.0, "gradient": 0.35}
SCRATCH_RING = {"low": 1.0, "gradient": 0.20, "texture": 0.50}
SCRATCH_MEAN = {"texture": 0.75, "gradient": 0.35, "low": 0.20}
SCRATCH_SPREAD = {"texture": 0.25, "gradient": 0.20, "low": 0.30}
PATCH_MEAN = {"low": 1.0, "gradient": 0.20, "texture": 0.55}
PATCH_SPREAD = {"low": 0.35, "gradient": 0.15, "texture": 0.30}
OVERLAP, MOST_SHIFT, MOST_PATCH_SHIFT, CANDIDATES = 0.35, 30.0, 25.0, 12


@dataclass(frozen=True)
class Repair:
    """Settings of the repair; checked when they are made."""

    band: int = 8
    margin: int = 300
    feather: float = 6.0
    scratch_feather: float = 3.0
    top: int = 3
    seed: int = 42
    inset: int = 50
    telea_side: int = 24
    telea_thickness: float = 16.0
    telea_radius: int = 3
    long_side: int = 96
    thin: float = 5.0

    def __post_init__(self):
        if min(self.band, self.margin, self.top, self.telea_radius) < 1 or min(self.feather, self.scratch_feather, self.inset) < 0:
            raise ValueError("sizes are positive, feathers and the inset not negative")


@dataclass
class Scene:
    """A picture, its feature maps, and where donors may not come from."""

    image: np.ndarray
    invalid: np.ndarray
    blocked: np.ndarray
    maps: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.maps = self.maps or {n: a.astype(float) for n, a in zip(("low", "gradient", "texture"), p.texture(self.image), strict=True)}


def _correlate(a: np.ndarray, tap: np.ndarray) -> np.ndarray:
    """Sums of ``a * tap`` for every place where ``tap`` lies wholly on ``a``."""
    h, w = a.shape[0] - tap.shape[0] + 1, a.shape[1] - tap.shape[1] + 1
    return np.fft.irfft2(np.fft.rfft2(a) * np.conj(np.fft.rfft2(tap, a.shape)), a.shape)[:h, :w]


def masked_mean_spread(a: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation under a mask, for every place of it."""
    m, n = mask.astype(float), max(int(mask.sum()), 1)
    mean = _correlate(a, m) / n
    return mean, np.sqrt(np.maximum(_correlate(a * a, m) / n - mean * mean, 0))


def masked_mse(a: np.ndarray, template: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean squared difference from a template under a mask, for every place of it."""
    m, n = mask.astype(float), max(int(mask.sum()), 1)
    return np.maximum((_correlate(a * a, m) - 2 * _correlate(a, template * m) + (template * template * m).sum()) / n, 0)


def _grown(y0: int, x0: int, y1: int, x1: int, by: int, shape: tuple[int, int]) -> tuple[slice, slice]:
    return slice(max(0, y0 - by), min(shape[0], y1 + by)), slice(max(0, x0 - by), min(shape[1], x1 + by))


def _frame(region: dict, scene: Scene, by: int) -> tuple[tuple[slice, slice], np.ndarray]:
    """A window around a region and the region's mask in it."""
    h, w = region["mask"].shape
    win = _grown(region["y"], region["x"], region["y"] + h, region["x"] + w, by, scene.invalid.shape)
    mask = np.zeros(scene.invalid[win].shape, bool)
    mask[region["y"] - win[0].start :, region["x"] - win[1].start :][:h, :w] = region["mask"]
    return win, mask


def find_donor(scene: Scene, region: dict, how: Repair) -> tuple[np.ndarray, np.ndarray, tuple[slice, slice], np.ndarray]:
    """Donor colours for a region, its ring of clean pixels, its window and its mask there.

    The window's rectangle must be free of blocked pixels at the donor's place; of such
    places within growing margins the one that scores least is taken.
    """
    win, mask = _frame(region, scene, how.band)
    ring = k.dilate(mask, k.kernel_offsets("ellipse", 2 * how.band + 1)) & ~mask & ~scene.invalid[win]
    if ring.sum() < 20:
        raise ValueError("too few clean pixels around the region")
    h, w = mask.shape
    scratch = "scratch" in region["categories"]
    for margin in dict.fromkeys((how.margin, 2 * how.margin, max(scene.invalid.shape))):
        area = _grown(win[0].start, win[1].start, win[0].stop, win[1].stop, margin, scene.invalid.shape)
        free = _correlate(scene.blocked[area].astype(float), np.ones((h, w))) < 0.5
        if not free.any():
            continue
        score = sum(weight * masked_mse(scene.maps[n][area], scene.maps[n][win], ring) for n, weight in (SCRATCH_RING if scratch else PLAIN).items())
        if scratch:
            for n in scene.maps:
                mean, spread = masked_mean_spread(scene.maps[n][area], mask)
                around = scene.maps[n][win][ring]
                score = score + SCRATCH_MEAN[n] * (mean - around.mean()) ** 2 + SCRATCH_SPREAD[n] * (spread - around.std()) ** 2
        y, x = np.unravel_index(int(np.argmin(np.where(free, score, np.inf))), score.shape)
        y, x = y + area[0].start, x + area[1].start
        return scene.image[y : y + h, x : x + w].copy(), ring, win, mask
    raise ValueError("no clean donor in the picture")


def _softened(a: np.ndarray) -> np.ndarray:
    return np.stack([k.blur(a[..., c].astype(float), 19, 3.0) for c in range(a.shape[2])], -1)


def blend(out: np.ndarray, scene: Scene, donor: np.ndarray, ring: np.ndarray, win: tuple[slice, slice], mask: np.ndarray, feather: float) -> None:
    """Set a donor into ``out``: its colours moved by a plane fitted on the ring, feathered at the edge."""
    c = k.plane(_softened(scene.image[win]) - _softened(donor), ring)
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]][..., None]
    moved = np.clip(donor + np.clip(x * c[0] + y * c[1] + c[2], -MOST_SHIFT, MOST_SHIFT), 0, 255)
    away = k.chamfer(np.pad(mask, 1))[1:-1, 1:-1]
    alpha = np.clip(away / min(feather, max(1.0, away.max() / 2)), 0, 1) if feather > 0 else mask.astype(float)
    out[win] = np.clip(out[win] * (1 - alpha[..., None]) + moved * alpha[..., None], 0, 255).astype(np.uint8)


def inpaint(out: np.ndarray, region: dict, radius: int) -> None:
    """Fast-marching inpainting (Telea 2004) of a region, in a window around it."""
    h, w = region["mask"].shape
    win = _grown(region["y"], region["x"], region["y"] + h, region["x"] + w, 2 * radius + 2, out.shape[:2])
    hole = np.zeros(out[win].shape[:2], bool)
    hole[region["y"] - win[0].start :, region["x"] - win[1].start :][:h, :w] = region["mask"]
    colours, time = out[win].astype(float), np.where(hole, np.inf, 0.0)
    known = ~hole
    queue = [(0.0, int(y), int(x)) for y, x in np.argwhere(known & k.dilate(hole, k.kernel_offsets("cross", 3)))]
    heapq.heapify(queue)
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    inside = lambda y, x: 0 <= y < hole.shape[0] and 0 <= x < hole.shape[1]

    def arrival(y: int, x: int) -> float:
        t = lambda a, b: time[a, b] if inside(a, b) and known[a, b] else np.inf
        v, u = min(t(y - 1, x), t(y + 1, x)), min(t(y, x - 1), t(y, x + 1))
        if max(u, v) < np.inf and abs(u - v) < 1:
            return (u + v + np.sqrt(2 - (u - v) ** 2)) / 2
        return min(u, v) + 1

    while queue:
        _, y, x = heapq.heappop(queue)
        for dy, dx in k.FOUR:
            a, b = y + dy, x + dx
            if not inside(a, b) or known[a, b]:
                continue
            time[a, b] = arrival(a, b)
            slope = np.array([time[a, b] - min(time[a - 1, b] if inside(a - 1, b) else np.inf, time[a + 1, b] if inside(a + 1, b) else np.inf), time[a, b] - min(time[a, b - 1] if inside(a, b - 1) else np.inf, time[a, b + 1] if inside(a, b + 1) else np.inf)])
            slope = np.where(np.isfinite(slope), slope, 0)
            total, weight = np.zeros(colours.shape[2]), 0.0
            for ey, ex in disc:
                q = (a + ey, b + ex)
                if inside(*q) and known[q]:
                    far = ey * ey + ex * ex
                    s = (abs(ey * slope[0] + ex * slope[1]) / far**0.5 + 1e-6) / far / (1 + abs(time[q] - time[a, b]))
                    total += s * colours[q]
                    weight += s
            colours[a, b] = total / weight if weight else colours[y, x]
            known[a, b] = True
            heapq.heappush(queue, (time[a, b], a, b))
    out[win][hole] = np.clip(np.rint(colours[hole]), 0, 255).astype(np.uint8)


def cover(mask: np.ndarray, skel: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Centres ``y, x``: skeleton pixels a disc apart, then mask pixels that no tile covers."""
    r = size // 2
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
    centres, left = [], skel.copy()
    while left.any():
        at = divmod(int(np.argmax(left)), mask.shape[1])
        centres.append(at)
        left &= (y - at[0]) ** 2 + (x - at[1]) ** 2 > max(2, r) ** 2
    bare = mask.copy()
    for cy, cx in centres:
        bare[max(0, cy - r) : cy + r + 1, max(0, cx - r) : cx + r + 1] = False
    while bare.any():
        cy, cx = divmod(int(np.argmax(bare)), mask.shape[1])
        centres.append((cy, cx))
        bare[max(0, cy - r) : cy + r + 1, max(0, cx - r) : cx + r + 1] = False
    return centres


def frame_at(points: np.ndarray, y: int, x: int, radius: float, least: int = 3, nearest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tangent and normal (x, y) of the skeleton near a place, and its nearest point (y, x)."""
    far = ((points - (y, x)) ** 2).sum(1)
    close = points[far <= radius * radius]
    if len(close) < least:
        close = points[np.argsort(far, kind="stable")[:nearest]]
    t = np.linalg.eigh(np.cov(close[:, ::-1].T.astype(float)))[1][:, -1] if len(close) > 1 else np.array([1.0, 0.0])
    return t, np.array([-t[1], t[0]]), points[int(np.argmin(far))]


def gather(scene: Scene, cy: float, cx: float, h: int, w: int, margin: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``y, x`` of h * w distinct valid pixels near a place, each tile pixel taking the nearest one left.

    The window widens until it holds enough valid pixels; None beyond the margin.
    """
    top, left = round(cy - (h - 1) / 2), round(cx - (w - 1) / 2)
    step = max(2, min(h, w) // 2)
    for by in range(0, margin + step, step):
        win = _grown(top, left, top + h, left + w, by, scene.blocked.shape)
        if win[0].start >= win[0].stop or win[1].start >= win[1].stop:
            continue
        pool = np.argwhere(~scene.blocked[win])
        if len(pool) >= h * w:
            break
    else:
        return None
    pool = pool + (win[0].start, win[1].start)
    far = ((pool - (cy, cx)) ** 2).sum(1)
    pool = pool[np.sort(np.argsort(far, kind="stable")[: max(8 * h * w, 512)])]
    want = np.argwhere(np.ones((h, w), bool)) + (top, left)
    d = ((want[:, None] - pool[None]) ** 2).sum(2).astype(float)
    pick = np.empty(h * w, int)
    for i in np.argsort(d.min(1), kind="stable"):
        pick[i] = int(np.argmin(d[i]))
        d[:, pick[i]] = np.inf
    return pool[pick, 0].reshape(h, w), pool[pick, 1].reshape(h, w)


def donors_near(scene: Scene, nearest: np.ndarray, tangent: np.ndarray, normal: np.ndarray, half: float, h: int, w: int, size: int, margin: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most ``CANDIDATES`` donor tiles: beside the scratch at growing offsets, then on a grid by distance."""
    places = []
    base = half + max(h, w) / 2 + 2
    for ring in range(3):
        off = base + ring * size
        for along in (0, -size, size):
            for side in (1, -1):
                places.append(nearest[::-1] + side * off * normal + along * tangent)
    grid = np.array([(dx, dy) for dy in range(-margin, margin + 1, 2 * size) for dx in range(-margin, margin + 1, 2 * size)], float)
    places += [nearest[::-1] + g for g in grid[np.argsort((grid**2).sum(1), kind="stable")]]
    out, seen = [], set()
    for x, y in places:
        if len(out) == CANDIDATES:
            break
        key = (round(y), round(x))
        if key in seen or not (0 <= key[0] < scene.blocked.shape[0] and 0 <= key[1] < scene.blocked.shape[1]):
            continue
        seen.add(key)
        got = gather(scene, y, x, h, w, size)
        if got is not None:
            out.append(got)
    return out


def statistics(scene: Scene, where: tuple, valid: np.ndarray | None = None) -> dict[str, tuple[float, float]] | None:
    """Mean and spread of each feature map over valid pixels; None with fewer than five."""
    if valid is not None and valid.sum() < 5:
        return None
    take = lambda a: a[where] if valid is None else a[where][valid]
    return {n: (float(take(a).mean()), float(take(a).std())) for n, a in scene.maps.items()}


def soft_choice(scores: np.ndarray, top: int, rng: np.random.Generator) -> int:
    """One of the ``top`` least scores, likelier the lower it is."""
    best = np.argsort(scores, kind="stable")[:top]
    s = scores[best]
    weight = np.exp(-(s - s.min()) / max(float(s.std()), 1.0))
    return int(best[rng.choice(len(best), p=weight / weight.sum())])


def skeleton_patches(out: np.ndarray, scene: Scene, region: dict, how: Repair) -> bool:
    """Cover a scratch with clean tiles along its skeleton; false where a pixel stays bare."""
    mask = region["mask"]
    skel = k.morphological_skeleton(mask)
    if not skel.any():
        return False
    size = int(np.clip(round(0.75 * region["thickness"]), 9, 15))
    size += size % 2 == 0 and size < 15
    points, edge = np.argwhere(skel), k.chamfer(np.pad(mask, 1))[1:-1, 1:-1]
    total, weight = np.zeros((*mask.shape, out.shape[2])), np.zeros(mask.shape)
    rng = np.random.default_rng([how.seed, region["x"], region["y"], mask.shape[1]])
    r = size // 2
    for cy, cx in cover(mask, skel, size):
        here = (slice(max(0, cy - r), min(mask.shape[0], cy + r + 1)), slice(max(0, cx - r), min(mask.shape[1], cx + r + 1)))
        part = mask[here]
        h, w = part.shape
        y0, x0 = region["y"] + here[0].start, region["x"] + here[1].start
        around = _grown(y0, x0, y0 + h, x0 + w, 2 * size, scene.invalid.shape)
        clean = ~scene.invalid[around]
        target = statistics(scene, around, clean)
        if target is None:
            continue
        mean = scene.image[around][clean].mean(0)
        tangent, normal, nearest = frame_at(points, cy, cx, 2 * size)
        tiles, scores = [], []
        for at in donors_near(scene, nearest + (region["y"], region["x"]), tangent, normal, float(edge[tuple(nearest)]), h, w, size, how.margin):
            own = statistics(scene, at)
            score = sum(PATCH_MEAN[n] * (own[n][0] - target[n][0]) ** 2 + PATCH_SPREAD[n] * (own[n][1] - target[n][1]) ** 2 for n in own)
            tile = scene.image[at].astype(float)
            tile = np.clip(tile + np.clip(mean - tile.mean((0, 1)), -MOST_PATCH_SHIFT, MOST_PATCH_SHIFT), 0, 255)
            both = part & (weight[here] > 0)
            if both.any():
                score += OVERLAP * float(((tile[both] - total[here][both] / weight[here][both][:, None]) ** 2).mean())
            tiles.append(tile)
            scores.append(score)
        if not tiles:
            continue
        y, x = np.mgrid[:h, :w]
        bell = np.exp(-2 * (((x - (w - 1) / 2) / max(w / 2, 1)) ** 2 + ((y - (h - 1) / 2) / max(h / 2, 1)) ** 2)) * part
        total[here] += tiles[soft_choice(np.array(scores), how.top, rng)] * bell[..., None]
        weight[here] += bell
    if (mask & (weight <= 0)).any():
        return False
    alpha = np.clip(edge / how.scratch_feather, 0, 1) if how.scratch_feather > 0 else mask.astype(float)
    place = (slice(region["y"], region["y"] + mask.shape[0]), slice(region["x"], region["x"] + mask.shape[1]))
    made = total / np.maximum(weight, 1e-6)[..., None]
    out[place] = np.clip(out[place] * (1 - alpha[..., None]) + made * alpha[..., None], 0, 255).astype(np.uint8)
    return True


def repaired_region(out: np.ndarray, scene: Scene, region: dict, how: Repair) -> str:
    """Repair one region and name the way taken; a region that no way repairs is an error."""
    mask, thick, pure = region["mask"], region["thickness"], region["categories"] == {"scratch"}
    small = "scratch" not in region["categories"] and max(mask.shape) <= how.telea_side and thick <= how.telea_thickness
    win, here = _frame(region, scene, how.telea_radius + 2)
    close = k.dilate(here, k.kernel_offsets("ellipse", 2 * (how.telea_radius + 2) + 1))
    safe = not (scene.invalid[win] & close & ~here).any()
    if small and safe:
        inpaint(out, region, how.telea_radius)
        return "telea"
    if pure and max(mask.shape) >= how.long_side and thick > how.thin and skeleton_patches(out, scene, region, how):
        return "skeleton_patches"
    try:
        blend(out, scene, *find_donor(scene, region, how), how.scratch_feather if pure else how.feather)
        return "thin_scratch_donor" if pure and thick <= how.thin else "donor"
    except ValueError:
        if pure and skeleton_patches(out, scene, region, how):
            return "skeleton_patches_fallback"
        if safe:
            inpaint(out, region, how.telea_radius)
            return "telea_fallback"
        raise


def expansion(category: str, thick: float) -> int:
    """Pixels by which a defect grows before it is repaired."""
    share, lo, hi = {"scratch": (0.35, 5, 10), "pit": (0.18, 2, 7)}.get(category, (0.10, 3, 10))
    return int(np.clip(round(share * thick), lo, hi))


def repaired(image: np.ndarray, silver: np.ndarray, avoided: np.ndarray, defects: list[tuple[str, np.ndarray]], how: Repair | None = None) -> tuple[np.ndarray, list[tuple[int, int, int, int, str]]]:
    """A picture without its defects (category, mask), and ``x, y, width, height, way`` of every region."""
    how = how or Repair()
    parts: dict[str, np.ndarray] = {}
    for category, mask in defects:
        grown = k.dilate(mask, k.kernel_offsets("ellipse", 2 * expansion(category, p.thickness(mask)) + 1)) & silver
        parts[category] = parts.get(category, np.zeros(silver.shape, bool)) | grown
    if not parts:
        return image.copy(), []
    invalid = ~silver | avoided | np.logical_or.reduce(list(parts.values()))
    inner = k.distance(np.pad(silver, 1))[1:-1, 1:-1] > how.inset if how.inset else silver
    plain, strict = Scene(image, invalid, invalid), None
    out, log = image.copy(), []
    for region in p.regions(parts):
        if "scratch" in region["categories"]:
            strict = strict or Scene(image, invalid, invalid | ~inner, plain.maps)
        way = repaired_region(out, strict if "scratch" in region["categories"] else plain, region, how)
        log.append((region["x"], region["y"], region["mask"].shape[1], region["mask"].shape[0], way))
    return out, log


def uniform(image: np.ndarray, silver: np.ndarray, avoided: np.ndarray, patch: np.ndarray, erosion: int = 30) -> np.ndarray:
    """A clean patch tiled into the eroded silver box; avoided pixels inside it stay."""
    inner = k.distance(np.pad(silver, 1))[1:-1, 1:-1] > erosion
    return k.tiled(image, patch, inner, avoided & silver)


def clean_patch(image: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The greatest rectangle of an annotated clean area."""
    y, x, h, w = k.largest_rectangle(clean)
    return image[y : y + h, x : x + w]
