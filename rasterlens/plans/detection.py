"""The detection pipeline: one fused Arrow function from raster to component features, then rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlens.functions.geometry import candidate
from rasterlens.operators import kernels as k

STAGES = ("gray", "mask", "background", "ridge", "threshold", "skeleton", "features")
FEATURES = (
    "component_id int, area int, bbox_x int, bbox_y int, bbox_width int, bbox_height int, centroid_x double, centroid_y double, "
    "rotated_length double, rotated_width double, aspect double, skeleton_pixels int, skeleton_length double, path_length double, path_aspect double, "
    "endpoints int, branches int, branch_density double, path_coverage double, linearity double, mean_width double, max_width double, mean_response double, max_response double, strong_share double"
)


@dataclass(frozen=True)
class Detection:
    """Settings of every stage; checked when they are made. A stage that is not enabled passes its input on."""

    method: str = "gabor"
    category: str | None = "Silver box"
    erosion: bool = True
    erosion_shape: str = "ellipse"
    erosion_size: int = 3
    erosion_times: int = 1
    background: bool = True
    background_size: int = 151
    ridge: bool = True
    gabor_mode: str = "absolute"
    gabor_size: int = 31
    gabor_angles: int = 12
    sigmas: tuple[float, ...] = (2.0, 2.5)
    response: str = "both"
    threshold: bool = True
    percentile: float = 97.0
    ratio: float = 0.4
    connectivity: int = 8
    thinning: bool = True
    skeleton: str = "zhang"
    least_area: int = 1
    rules: bool = True
    least_length: float = 12.0
    long_length: float = 40.0
    least_aspect: float = 3.0
    least_linearity: float = 0.30

    def __post_init__(self):
        one_of = {"method": ("gabor", "frangi"), "erosion_shape": ("rectangle", "ellipse", "cross"), "gabor_mode": ("absolute", "positive", "negative"), "response": ("both", "bright", "dark"), "skeleton": ("zhang", "lee"), "connectivity": (4, 8)}
        for name, choices in one_of.items():
            if getattr(self, name) not in choices:
                raise ValueError(f"{name} is one of {choices}")
        if any(n < 3 or n % 2 == 0 for n in (self.background_size, self.gabor_size, self.erosion_size)):
            raise ValueError("kernel sizes are odd and at least 3")
        if not 0 < self.percentile <= 100 or not 0 < self.ratio <= 1 or self.least_area < 1 or self.erosion_times < 0 or self.gabor_angles < 1:
            raise ValueError("percentile lies in (0, 100], ratio in (0, 1]; areas and angles are positive")
        if not self.sigmas or min(self.sigmas) <= 0 or not 0 <= self.least_length <= self.long_length or not 0 <= self.least_linearity <= 1:
            raise ValueError("sigmas are positive, lengths ascend, linearity lies in 0..1")


@dataclass
class Found:
    """What detection finds in one image."""

    gray: np.ndarray
    mask: np.ndarray
    flat: np.ndarray
    response: np.ndarray
    low: float
    high: float
    binary: np.ndarray
    skeleton: np.ndarray
    label: np.ndarray
    paths: dict
    rows: list


def _ridge(flat: np.ndarray, mask: np.ndarray, how: Detection) -> np.ndarray:
    if not how.ridge:
        return flat * mask
    if how.method == "gabor":
        return k.gabor(flat, mask, how.gabor_angles, how.gabor_size, mode=how.gabor_mode)[0]
    return k.frangi(flat, mask, how.sigmas, dark=how.response != "bright", bright=how.response != "dark")


def _linearity(xs: np.ndarray, ys: np.ndarray) -> float:
    if len(xs) < 2:
        return 0.0
    low, high = np.linalg.eigvalsh(np.cov(np.stack([xs, ys]), bias=True))
    return float(np.clip((high - low) / high, 0, 1)) if high > 1e-12 else 0.0


def found(gray: np.ndarray, support: np.ndarray, how: Detection) -> Found:
    """All stages over one image; ``support`` is the mask before erosion."""
    mask = k.erode(support, k.kernel_offsets(how.erosion_shape, how.erosion_size), how.erosion_times, outside=False) if how.erosion else support
    flat = k.corrected(gray, support, how.background_size)[1] if how.background else gray
    response = _ridge(flat, mask, how)
    if how.threshold:
        binary, low, high = k.hysteresis(response, mask, how.percentile, how.ratio, connectivity=how.connectivity)
    else:
        binary, low, high = mask.copy(), 0.0, 0.0
    thin = (k.skeleton if how.skeleton == "zhang" else k.thinned)(binary) if how.thinning else binary
    label = k.components(binary, how.connectivity)
    dist = k.distance(np.pad(binary, 1))[1:-1, 1:-1]
    # pixels of a component lie together once sorted by its label
    order = np.argsort(label, axis=None, kind="stable")
    flat_label = label.ravel()[order]
    order, flat_label = order[flat_label >= 0], flat_label[flat_label >= 0]
    begin = np.flatnonzero(np.concatenate(([True], flat_label[1:] != flat_label[:-1]))) if len(order) else np.empty(0, int)
    rows, paths = [], {}
    for number, (lo, hi) in enumerate(zip(begin, [*begin[1:], len(order)], strict=True), 1):
        if hi - lo < how.least_area:
            continue
        ys, xs = np.unravel_index(order[lo:hi], label.shape)
        y0, x0 = int(ys.min()), int(xs.min())
        part = np.zeros((int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1), bool)
        part[ys - y0, xs - x0] = True
        bones = part & thin[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
        by, bx = np.nonzero(bones if bones.any() else part)
        length, path = k.longest_path(bones)
        paths[number] = [(y + y0, x + x0) for y, x in path]
        long, short, aspect = k.min_area_rectangle(np.column_stack([xs, ys]))
        path_aspect = k.min_area_rectangle(np.array([(x, y) for y, x in path]).reshape(-1, 2))[2]
        tips, branches, n = k.topology(bones)
        whole = k.graph_length(bones)
        wide = np.maximum(2 * dist[by + y0, bx + x0] - 1, 1)
        strength = response[ys, xs]
        rows.append((
            number, len(ys), x0, y0, part.shape[1], part.shape[0], float(xs.mean()), float(ys.mean()), long, short, aspect, n, whole, length, path_aspect,
            tips, branches, branches / n if n else 0.0, float(np.clip(length / whole, 0, 1)) if whole else 0.0, _linearity(bx, by),
            float(wide.mean()), float(wide.max()), float(strength.mean()), float(strength.max()), float((strength >= high).mean()),
        ))
    numbers = np.zeros(label.size + 1, int)
    numbers[flat_label[begin]] = np.arange(1, len(begin) + 1)
    return Found(gray, mask, flat, response, low, high, binary, thin, np.where(label >= 0, numbers[label], 0), paths, rows)


def features(gray: np.ndarray, mask: np.ndarray, how: Detection) -> list[tuple]:
    """Feature rows of the components of one image."""
    return found(gray, mask, how).rows


def decided(rows: DataFrame, how: Detection) -> DataFrame:
    """Feature rows with the verdict of the rule chain."""
    verdict = candidate(F.col("path_length"), F.col("path_aspect"), F.col("linearity"), how.rules, how.least_length, how.long_length, how.least_aspect, how.least_linearity)
    return rows.select("*", *(c.alias(n) for n, c in verdict.items()))


def support(polygons: list, height: int, width: int) -> np.ndarray:
    """Mask of annotated polygons, filled in one go; an image without a usable one is an error."""
    usable = [p for p in polygons if len(p) >= 3]
    if not usable:
        raise ValueError("no usable polygon of the category")
    return k.fill_polygons(usable, height, width, even_odd=True)


def detect_folder(images: DataFrame, objects: DataFrame, how: Detection | None = None) -> DataFrame:
    """Detection over annotated images: features and verdicts of every component.

    ``images`` is Spark's image source; ``objects`` holds ``path, category, points`` of the
    annotations, joined by folder and stem without case. The polygons of ``how.category``
    (spelt as it is; None for all) are the mask of their image. An image without a usable
    polygon, or that cannot be decoded, is an error.
    """
    how = how or Detection()
    key = lambda path: F.lower(F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), r"\.[^./]+$", ""))
    mine = objects if how.category is None else objects.where(F.col("category") == how.category)
    polygons = mine.groupBy(key(F.col("path")).alias("pk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "points"))), lambda s: s["points"]).alias("polygons"))
    met = images.select("image", key(F.col("image.origin")).alias("ik")).join(polygons, F.col("ik") == F.col("pk"), "left")
    return decided(detect_images(met.select("image", F.coalesce("polygons", F.array().cast("array<array<struct<x:double,y:double>>>")).alias("polygons")), how), how)


def grayscale(pixels: np.ndarray) -> np.ndarray:
    """One channel of 1, 3 or 4 (BGR first); any other number is an error."""
    if pixels.shape[2] not in (1, 3, 4):
        raise ValueError(f"{pixels.shape[2]} channels")
    return np.rint(pixels[..., :3] @ np.array([0.114, 0.587, 0.299])) if pixels.shape[2] > 1 else pixels[..., 0].astype(float)


def detect_vectors(vectors: DataFrame, id_col: str, values: str, width: int, how: Detection | None = None) -> DataFrame:
    """Components of row-major rasters with the verdict of the rule chain."""
    how = how or Detection(erosion=False, background_size=5, gabor_size=5, percentile=90.0, least_length=2.0, long_length=6.0)
    return decided(k.over_rasters(vectors, id_col, values, width, lambda a: features(a, np.ones(a.shape, bool), how), FEATURES), how)


def detect_images(images: DataFrame, how: Detection | None = None) -> DataFrame:
    """Features over Spark's ``image`` source (BGR bytes), with ``polygons``, a ``mask`` of set bytes, or all of the image."""
    how = how or Detection()
    from collections.abc import Iterator

    import pyarrow as pa

    fields = [f.strip().split(" ") for f in FEATURES.split(",")]
    kinds = {"int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            origins, rows = [], []
            for r in b.to_pylist():
                if r["height"] < 0:
                    raise ValueError(f"{r['origin']} is not an image")
                gray = grayscale(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], -1))
                if r["polygons"] is not None:
                    mask = support([[(p["x"], p["y"]) for p in poly] for poly in r["polygons"]], *gray.shape)
                else:
                    mask = np.ones(gray.shape, bool) if r["mask"] is None else np.frombuffer(r["mask"], np.uint8).reshape(gray.shape) > 0
                got = features(gray, mask, how)
                origins += [r["origin"]] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), *(pa.array(list(c), kinds[f[1]]) for c, f in zip(cols, fields, strict=True))], names=["origin", *(f[0] for f in fields)])

    cols = ["image.origin", "image.height", "image.width", "image.data"]
    more = {"mask": "binary", "polygons": "array<array<struct<x:double,y:double>>>"}
    return images.select(*cols, *((F.col(c) if c in images.columns else F.lit(None).cast(kind)).alias(c) for c, kind in more.items())).mapInArrow(run, f"origin string, {FEATURES}")
