"""Column functions over points, boxes, angles and rule chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(x: Column, size: Column) -> Column:
    """A coordinate within 0..size-1."""
    return F.greatest(F.least(x, size - 1), F.lit(0))


def rotated(x: Column, y: Column, angle: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A point of a canvas turned by ``angle`` degrees about its middle."""
    a = F.radians(angle.cast("double"))
    cx, cy = w / F.lit(2.0), h / F.lit(2.0)
    dx, dy = x - cx, y - cy
    rx = F.cos(a) * dx + F.sin(a) * dy + cx
    ry = -F.sin(a) * dx + F.cos(a) * dy + cy
    still, half = angle.isin(0, 360), angle == 180
    return (
        F.when(still, x.cast("double")).when(half, (w - 1 - x).cast("double")).otherwise(rx),
        F.when(still, y.cast("double")).when(half, (h - 1 - y).cast("double")).otherwise(ry),
    )


def flipped(x: Column, y: Column, flip: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return F.when(flip == "hflip", w - 1 - x).otherwise(x), F.when(flip == "vflip", h - 1 - y).otherwise(y)


def centring(size: Column, centre: Column) -> Column:
    """Whole pixels from a centre to the middle of a side; halves go to the even number."""
    return F.bround((size - 1) / F.lit(2.0) - centre, 0).cast("int")


def odd_kernel(n: Column) -> Column:
    return F.when(n < 3, 3).when(n % 2 == 0, n + 1).otherwise(n)


def expansion(category: Column, thickness: Column) -> Column:
    """Pixels by which a defect grows before it is repaired."""
    within = lambda share, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(thickness * share, 0).cast("int")))
    return F.when(category == "scratch", within(0.35, 5, 10)).when(category == "pit", within(0.18, 2, 7)).otherwise(within(0.10, 3, 10))


def patch_size(thickness: Column) -> Column:
    n = F.greatest(F.lit(9), F.least(F.lit(15), F.bround(thickness * 0.75, 0).cast("int")))
    return F.when(n % 2 == 0, F.least(n + 1, F.lit(15))).otherwise(n)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column, undirected: bool = False) -> Column:
    dot = ax * bx + ay * by
    dot = F.abs(dot) if undirected else dot
    return F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def candidate(length: Column, aspect: Column, linearity: Column, enabled: bool = True, least: float = 12.0, long: float = 40.0, least_aspect: float = 3.0, least_linearity: float = 0.30) -> dict[str, Column]:
    """Verdict of the rule chain on a component: first match wins."""
    group = F.when(length >= long, "long").otherwise("short")
    if not enabled:
        return {"kept": F.lit(True), "length_group": group, "reason": F.lit("filter_disabled")}
    reason = (
        F.when(length < least, "path_length_below_minimum")
        .when(length >= long, "long_candidate_passed")
        .when(aspect < least_aspect, "short_longest_path_aspect_ratio_too_low")
        .when(linearity < least_linearity, "short_linearity_too_low")
        .otherwise("short_candidate_passed")
    )
    return {"kept": reason.endswith("passed"), "length_group": F.when(length < least, "below_minimum").otherwise(group), "reason": reason}


def repair_route(category: Column, side: Column, thickness: Column) -> Column:
    """How a defect region is repaired."""
    return (
        F.when((category != "scratch") & (side <= 24) & (thickness <= 16), "telea")
        .when((category == "scratch") & (side >= 96) & (thickness > 5), "skeleton_patches")
        .when((category == "scratch") & (thickness <= 5), "thin_scratch_donor")
        .otherwise("donor")
    )


def numbered(rows: DataFrame, folder: str, order: list, start: int = 1, digits: int = 3) -> DataFrame:
    """``number`` (zero-padded, by ``order`` within a folder) and ``valid``: whether it fits the digits.

    ``digits`` is 1 to 3 and ``start`` at least 1; a number above 999 is null and not valid.
    """
    if not 1 <= digits <= 3 or start < 1:
        raise ValueError("digits lie in 1..3 and start is positive")
    n = F.row_number().over(Window.partitionBy(folder).orderBy(*order)) + (start - 1)
    return rows.withColumn("n_", n).withColumn("valid", F.col("n_") <= 999).withColumn("number", F.when(F.col("valid"), F.format_string(f"%0{digits}d", "n_"))).drop("n_")


def expanded_box(x: Column, y: Column, w: Column, h: Column, margin: int, width: int, height: int) -> dict[str, Column]:
    """A box grown by ``margin`` and cut at the image: ``left, top, right, bottom`` (ends excluded)."""
    return {
        "left": F.greatest(x - margin, F.lit(0)), "top": F.greatest(y - margin, F.lit(0)),
        "right": F.least(x + w + margin, F.lit(width)), "bottom": F.least(y + h + margin, F.lit(height)),
    }


def shifted_overlap(size: int, move: Column) -> tuple[Column, Column, Column]:
    """Start in the source, start in the target and length of a side moved by ``move``; null where nothing is left."""
    n = F.lit(size) - F.abs(move)
    return F.greatest(-move, F.lit(0)), F.greatest(move, F.lit(0)), F.when(n > 0, n)


def points(segmentation: Column, lenient: bool = True) -> Column:
    """Points of an ``array<array<string>>``: pairs of numbers.

    Lenient: what is no number is skipped. Strict: it is an error. Fewer than three points
    are none at all.
    """
    whole = F.filter(segmentation, lambda p: F.coalesce(F.size(p) >= 2, F.lit(False)))
    as_number = (lambda c: c.try_cast("double")) if lenient else (lambda c: c.cast("double"))
    found = F.transform(whole, lambda p: F.struct(as_number(p[0]).alias("x"), as_number(p[1]).alias("y")))
    found = F.filter(found, lambda p: p["x"].isNotNull() & p["y"].isNotNull()) if lenient else found
    return F.when(F.size(found) >= 3, found).otherwise(F.slice(found, 1, 0))


def translated(points_: Column, dx: Column, dy: Column) -> Column:
    """All points moved; fewer than three points give null."""
    return F.when(F.size(points_) >= 3, F.transform(points_, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))
