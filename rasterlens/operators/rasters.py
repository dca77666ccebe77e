"""Relational operators over pixel rows ``image_id, y, x, v``: set algebra, morphology, statistics.

Equi-joins on (image, y, x) with the few neighbour offsets exploded first; nothing here
compares all pixels with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["image_id", "y", "x"]
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def pixels(vectors: DataFrame, id_col: str, values: str, width: int) -> DataFrame:
    """Row-major arrays as pixel rows."""
    rows = vectors.select(F.col(id_col).alias("image_id"), F.posexplode(values).alias("i", "f"))
    return rows.select("image_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("f").cast("double").alias("v"))


def shifted(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once for each offset, at the place that it reaches."""
    off = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets)))
    return rows.withColumn("o", off).withColumn("dy", F.col("o.dy")).withColumn("dx", F.col("o.dx")).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx")).drop("o")


def threshold_by_percentile(rows: DataFrame, p: float) -> DataFrame:
    """Adds ``t``, the image's exact percentile with linear interpolation."""
    return rows.join(rows.groupBy("image_id").agg(F.percentile("v", p).alias("t")), "image_id")


def eroded(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose neighbours are set (outside counts as unset)."""
    reach = shifted(mask.select(*KEYS), [*offsets, (0, 0)])
    return reach.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") == len(offsets) + 1).select(*KEYS)


def dilated(mask: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    reach = shifted(mask.select(*KEYS), [*offsets, (0, 0)])
    return reach.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).select(*KEYS).distinct()


def neighbour_counts(mask: DataFrame) -> DataFrame:
    """``n`` set neighbours of each set pixel, eight-connected."""
    near = shifted(mask.select(*KEYS), EIGHT).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return mask.select(*KEYS).join(near, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def skeleton_length(mask: DataFrame) -> DataFrame:
    """1 + straight steps + sqrt(2) for each diagonal step, over all adjacent pairs."""
    half = [(0, 1), (1, 0), (1, 1), (1, -1)]
    pairs = shifted(mask.select(*KEYS), half).join(mask.select(*KEYS), KEYS)
    step = F.when((F.col("dy") != 0) & (F.col("dx") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0)
    lens = pairs.groupBy("image_id").agg(F.sum(step).alias("s"))
    return mask.select("image_id").distinct().join(lens, "image_id", "left").select("image_id", (F.coalesce("s", F.lit(0.0)) + 1).alias("length"))


def principal_axis(rows: DataFrame, group: list[str], eps: float = 1e-12) -> DataFrame:
    """Orientation (degrees modulo 180) and linearity of each group of pixels, by population covariance."""
    m = rows.groupBy(*group).agg(F.count("*").alias("n"), F.var_pop("x").alias("cxx"), F.var_pop("y").alias("cyy"), F.covar_pop("x", "y").alias("cxy"))
    root = F.sqrt((F.col("cxx") - F.col("cyy")) * (F.col("cxx") - F.col("cyy")) + 4 * F.col("cxy") * F.col("cxy"))
    major, minor = (F.col("cxx") + F.col("cyy") + root) / 2, (F.col("cxx") + F.col("cyy") - root) / 2
    flat = (F.col("n") < 2) | (major <= eps)
    angle = F.pmod(F.degrees(F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2), F.lit(180.0))
    return m.select(*group, "n", F.when(~flat, angle).alias("orientation"), F.when(flat, 0.0).otherwise(F.greatest(F.least((major - minor) / major, F.lit(1.0)), F.lit(0.0))).alias("linearity"))


def weighted_background(rows: DataFrame, weights: dict[tuple[int, int], float], height: int, width: int) -> DataFrame:
    """Weighted mean of the neighbourhood with mirrored borders (the edge is not repeated)."""
    mirror = lambda c, n: F.when(c < 0, -c).when(c >= n, 2 * (n - 1) - c).otherwise(c)
    w = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(v).alias("w")) for (dy, dx), v in weights.items()))
    asked = rows.select("image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(w).alias("o"))
    asked = asked.select("image_id", "y0", "x0", mirror(F.col("y0") + F.col("o.dy"), height).alias("y"), mirror(F.col("x0") + F.col("o.dx"), width).alias("x"), F.col("o.w").alias("w"))
    met = asked.join(rows.select(*KEYS, "v"), KEYS)
    return met.groupBy("image_id", F.col("y0").alias("y"), F.col("x0").alias("x")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("b"))


def best_direction(rows: DataFrame, kernels: dict[int, dict[tuple[int, int], float]]) -> DataFrame:
    """Per pixel the direction of greatest absolute response; ties to the first; none at zero."""
    taps = F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(v).alias("w")) for a, k in kernels.items() for (dy, dx), v in k.items()))
    sent = rows.select("image_id", "y", "x", "v", F.explode(taps).alias("t"))
    sent = sent.select("image_id", (F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), F.col("t.angle").alias("angle"), (F.col("v") * F.col("t.w")).alias("r"))
    score = sent.groupBy(*KEYS, "angle").agg(F.abs(F.sum("r")).alias("s")).where("s > 1e-9")
    best = score.groupBy(*KEYS).agg(F.max(F.struct("s", (-F.col("angle")).alias("a"))).alias("b"))
    return best.join(rows.select(*KEYS), KEYS).select(*KEYS, F.col("b.s").alias("score"), (-F.col("b.a")).alias("angle"))


def component_labels(mask: DataFrame, rounds: int = 64) -> DataFrame:
    """``label``: least row-major index of the pixel's eight-connected component, by min propagation.

    For small rasters only (a cross-check of the array kernel); each round is one equi-join.
    """
    now = mask.select(*KEYS).withColumn("label", (F.col("y") * 1_000_000 + F.col("x")).cast("long")).checkpoint()
    for _ in range(rounds):
        near = shifted(now, EIGHT).groupBy(*KEYS).agg(F.min("label").alias("m"))
        nxt = now.join(near, KEYS, "left").select(*KEYS, F.least("label", F.coalesce("m", "label")).alias("label")).checkpoint()
        if nxt.exceptAll(now).isEmpty():
            return nxt
        now = nxt
    return now


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ranked_globally(rows: DataFrame, key: str, bins: int = 4096) -> DataFrame:
    """``key, rank`` (from 0) of distinct whole numbers, without one window over all rows.

    Rows are counted by equal spans of the key; ranks are taken inside a span and moved by
    the counts before it, of which there are at most ``bins``.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ends = ends.select("lo", F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins)).alias("span"))
    filed = rows.select(key).join(F.broadcast(ends)).withColumn("bin", F.floor((F.col(key) - F.col("lo")) / F.col("span")))
    counts = filed.groupBy("bin").agg(F.count("*").alias("n"))
    before = counts.select(F.col("bin").alias("b"), (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("before"))
    inside = filed.withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy(key)) - 1)
    return inside.join(F.broadcast(before), F.col("bin") == F.col("b")).select(key, (F.col("before") + F.col("at")).alias("rank"))
