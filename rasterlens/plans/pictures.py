"""Picture batches as DataFrames: rows of Spark's image source with their annotated objects.

``images``: ``image`` as the image source gives it. ``objects``: ``path, pos, norm, points`` of
``annotation_objects``. They meet by folder and stem without case; only annotations are
shuffled with the pictures' rows, and every change of pixels is one fused function a row.
Results are ``origin, name, height, width, nChannels, data`` (BGR) for ``write_images``, with
a ``log`` of strings.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlens.functions import text as t
from rasterlens.operators import kernels as k
from rasterlens.operators import pictures as p
from rasterlens.operators import repair, synthesis

OBJECTS = "array<struct<pos:int,norm:string,points:array<struct<x:double,y:double>>>>"
PICTURE = "origin string, name string, height int, width int, nChannels int, data binary, log array<string>"
_SCHEMA = pa.schema([("origin", pa.string()), ("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary()), ("log", pa.list_(pa.string()))])
#: Categories of defects.
DEFECTS = ("scratch", "pit", "stain")


def file_key(path):
    """Folder and stem of a path or URL, without case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), r"\.[^./]+$", ""))


def annotated(images: DataFrame, objects: DataFrame) -> DataFrame:
    """``image, objects``: the objects of a picture in their order; an empty array without annotation."""
    by_file = objects.groupBy(file_key(F.col("path")).alias("pk")).agg(F.sort_array(F.collect_list(F.struct("pos", "norm", "points"))).alias("objects"))
    met = images.select("image", file_key(F.col("image.origin")).alias("ik")).join(by_file, F.col("ik") == F.col("pk"), "left")
    return met.select("image", F.coalesce("objects", F.array().cast(OBJECTS)).alias("objects"))


def with_defects(pictures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pictures with a defect, and ``skipped``: the number of the others."""
    has = F.exists("objects", lambda o: o["norm"].isin(*DEFECTS) & (F.size(o["points"]) >= 3))
    return pictures.where(has), pictures.agg(F.count_if(~has).alias("skipped"))


def over(pictures: DataFrame, one: Callable, *more: str) -> DataFrame:
    """``one(rgb, objects, row) -> (name, rgb, log)`` or a list of them, for every picture.

    ``objects`` are (category, points) with at least three points; ``more`` names further columns of ``row``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if row["height"] < 0:
                    raise ValueError(f"{row['origin']} is not an image")
                rgb = p.rgb(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1))
                things = [(o["norm"], [(q["x"], q["y"]) for q in o["points"]]) for o in row["objects"] if len(o["points"]) >= 3]
                got = one(rgb, things, row)
                for name, made, log in got if isinstance(got, list) else [got]:
                    cells = {"origin": row["origin"], "name": name, "height": made.shape[0], "width": made.shape[1], "nChannels": 3, "data": np.ascontiguousarray(made[..., ::-1]).tobytes(), "log": log}
                    yield pa.RecordBatch.from_pylist([cells], schema=_SCHEMA)

    cols = [F.col(f"image.{c}").alias(c) for c in ("origin", "height", "width", "data")]
    return pictures.select(*cols, "objects", *more).mapInArrow(run, PICTURE)


def _name(row: dict) -> str:
    return row["origin"].rsplit("/", 1)[-1]


def masks(shape: tuple[int, int], things: list, *categories: str) -> np.ndarray:
    """Union of the polygons of some categories, filled one by one."""
    return k.fill_polygons([pts for c, pts in things if c in categories], *shape)


def box_mask(shape: tuple[int, int], things: list, row: dict) -> np.ndarray:
    silver = masks(shape, things, "silver_box")
    if not silver.any():
        raise ValueError(f"{row['origin']} has no usable silver box")
    return silver


def blackened(pictures: DataFrame) -> DataFrame:
    """Pictures black outside their silver box."""
    return over(pictures, lambda a, o, r: (_name(r), p.outside_black(a, p.fill_floats([pts for c, pts in o if c == "silver_box"], *a.shape[:2])), []))


def repaired(pictures: DataFrame, how: repair.Repair | None = None) -> DataFrame:
    """Pictures without their defects; ``log`` holds ``x,y,width,height,way`` of every region."""

    def one(a, things, row):
        silver = box_mask(a.shape[:2], things, row)
        defects = [(c, k.fill_polygons([pts], *a.shape[:2])) for c, pts in things if c in DEFECTS]
        made, log = repair.repaired(a, silver, masks(a.shape[:2], things, "the_avoided_area"), defects, how)
        return _name(row), made, [",".join(map(str, x)) for x in log]

    return over(pictures, one)


def whitened(pictures: DataFrame, base: dict[str, float], gradient: dict[str, float]) -> DataFrame:
    """Pictures with their defects blended towards white."""
    p.checked_strengths(base, DEFECTS)
    p.checked_strengths(gradient, DEFECTS)

    def one(a, things, row):
        objects = [(c, k.fill_polygons([pts], *a.shape[:2])) for c, pts in things if c in base]
        return _name(row), p.whitened(a, objects, base, gradient), [c for c, _ in objects]

    return over(pictures, one)


def uniform(pictures: DataFrame, patch: np.ndarray, erosion: int = 30) -> DataFrame:
    """Clean texture tiled over every silver box; ``patch`` comes from ``clean_patch`` of one picture."""

    def one(a, things, row):
        return _name(row), repair.uniform(a, box_mask(a.shape[:2], things, row), masks(a.shape[:2], things, "the_avoided_area"), patch, erosion), []

    return over(pictures, one)


def clean_patch(pictures: DataFrame, stem: str = "001") -> np.ndarray:
    """The greatest clean rectangle of one picture (one row comes to the driver)."""
    one = pictures.where(F.col("image.origin").rlike(rf"/{stem}\.[^./]+$"))
    cut = over(one, lambda a, o, r: (_name(r), repair.clean_patch(a, masks(a.shape[:2], o, "clean_area")), []))
    row = cut.first()
    if row is None:
        raise ValueError(f"no picture {stem}")
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1]


def centred(pictures: DataFrame) -> DataFrame:
    """The silver box moved to the middle of a black canvas; ``log`` holds the move.

    Cutting the object, or a centre more than a pixel off afterwards, is an error.
    """

    def one(a, things, row):
        h, w = a.shape[:2]
        boxes = [pts for c, pts in things if c == "silver_box"]
        cx, cy = p.rectangle_centre(boxes)
        dx, dy = round((w - 1) / 2 - cx), round((h - 1) / 2 - cy)
        made = p.centred(a, box_mask((h, w), things, row), dx, dy)
        if abs(cx + dx - (w - 1) / 2) > 1 or abs(cy + dy - (h - 1) / 2) > 1:
            raise ValueError(f"{row['origin']} is off its centre")
        return _name(row), made, [str(dx), str(dy)]

    return over(pictures, one)


#: Angle and flip of the 56 variants of a picture.
VARIANTS = [(0, "vflip"), (0, "hflip"), *((a, f) for a in range(20, 361, 20) for f in (None, "vflip", "hflip"))]


def turned_objects(objects: DataFrame, width: int, height: int, *more: str) -> DataFrame:
    """``path, pos, norm, angle, flip, points`` of every object under every variant; null points where none are left.

    Columns named in ``more`` come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(3)
            flat = points.flatten()
            x, y = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in (0, 1))
            size = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for angle, flip in VARIANTS:
                nx, ny, n = k.turned_polygons(x, y, size, angle, flip, width, height)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(nx, pa.float64()), pa.array(ny, pa.float64())], names=["x", "y"]), mask=pa.array(n == 0))
                plan = [pa.array([angle] * b.num_rows, pa.int32()), pa.array([flip] * b.num_rows, pa.string())]
                cols = [*b.columns[:3], *plan, made, *b.columns[4:]]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "pos", "norm", "angle", "flip", "points", *more])

    # few bytes, much work: spread over all tasks, however small the table is
    spread = objects.repartition(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "pos")
    kind = "array<struct<x:double,y:double>>"
    pair = F.transform("points", lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y"))).cast(kind)
    rows = spread.select(F.col("path").cast("string"), F.col("pos").cast("int"), "norm", pair.alias("points"), *more)
    out = ", ".join(["path string, pos int, norm string, angle int, flip string", f"points {kind}", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in more)])
    return rows.mapInArrow(run, out)


def augmented(pictures: DataFrame) -> DataFrame:
    """All variants of every source picture, turned and flipped inside one function a picture."""
    def one(a, things, row):
        stem, _, suffix = _name(row).rpartition(".")
        named = lambda angle, flip: f"{stem}_aug_r{angle:03d}{'_' + flip if flip else ''}.{suffix}"
        return [(named(angle, flip), p.flipped(p.rotated(a, angle), flip), []) for angle, flip in VARIANTS]

    return over(pictures.where(~F.contains(F.col("image.origin"), F.lit("_aug_"))), one)


def augmented_objects(objects: DataFrame, width: int, height: int) -> DataFrame:
    """Objects of every variant; ``error`` where a silver box or avoided area does not stay valid.

    An object whose polygon does not survive keeps its old one (``moved`` is false), but
    for the silver box and the avoided area, which must stay, and there must be a silver box.
    """
    old = objects.select(F.col("path").alias("op"), F.col("pos").alias("on"), F.col("points").alias("old"))
    rows = turned_objects(objects, width, height).withColumnRenamed("points", "new").join(old, (F.col("path") == F.col("op")) & (F.col("pos") == F.col("on")))
    must = F.col("norm").isin("silver_box", "the_avoided_area")
    whole = Window.partitionBy("path", "angle", F.coalesce("flip", F.lit("")))
    lost = F.count_if(must & F.col("new").isNull()).over(whole)
    boxes = F.count_if((F.col("norm") == "silver_box") & F.col("new").isNotNull()).over(whole)
    error = F.when(lost > 0, "an object that must stay is lost").when(boxes == 0, "no silver box")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", "pos", "norm", "angle", "flip", t.augmented_name(stem, F.col("angle"), F.col("flip"), F.lit("")).alias("stem"), F.col("new").isNotNull().alias("moved"), F.coalesce("new", "old").alias("points"), error.alias("error"))


def defect_patches(pictures: DataFrame, padding: int = 8) -> DataFrame:
    """``source, index, category, height, width, data, mask`` of every annotated defect."""
    schema = pa.schema([("source", pa.string()), ("index", pa.int32()), ("category", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                a = p.rgb(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1))
                things = [(t_.capitalize(), [(q["x"], q["y"]) for q in o["points"]]) for o in row["objects"] if (t_ := o["norm"]) in DEFECTS]
                got = synthesis.patches(row["origin"], a, things, padding)
                cells = [{"source": x.source, "index": x.index, "category": x.category, "height": x.mask.shape[0], "width": x.mask.shape[1], "data": x.image.tobytes(), "mask": x.mask.tobytes()} for x in got]
                yield pa.RecordBatch.from_pylist(cells, schema=schema)

    cols = [F.col(f"image.{c}").alias(c) for c in ("origin", "height", "width", "data")]
    return pictures.select(*cols, "objects").mapInArrow(run, "source string, index int, category string, height int, width int, data binary, mask binary")


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rank`` from 0 in no telling order that stays the same: by leading bits of a hash, then inside them."""
    filed = rows.withColumn("bin", F.pmod(F.xxhash64(*order), F.lit(1024)))
    counts = filed.groupBy("bin").agg(F.count("*").alias("c")).select(F.col("bin").alias("b"), (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("before"))
    inside = filed.withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy(*order)) - 1)
    return inside.join(F.broadcast(counts), F.col("bin") == F.col("b")).withColumn("rank", F.col("at") + F.col("before")).drop("bin", "b", "at", "before")


def synthesised(pictures: DataFrame, patches: DataFrame, category: str, seed: int = 42, n: int = 3, base: dict[str, float] | None = None, gradient: dict[str, float] | None = None, outlines: dict[str, bool] | None = None) -> DataFrame:
    """Pictures with ``n`` defects of a category each, drawn without replacement by cycles.

    A picture's rank tells its cycle and its place there; the patches of a cycle are dealt in
    an order of their own (a stride through the pool from a seeded start), so each is used once
    a cycle at most. With strengths the defects are whitened, with ``outlines`` outlined.
    """
    pool = patches.where(F.col("category") == category)
    size = pool.count()
    if size < n:
        raise ValueError(f"{size} patches of {category}, {n} are needed")
    per = size // n
    stride = next(i for i in range(size * 5 // 8 + 1, size * 2 + 2) if math.gcd(i, size) == 1)
    rank = _ranked(pictures.select(F.col("image.origin").alias("o")).distinct(), "o")
    slots = rank.select("o", F.floor(F.col("rank") / per).alias("cycle"), F.explode(F.sequence((F.col("rank") % per) * n, (F.col("rank") % per) * n + n - 1)).alias("slot"))
    slots = slots.select("o", "slot", F.pmod(F.col("slot") * stride + F.pmod(F.xxhash64(F.lit(seed), "cycle"), F.lit(size)), F.lit(size)).alias("patch"))
    order = _ranked(pool.select(F.struct("source", "index", "category", "height", "width", "data", "mask").alias("x"), "source", "index"), "source", "index")
    chosen = slots.join(order, F.col("patch") == F.col("rank")).groupBy("o").agg(F.sort_array(F.collect_list(F.struct("slot", "x.source", "x.index", "x.category", "x.height", "x.width", "x.data", "x.mask"))).alias("chosen"))
    met = pictures.join(chosen, F.col("image.origin") == F.col("o"))

    def one(a, things, row):
        got = [synthesis.Patch(x["source"], x["index"], x["category"], np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], 3), np.frombuffer(x["mask"], bool).reshape(x["height"], x["width"])) for x in row["chosen"]]
        silver, avoided = box_mask(a.shape[:2], things, row), masks(a.shape[:2], things, "the_avoided_area")
        start = random.Random(f"{seed}|{_name(row)}").getrandbits(32)
        if base is None:
            made, done = synthesis.synthesised(a, silver, avoided, got, start)
        else:
            made, done = synthesis.synthesised_white(a, silver, avoided, got, start, base, gradient or {}, outlines)
        return _name(row), made, [f"{x.category}\t{x.source}\t{x.index}\t{int(m.sum())}" for x, (_, m) in zip(got, done, strict=True)]

    return over(met, one, "chosen")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pictures of two runs with the same name, put together; ``log`` is empty."""
    name = F.regexp_extract("image.origin", r"([^/]+)$", 1)
    a, b = left.select("image", name.alias("n")), right.select(F.col("image").alias("other"), name.alias("m"))
    met = a.join(b, F.col("n") == F.col("m")).select("image", "other", F.array().cast(OBJECTS).alias("objects"))

    def one(pixels, things, row):
        o = row["other"]
        return _name(row), p.assembled(pixels, p.rgb(np.frombuffer(o["data"], np.uint8).reshape(o["height"], o["width"], -1))), []

    return over(met, one, "other")
