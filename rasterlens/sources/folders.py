"""Folders of images and annotations as DataFrames: one narrow row a file.

Listings read no file contents (the ``content`` column is pruned), so that pairing and
auditing a large set costs its file names only. Annotations are parsed as ``VARIANT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlens.functions import text as t

#: Suffixes of images; catalogue tools also take GIF.
IMAGE_SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]
CATALOGUE_SUFFIXES = [*IMAGE_SUFFIXES, ".gif"]


def listing(spark: SparkSession, *folders: str, recursive: bool = False) -> DataFrame:
    """``path, folder, name, stem, suffix, mtime, length`` of every file.

    A missing folder is an error of the reader; an empty one gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(folders))
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.col("modificationTime").alias("mtime"), "length")
    suffix = F.regexp_extract("name", r"(?<=.)(\.[^./]*)$", 1)
    return rows.select("path", "folder", "name", F.expr("substr(name, 1, length(name) - length(regexp_extract(name, '(?<=.)([.][^./]*)$', 1)))").alias("stem"), suffix.alias("suffix"), "mtime", "length")


def images(files: DataFrame, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    return files.where(F.lower("suffix").isin(suffixes))


def pairs(files: DataFrame, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``folder, name, image_path, json_path``: images with the annotation of the same stem.

    Stems are compared without case. Of several annotations with one stem the last name
    counts; images with one stem share it; an annotation without image gives no row.
    """
    key = F.lower("stem").alias("key")
    index = files.where(F.lower("suffix") == ".json").groupBy(F.col("folder").alias("jf"), key).agg(F.max_by("path", "name").alias("json_path"))
    left = images(files, suffixes).select("folder", "name", F.col("path").alias("image_path"), key)
    return left.join(index.withColumnRenamed("key", "jk"), (F.col("folder") == F.col("jf")) & (F.col("key") == F.col("jk")), "left").select("folder", "name", "image_path", "json_path")


def strict_pairs(files: DataFrame, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``pairs``, where an image without annotation is an error that names the first five."""
    found = pairs(files, suffixes)
    missing = [r["name"] for r in found.where("json_path is null").orderBy(F.lower("name"), "name").select("name").limit(5).collect()]
    if missing:
        raise ValueError(f"images without annotation: {', '.join(missing)}")
    return found


def found_for(files: DataFrame, precedence: list[str] = CATALOGUE_SUFFIXES) -> DataFrame:
    """``folder, stem, json_path, image_path`` of every annotation.

    The image is the one whose suffix comes first in ``precedence`` as written; only where
    there is none, suffixes count without case. No image at all leaves a null.
    """
    order = F.array(*map(F.lit, precedence))
    exact, loose = F.array_position(order, F.col("suffix")), F.array_position(order, F.lower("suffix"))
    rank = F.when(exact > 0, exact).otherwise(loose + len(precedence))
    best = images(files, precedence).withColumn("rank", rank).groupBy(F.col("folder").alias("f"), F.col("stem").alias("s")).agg(F.min_by("path", F.struct("rank", "name")).alias("image_path"))
    notes = files.where(F.col("suffix") == ".json").select("folder", "stem", F.col("path").alias("json_path"))
    return notes.join(best, (F.col("folder") == F.col("f")) & (F.col("stem") == F.col("s")), "left").drop("f", "s")


def folder_grid(spark: SparkSession, files: DataFrame, groups: list[str], categories: list[str]) -> DataFrame:
    """``grp, category, n_files`` of every cell of groups x categories, 0 where there is none.

    ``files`` is a recursive listing; the cell is the last two folders of a path.
    """
    cells = spark.createDataFrame([(g, c) for g in groups for c in categories], "grp string, category string")
    parts = F.split("path", "/")
    seen = files.groupBy(F.element_at(parts, -3).alias("g"), F.element_at(parts, -2).alias("c")).agg(F.count("*").alias("n"))
    joined = cells.join(seen, (F.col("grp") == F.col("g")) & (F.col("category") == F.col("c")), "left")
    return joined.select("grp", "category", F.coalesce("n", F.lit(0)).alias("n_files"))


def strict_grid(spark: SparkSession, files: DataFrame, groups: list[str], categories: list[str]) -> DataFrame:
    """``folder_grid``, where a cell without files is an error that names the first of them."""
    grid = folder_grid(spark, files, groups, categories)
    empty = grid.where("n_files = 0").orderBy("grp", "category").first()
    if empty is not None:
        raise ValueError(f"no folder {empty['grp']}/{empty['category']}")
    return grid


def missing_folders(spark: SparkSession, files: DataFrame, wanted: list[str]) -> DataFrame:
    """``folder``: those of ``wanted`` (last folder of a path) that hold no file, all at once."""
    there = files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()
    return spark.createDataFrame([(w,) for w in wanted], "folder string").join(there, "folder", "left_anti")


def augmented_only(files: DataFrame) -> DataFrame:
    """Images that an augmentation has written, with their ``source, angle, flip``, by name.

    An angle that is no multiple of 20 up to 360 is an error.
    """
    parts = t.augmentation(F.col("stem"))
    rows = images(files).withColumns(parts).where("source is not null")
    angle = F.when(F.col("valid"), F.col("angle")).otherwise(F.raise_error(F.concat(F.lit("angle of "), F.col("name"))).cast("int"))
    return rows.withColumn("angle", angle).drop("valid").orderBy("name")


def sheet_rows(rows: DataFrame) -> DataFrame:
    """Rows of a schedule sheet (row, a, b, ...) up to the last whose cell ``a`` is not empty."""
    last = rows.where(F.trim(F.coalesce("a", F.lit(""))) != "").agg(F.max("row").alias("last_row"))
    return rows.join(F.broadcast(last)).where("row <= last_row").drop("last_row")


def run_files(files: DataFrame, keywords: list[str]) -> DataFrame:
    """Files whose name has one of the keywords (without case), with the first that it has."""
    has = [F.when(F.contains(F.lower("name"), F.lit(k.lower())), F.lit(k)) for k in keywords]
    return files.withColumn("keyword", F.coalesce(*has)).where("keyword is not null")


def sources_only(files: DataFrame) -> DataFrame:
    """Images that no augmentation has written."""
    return images(files).where(~F.contains("stem", F.lit("_aug_")))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def annotations(spark: SparkSession, *folders: str, recursive: bool = False, need_objects: bool = True, strict: bool = False) -> DataFrame:
    """``path, raw, doc variant, error`` of every annotation file.

    ``error`` tells what is wrong with a file: not JSON, a root that is no object, or (with
    ``need_objects``) no list under ``objects``; ``strict`` raises it instead.
    """
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json").text(list(folders))
    doc = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.try_parse_json("value").alias("doc"))
    wrong = F.when(F.col("doc").isNull(), "not JSON").when(~_kind(F.col("doc")).startswith("OBJECT"), "root is no object")
    if need_objects:
        listed = F.try_variant_get("doc", "$.objects", "variant")
        wrong = wrong.when(listed.isNull() | ~_kind(listed).startswith("ARRAY"), "objects is no list")
    doc = doc.withColumn("error", wrong)
    if strict:
        doc = doc.withColumn("doc", F.when(F.col("error").isNull(), F.col("doc")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error")).cast("variant")))
    return doc


def annotation_objects(docs: DataFrame) -> DataFrame:
    """``path, pos, category, norm, points array<struct<x, y>>`` of every object of sound files.

    Items that are no objects are left out; points that are no pair of numbers, or of
    numbers written as text, are skipped; a segmentation that is no list has no points.
    """
    items = docs.where("error is null").select("path", F.posexplode(F.try_variant_get("doc", "$.objects", "array<variant>")).alias("pos", "item")).where(_kind(F.col("item")).startswith("OBJECT"))
    category = F.try_variant_get("item", "$.category", "string")
    pairs_ = F.coalesce(F.try_variant_get("item", "$.segmentation", "array<variant>"), F.array().cast("array<variant>"))
    cells = F.transform(pairs_, lambda p: F.try_variant_get(p, "$", "array<string>"))
    whole = F.filter(cells, lambda c: F.coalesce(F.size(c) >= 2, F.lit(False)))
    points = F.transform(whole, lambda c: F.struct(c[0].try_cast("double").alias("x"), c[1].try_cast("double").alias("y")))
    points = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return items.select("path", "pos", category.alias("category"), t.normal_category(category).alias("norm"), points.alias("points"))
