"""Queries over the given tables and their SQL for DuckDB, side by side."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlens.functions import geometry as g
from rasterlens.functions import text as t
from rasterlens.operators import kernels, linking, pictures, rasters, segments
from rasterlens.sources.tables import SQL, endpoints, files, objects, raster_pixels, read, schedule

QUERIES: dict = {}
ORACLES: dict = {}
P90 = 0.9
LINES = {
    0: {(0, -1): 1.0, (0, 0): 1.0, (0, 1): 1.0, (-1, 0): -1.5, (1, 0): -1.5},
    45: {(-1, 1): 1.0, (0, 0): 1.0, (1, -1): 1.0, (-1, -1): -1.5, (1, 1): -1.5},
    90: {(-1, 0): 1.0, (0, 0): 1.0, (1, 0): 1.0, (0, -1): -1.5, (0, 1): -1.5},
    135: {(-1, -1): 1.0, (0, 0): 1.0, (1, 1): 1.0, (-1, 1): -1.5, (1, -1): -1.5},
}


def query(*ctes: str, sql: str | None = None):
    """Register a query and, with ``sql``, its oracle over the named inputs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH RECURSIVE " if "RECURSIVE" in ctes else "WITH ") * bool(ctes) + ",\n".join(SQL.get(c, c) for c in ctes if c != "RECURSIVE") + "\n" + sql
        return f

    return add


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return objects(spark, sf).withColumn("norm", t.normal_category(F.col("category")))


@query(sql="""SELECT p_partkey, array_to_string(list_filter(string_split(replace(lower(trim(replace(p_type, ' ', '  '))), ' ', '_'), '_'), lambda q: q <> ''), '_') AS norm FROM part""")
def normalize_category(spark, sf):
    raw = F.concat(F.lit(" \t"), F.replace(F.col("p_type"), F.lit(" "), F.lit("  ")), F.lit("\n "))
    return read(spark, sf, "part").select("p_partkey", t.normal_category(raw).alias("norm"))


@query("O", "N", sql="SELECT count(*) FILTER (category = 'Silver box') AS n_exact, count(*) FILTER (norm = 'silver_box') AS n_norm, count(*) FILTER (norm IN ('scratch', 'pit', 'stain')) AS n_defects FROM n")
def exact_vs_normalized(spark, sf):
    return _normal(spark, sf).agg(F.count_if(F.col("category") == "Silver box").alias("n_exact"), F.count_if(F.col("norm") == "silver_box").alias("n_norm"), F.count_if(F.col("norm").isin("scratch", "pit", "stain")).alias("n_defects"))


@query("O", "N", sql="SELECT image_id, pos, category FROM n WHERE norm IS DISTINCT FROM 'the_avoided_area'")
def drop_category(spark, sf):
    return _normal(spark, sf).where(~F.col("norm").eqNullSafe("the_avoided_area")).select("image_id", "pos", "category")


@query("O", "N", sql="SELECT image_id, bool_or(norm = 'the_avoided_area') AS has_avoided FROM n GROUP BY image_id")
def has_category_audit(spark, sf):
    return _normal(spark, sf).groupBy("image_id").agg(F.bool_or(F.col("norm") == "the_avoided_area").alias("has_avoided"))


_RULES = """SELECT image_id, pos, CASE WHEN len >= 40 THEN 'long' ELSE 'short' END AS grp, CASE WHEN len < 12 THEN 'path_length_below_minimum' WHEN len >= 40 THEN 'long_candidate_passed'
  WHEN aspect < 3 THEN 'short_longest_path_aspect_ratio_too_low' WHEN lin < 0.30 THEN 'short_linearity_too_low' ELSE 'short_candidate_passed' END AS reason FROM (SELECT image_id, pos, CAST(x0 AS DOUBLE) AS len, tax * 100 AS aspect, discount * 10 AS lin FROM o)"""


@query("O", sql=f"SELECT image_id, pos, reason LIKE '%passed' AS kept, CASE WHEN reason = 'path_length_below_minimum' THEN 'below_minimum' ELSE grp END AS length_group, reason FROM ({_RULES})")
def candidate_rules(spark, sf):
    v = g.candidate(F.col("x0").cast("double"), F.col("tax") * 100, F.col("discount") * 10)
    return objects(spark, sf).select("image_id", "pos", *(c.alias(k) for k, c in v.items()))


@query("O", sql="SELECT image_id, pos, true AS kept, CASE WHEN x0 >= 40 THEN 'long' ELSE 'short' END AS length_group, 'filter_disabled' AS reason FROM o")
def candidate_rules_disabled(spark, sf):
    v = g.candidate(F.col("x0").cast("double"), F.col("tax"), F.col("discount"), enabled=False)
    return objects(spark, sf).select("image_id", "pos", *(c.alias(k) for k, c in v.items()))


@query(sql="SELECT page_id, 'P' || page_id || regexp_extract(url, '(\\.[^./]+)$', 1) AS new_name FROM pages")
def new_name_suffix(spark, sf):
    return read(spark, sf, "pages").select("page_id", t.renamed(F.concat(F.lit("P"), F.col("page_id")), F.col("url")).alias("new_name"))


_STEM = "lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '_aug_r' || lpad(CAST((p_partkey * 10) % 400 AS VARCHAR), 3, '0') || CASE p_partkey % 4 WHEN 1 THEN '_vflip' WHEN 2 THEN '_hflip' WHEN 3 THEN '_flip' ELSE '' END END"


@query(sql=f"""SELECT p_partkey, nullif(regexp_extract(s, pat, 1), '') AS source, CAST(nullif(regexp_extract(s, pat, 2), '') AS INT) AS angle, nullif(regexp_extract(s, pat, 3), '') AS flip,
  CAST(nullif(regexp_extract(s, pat, 2), '') AS INT) <= 360 AND CAST(nullif(regexp_extract(s, pat, 2), '') AS INT) % 20 = 0 AS valid
  FROM (SELECT p_partkey, {_STEM} AS s, '^(\\d{{3}})_aug_r(\\d{{3}})(?:_(vflip|hflip))?$' AS pat FROM part)""")
def augmentation_parse(spark, sf):
    k = F.col("p_partkey")
    flip = F.when(k % 4 == 1, "_vflip").when(k % 4 == 2, "_hflip").when(k % 4 == 3, "_flip").otherwise("")
    stem = F.concat(F.format_string("%03d", k % 1000), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("_aug_r"), F.format_string("%03d", (k * 10) % 400), flip)))
    return read(spark, sf, "part").select("p_partkey", *(c.alias(n) for n, c in t.augmentation(stem).items()))


@query(sql="""SELECT p_partkey, angle, flip, printf('%03d', p_partkey % 1000) || printf('_aug_r%03d', angle) || coalesce('_' || flip, '') || '.png' AS name FROM part, (
  SELECT 0 AS angle, f AS flip FROM (VALUES ('vflip'), ('hflip')) a(f) UNION ALL SELECT CAST(r AS INT), f FROM range(20, 361, 20) b(r), (VALUES (NULL), ('vflip'), ('hflip')) c(f))""")
def augmentation_plan(spark, sf):
    turns = F.flatten(F.transform(F.sequence(F.lit(20), F.lit(360), F.lit(20)), lambda a: F.transform(F.array(F.lit(None).cast("string"), F.lit("vflip"), F.lit("hflip")), lambda f: F.struct(a.alias("angle"), f.alias("flip")))))
    flips = F.transform(F.array(F.lit("vflip"), F.lit("hflip")), lambda f: F.struct(F.lit(0).alias("angle"), f.alias("flip")))
    rows = read(spark, sf, "part").select("p_partkey", F.explode(F.concat(flips, turns)).alias("v")).select("p_partkey", "v.angle", "v.flip")
    return rows.withColumn("name", t.augmented_name(F.format_string("%03d", F.col("p_partkey") % 1000), F.col("angle"), F.col("flip"), F.lit(".png")))


@query("O", sql="""SELECT image_id, pos, a AS angle, round(CASE WHEN a IN (0, 360) THEN x0 WHEN a = 180 THEN 63 - x0 ELSE cos(radians(a)) * (x0 - 32.0) + sin(radians(a)) * (y0 - 32.0) + 32.0 END, 6) AS rx,
  round(63 - CASE WHEN a IN (0, 360) THEN y0 WHEN a = 180 THEN 63 - y0 ELSE -sin(radians(a)) * (x0 - 32.0) + cos(radians(a)) * (y0 - 32.0) + 32.0 END, 6) AS ry FROM o, (VALUES (0), (20), (180), (360)) v(a)""")
def rotate_flip_points(spark, sf):
    rows = objects(spark, sf).withColumn("angle", F.explode(F.array(*map(F.lit, (0, 20, 180, 360)))))
    rx, ry = g.rotated(F.col("x0"), F.col("y0"), F.col("angle"), F.lit(64), F.lit(64))
    rx, ry = g.flipped(rx, ry, F.lit("vflip"), F.lit(64), F.lit(64))
    return rows.select("image_id", "pos", "angle", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"))


@query("O", sql="SELECT image_id, pos, greatest(least(x0 + w, 39), 0) AS x1, greatest(least(y0 - h, 39), 0) AS y1 FROM o")
def vertex_clip(spark, sf):
    return objects(spark, sf).select("image_id", "pos", g.clipped(F.col("x0") + F.col("w"), F.lit(40)).alias("x1"), g.clipped(F.col("y0") - F.col("h"), F.lit(40)).alias("y1"))


@query("O", sql="SELECT image_id, pos, x0 + CAST(round_even(31.5 - (x0 + w / 2.0), 0) AS INT) AS x1, y0 + CAST(round_even(31.5 - (y0 + h / 2.0), 0) AS INT) AS y1 FROM o")
def translate_center(spark, sf):
    dx, dy = g.centring(F.lit(64), F.col("x0") + F.col("w") / F.lit(2.0)), g.centring(F.lit(64), F.col("y0") + F.col("h") / F.lit(2.0))
    return objects(spark, sf).select("image_id", "pos", (F.col("x0") + dx).alias("x1"), (F.col("y0") + dy).alias("y1"))


@query("O", "N", sql="""SELECT image_id, pos, CASE norm WHEN 'scratch' THEN greatest(5, least(10, CAST(round_even(x0 * 0.35::DOUBLE, 0) AS INT))) WHEN 'pit' THEN greatest(2, least(7, CAST(round_even(x0 * 0.18::DOUBLE, 0) AS INT))) ELSE greatest(3, least(10, CAST(round_even(x0 * 0.10::DOUBLE, 0) AS INT))) END AS px,
  CASE WHEN greatest(9, least(15, CAST(round_even(x0 * 0.75::DOUBLE, 0) AS INT))) % 2 = 0 THEN least(15, 1 + greatest(9, least(15, CAST(round_even(x0 * 0.75::DOUBLE, 0) AS INT)))) ELSE greatest(9, least(15, CAST(round_even(x0 * 0.75::DOUBLE, 0) AS INT))) END AS patch FROM n""")
def expansion_pixels(spark, sf):
    return _normal(spark, sf).select("image_id", "pos", g.expansion(F.col("norm"), F.col("x0")).alias("px"), g.patch_size(F.col("x0")).alias("patch"))


@query(sql="SELECT o_orderkey, CAST(make_date(2024, month(o_orderdate), day(o_orderdate)) AS VARCHAR) AS ends FROM orders")
def schedule_parse(spark, sf):
    m, d = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    md = F.concat(m, F.lit("."), d)
    raw = F.when(F.col("o_orderkey") % 3 == 0, md).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" 1.1-"), md)).otherwise(F.concat(m, F.lit(".1-"), d))
    return read(spark, sf, "orders").select("o_orderkey", t.schedule_date(raw, 2024).cast("string").alias("ends"))


@query(sql="SELECT event_id, props AS raw, json_keys(props)[1] AS first_key, len(json_keys(props)) AS n_keys FROM events")
def json_extract(spark, sf):
    keys = F.json_object_keys("props")
    return read(spark, sf, "events").select("event_id", F.col("props").alias("raw"), F.get(keys, F.lit(0)).alias("first_key"), F.size(keys).cast("long").alias("n_keys"))


@query(sql="SELECT p_partkey, CASE WHEN p_size < 3 THEN 3 WHEN p_size % 2 = 0 THEN p_size + 1 ELSE p_size END AS k FROM part")
def odd_kernel(spark, sf):
    return read(spark, sf, "part").select("p_partkey", g.odd_kernel(F.col("p_size")).alias("k"))


@query("F", sql="SELECT f.doc_id, f.stem || f.suffix AS image, CASE WHEN l.doc_id IS NOT NULL THEN f.stem || '.json' END AS json FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON f.doc_id = l.doc_id")
def pair_left(spark, sf):
    js = read(spark, sf, "labels").select(F.col("doc_id").alias("j")).distinct()
    f = files(spark, sf).join(js, F.col("doc_id") == F.col("j"), "left")
    return f.select("doc_id", F.concat("stem", "suffix").alias("image"), F.when(F.col("j").isNotNull(), F.concat("stem", F.lit(".json"))).alias("json"))


@query("F", sql="SELECT doc_id, stem || suffix AS image FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pair_anti(spark, sf):
    return files(spark, sf).join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.concat("stem", "suffix").alias("image"))


@query(sql="""SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'right' WHEN b.name IS NULL THEN 'left' ELSE 'both' END AS side FROM
  (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 3 = 0) a FULL JOIN (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 5 = 0) b ON a.name = b.name""")
def run_compare(spark, sf):
    p = read(spark, sf, "part")
    a, b = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("a")).distinct(), p.where("p_partkey % 5 = 0").select(F.col("p_type").alias("b")).distinct()
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("name"), side.alias("side"))


@query("O", "N", sql="""SELECT s.image_id, f.folder, count(*) AS n_kept, count(*) FILTER (norm = 'the_avoided_area') AS n_copied FROM n s JOIN (SELECT n_nationkey AS folder FROM nation) f ON s.image_id % 25 = f.folder OR norm = 'the_avoided_area' AND (s.image_id + 1) % 25 = f.folder
  GROUP BY ALL""")
def copy_objects(spark, sf):
    n = _normal(spark, sf)
    own = F.array((F.col("image_id") % 25).cast("int"))
    more = F.when(F.col("norm") == "the_avoided_area", F.array(((F.col("image_id") + 1) % 25).cast("int"))).otherwise(F.array().cast("array<int>"))
    asked = n.select("image_id", "norm", F.explode(F.array_distinct(F.concat(own, more))).alias("folder"))
    met = asked.join(F.broadcast(read(spark, sf, "nation").select(F.col("n_nationkey").alias("folder"))), "folder")
    return met.groupBy("image_id", "folder").agg(F.count("*").alias("n_kept"), F.count_if(F.col("norm") == "the_avoided_area").alias("n_copied"))


@query("F", sql="""SELECT folder, mtime % 50 AS stem_key, arg_min(suffix, CASE lower(suffix) WHEN '.bmp' THEN 1 WHEN '.jpg' THEN 3 WHEN '.png' THEN 4 ELSE 7 END) AS suffix FROM f GROUP BY ALL""")
def suffix_precedence(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, t.IMAGE_SUFFIXES)), F.lower("suffix"))
    return files(spark, sf).groupBy("folder", (F.col("mtime") % 50).alias("stem_key")).agg(F.min_by("suffix", rank).alias("suffix"))


@query("F", sql="SELECT folder, stem || suffix AS old_name, n <= 999 AS valid, CASE WHEN n <= 999 THEN printf('%03d', n) || suffix END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY mtime, lower(stem || suffix)) AS n FROM f)")
def rename_plan(spark, sf):
    return g.numbered(files(spark, sf), "folder", ["mtime", F.lower(F.concat("stem", "suffix"))]).select("folder", F.concat("stem", "suffix").alias("old_name"), "valid", F.concat("number", "suffix").alias("new_name"))


@query(sql="SELECT a.p_partkey AS source, a.p_partkey + CASE WHEN a.p_partkey % 2 = 0 THEN 1 ELSE 3 END AS target FROM part a WHERE a.p_partkey % 3 = 0 AND target IN (SELECT p_partkey FROM part) AND target NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def rename_conflicts(spark, sf):
    there = read(spark, sf, "part").select(F.col("p_partkey").alias("target"))
    plan = there.where("target % 3 = 0").select(F.col("target").alias("source"), (F.col("target") + F.when(F.col("target") % 2 == 0, 1).otherwise(3)).alias("target"))
    return plan.join(there, "target", "left_semi").join(plan.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target")


@query(sql="SELECT printf('%03d', coalesce(max(s_suppkey % 500) FILTER (s_suppkey % 3 <> 0), 0) + 1) AS next_run FROM supplier")
def next_run_number(spark, sf):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("old_"), F.col("s_suppkey"))).otherwise((F.col("s_suppkey") % 500).cast("string"))
    digits = read(spark, sf, "supplier").select(name.alias("name")).where(F.regexp_like("name", F.lit("^[0-9]+$")))
    return digits.agg(F.format_string("%03d", F.coalesce(F.max(F.col("name").cast("long")), F.lit(0).cast("long")) + 1).alias("next_run"))


@query("O", "N", sql="SELECT image_id, pos, norm, CAST(row_number() OVER (PARTITION BY image_id, norm ORDER BY pos) AS INT) AS ordinal FROM n")
def object_ordinal(spark, sf):
    return _normal(spark, sf).select("image_id", "pos", "norm", F.row_number().over(Window.partitionBy("image_id", "norm").orderBy("pos")).alias("ordinal"))


@query("O", "N", sql="SELECT image_id, bit_or(CASE norm WHEN 'scratch' THEN 1 WHEN 'pit' THEN 2 WHEN 'stain' THEN 4 ELSE 0 END) AS bits FROM n GROUP BY image_id")
def category_bits(spark, sf):
    bit = F.when(F.col("norm") == "scratch", 1).when(F.col("norm") == "pit", 2).when(F.col("norm") == "stain", 4).otherwise(0)
    return _normal(spark, sf).groupBy("image_id").agg(F.bit_or(bit).alias("bits"))


@query("O", "N", sql="SELECT norm, count(*) AS n, count(DISTINCT image_id) AS images, count(*) >= 3 AS enough FROM n GROUP BY norm")
def run_counters(spark, sf):
    return _normal(spark, sf).groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"), (F.count("*") >= 3).alias("enough"))


@query("P", sql="SELECT image_id, round(quantile_cont(v, 0.9), 9) AS p90 FROM p GROUP BY image_id")
def masked_percentile(spark, sf):
    return raster_pixels(spark, sf).groupBy("image_id").agg(F.round(F.percentile("v", P90), 9).alias("p90"))


_MASK = "m AS (SELECT p.image_id, y, x, v, t FROM p JOIN (SELECT image_id, quantile_cont(v, 0.7) AS t FROM p GROUP BY image_id) q USING (image_id) WHERE v >= t)"
_LABELS = """l AS (SELECT image_id, y, x, y * 1000000 + x AS label FROM m UNION SELECT b.image_id, b.y, b.x, l.label FROM l JOIN m b ON b.image_id = l.image_id AND abs(b.y - l.y) <= 1 AND abs(b.x - l.x) <= 1 AND b.y * 1000000 + b.x > l.label),
c AS (SELECT image_id, y, x, min(label) AS label FROM l GROUP BY ALL)"""


def _mask(spark: SparkSession, sf: str, p: float = 0.7) -> DataFrame:
    return rasters.threshold_by_percentile(raster_pixels(spark, sf), p).where("v >= t")


def _over_masks(spark: SparkSession, sf: str, one, schema: str) -> DataFrame:
    """Rows of ``one(mask)``, where the mask holds the pixels of an image from its 70 % quantile up."""
    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, lambda a: one(a >= np.percentile(a, 70)), schema)


def _digest(mask: np.ndarray) -> list[tuple]:
    at = np.flatnonzero(mask)
    return [(len(at), int(at.sum()))] if len(at) else []


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.labelled(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, 0.7)


@query("RECURSIVE", "P", """q AS (SELECT image_id, quantile_cont(v, 0.9) AS hi FROM p GROUP BY image_id), m AS (SELECT p.image_id, y, x, v, hi FROM p JOIN q USING (image_id) WHERE hi > 1e-12 AND v >= hi * 0.4),
l AS (SELECT image_id, y, x FROM m WHERE v >= hi UNION SELECT b.image_id, b.y, b.x FROM l JOIN m b ON b.image_id = l.image_id AND abs(b.y - l.y) <= 1 AND abs(b.x - l.x) <= 1)""",
       sql="SELECT image_id, count(*) AS kept, CAST(sum((y * 8 + x) * (y * 8 + x)) AS BIGINT) AS sum_sq FROM l GROUP BY image_id")
def hysteresis(spark, sf):
    return kernels.hysteresis_counts(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, P90, 0.4)


@query("P", _MASK, sql="SELECT image_id, count(*) AS n, CAST(sum(y * 8 + x) AS BIGINT) AS s FROM m a WHERE (SELECT count(*) FROM m b WHERE b.image_id = a.image_id AND abs(b.y - a.y) + abs(b.x - a.x) <= 1) = 5 GROUP BY image_id")
def erode_mask(spark, sf):
    return _over_masks(spark, sf, lambda m: _digest(kernels.erode(m, kernels.kernel_offsets("cross", 3), outside=False)), "n long, s long")



@query("P", _MASK, sql="SELECT image_id, count(*) AS n, CAST(sum(y * 8 + x) AS BIGINT) AS s FROM (SELECT DISTINCT p.image_id, p.y, p.x FROM p JOIN m ON m.image_id = p.image_id AND abs(m.y - p.y) + abs(m.x - p.x) <= 1) GROUP BY image_id")
def dilate_mask(spark, sf):
    return _over_masks(spark, sf, lambda m: _digest(kernels.dilate(m, kernels.kernel_offsets("cross", 3))), "n long, s long")



@query("P", _MASK, "k AS (SELECT a.image_id, a.y, a.x, count(b.image_id) AS n FROM m a LEFT JOIN m b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y, b.x) <> (a.y, a.x) GROUP BY ALL)",
       sql="SELECT image_id, count(*) FILTER (n = 1) AS endpoints, count(*) FILTER (n >= 3) AS branches, count(*) AS n FROM k GROUP BY image_id")
def neighbour_topology(spark, sf):
    return _over_masks(spark, sf, lambda m: [kernels.topology(m)], "endpoints long, branches long, n long")



@query("RECURSIVE", "P", _MASK, _LABELS, sql="SELECT image_id, CAST(label AS BIGINT) AS label, count(*) AS area, min(x) AS bx, min(y) AS by_, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM c GROUP BY image_id, label HAVING count(*) >= 2")
def component_stats(spark, sf):
    c = _labelled(spark, sf).groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("bx"), F.min("y").alias("by_"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))
    return c.where("area >= 2")


@query("RECURSIVE", "P", _MASK, _LABELS, """a AS (SELECT image_id, label, count(*) AS n, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy FROM c GROUP BY image_id, label),
d AS (SELECT *, sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy) AS root FROM a)""",
       sql="SELECT image_id, CAST(label AS BIGINT) AS label, n, CASE WHEN n < 2 OR (cxx + cyy + root) / 2 <= 1e-12 THEN 0 ELSE round(greatest(least(root / ((cxx + cyy + root) / 2), 1), 0) + 1e-9, 6) END AS linearity FROM d")
def pca_orientation(spark, sf):
    return rasters.principal_axis(_labelled(spark, sf), ["image_id", "label"]).select("image_id", "label", "n", F.round(F.col("linearity") + 1e-9, 6).alias("linearity"))


@query("P", _MASK, sql="""SELECT a.image_id, round(1 + coalesce(sum(CASE WHEN b.image_id IS NULL THEN 0 WHEN a.y <> b.y AND a.x <> b.x THEN sqrt(2) ELSE 1 END), 0), 6) AS length FROM m a LEFT JOIN m b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y > a.y OR b.y = a.y AND b.x > a.x) GROUP BY a.image_id""")
def skeleton_length(spark, sf):
    return _over_masks(spark, sf, lambda m: [(round(kernels.graph_length(m), 6),)], "length double")



@query("P", sql="""SELECT a.image_id, a.y, a.x, round(CASE WHEN a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 THEN a.v - sum(w * b.v) FILTER (b.y BETWEEN 1 AND 6 AND b.x BETWEEN 1 AND 6) / sum(w) FILTER (b.y BETWEEN 1 AND 6 AND b.x BETWEEN 1 AND 6) ELSE 0 END, 6) + 0 AS corrected FROM p a, (VALUES (-1), (0), (1)) d(dy), (VALUES (-1), (0), (1)) e(dx), (SELECT 0 z) zz JOIN p b ON b.image_id = a.image_id AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END, LATERAL (SELECT CASE WHEN dy = 0 AND dx = 0 THEN 1.0::DOUBLE WHEN dy = 0 OR dx = 0 THEN 0.5 ELSE 0.25 END AS w) u GROUP BY a.image_id, a.y, a.x, a.v""")
def masked_background(spark, sf):
    sigma = (0.5 / math.log(2)) ** 0.5  # a neighbour weighs half

    def one(a):
        mask = np.zeros(a.shape, bool)
        mask[1:-1, 1:-1] = True
        out = kernels.corrected(a, mask, 3, sigma)[1]
        return [(y, x, round(float(out[y, x]), 6) + 0.0) for y, x in np.ndindex(*a.shape)]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "y int, x int, corrected double")


_TAPS = ", ".join(f"({a}, {dy}, {dx}, {w}::DOUBLE)" for a, k in LINES.items() for (dy, dx), w in k.items())


@query("P", f"s AS (SELECT a.image_id, a.y, a.x, k.a AS angle, abs(sum(b.v * k.w)) AS s FROM p a, (VALUES {_TAPS}) k(a, dy, dx, w), p b WHERE b.image_id = a.image_id AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY ALL)",
       sql="SELECT image_id, y, x, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY s DESC, angle) AS r FROM s WHERE s > 1e-9) WHERE r = 1")
def argmax_direction(spark, sf):
    def one(a):
        score = np.max([np.abs(sum(w * kernels.moved(a, dy, dx, 0.0) for (dy, dx), w in taps.items())) for taps in LINES.values()], axis=0)
        return [(int(y), int(x), round(float(score[y, x]), 4)) for y, x in np.argwhere(score > 1e-9)]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "y int, x int, score double")



@query("RECURSIVE", "P", _MASK, _LABELS, sql="SELECT image_id, CAST(label AS BIGINT) AS label, round(avg(v), 6) AS mean_v, round(max(v), 6) AS max_v, round(avg(CASE WHEN v >= t * 1.5 THEN 1.0 ELSE 0.0 END), 6) AS strong FROM c JOIN m USING (image_id, y, x) GROUP BY image_id, label")
def response_stats(spark, sf):
    c = _labelled(spark, sf).join(_mask(spark, sf), rasters.KEYS)
    return c.groupBy("image_id", "label").agg(F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.max("v"), 6).alias("max_v"), F.round(F.avg(F.when(F.col("v") >= F.col("t") * 1.5, 1.0).otherwise(0.0)), 6).alias("strong"))


@query("O", sql="SELECT image_id, count(*) AS n_union, count(*) FILTER (k % 2 = 1) AS n_evenodd FROM (SELECT image_id, x, y, count(*) AS k FROM o, range(0, 14) a(i), range(0, 10) b(j), LATERAL (SELECT x0 + i AS x, y0 + j AS y) c WHERE i < w AND j < h GROUP BY ALL) GROUP BY image_id")
def mask_union_vs_evenodd(spark, sf):
    span = lambda a, n: F.sequence(F.col(a), F.col(a) + F.col(n) - 1)
    px = objects(spark, sf).select("image_id", F.explode(span("x0", "w")).alias("x"), "y0", "h").select("image_id", "x", F.explode(span("y0", "h")).alias("y"))
    return px.groupBy("image_id", "x", "y").agg(F.count("*").alias("k")).groupBy("image_id").agg(F.count("*").alias("n_union"), F.count_if(F.col("k") % 2 == 1).alias("n_evenodd"))


_PAIRS = "g AS (SELECT a.image_id, a.id AS a_id, b.id AS b_id, a.component_id AS a_comp, b.component_id AS b_comp, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.tx AS atx, a.ty AS aty, b.tx AS btx, b.ty AS bty, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS gap FROM e a JOIN e b ON a.image_id = b.image_id AND b.id > a.id AND a.component_id <> b.component_id WHERE gap <= 20)"


@query("E", _PAIRS, sql="SELECT image_id, a_id, b_id, round(gap, 6) AS gap FROM g")
def grid_distance_join(spark, sf):
    ends = endpoints(spark, sf).select("id", "image_id", "component_id", "x", "y")
    return linking.grid_pairs(ends, 20.0).select(F.col("a.image_id").alias("image_id"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.round("gap", 6).alias("gap"))


_LINKS = """u AS (SELECT *, (bx - ax) / gap AS ux, (by_ - ay) / gap AS uy FROM g WHERE gap > 1e-9),
k AS (SELECT *, degrees(acos(greatest(least(abs(atx * btx + aty * bty), 1.0), -1.0))) AS turn, degrees(acos(least(abs(atx * ux + aty * uy), 1.0))) AS ca, degrees(acos(least(abs(btx * ux + bty * uy), 1.0))) AS cb, greatest(abs(gap * (ux * aty - uy * atx)), abs(gap * (ux * bty - uy * btx))) AS offset_px FROM u),
s AS (SELECT image_id, a_id, b_id, a_comp, b_comp, round(gap, 6) AS gap, round(turn, 6) AS turn, round(offset_px, 6) AS offset_px, round(gap / 20 + turn / 60 + greatest(ca, cb) / 75 + offset_px / 15, 6) AS score FROM k WHERE turn <= 60 AND ca <= 75 AND cb <= 75 AND offset_px <= 15)"""


@query("E", _PAIRS, _LINKS, sql="SELECT * FROM s")
def link_scores(spark, sf):
    return linking.scores(linking.grid_pairs(endpoints(spark, sf), 20.0), 20.0)


@query("E", _PAIRS, """n AS (SELECT a_id, b_id, ax, ay, bx, by_, greatest(CAST(ceil(gap) AS INT) + 1, 2) AS n FROM g),
q AS (SELECT a_id, b_id, list_sort(list_distinct(list_transform(range(0, n), lambda i: {'x': CAST(round_even(ax + (bx - ax) * i / (n - 1.0::DOUBLE), 0) AS BIGINT), 'y': CAST(round_even(ay + (by_ - ay) * i / (n - 1.0::DOUBLE), 0) AS BIGINT)}))) AS pts FROM n)""",
       sql="SELECT a_id, b_id, len(pts) - 2 AS n_inner, array_to_string(list_transform(pts[2:-2], lambda p: p.x || ':' || p.y), ';') AS inner_points FROM q WHERE len(pts) > 2")
def gap_samples(spark, sf):
    ends = endpoints(spark, sf).select("id", "image_id", "component_id", "x", "y")
    pairs = linking.sampled(linking.grid_pairs(ends, 20.0), 20.0)
    inner = F.transform(F.slice("rel", F.lit(2), F.size("rel") - 2), lambda p: F.concat(F.col("x0") + p["x"], F.lit(":"), F.col("y0") + p["y"]))
    got = pairs.where(F.size("rel") > 2)
    return got.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), (F.size("rel") - 2).cast("long").alias("n_inner"), F.array_join(inner, ";").alias("inner_points"))


@query("E", _PAIRS, _LINKS, "r AS (SELECT image_id, a_id, b_id, score, i AS e, row_number() OVER (PARTITION BY image_id, i ORDER BY score, a_id, b_id) AS r FROM (SELECT *, unnest([a_id, b_id]) AS i FROM s))",
       sql="SELECT image_id, a_id, b_id, score FROM r WHERE r = 1 GROUP BY ALL HAVING count(*) = 2")
def mutual_best(spark, sf):
    return linking.mutual_best(link_scores(spark, sf))


@query()
def selected_links(spark, sf):
    return linking.forest(linking.mutual_links(endpoints(spark, sf), 20.0))


@query("F", sql="SELECT folder, stem, CASE (rn - 1) // 3 WHEN 0 THEN 'Pit' WHEN 1 THEN 'Scratch' ELSE 'Stain' END AS grp FROM (SELECT folder, stem, row_number() OVER (PARTITION BY folder ORDER BY md5('7|' || stem), stem) AS rn FROM f) WHERE rn <= 9")
def group_sample(spark, sf):
    rn = F.row_number().over(Window.partitionBy("folder").orderBy(F.md5(F.concat(F.lit("7|"), F.col("stem"))), "stem"))
    some = files(spark, sf).select("folder", "stem", rn.alias("rn")).where("rn <= 9")
    return some.select("folder", "stem", F.when(F.col("rn") <= 3, "Pit").when(F.col("rn") <= 6, "Scratch").otherwise("Stain").alias("grp"))


@query("O", sql="SELECT image_id, (dense - 1) // 4 AS cycle, (dense - 1) % 4 AS slot FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) AS dense FROM (SELECT DISTINCT image_id FROM o))")
def bag_cycles(spark, sf):
    n = F.col("rank")
    return rasters.ranked_globally(objects(spark, sf).select("image_id").distinct(), "image_id").select("image_id", F.floor(n / 4).alias("cycle"), (n % 4).alias("slot"))


@query("O", "N", """b AS (SELECT image_id, pos, norm, w * h AS area, greatest(0, least(x0 + w, 40) - greatest(x0, 8)) * greatest(0, least(y0 + h, 40) - greatest(y0, 8)) AS inside FROM n)""",
       sql="SELECT image_id, pos, CASE norm WHEN 'pit' THEN inside = area WHEN 'scratch' THEN 3 * inside >= area ELSE 2 * inside >= area END AS fits FROM b")
def placement_area_rule(spark, sf):
    over = lambda a, n: F.greatest(F.lit(0), F.least(F.col(a) + F.col(n), F.lit(40)) - F.greatest(F.col(a), F.lit(8)))
    area, inside = F.col("w") * F.col("h"), over("x0", "w") * over("y0", "h")
    fits = F.when(F.col("norm") == "pit", inside == area).when(F.col("norm") == "scratch", 3 * inside >= area).otherwise(2 * inside >= area)
    return _normal(spark, sf).select("image_id", "pos", fits.alias("fits"))


@query("P", "d AS (SELECT *, CAST(least(abs(y - 3), 3) AS DOUBLE) AS d FROM p)", sql="SELECT image_id, y, x, CAST(round_even((v * 100 + 128) * (1 - greatest(0.0, least(1.0, 0.3 + 0.5 * (1 - d / 3)))) + 255 * greatest(0.0, least(1.0, 0.3 + 0.5 * (1 - d / 3))), 0) AS INT) AS white FROM d")
def whiten_blend(spark, sf):
    d = F.least(F.abs(F.col("y") - 3), F.lit(3)).cast("double")
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 + 0.5 * (1 - d / 3)))
    return raster_pixels(spark, sf).select(*rasters.KEYS, F.bround((F.col("v") * 100 + 128) * (1 - a) + 255 * a, 0).cast("int").alias("white"))


@query("P", sql="SELECT p.image_id, y, x, round(CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN CAST(e.embedding[((y + 2) % 3) * 8 + (x + 2) % 3 + 1] AS DOUBLE) ELSE v END, 6) AS v FROM p JOIN embeddings e ON e.vec_id = p.image_id")
def tile_fill(spark, sf):
    def one(a):
        mask = np.zeros(a.shape, bool)
        mask[1:-1, 1:-1] = True
        out = kernels.tiled(a, a[:3, :3], mask)
        return [(y, x, round(float(out[y, x]), 6)) for y, x in np.ndindex(*a.shape)]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "y int, x int, v double")


@query("O", "N", sql="SELECT image_id, pos, CASE WHEN norm <> 'scratch' AND x0 <= 24 AND w <= 16 THEN 'telea' WHEN norm = 'scratch' AND x0 * 4 >= 96 AND w > 5 THEN 'skeleton_patches' WHEN norm = 'scratch' AND w <= 5 THEN 'thin_scratch_donor' ELSE 'donor' END AS route FROM (SELECT * FROM n WHERE norm IN ('scratch', 'pit', 'stain'))")
def repair_dispatch(spark, sf):
    n = _normal(spark, sf).where(F.col("norm").isin("scratch", "pit", "stain"))
    side = F.when(F.col("norm") == "scratch", F.col("x0") * 4).otherwise(F.col("x0"))
    return n.select("image_id", "pos", g.repair_route(F.col("norm"), side, F.col("w")).alias("route"))


@query("P", "s AS (SELECT image_id, y, x, round((v - 0.1) * (v - 0.1), 9) AS mse FROM p)", sql="SELECT image_id, CAST(r AS INT) AS rank, y, x, mse FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mse, y, x) AS r FROM s) WHERE r <= 3")
def topk_donors(spark, sf):
    s = raster_pixels(spark, sf).withColumn("mse", F.round((F.col("v") - 0.1) * (F.col("v") - 0.1), 9))
    return rasters.ranked(s, ["image_id"], [F.col("mse"), F.col("y"), F.col("x")], 3).select("image_id", "rank", "y", "x", "mse")


@query("T", "l AS (SELECT sheet, make_date(2024, CAST(split_part(arg_max(b, row), '.', 1) AS INT), CAST(split_part(arg_max(b, row), '.', 2) AS INT)) AS last FROM t WHERE a = '1-URGENT' GROUP BY sheet)",
       sql="SELECT sheet, a, month(d) || '.' || day(d) AS b FROM l, LATERAL (SELECT CAST(unnest(generate_series(last + INTERVAL 1 DAY, DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d) x, (VALUES ('first'), ('second'), ('third')) v(a)")
def schedule_gapfill(spark, sf):
    last = schedule(spark, sf).where("a = '1-URGENT'").groupBy("sheet").agg(t.schedule_date(F.max_by("b", "row"), 2024).alias("last"))
    today = F.make_date(F.lit(2024), F.lit(12), F.lit(31))
    days = last.where(F.col("last") < today).select("sheet", F.explode(F.sequence(F.date_add("last", 1), today)).alias("d"))
    rows = days.select("sheet", "d", F.explode(F.array(F.lit("first"), F.lit("second"), F.lit("third"))).alias("a"))
    return rows.select("sheet", "a", F.concat(F.month("d"), F.lit("."), F.dayofmonth("d")).alias("b"))


@query("T", sql="SELECT sheet, CAST(row AS INT) AS row, CASE WHEN trim(coalesce(a, '')) = '' THEN NULL WHEN trim(coalesce(d, '')) = '' AND d_fill IS DISTINCT FROM 255 THEN 'fill' WHEN trim(coalesce(d, '')) <> '' AND d_fill = 255 THEN 'clear' END AS action FROM t")
def schedule_status(spark, sf):
    return schedule(spark, sf).select("sheet", "row", t.status_action(F.col("a"), F.col("d"), F.col("d_fill")).alias("action"))


@query(sql="SELECT doc_id, lang || chr(9) || replace(replace(replace(text, chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n') AS line FROM documents")
def defect_log(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.concat_ws("\t", t.log_field(F.col("lang")), t.log_field(F.col("text"))).alias("line"))


@query("RECURSIVE", "P", _MASK, _LABELS, sql="SELECT image_id, CAST(label AS BIGINT) AS label, string_agg(x || ':' || y, ';' ORDER BY y, x) AS coordinates FROM c GROUP BY image_id, label")
def feature_csv_row(spark, sf):
    pts = F.array_sort(F.collect_list(F.struct("y", "x")))
    return _labelled(spark, sf).groupBy("image_id", "label").agg(F.array_join(F.transform(pts, lambda p: F.concat(p["x"], F.lit(":"), p["y"])), ";").alias("coordinates"))


@query("P", sql="SELECT image_id, round(regr_slope(v, x), 6) + 0 AS bx, round(regr_slope(v, y), 6) + 0 AS by_, round(avg(v), 6) AS mean_v FROM p WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY image_id")
def plane_fit(spark, sf):
    def one(a):
        ring = np.ones(a.shape, bool)
        ring[1:-1, 1:-1] = False
        bx, by, c = kernels.plane(a, ring)
        return [(round(bx, 6) + 0.0, round(by, 6) + 0.0, round(c + bx * 3.5 + by * 3.5, 6))]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "bx double, by_ double, mean_v double")


@query()
def detection_pipeline(spark, sf):
    from rasterlens.plans.detection import detect_vectors

    return detect_vectors(read(spark, sf, "embeddings"), "vec_id", "embedding", 8)


_ALL = "round(gap / 20 + turn / 60 + greatest(ca, cb) / 75 + offset_px / 15 + 1 - share, 6)"


@query("E", _PAIRS, _LINKS.split(",\ns AS")[0], """q AS (SELECT image_id, a_id, b_id, greatest(CAST(ceil(gap) AS INT) + 1, 2) AS n, ax, ay, bx, by_ FROM g),
z AS (SELECT a_id, b_id, list_sort(list_distinct(list_transform(range(0, n), lambda i: {'x': CAST(round_even(ax + (bx - ax) * i / (n - 1.0::DOUBLE), 0) AS BIGINT), 'y': CAST(round_even(ay + (by_ - ay) * i / (n - 1.0::DOUBLE), 0) AS BIGINT)}))) AS pts FROM q),
i AS (SELECT a_id, b_id, CASE WHEN len(pts) > 2 THEN pts[2:-2] ELSE pts END AS pts FROM z),
r AS (SELECT a_id, b_id, bool_and((t.p.x + t.p.y) % 97 <> 0) AS inside, avg(CASE WHEN (t.p.x * 13 + t.p.y * 7) % 10 >= 5 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM (SELECT a_id, b_id, unnest(pts) AS p FROM i) t GROUP BY a_id, b_id)""",
       sql=f"SELECT image_id, k.a_id, k.b_id, round(share, 6) AS share, {_ALL} AS score FROM k JOIN r ON k.a_id = r.a_id AND k.b_id = r.b_id WHERE turn <= 60 AND ca <= 75 AND cb <= 75 AND offset_px <= 15 AND inside AND share >= 0.25")
def link_proposals(spark, sf):
    """All rules of a link: geometry, containment in a mask, and the response along the gap."""

    def support(pairs: DataFrame) -> DataFrame:
        at = lambda p: (F.col("x0") + p["x"], F.col("y0") + p["y"])
        inside = F.forall("rel", lambda p: (at(p)[0] + at(p)[1]) % 97 != 0)
        strong = F.filter("rel", lambda p: (at(p)[0] * 13 + at(p)[1] * 7) % 10 >= 5)
        met = linking.sampled(pairs, 20.0, inner=True).where(inside)
        return linking.fixed(met, **{c: F.col(c) for c in pairs.columns}, inside=F.lit(True), share=F.size(strong) / F.size("rel"))

    links = linking.scores(linking.grid_pairs(endpoints(spark, sf), 20.0), 20.0, response=0.25, support=support)
    return links.select("image_id", "a_id", "b_id", F.round("share", 6).alias("share"), "score")


@query("P", _MASK, sql="SELECT image_id, round(sum(d), 6) AS total, round(max(d), 6) AS most FROM (SELECT m.image_id, m.y, m.x, sqrt(min((m.y - p.y) * (m.y - p.y) + (m.x - p.x) * (m.x - p.x))) AS d FROM m JOIN p ON p.image_id = m.image_id AND p.v < m.t GROUP BY ALL) GROUP BY image_id")
def mask_distances(spark, sf):
    def one(m):
        d = kernels.distance(m)[m]
        return [(round(float(d.sum()), 6), round(float(d.max()), 6))]

    return _over_masks(spark, sf, one, "total double, most double")


@query("O", sql="SELECT image_id, pos, greatest(x0 - 8, 0) AS \"left\", greatest(y0 - 8, 0) AS top, least(x0 + w + 8, 64) AS \"right\", least(y0 + h + 8, 64) AS bottom FROM o")
def expanded_boxes(spark, sf):
    box = g.expanded_box(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), 8, 64, 64)
    return objects(spark, sf).select("image_id", "pos", *(c.alias(n) for n, c in box.items()))


@query("O", sql="SELECT image_id, pos, greatest(y0 - x0, 0) AS source, greatest(x0 - y0, 0) AS target, CASE WHEN 40 - abs(x0 - y0) > 0 THEN 40 - abs(x0 - y0) END AS length FROM o")
def shifted_overlaps(spark, sf):
    source, target, length = g.shifted_overlap(40, F.col("x0") - F.col("y0"))
    return objects(spark, sf).select("image_id", "pos", source.alias("source"), target.alias("target"), length.alias("length"))


@query("O", "N", sql="SELECT image_id, pos, CASE norm WHEN 'scratch' THEN 'Scratch' WHEN 'pit' THEN 'Pit' WHEN 'stain' THEN 'Stain' END AS shown, norm = 'pit' AS outlined, concat_ws('_', norm, nullif(CASE WHEN pos % 2 = 0 THEN '' ELSE 'v' || pos END, '')) AS stem FROM n")
def category_names(spark, sf):
    text = F.when(F.col("pos") % 2 == 0, "").otherwise(F.concat(F.lit("v"), F.col("pos")))
    return _normal(spark, sf).select("image_id", "pos", t.display_category(F.col("norm")).alias("shown"), t.flag_of(F.col("norm"), {"pit": True, "stain": False}).alias("outlined"), t.output_stem(F.col("norm"), text).alias("stem"))


@query("O", "N", sql="SELECT count(*) FILTER (n > 0) AS processed, count(*) FILTER (n = 0) AS skipped FROM (SELECT image_id, count(*) FILTER (norm IN ('scratch', 'pit', 'stain')) AS n FROM n GROUP BY image_id)")
def skipped_images(spark, sf):
    n = _normal(spark, sf).groupBy("image_id").agg(F.count_if(F.col("norm").isin("scratch", "pit", "stain")).alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("processed"), F.count_if(F.col("n") == 0).alias("skipped"))


@query("O", sql="SELECT image_id, pos, round(x0 + w / 2.0 + dx, 6) AS cx, round(y0 + h / 2.0 - dx, 6) AS cy FROM (SELECT *, pos * 3 AS dx FROM o)")
def translated_objects(spark, sf):
    """Every point of an object moved; the mean of its corners tells the result."""
    at = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    corners = F.array(at(0, 0), at(F.col("w"), 0), at(F.col("w"), F.col("h")), at(0, F.col("h")))
    rows = objects(spark, sf).select("image_id", "pos", g.translated(corners, F.col("pos") * 3, F.col("pos") * -3).alias("p"))
    mean = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda s, p: s + p[c]) / 4, 6)
    return rows.select("image_id", "pos", mean("x").alias("cx"), mean("y").alias("cy"))


@query("E", sql="SELECT image_id, CAST(r AS INT) AS rank, id FROM (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY (x - 400) * (x - 400) + (y - 400) * (y - 400), id) AS r FROM e) WHERE r <= 12")
def nearest_points(spark, sf):
    far = (F.col("x") - 400) * (F.col("x") - 400) + (F.col("y") - 400) * (F.col("y") - 400)
    return rasters.ranked(endpoints(spark, sf), ["image_id"], [far, F.col("id")], 12).select("image_id", "rank", "id")


@query("P", sql="SELECT image_id, y, x, CASE WHEN hi > lo THEN CAST(trunc(greatest(0.0, least(255.0, (v - lo) * 255 / (hi - lo)))) AS INT) ELSE 0 END AS shown FROM p JOIN (SELECT image_id, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM p GROUP BY image_id) USING (image_id)")
def stretched_preview(spark, sf):
    def one(a):
        out = pictures.stretched(a, np.ones(a.shape, bool), 25, 75)
        return [(y, x, int(out[y, x])) for y, x in np.ndindex(*a.shape)]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "y int, x int, shown int")


@query()
def ridge_responses(spark, sf):
    """Greatest Gabor and Frangi responses of every raster, and the direction of the first."""

    def one(a):
        mask = np.ones(a.shape, bool)
        best, at = kernels.gabor(a, mask, size=7)
        ridge = kernels.frangi(a, mask, (1.0, 1.5))
        y, x = np.unravel_index(int(np.argmax(best)), a.shape)
        return [(float(best.max()), float(at[y, x]), float(ridge.max()), int((ridge > 0).sum()))]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "gabor double, angle double, frangi double, ridge_pixels int")


@query()
def skeleton_kinds(spark, sf):
    """Pixels of the three skeletons of a mask, its longest path, width and least rectangle."""

    def one(m):
        zhang, lee, cross = kernels.skeleton(m), kernels.thinned(m), kernels.morphological_skeleton(m)
        ys, xs = np.nonzero(m)
        return [(int(zhang.sum()), int(lee.sum()), int(cross.sum()), kernels.longest_path(zhang)[0], pictures.skeleton_width(m, cross), *kernels.min_area_rectangle(np.column_stack([xs, ys])))]

    return _over_masks(spark, sf, one, "zhang int, lee int, cross_ int, path double, width double, longer double, shorter double, ratio double")


@query()
def mask_regions(spark, sf):
    """Regions of a mask with their holes filled, and the greatest rectangle inside the mask."""

    def one(m):
        y, x, h, w = kernels.largest_rectangle(m)
        return [(r["y"], r["x"], int(r["mask"].sum()), r["thickness"], h * w) for r in pictures.regions({"mask": m})]

    return _over_masks(spark, sf, one, "y int, x int, area int, thickness double, rectangle int")


@query()
def linked_skeletons(spark, sf):
    """Skeletons of masks with their gaps linked: pixels before and after, ends and links."""

    def one(a):
        skel = kernels.skeleton(a >= np.percentile(a, 70))
        made, links, found = segments.linked(skel, a, np.ones(a.shape, bool), float(np.percentile(a, 40)), segments.Linking(gap=4.0, direction=60.0, connection=75.0, lateral=3.0))
        return [(int(skel.sum()), int(made.sum()), len(found), len(links))]

    return kernels.over_rasters(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, one, "before int, after int, ends int, links int")


@query()
def augmented_polygons(spark, sf):
    """Boxes of every object under each of the 56 variants: how many stay valid, with how many corners, and their mean."""
    from rasterlens.plans.pictures import turned_objects

    # a turn sees a box alone, so equal boxes are turned once and counted as often as they stand
    boxes = objects(spark, sf).groupBy("x0", "y0", "w", "h").agg(F.count("*").alias("n"))
    at = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    corners = F.array(at(0, 0), at(F.col("w"), 0), at(F.col("w"), F.col("h")), at(0, F.col("h")))
    named = boxes.select(F.concat_ws(" ", "x0", "y0", "w", "h").alias("path"), F.lit(0).alias("pos"), F.lit("box").alias("norm"), corners.alias("points"), "n")
    made = turned_objects(named, 64, 64, "n")
    total = lambda c: F.sum(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) * F.col("n"))
    corners = F.sum(F.size("points") * F.col("n"))
    return made.groupBy("angle", "flip").agg(F.sum("n").alias("objects"), F.coalesce(F.sum(F.when(F.col("points").isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("valid"), corners.alias("corners"), F.round(total("x") / corners, 3).alias("cx"), F.round(total("y") / corners, 3).alias("cy"))
