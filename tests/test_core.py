from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlens import catalogue
from rasterlens.functions import geometry as g
from rasterlens.functions import text as t
from rasterlens.operators import kernels as k
from rasterlens.operators import linking, rasters
from rasterlens.plans.detection import Detection, features

SF = "/root/testdata/sf0.001"


def _same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    if cols != sorted(b.columns) or len(a) != len(b):
        return False
    show = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(v) if isinstance(v, (str, bool, np.bool_)) else f"{float(v):.5f}"
    sort = lambda d: sorted(tuple(show(v) for v in r) for r in d[cols].itertuples(index=False))
    return sort(a) == sort(b)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert _same(catalogue.QUERIES[name](spark, SF).toPandas(), c.sql(catalogue.ORACLES[name]).df())


def test_category_text(spark):
    rows = spark.createDataFrame([("\t Silver  box\n", 1), ("__pit_", 2), (None, 3), ("", 4)], "s string, i int")
    assert [r.n for r in rows.select(t.normal_category(F.col("s")).alias("n"), "i").orderBy("i").collect()] == ["silver_box", "pit", "none", ""]


def test_dates(spark):
    cells = [("3.4", "2024-03-04"), ("1.2-3.4", "2024-03-04"), ("3.1-4", "2024-03-04"), ("x", None), ("13.40", None), (None, None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cells)], "i int, c string")
    got = [r.d for r in rows.select(t.schedule_date(F.col("c"), 2024).cast("string").alias("d"), "i").orderBy("i").collect()]
    assert got == [d for _, d in cells]


def test_rotation_by_quarters(spark):
    x, y = g.rotated(F.lit(3), F.lit(5), F.lit(180), F.lit(10), F.lit(8))
    assert spark.range(1).select(x.alias("x"), y.alias("y")).first() == (6.0, 2.0)


def _raster(*lines: str) -> np.ndarray:
    return np.array([[c == "#" for c in line] for line in lines])


def test_hysteresis_keeps_touching_weak_pixels():
    a = np.array([[0, 0.5, 0], [0.5, 1.0, 0.5], [0, 0.5, 0], [0, 0, 0], [0.5, 0, 0]])
    full = np.ones(a.shape, bool)
    assert k.hysteresis(a, full, 100, 0.4)[0].sum() == 5
    diamond = np.array([[0, 0.5, 0], [0.5, 0, 1.0], [0, 0.5, 0]])
    assert k.hysteresis(diamond, np.ones((3, 3), bool), 100, 0.4, connectivity=8)[0].sum() == 4
    assert k.hysteresis(diamond, np.ones((3, 3), bool), 100, 0.4, connectivity=4)[0].sum() == 1
    assert not k.hysteresis(np.zeros((3, 3)), np.ones((3, 3), bool))[0].any()


def test_paths_and_rectangles():
    line = np.zeros((8, 8), bool)
    line[2, 1:7] = True
    assert k.longest_path(line)[0] == 6
    diagonal = np.eye(8, dtype=bool)[:4]
    assert math.isclose(k.longest_path(np.pad(diagonal, ((0, 4), (0, 0))))[0], 3 * math.sqrt(2) + 1)
    one = np.zeros((8, 8), bool)
    one[3, 3] = True
    assert k.longest_path(one)[0] == 1
    assert k.min_area_rectangle(np.argwhere(one)) == (1.0, 1.0, 1.0)
    assert k.min_area_rectangle(np.argwhere(line))[:2] == (6.0, 1.0)
    assert k.largest_rectangle(_raster("##..", "####", "####")) == (1, 0, 2, 4)


def test_distance_against_brute_force():
    rng = np.random.default_rng(1)
    m = rng.random((9, 7)) < 0.8
    m[0, 0] = False
    zero = np.argwhere(~m)
    want = np.array([[np.sqrt(((zero - (y, x)) ** 2).sum(1)).min() for x in range(7)] for y in range(9)])
    assert np.allclose(k.distance(m), want)
    assert np.abs(k.chamfer(m) - want).max() < 0.4


def test_morphology():
    m = _raster(".....", ".###.", ".###.", ".###.", ".....")
    cross = k.kernel_offsets("cross", 3)
    assert k.erode(m, cross, outside=False).sum() == 1
    assert k.dilate(k.erode(m, cross, outside=False), cross).sum() == 5
    assert k.skeleton(m).sum() >= 1
    assert k.morphological_skeleton(m).any()


def test_fill_union_and_parity():
    a, b = [(1, 1), (5, 1), (5, 5), (1, 5)], [(3, 3), (8, 3), (8, 8), (3, 8)]
    union = k.fill_polygons([a, b], 12, 12)
    assert union.sum() == 25 + 36 - 9
    assert k.fill_polygons([a, b], 12, 12, even_odd=True).sum() < union.sum()
    assert not k.fill_polygons([[(1, 1), (2, 2)]], 5, 5).any()


def test_background_and_ridges():
    flat = np.full((32, 32), 7.0)
    back, rest = k.corrected(flat, np.ones((32, 32), bool), 9)
    assert np.allclose(back, 7) and np.allclose(rest, 0)
    lined = flat.copy()
    lined[16, 4:28] += 50
    mask = np.ones((32, 32), bool)
    for r in (k.gabor(lined - 7, mask, size=9)[0], k.frangi(lined, mask, dark=False)):
        assert r[16, 10:20].mean() > 4 * r[4, 10:20].mean()


def test_polygon_clip_and_rotation():
    assert sorted(k.clip_polygon([(-2.0, 1.0), (2.0, 1.0), (2.0, 3.0), (-2.0, 3.0)], 5, 5)) == [(0.0, 1.0), (0.0, 3.0), (2.0, 1.0), (2.0, 3.0)]
    assert np.allclose(k.rotate_points([(3, 5)], 360, 10, 8), [(3, 5)])


def test_features_of_a_line():
    a = np.zeros((16, 16))
    a[8, 2:14] = 200
    rows = features(a, np.ones(a.shape, bool), Detection(background_size=5, gabor_size=5, percentile=90.0))
    assert rows and max(r[12] for r in rows) >= 10
    with pytest.raises(ValueError):
        Detection(method="other")


def test_kernel_and_relational_labels_agree(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(20)
    mask = rasters.threshold_by_percentile(rasters.pixels(vectors, "vec_id", "embedding", 8), 0.7).where("v >= t")
    one = {tuple(r) for r in rasters.component_labels(mask).collect()}
    two = {tuple(r) for r in k.labelled(vectors, "vec_id", "embedding", 8, 0.7).collect()}
    assert one == two


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_copy_objects_asks_every_folder(spark, monkeypatch):
    whole = catalogue.QUERIES["copy_objects"](spark, SF).count()
    read = catalogue.read
    many = spark.range(-2000, 25, 1, 1).select(F.col("id").cast("int").alias("n_nationkey"))
    monkeypatch.setattr(catalogue, "read", lambda s, sf, name: many if name == "nation" else read(s, sf, name))
    assert catalogue.QUERIES["copy_objects"](spark, SF).count() == whole > 0


def _some_ends(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, i // 2, int(x), int(y), math.cos(t), math.sin(t)) for i, (x, y, t) in enumerate(zip(rng.integers(-60, 60, n), rng.integers(-60, 60, n), rng.random(n) * math.pi, strict=True))]
    return rows, spark.createDataFrame(rows, "id long, image_id long, component_id long, x long, y long, tx double, ty double")


def _is_dealt(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and not any("im#" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)


def test_grid_pairs_are_all_pairs_and_neither_side_is_broadcast(spark):
    rows, ends = _some_ends(spark)
    met = linking.grid_pairs(ends, 20.0)
    got = {(r.a, r.b) for r in met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[0] < q[0] and p[2] != q[2] and math.dist(p[3:5], q[3:5]) <= 20}
    assert got == want and met.count() == len(want) and _is_dealt(met)


def test_mutual_best_is_the_best_of_both_ends(spark):
    links = [(1, 5, 9, 0.5), (1, 5, 7, 0.5), (1, 7, 9, 0.25), (2, 5, 9, 0.5), (2, 5, 7, 0.5), (2, -8, 7, 0.500001), (2, 9, 2**62, 3.25), (3, -4, -3, 0.0), (3, -5, -4, 0.0), (3, -6, -5, 0.000001)]
    got = linking.mutual_best(spark.createDataFrame(links, "image_id long, a_id long, b_id long, score double")).collect()
    best = lambda im, e: min((s, a, b) for i, a, b, s in links if i == im and e in (a, b))
    want = {(i, a, b, s) for i, a, b, s in links if best(i, a) == best(i, b) == (s, a, b)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_mutual_links_keep_all_columns_of_their_scores(spark):
    _, ends = _some_ends(spark)
    scored = linking.scores(linking.grid_pairs(ends, 20.0), 20.0).toPandas()
    best = {(r.image_id, r.a_id, r.b_id) for r in linking.mutual_best(linking.scores(linking.grid_pairs(ends, 20.0), 20.0)).collect()}
    want = {tuple(r) for r in scored.itertuples(index=False) if (r.image_id, r.a_id, r.b_id) in best}
    made = linking.mutual_links(ends, 20.0)
    assert {tuple(r) for r in made.collect()} == want and want and made.columns == list(scored.columns)


def test_sample_points_are_looked_up_by_their_way(spark):
    _, ends = _some_ends(spark, 120)
    pairs = linking.grid_pairs(ends, 20.0)
    for inner in (False, True):
        some = linking.sampled(pairs, 20.0, inner)
        for r in some.collect():
            n = max(math.ceil(r.gap) + 1, 2)
            want = sorted({(round(r.a.x + (r.b.x - r.a.x) * i / (n - 1.0)), round(r.a.y + (r.b.y - r.a.y) * i / (n - 1.0))) for i in range(n)})
            want = want[1:-1] if inner and len(want) > 2 else want
            assert [(r.x0 + p.x, r.y0 + p.y) for p in r.rel] == want
