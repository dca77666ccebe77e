"""Kernels against brute force, and picture batches over written files."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlens.functions import geometry as g
from rasterlens.operators import kernels as k
from rasterlens.operators import pictures as p
from rasterlens.operators import repair, segments, synthesis
from rasterlens.plans import detection
from rasterlens.plans import pictures as plans
from rasterlens.sources import folders, sinks

RNG = np.random.default_rng


def _far(mask):
    out = np.argwhere(~mask)
    y, x = np.indices(mask.shape)
    return np.sqrt(np.min([(y - a) ** 2 + (x - b) ** 2 for a, b in out], axis=0))


def test_distances_against_all_pairs():
    for seed in range(4):
        mask = RNG(seed).random((23, 31)) > 0.15 * (seed + 1)
        assert np.allclose(k.distance(mask), _far(mask))
        slow = np.where(mask, np.inf, 0.0)
        taps = [(dy, dx, 1.0 if abs(dy) + abs(dx) == 1 else 1.4 if abs(dy * dx) == 1 else 2.1969) for dy in range(-2, 3) for dx in range(-2, 3) if (abs(dy), abs(dx)) in {(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)}]
        while True:
            wide = np.pad(slow, 2, constant_values=np.inf)
            now = np.minimum.reduce([slow, *(wide[2 + dy : 25 + dy, 2 + dx : 33 + dx] + v for dy, dx, v in taps)])
            if np.array_equal(now, slow):
                break
            slow = now
        assert np.allclose(k.chamfer(mask), slow)
    assert k.distance(np.zeros((0, 4), bool)).shape == (0, 4)


def test_skeletons_keep_the_number_of_pieces():
    for seed in range(5):
        mask = k.dilate(RNG(seed).random((30, 30)) > 0.97, k.kernel_offsets("ellipse", 5))
        n = len(np.unique(k.components(mask))) - 1
        for skel in (k.skeleton(mask), k.thinned(mask)):
            assert not (skel & ~mask).any() and len(np.unique(k.components(skel))) - 1 == n and skel.sum() < mask.sum()
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    assert k.topology(k.thinned(bar))[0] == 2 and set(np.nonzero(k.thinned(bar))[0]) == {4}


def test_ridge_filter_looks_at_its_region_only():
    a = RNG(1).random((80, 90))
    mask = np.zeros(a.shape, bool)
    mask[30:40, 30:45] = True
    other = a.copy()
    other[:15], other[60:] = 9.0, 9.0
    assert np.array_equal(k.frangi(a, mask, (1.0, 2.0)), k.frangi(other, mask, (1.0, 2.0)))
    line = np.zeros((40, 40))
    line[20] = 1.0
    assert k.frangi(line, np.ones(line.shape, bool), (1.0,))[20].min() > k.frangi(line, np.ones(line.shape, bool), (1.0,))[10].max()


def test_reasons_of_the_rule_chain(spark):
    rows = spark.createDataFrame([(5.0, 9.0, 0.9), (50.0, 0.1, 0.1), (20.0, 2.0, 0.9), (20.0, 4.0, 0.2), (20.0, 4.0, 0.9)], "n double, a double, l double")
    got = [tuple(r) for r in rows.select(*g.candidate(F.col("n"), F.col("a"), F.col("l")).values()).collect()]
    assert got == [
        (False, "below_minimum", "path_length_below_minimum"), (True, "long", "long_candidate_passed"), (False, "short", "short_longest_path_aspect_ratio_too_low"),
        (False, "short", "short_linearity_too_low"), (True, "short", "short_candidate_passed"),
    ]


def test_rename_numbers_stop_at_999(spark):
    rows = spark.range(3).withColumn("folder", F.lit("a"))
    got = [(r.number, r.valid) for r in g.numbered(rows, "folder", ["id"], start=998).orderBy("id").collect()]
    assert got == [("998", True), ("999", True), (None, False)]
    for bad in ({"digits": 4}, {"start": 0}):
        with pytest.raises(ValueError):
            g.numbered(rows, "folder", ["id"], **bad)


def test_gap_between_two_dashes_is_linked_unless_a_rule_says_no():
    skel = np.zeros((16, 24), bool)
    skel[8, 2:9], skel[8, 12:20] = True, True
    response, mask = np.ones(skel.shape), np.ones(skel.shape, bool)
    made, links, found = segments.linked(skel, response, mask, 0.5)
    assert len(found) == 4 and len(links) == 1 and made[8, 2:20].all() and made.sum() == 18
    assert math.isclose(links[0][0], 4 / 20, abs_tol=1e-9)
    assert segments.linked(skel, response * 0, mask, 0.5)[1] == []
    gone = mask.copy()
    gone[8, 10] = False
    assert segments.linked(skel, response, gone, 0.5)[1] == []
    assert np.array_equal(segments.linked(skel, response, mask, 0.5, segments.Linking(enabled=False))[0], skel)
    assert segments.between(0, 4, 1, 0).tolist() == [[0, 3], [0, 4], [1, 0], [1, 1]]
    with pytest.raises(ValueError):
        segments.Linking(gap=0)


def test_selected_links_are_a_least_forest():
    rng = RNG(5)
    links = [(float(rng.random()), *sorted(rng.choice(12, 2, replace=False).tolist())) for _ in range(40)]
    part = list(range(12))
    got = segments.selected(links, part, mutual=False)
    used, root, want = set(), list(range(12)), []
    for x in sorted(links):
        if x[1] in used or x[2] in used or root[x[1]] == root[x[2]]:
            continue
        used |= {x[1], x[2]}
        root = [root[x[1]] if r == root[x[2]] else r for r in root]
        want.append(x)
    assert got == want
    mutual = segments.selected(links, part)
    best = lambda e: min(x for x in links if e in x[1:])
    assert {x for x in mutual} <= {x for x in links if best(x[1]) == best(x[2]) == x}


def test_verdicts_cut_skeletons():
    skel = np.zeros((9, 9), bool)
    skel[1, 1:8] = skel[5, 1:8] = skel[4, 4] = True
    label = np.where(skel, np.where(np.indices(skel.shape)[0] < 3, 1, 2), 0)
    paths = {2: [(5, x) for x in range(1, 8)]}
    got = segments.filtered(label, skel, paths, {1: "long", 2: "short"})
    assert got[1].sum() == 7 and got[5].sum() == 7 and not got[4, 4]
    assert segments.filtered(label, skel, paths, {2: "short"}, enabled=False)[4, 4]


def test_correlation_maps_against_loops():
    rng = RNG(2)
    a, tap, mask = rng.random((12, 14)), rng.random((4, 5)), rng.random((4, 5)) > 0.4
    mse, (mean, spread) = repair.masked_mse(a, tap, mask), repair.masked_mean_spread(a, mask)
    for y in range(9):
        for x in range(10):
            win = a[y : y + 4, x : x + 5]
            assert math.isclose(mse[y, x], ((win - tap)[mask] ** 2).mean(), abs_tol=1e-9)
            assert math.isclose(mean[y, x], win[mask].mean(), abs_tol=1e-9) and math.isclose(spread[y, x], win[mask].std(), abs_tol=1e-7)
    places = {tuple(c) for c in synthesis.valid_corners(a > 0.2, mask).tolist()}
    assert places == {(y, x) for y in range(9) for x in range(10) if (a[y : y + 4, x : x + 5] > 0.2)[mask].all()}


def _scene(h=160, w=200):
    rng = RNG(0)
    base = np.clip(120 + 20 * np.sin(np.arange(w) / 9)[None, :, None] + rng.normal(0, 3, (h, w, 3)), 0, 255).astype(np.uint8)
    silver = np.zeros((h, w), bool)
    silver[4:-4, 4:-4] = True
    return base, silver


def test_repair_removes_defects_and_leaves_the_rest():
    base, silver = _scene()
    marks = {c: np.zeros(silver.shape, bool) for c in ("scratch", "pit", "stain")}
    for i in range(110):
        marks["scratch"][60 + i // 4 : 68 + i // 4, 50 + i] = True
    marks["pit"][120:125, 30:36] = True
    marks["stain"][15:40, 20:50] = True
    bad = base.copy()
    for m in marks.values():
        bad[m] = 255
    none = np.zeros(silver.shape, bool)
    made, log = repair.repaired(bad, silver, none, list(marks.items()), repair.Repair(margin=80, inset=6))
    assert [x[4] for x in log] == ["donor", "skeleton_patches", "telea"]
    for m in marks.values():
        assert np.abs(made[m].astype(float) - base[m]).mean() < 25
    far = ~k.dilate(np.logical_or.reduce(list(marks.values())), k.kernel_offsets("ellipse", 23))
    assert np.array_equal(made[far], bad[far])
    again = repair.repaired(bad, silver, none, list(marks.items()), repair.Repair(margin=80, inset=6))[0]
    assert np.array_equal(made, again)
    with pytest.raises(ValueError):
        repair.repaired(bad, silver, silver, [("stain", marks["stain"])], repair.Repair(inset=6))


def test_tiles_cover_and_frames_follow():
    mask = k.dilate(segments.line((30, 40), 3, 3, 35, 25), k.kernel_offsets("ellipse", 5))
    skel = k.morphological_skeleton(mask)
    bare = mask.copy()
    for y, x in repair.cover(mask, skel, 9):
        bare[max(0, y - 4) : y + 5, max(0, x - 4) : x + 5] = False
    assert not bare.any()
    t, n, _ = repair.frame_at(np.argwhere(skel), 14, 19, 12)
    assert abs(t @ np.array([32, 22]) / math.hypot(32, 22)) > 0.98 and abs(t @ n) < 1e-9
    scene = repair.Scene(np.zeros((30, 40, 3), np.uint8), mask, mask)
    y, x = repair.gather(scene, 14, 19, 5, 5, 20)
    assert not mask[y, x].any() and len(set(zip(y.ravel(), x.ravel(), strict=True))) == 25
    picks = [repair.soft_choice(np.array([5.0, 1.0, 9.0, 2.0]), 2, RNG(i)) for i in range(40)]
    assert set(picks) == {1, 3}


def test_synthesis_respects_its_regions():
    import random

    base, silver = _scene()
    avoided = np.zeros(silver.shape, bool)
    avoided[60:100, 60:120] = True
    shapes = [("Pit", [(10, 10), (16, 10), (16, 15), (10, 15)]), ("Scratch", [(20, 20), (60, 22), (60, 25), (20, 23)]), ("Stain", [(30, 40), (45, 40), (42, 52)]), ("Pit", [(1, 1), (2, 2)])]
    found = synthesis.patches("a", base, shapes)
    assert sorted((x.category, x.index) for x in found) == [("Pit", 1), ("Scratch", 1), ("Stain", 1)]
    made, masks = synthesis.synthesised(base, silver, avoided, found, 3, 5.0)
    for category, mask in masks:
        assert mask.any() and not (mask & avoided).any() and not (mask & ~silver).any()
    assert sum(m.sum() for _, m in masks) == np.logical_or.reduce([m for _, m in masks]).sum()
    rest = ~np.logical_or.reduce([m for _, m in masks])
    assert np.array_equal(made[rest], base[rest])
    white, _ = synthesis.synthesised_white(base, silver, avoided, found, 3, {"Pit": 1.0, "Scratch": 0.5, "Stain": 0.2}, {"Pit": 0.0, "Scratch": 0.5, "Stain": 0.1})
    assert white.mean() > made.mean()
    with pytest.raises(ValueError):
        synthesis.placed(found[0], silver & False, silver & False, avoided, avoided, random.Random(1), 5)
    bag = synthesis.Bag(list(range(7)), random.Random(2))
    drawn = [bag.draw(3) for _ in range(4)]
    assert len({*drawn[0], *drawn[1]}) == 6 and len({*drawn[2], *drawn[3]}) == 6


def test_whitening_is_strongest_on_the_skeleton():
    mask = np.zeros((20, 30), bool)
    mask[5:14, 4:26] = True
    alpha, skel = p.whitening(mask, 0.2, 0.5), k.morphological_skeleton(mask[5:14, 4:26])
    assert np.allclose(alpha[5:14, 4:26][skel], 0.7) and not alpha[~mask].any() and math.isclose(alpha[mask].min(), 0.2)
    image = np.full((20, 30, 3), 100, np.uint8)
    out = p.whitened(image, [("pit", mask), ("other", ~mask)], {"pit": 0.2}, {"pit": 0.5})
    assert (out[~mask] == 100).all() and (out[mask] == np.rint(100 * (1 - alpha[mask]) + 255 * alpha[mask])[:, None]).all()
    with pytest.raises(ValueError):
        p.checked_strengths({"pit": 0.1}, ("pit", "stain"))


def test_turns_centres_and_crops():
    a = RNG(3).integers(0, 255, (20, 20, 3)).astype(np.uint8)
    assert np.array_equal(p.rotated(a, 360), a) and np.array_equal(p.rotated(a, 180), a[::-1, ::-1])
    assert np.array_equal(p.rotated(a, 90)[1:-1, 1:-1], np.rot90(a)[1:-1, 1:-1])
    box = [(2.0, 3.0), (9.0, 3.0), (9.0, 7.0), (2.0, 7.0)]
    for angle, flip in plans.VARIANTS:
        pts = k.turned_polygon(box, angle, flip, 20, 20)
        x, y = zip(*pts, strict=True)
        assert min(x) >= -1e-9 and max(x) <= 19 + 1e-9 and min(y) >= -1e-9 and max(y) <= 19 + 1e-9
    assert k.turned_polygon(box, 0, "hflip", 20, 20)[0] == (17.0, 3.0) and k.turned_polygon(box[:2], 0, None, 20, 20) is None
    assert p.rectangle_centre([box]) == (5.5, 5.0)
    mask = np.zeros((20, 20), bool)
    mask[3:8, 2:10] = True
    made = p.centred(a, mask, 4, 5)
    assert np.array_equal(made[8:13, 6:14], a[3:8, 2:10]) and made.sum() == a[3:8, 2:10].sum()
    with pytest.raises(ValueError):
        p.centred(a, mask, -3, 0)
    assert p.cropped([a], mask, 1)[0].shape == (7, 10, 3)
    assert p.assembled(a, a[:5], (1, 6)).shape == (20, 25, 3) and np.array_equal(p.upright(a, 6), np.rot90(a, 3))
    assert p.pasted((20, 20), mask, 30, 0) is None and p.pasted((20, 20), mask, -2, -3)[0].sum() == 40
    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    assert [r["mask"].sum() for r in p.regions({"a": ring})] == [81]
    assert p.inset(mask, 1).sum() < mask.sum() and p.fill_floats([[(2, 3), (9, 3), (9, 7), (2, 7)]], 20, 20)[4:7, 3:9].all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    base, _ = _scene(96, 120)
    square = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    for i in range(3):
        image = base.copy()
        image[40 + i : 42 + i, 30:90] = 255
        (root / f"{i:03d}.png").write_bytes(sinks.png(image))
        objects = [("Silver box", square(6, 5, 100, 84)), ("scratch", square(30, 39 + i, 60, 4)), ("Clean area", square(20, 60, 40, 20)), ("pit", square(80, 70, 6, 6))]
        (root / f"{i:03d}.json").write_text(json.dumps({"info": {"folder": "x", "name": "y.png"}, "objects": [{"category": c, "segmentation": s} for c, s in objects]}))
    return root


@pytest.fixture(scope="module")
def batch(spark, folder):
    images = spark.read.format("image").load(str(folder / "*.png"))
    objects = folders.annotation_objects(folders.annotations(spark, str(folder)))
    return images, objects, plans.annotated(images, objects)


def test_detection_over_a_folder(spark, batch):
    images, objects, _ = batch
    how = detection.Detection(background_size=31, gabor_size=9, least_length=8.0)
    rows = detection.detect_folder(images, objects, how).collect()
    assert {r.origin[-7:] for r in rows} == {"000.png", "001.png", "002.png"}
    best = max(rows, key=lambda r: r.path_length)
    assert best.kept and best.path_length >= 40 and best.reason in ("long_candidate_passed", "short_candidate_passed")
    plain = detection.detect_folder(images, objects, detection.Detection(ridge=False, threshold=False, thinning=False, erosion=False, background=False, rules=False)).collect()
    assert {r.reason for r in plain} == {"filter_disabled"} and {r.area for r in plain} == {101 * 85}
    with pytest.raises(Exception, match="no usable polygon"):
        detection.detect_folder(images, objects, detection.Detection(category="silver box")).collect()
    for bad in ({"method": "x"}, {"skeleton": "x"}, {"ratio": 0}, {"sigmas": ()}, {"erosion_size": 2}):
        with pytest.raises(ValueError):
            detection.Detection(**bad)


def test_detection_of_a_large_picture():
    gray = RNG(0).normal(100, 1, (1024, 1024))
    gray[500:503, 200:800] += 40
    found = detection.found(gray, np.ones(gray.shape, bool), detection.Detection(gabor_size=9, background_size=51, percentile=99.8))
    assert max(r[13] for r in found.rows) >= 550


def test_picture_batches(spark, batch, tmp_path):
    images, objects, pics = batch
    with_, skipped = plans.with_defects(pics)
    assert with_.count() == 3 and skipped.first().skipped == 0
    strength = {c: 0.5 for c in plans.DEFECTS}
    white = plans.whitened(pics, strength, strength)
    assert white.count() == 3
    patch = plans.clean_patch(pics)
    assert patch.shape[2] == 3 and patch.shape[0] * patch.shape[1] >= 38 * 18
    for made in (plans.uniform(pics, patch, 8), plans.blackened(pics), plans.centred(pics)):
        assert {(r.height, r.width) for r in made.select("height", "width").collect()} == {(96, 120)}
    fixed = plans.repaired(pics, repair.Repair(margin=40, inset=4)).collect()
    assert len(fixed) == 3 and all(r.log for r in fixed)
    found = plans.defect_patches(pics)
    assert found.groupBy("category").count().collect() and found.where("category = 'Pit'").count() == 3
    made = plans.synthesised(pics, found, "Pit", base={"Pit": 0.5}, gradient={"Pit": 0.5}, outlines={"Pit": True}).collect()
    assert len(made) == 3 and all(len({x.split("\t")[1] for x in r.log}) == 3 for r in made)
    turned = plans.augmented(pics.limit(1)).select("name").collect()
    assert len(turned) == 56 and turned[0].name == "000_aug_r000_vflip.png" or len({r.name for r in turned}) == 56
    notes = plans.augmented_objects(objects, 120, 96)
    assert notes.count() == 3 * 4 * 56 and notes.where("error is not null").count() == 0
    assert notes.where("norm = 'silver_box' and not moved").count() == 0
    both = plans.side_by_side(images, images).collect()
    assert {(r.height, r.width) for r in both} == {(96, 240)}
    rows = white.select("name", "height", "width", "nChannels", "data")
    out = sinks.write_results(rows, rows, str(tmp_path / "out")).collect()
    assert len(out) == 6
    back = spark.read.format("image").load(str(tmp_path / "out" / "compared" / "*.png"))
    assert {(r.image.height, r.image.width) for r in back.collect()} == {(96, 240)}


def test_small_sinks(spark, folder, tmp_path):
    files = folders.listing(spark, str(folder))
    pairs = folders.strict_pairs(files).select(F.regexp_replace("image_path", "^file:", "").alias("image_path"), F.regexp_replace("json_path", "^file:", "").alias("json_path"))
    target = tmp_path / "group"
    target.mkdir()
    (target / "old.txt").write_text("x")
    assert sinks.copy_group(pairs, str(target), each=3) == 6 and (target / "000.json").read_bytes() == (folder / "000.json").read_bytes()
    with pytest.raises(RuntimeError):
        sinks.copy_group(pairs, str(target), each=20)
    assert sinks.parameter_folder(str(tmp_path), "gabor", {"size": 31, "sigma": 3.0}).endswith("gabor_size-31_sigma-3.0")
    assert "n: 3" in sinks.summary(spark.range(3).agg(F.count("*").alias("n")), "counted")
    notes = spark.createDataFrame([(str(target / "000.json"), (target / "000.json").read_text())], "path string, raw string")
    sinks.rewrite_in_place(notes, "scratch").collect()
    assert [o["category"] for o in json.loads((target / "000.json").read_text())["objects"]] == ["Silver box", "Clean area", "pit"]
    assert {r.folder for r in folders.missing_folders(spark, files, [folder.name, "x", "y"]).collect()} == {"x", "y"}
    names = spark.createDataFrame([("p", "f", "001_aug_r020.png", "001_aug_r020", ".png"), ("p", "f", "001.png", "001", ".png")], "path string, folder string, name string, stem string, suffix string")
    assert [(r.source, r.angle) for r in folders.augmented_only(names).collect()] == [("001", 20)]
    with pytest.raises(Exception, match="angle"):
        folders.augmented_only(names.withColumn("stem", F.lit("001_aug_r030"))).collect()
    sheet = spark.createDataFrame([(1, "x"), (2, " "), (3, "y"), (4, None)], "row int, a string")
    assert [r.row for r in folders.sheet_rows(sheet).orderBy("row").collect()] == [1, 2, 3]
    pts = spark.sql("select array(array('1','2'), array('a','2'), array('3'), array('4','5'), array('6','7')) s")
    assert len(pts.select(g.points(F.col("s")).alias("p")).first().p) == 3
    with pytest.raises(Exception):
        pts.select(g.points(F.col("s"), lenient=False).alias("p")).collect()


def test_previews_and_textures():
    a = RNG(4).integers(0, 255, (30, 40, 3)).astype(np.uint8)
    mask = np.zeros((30, 40), bool)
    mask[5:20, 6:30] = True
    assert set(map(tuple, p.contours(a, [(mask, (255, 0, 0))])[p.outline(mask)].tolist())) == {(255, 0, 0)}
    assert p.stretched(np.ones((4, 4)), np.ones((4, 4), bool)).sum() == 0 and p.shown(np.array([-200.0, 0, 200]), True).tolist() == [0, 128, 255]
    assert (p.red_annotation(a, mask) != a).any() and p.outside_black(a, mask)[~mask].sum() == 0
    low, grad, energy = p.texture(np.full((20, 20, 3), 90, np.uint8))
    assert grad.max() == 0 and energy.max() == 0 and low.min() == low.max()
    gray = a[..., 0].astype(float)
    assert p.subtracted(np.full((9, 9), 50.0), np.ones((9, 9), bool), 5).tolist() == [[128] * 9] * 9
    assert p.scaled_response(gray, mask, 4, 7, 2.0, 4.0, 0.5)[mask].max() == 255
    c = k.plane(np.add.outer(np.arange(5) * 2.0, np.arange(6) * 3.0) + 1, np.ones((5, 6), bool))
    assert np.allclose(c, [3, 2, 1])


def test_many_polygons_are_turned_as_one_by_one(spark):
    rng = RNG(8)
    shapes = [[tuple(q) for q in rng.uniform(-6, 30, (n, 2)).tolist()] for n in (0, 2, 3, 4, 4, 5, 9, 3)] + [[(2.0, 3.0), (9.0, 3.0), (9.0, 7.0), (2.0, 7.0)], [(40.0, 40.0), (50.0, 40.0), (50.0, 50.0)], None]
    want = {(str(i), a, f): k.turned_polygon(s or [], a, f, 20, 24) for i, s in enumerate(shapes) for a, f in plans.VARIANTS}
    rows = spark.createDataFrame([(str(i), i, "pit", s, i + 10) for i, s in enumerate(shapes)], "path string, pos int, norm string, points array<struct<x:double,y:double>>, n long")
    got = plans.turned_objects(rows, 20, 24, "n").collect()
    assert len(got) == len(want) and all(r.n == r.pos + 10 for r in got)
    for r in got:
        assert (None if r.points is None else [tuple(q) for q in r.points]) == want[r.path, r.angle, r.flip]


def test_equal_boxes_are_turned_once(spark, monkeypatch):
    from rasterlens import catalogue

    sent, real = [], plans.turned_objects
    monkeypatch.setattr(plans, "turned_objects", lambda rows, *how: sent.append(rows) or real(rows, *how))
    got = catalogue.augmented_polygons(spark, "/root/testdata/sf0.001").collect()
    things = catalogue.objects(spark, "/root/testdata/sf0.001")
    assert sent[0].count() == things.select("x0", "y0", "w", "h").distinct().count() and {r.objects for r in got} == {things.count()} and len(got) == 56
