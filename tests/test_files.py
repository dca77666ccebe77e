from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlens.sources import folders, sinks


def _touch(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}")


def _plain(rows):
    return sorted((r.name, os.path.basename(r.json_path) if r.json_path else None) for r in rows.collect())


def test_pairs_ignore_case_and_report_missing(spark, tmp_path):
    _touch(tmp_path, "A.PNG", "a.json", "b.jpg", "c.json", "d.txt", "e.f.webp", "E.F.JSON")
    files = folders.listing(spark, str(tmp_path))
    assert _plain(folders.pairs(files)) == [("A.PNG", "a.json"), ("b.jpg", None), ("e.f.webp", "E.F.JSON")]
    with pytest.raises(ValueError, match="b.jpg"):
        folders.strict_pairs(files)
    assert {r.name: (r.stem, r.suffix) for r in files.collect()}["e.f.webp"] == ("e.f", ".webp")


def test_image_lookup_prefers_exact_suffixes(spark, tmp_path):
    _touch(tmp_path, "a.json", "a.PNG", "a.tif", "b.json", "b.JPG", "c.json", "d.json", "d.png", "d.bmp")
    got = {r.stem: r.image_path and os.path.basename(r.image_path) for r in folders.found_for(folders.listing(spark, str(tmp_path))).collect()}
    assert got == {"a": "a.tif", "b": "b.JPG", "c": None, "d": "d.bmp"}


def test_grid_runs_and_augmented_names(spark, tmp_path):
    _touch(tmp_path, "g1/Pit/x.png", "g1/Pit/y.png", "g2/Stain/z.png", "g2/Stain/z_aug_r020.png")
    files = folders.listing(spark, str(tmp_path), recursive=True)
    got = {(r.grp, r.category): r.n_files for r in folders.folder_grid(spark, files, ["g1", "g2"], ["Pit", "Stain"]).collect()}
    assert got == {("g1", "Pit"): 2, ("g1", "Stain"): 0, ("g2", "Pit"): 0, ("g2", "Stain"): 2}
    assert sorted(r.name for r in folders.sources_only(files).collect()) == ["x.png", "y.png", "z.png"]
    assert [(r.name, r.keyword) for r in folders.run_files(files, ["AUG", "z"]).orderBy("name").collect()] == [("z.png", "z"), ("z_aug_r020.png", "AUG")]


def test_annotations(spark, tmp_path):
    docs = {
        "ok": {"objects": [{"category": " Silver  Box ", "segmentation": [[0, 0], [1, "2.5"], [3], ["x", 1], [4, 5, 6], 7]}, 5, {"segmentation": "no"}]},
        "empty": {"objects": []},
        "nolist": {"objects": {}},
        "root": [1],
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    notes = folders.annotations(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.error for r in notes.select("path", "error").collect()} == {
        "ok.json": None, "empty.json": None, "nolist.json": "objects is no list", "root.json": "root is no object", "bad.json": "not JSON",
    }
    got = sorted((r.pos, r.category, r.norm, [(p.x, p.y) for p in r.points]) for r in folders.annotation_objects(notes).where("pos = 0").collect())
    assert got == [(0, " Silver  Box ", "silver_box", [(0.0, 0.0), (1.0, 2.5), (4.0, 5.0)])]
    assert [len(r.points) for r in folders.annotation_objects(notes).where("pos = 2").collect()] == [0]
    with pytest.raises(Exception, match="no"):
        folders.annotations(spark, str(tmp_path), strict=True).select(F.to_json("doc")).collect()


def test_images_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    kept = {f"i{k}": rng.integers(0, 256, (5 + k, 7, c), np.uint8) for k, c in enumerate((3, 1, 3))}
    rows = spark.createDataFrame([(n, *a.shape, bytearray(a.tobytes())) for n, a in kept.items()], "name string, height int, width int, nChannels int, data binary")
    assert len(sinks.write_images(rows, str(tmp_path)).collect()) == 3
    assert sorted(os.listdir(tmp_path)) == ["i0.png", "i1.png", "i2.png"]
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        name = os.path.basename(r.origin)[:-4]
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
        assert (got == kept[name]).all()
    with pytest.raises(ValueError):
        sinks.png(np.zeros((0, 3), np.uint8))
    with pytest.raises(ValueError):
        sinks.beside(np.zeros((2, 3), np.uint8), np.zeros((3, 3), np.uint8))


def test_rewrites_keep_other_keys(spark, tmp_path):
    doc = {"z": 1, "name": "old", "info": {"b": "é", "name": "x.JPG"}, "objects": [{"category": "Silver box"}, {"category": "pit"}, 3], "a": None}
    df = spark.createDataFrame([(json.dumps(doc), "f", "007"), (None, "f", "008")], "raw string, folder string, stem string")
    got = [r[0] for r in df.select(sinks.placed(F.col("raw"), F.col("folder"), F.col("stem"))).collect()]
    assert got[1] is None and got[0].endswith("\n") and "é" in got[0]
    assert list(json.loads(got[0])) == ["z", "info", "objects", "a"] and json.loads(got[0])["info"] == {"b": "é", "name": "007.JPG", "folder": "f"}
    only = df.select(sinks.only_category(F.col("raw"), "silver_box").alias("text")).first().text
    assert json.loads(only)["objects"] == [{"category": "Silver box"}] and '\n    "z"' in only
    sinks.write_texts(spark.createDataFrame([(f"{tmp_path}/d/x.json", only)], "path string, text string")).collect()
    assert (tmp_path / "d/x.json").read_text() == only and os.listdir(tmp_path / "d") == ["x.json"]


def test_run_folders_and_reports(spark, tmp_path):
    (tmp_path / "007").mkdir()
    (tmp_path / "x9").mkdir()
    assert os.path.basename(sinks.run_folder(str(tmp_path))) == "008"
    with pytest.raises(RuntimeError):
        sinks.run_folder(str(tmp_path), most=8)
    assert sinks.next_run(spark.createDataFrame([("007",), ("x9",), (None,)], "name string")).first().run == 8
    assert sinks.next_run(spark.createDataFrame([], "name string")).first().run == 1
    df = spark.createDataFrame([(1, True, 'a "b", c'), (2, None, None)], "id int, kept boolean, note string")
    assert sinks.write_report(df.orderBy("id"), f"{tmp_path}/r.csv") == 2
    assert (tmp_path / "r.csv").read_bytes().decode() == '\ufeffid,kept,note\r\n1,True,"a ""b"", c"\r\n2,,\r\n'


def test_renames(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    plan = lambda *p: spark.createDataFrame([(f"{tmp_path}/{x}", f"{tmp_path}/{y}") for x, y in p], "old string, new string")
    files = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in "abc"], "path string")
    assert sinks.rename_conflicts(plan(("a", "b"), ("b", "a")), files).count() == 0
    assert [os.path.basename(r.new) for r in sinks.rename_conflicts(plan(("a", "c"), ("b", "a")), files).collect()] == ["c"]
    assert sinks.rename(plan(("a", "b"), ("b", "a"))) == 2
    assert (tmp_path / "a").read_text() == "b" and (tmp_path / "b").read_text() == "a"
    with pytest.raises(FileExistsError):
        sinks.rename(plan(("a", "c")))
    with pytest.raises(ValueError):
        sinks.rename(plan(("a", "d"), ("b", "d")))
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]
