"""Sinks: run folders, PNG images, annotation rewrites, reports and renames.

Images and annotations are written by the tasks that hold them, each under a temporary
name that is then replaced, so a task that runs twice leaves one whole file. Folders must
be ones that driver and executors share. Plans (numbers, names, conflicts) are DataFrames;
only the renames themselves are done by the driver, which owns the folder.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def next_run(names: DataFrame, column: str = "name") -> DataFrame:
    """``run``: one more than the greatest name that is a number, 1 without any."""
    number = F.when(F.col(column).rlike("^[0-9]+$"), F.col(column).try_cast("int"))
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("run"))


def run_folder(root: str, width: int = 3, most: int = 999) -> str:
    """Create the next numbered folder below ``root``; two runs never get the same one."""
    os.makedirs(root, exist_ok=True)
    while True:
        run = max((int(n) for n in os.listdir(root) if n.isascii() and n.isdigit()), default=0) + 1
        if run > most:
            raise RuntimeError(f"{root} has no number left below {most}")
        try:
            os.mkdir(made := f"{root}/{run:0{width}d}")
            return made
        except FileExistsError:
            continue  # another run was faster


def replaced(path: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def png(pixels: np.ndarray) -> bytes:
    """PNG of ``uint8`` pixels, (h, w) grey or (h, w, 3) RGB; an empty image is an error."""
    if pixels.dtype != np.uint8 or pixels.size == 0 or not (pixels.ndim == 2 or pixels.shape[2:] == (3,)):
        raise ValueError(f"no image: {pixels.dtype} {pixels.shape}")
    h, w = pixels.shape[:2]
    lines = np.zeros((h, 1 + pixels[0].size), np.uint8)  # a filter byte before each line
    lines[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def beside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Original and processed image side by side; their shapes must match."""
    if left.shape != right.shape:
        raise ValueError(f"shapes differ: {left.shape}, {right.shape}")
    return np.hstack([left, right])


def write_images(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``name, height, width, nChannels, data`` (BGR, as Spark's image source gives it) as PNG.

    Returns ``name, path, length``; files are written when the result is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, paths, sizes = [], [], []
            for r in b.to_pylist():
                cells = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                body = png(cells[:, :, 0] if r["nChannels"] == 1 else np.ascontiguousarray(cells[:, :, 2::-1]))
                path = f"{folder}/{Path(r['name']).stem}.png"
                replaced(path, body)
                names.append(r["name"])
                paths.append(path)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["name", "path", "length"])

    return rows.select("name", "height", "width", "nChannels", "data").mapInArrow(run, "name string, path string, length long")


def _udf(change: Callable[[dict, dict], None], indent: int):
    """A change of parsed JSON that keeps all other keys and their order; null stays null."""
    import pandas as pd

    def many(raw: pd.Series, args: pd.DataFrame) -> pd.Series:
        out = []
        for text, given in zip(raw, args.to_dict("records"), strict=True):
            if text is None:
                out.append(None)
                continue
            doc = json.loads(text)
            if not isinstance(doc, dict):
                raise ValueError("root is no object")
            change(doc, given)
            out.append(json.dumps(doc, ensure_ascii=False, indent=indent) + "\n")
        return pd.Series(out, dtype=object)

    # the annotations of this module are strings, which say nothing to Spark
    many.__annotations__ = {"raw": pd.Series, "args": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(many, "string")


def _place(doc: dict, given: dict) -> None:
    info = doc.get("info")
    if not isinstance(info, dict):
        raise ValueError("info is no object")
    name = info.get("name")
    info["folder"], info["name"] = given["folder"], given["stem"] + (Path(name).suffix if isinstance(name, str) else "")
    for key in ("folder", "name"):
        doc.pop(key, None)


def _normal(value: object) -> str:
    return "_".join(p for p in str(value).strip().lower().replace(" ", "_").split("_") if p)


def _only(doc: dict, given: dict) -> None:
    if not isinstance(doc.get("objects"), list):
        raise ValueError("objects is no list")
    doc["objects"] = [o for o in doc["objects"] if isinstance(o, dict) and _normal(o.get("category")) == given["category"]]


def placed(raw: Column, folder: Column, stem: Column) -> Column:
    """Annotation text with ``info.folder`` and ``info.name`` set and the root's own dropped."""
    return _udf(_place, 2)(raw, F.struct(folder.alias("folder"), stem.alias("stem")))


def only_category(raw: Column, category: str) -> Column:
    """Annotation text with the objects of one normalised category."""
    return _udf(_only, 4)(raw, F.struct(F.lit(category).alias("category"), F.lit(0).alias("_")))


def write_texts(rows: DataFrame) -> DataFrame:
    """Write ``path, text`` as UTF-8 files, each whole or not at all; returns ``path, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, bodies = b.column(0).to_pylist(), [t.encode() for t in b.column(1).to_pylist()]
            for path, body in zip(paths, bodies, strict=True):
                replaced(path, body)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([len(x) for x in bodies], pa.int64())], names=["path", "length"])

    return rows.select("path", "text").mapInArrow(run, "path string, length long")


def csv_lines(table: DataFrame) -> DataFrame:
    """``line``: the rows as CSV text, with quotes where they are needed; ``True``/``False`` for booleans."""
    cell = lambda c, kind: F.initcap(F.col(c).cast("string")) if kind == "boolean" else F.col(c).cast("string")
    quoted = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))
    return table.select(F.concat_ws(",", *(quoted(cell(c, k)) for c, k in table.dtypes)).alias("line"))


def write_report(table: DataFrame, path: str) -> int:
    """One CSV file with byte order mark and header, for people; rows pass through one at a time.

    Tables for further work are written by ``DataFrame.write``, not by this.
    """
    temp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    try:
        with open(temp, "w", encoding="utf-8", newline="") as f:
            f.write(BOM + ",".join(table.columns) + "\r\n")
            for n, r in enumerate(csv_lines(table).toLocalIterator(), 1):
                f.write(r["line"] + "\r\n")
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return n


def rename_conflicts(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of ``plan`` (old, new) that exist in ``files`` (path) and are not renamed themselves."""
    there = plan.join(files.select(F.col("path").alias("p")), F.col("new") == F.col("p"), "left_semi")
    return there.join(plan.select(F.col("old").alias("o")), F.col("new") == F.col("o"), "left_anti")


def rename(plan: DataFrame) -> int:
    """Rename files as ``plan`` (old, new) says, by way of temporary names, so that chains and swaps work.

    On an error the files that still have a temporary name get their old one back; those
    that have their new name keep it.
    """
    todo = [(r["old"], r["new"]) for r in plan.select("old", "new").orderBy("old").collect()]  # one folder's names
    if len({new for _, new in todo}) < len(todo):
        raise ValueError("two files would get the same name")
    waiting: dict[str, tuple[str, str]] = {}
    try:
        for old, new in todo:
            temp = f"{os.path.dirname(old)}/.rasterlens-move-{uuid.uuid4().hex}"
            os.rename(old, temp)
            waiting[temp] = (old, new)
        for temp, (_, new) in list(waiting.items()):
            if os.path.exists(new):
                raise FileExistsError(new)
            os.rename(temp, new)
            del waiting[temp]
    except OSError:
        for temp, (old, _) in waiting.items():
            os.rename(temp, old)
        raise
    return len(todo)


def write_results(original: DataFrame, processed: DataFrame, folder: str, side_by_side: bool = True, alone: bool = True) -> DataFrame:
    """Write results as PNG, beside their originals and alone; shapes must match. Returns ``name, path, length``.

    Both sides hold ``name, height, width, nChannels, data``.
    """
    out = write_images(processed, f"{folder}/processed") if alone else None
    if not side_by_side:
        return out
    o = original.select("name", F.struct("height", "width", "nChannels", "data").alias("o"))
    met = processed.join(o, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cells = [np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"]) for x in (r["o"], r)]
                both = beside(*cells)
                yield pa.RecordBatch.from_pylist([{"name": r["name"], "height": both.shape[0], "width": both.shape[1], "nChannels": both.shape[2], "data": both.tobytes()}], schema=pa.schema([("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())]))

    joined = met.select("name", "height", "width", "nChannels", "data", "o").mapInArrow(run, "name string, height int, width int, nChannels int, data binary")
    pairs = write_images(joined, f"{folder}/compared")
    return pairs.unionByName(out) if alone else pairs


def copied(plan: DataFrame) -> DataFrame:
    """Copy files as ``plan`` (old, new) says, unchanged and each whole or not at all; returns ``new, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            olds, news = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = []
            for old, new in zip(olds, news, strict=True):
                body = Path(old).read_bytes()
                replaced(new, body)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(news, pa.string()), pa.array(sizes, pa.int64())], names=["new", "length"])

    return plan.select("old", "new").mapInArrow(run, "new string, length long")


def copy_group(pairs: DataFrame, folder: str, each: int = 20) -> int:
    """Fill a cleared group folder with pairs (image_path, json_path); other counts than ``each`` are an error."""
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        if os.path.isfile(f"{folder}/{name}"):
            os.unlink(f"{folder}/{name}")
    plan = pairs.select(F.explode(F.array("image_path", "json_path")).alias("old")).select("old", F.concat(F.lit(f"{folder}/"), F.regexp_extract("old", r"([^/]+)$", 1)).alias("new"))
    copied(plan).agg(F.count("*")).collect()
    names = os.listdir(folder)
    notes = sum(n.lower().endswith(".json") for n in names)
    if (len(names) - notes, notes) != (each, each):
        raise RuntimeError(f"{folder} holds {len(names) - notes} images and {notes} annotations, not {each} of both")
    return len(names)


def parameter_folder(run: str, module: str, settings: dict[str, object]) -> str:
    """An empty folder whose name tells the settings of a module."""
    shown = "_".join(f"{k}-{v}" for k, v in settings.items())
    made = f"{run}/{module}_{shown}".replace(" ", "")
    os.makedirs(made)
    return made


def summary(counted: DataFrame, title: str) -> str:
    """Text of a small table of counts for people, a line a row."""
    return "\n".join([title, *("  " + ", ".join(f"{c}: {r[c]}" for c in counted.columns) for r in counted.limit(1000).collect())])


def rewrite_in_place(rows: DataFrame, category: str) -> DataFrame:
    """Annotations (path, raw) rewritten where they are, without the objects of one normalised category; ``path, length``."""
    return write_texts(rows.select("path", without_category(F.col("raw"), category).alias("text")))


def _without(doc: dict, given: dict) -> None:
    doc["objects"] = [o for o in doc.get("objects", []) if not isinstance(o, dict) or _normal(o.get("category")) != given["category"]]


def without_category(raw: Column, category: str) -> Column:
    """Annotation text without the objects of one normalised category; items that are no objects stay."""
    return _udf(_without, 2)(raw, F.struct(F.lit(category).alias("category"), F.lit(0).alias("_")))
