"""Groups of near copies: rows that share a key are candidates, an exact rule decides.

Rows are filed under several keys. Every row of a bucket is first held against the
bucket's least row; once the links found so are contracted, rows of different groups
that still share a bucket are held against each other, those of the bucket's largest
group only against the rest. Every pair that shares a key and passes ``near`` thus lies in
one group or is given to ``verify``, and a dense bucket of g near copies yields about g
pairs and not g^2.

``met`` makes such keys of 128-bit fingerprints: only those that have a near one in a
bucket become rows of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import dropped, give_back, written
from rasterlens.llm.components import components

#: Fingerprints of a task group of the search.
GROUP = 1 << 17
#: Buckets of more fingerprints are searched from one fingerprint to all at once.
_CROWD = 1024
_RECORD = np.dtype([("f0", "<u8"), ("f1", "<u8")])


def mix(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, well scattered."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def apart(f0: np.ndarray, f1: np.ndarray, a, b) -> np.ndarray:
    """Differing bits of the 128-bit fingerprints at places ``a`` and ``b``."""
    return np.bitwise_count(f0[a] ^ f0[b]) + np.bitwise_count(f1[a] ^ f1[b])


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``most`` or more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def paired(blobs: DataFrame, sizes: DataFrame, record: np.dtype, most: int, tag: str) -> DataFrame:
    """``g, pair, rows`` of ``blobs`` (g, rows: packed records with f0, f1), ``sizes`` (g, n) being their counts.

    Groups of more than ``4 * most`` records are cut into chunks by fingerprint, and every
    ``pair`` of chunks meets.
    """
    hot = sizes.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * most)
    hot = written(hot.select(F.col("g").alias("hot"), F.ceil(F.col("n") / (2 * most)).cast("int").alias("chunks")), tag)
    if hot.isEmpty():
        return blobs.select("g", F.lit(0).cast("long").alias("pair"), "rows")
    blobs = blobs.join(hot, F.col("g") == F.col("hot"), "left").select("g", "rows", F.coalesce("chunks", F.lit(1)).alias("chunks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "pair", "rows"]
        for b in batches:
            for g, rows, chunks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunks == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([0]), pa.array([rows], pa.binary())], names=names)
                    continue
                rows = np.frombuffer(rows, record)
                mine = mix(rows["f0"] + rows["f1"]) % np.uint64(chunks)
                for c in range(chunks):
                    data = rows[mine == c].tobytes()
                    pairs = [min(c, d) * chunks + max(c, d) for d in range(chunks) if d != c]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(pairs)), pa.array(pairs), pa.array([data] * len(pairs), pa.binary())], names=names)

    return blobs.mapInArrow(cut, "g long, pair long, rows binary")


def in_groups(batches: Iterator[pa.RecordBatch], record: np.dtype) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number, pair and records of each group of rows ``g, pair, rows`` that are sorted by these."""
    now, held = None, []
    for b in batches:
        for g, pair, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (g, pair):
                if held:
                    yield *now, np.frombuffer(b"".join(held), record)
                now, held = (g, pair), []
            held.append(rows)
    if held:
        yield *now, np.frombuffer(b"".join(held), record)


def sampled(f0: np.ndarray, f1: np.ndarray, mask: tuple[int, int]) -> np.ndarray:
    """A hash of the bits that ``mask`` samples."""
    x, y = (np.uint64(m & (1 << 64) - 1) for m in mask)
    return mix(mix(f0 & x) + (f1 & y))


def partnered(rows: np.ndarray, masks: list[tuple[int, int]], block: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, keys in this order, and marks of the records with one within ``far`` bits that agrees on mask ``block``.

    In buckets of usual size a pair counts on the first mask on which it agrees; in crowded ones on all.
    """
    key = sampled(rows["f0"], rows["f1"], masks[block])
    order = np.argsort(key, kind="stable")
    key, f0, f1 = key[order], rows["f0"][order], rows["f1"][order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    found = np.zeros(len(key), bool)
    ends = np.repeat(begin + size, size)
    at, d = np.flatnonzero(np.repeat((size > 1) & (size <= _CROWD), size)), 1
    while len(at):
        at = at[at + d < ends[at]]
        near = at[apart(f0, f1, at, at + d) <= far]
        for x, y in masks[:block]:
            if not len(near):
                break
            x, y = (np.uint64(m & (1 << 64) - 1) for m in (x, y))
            near = near[((f0[near] ^ f0[near + d]) & x | (f1[near] ^ f1[near + d]) & y) != 0]
        found[near] = found[near + d] = True
        d += 1
    for lo, n in zip(begin[size > _CROWD].tolist(), size[size > _CROWD].tolist(), strict=True):
        left = np.arange(lo, lo + n)
        while len(left):
            near = lo + np.flatnonzero(apart(f0, f1, slice(lo, lo + n), left[0]) <= far)
            if len(near) > 1:
                found[near] = True
            stays = ~found[left]
            stays[0] = False
            left = left[stays]
    return order, key, found


def met(prints: DataFrame, n: int, masks: list[tuple[int, int]], far: int) -> DataFrame:
    """``k, f0, f1``: those of the ``n`` distinct fingerprints ``prints`` (f0, f1) that have a partner in bucket ``k``.

    A bucket holds what agrees on the bits of a mask. Fingerprints travel packed to task
    groups of a mask and the leading bits of its hash.
    """
    top = max(0, math.ceil(math.log2(max(n, 1) / GROUP)))
    count = len(masks)

    def group(f0: np.ndarray, f1: np.ndarray, i: int) -> np.ndarray:
        key = sampled(f0, f1, masks[i])
        lead = key >> np.uint64(64 - top) if top else np.zeros(len(key), np.uint64)
        return lead * np.uint64(count) + np.uint64(i)

    def both(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.asarray(b.column(c)).view(np.uint64) for c in (0, 1))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1 << 16):
            for i in range(count):
                g, c = np.unique(group(*both(b), i), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], names=["g", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1 << 16):
            f0, f1 = both(b)
            for i in range(count):
                at = group(f0, f1, i)
                order = np.argsort(at, kind="stable")
                rows = np.empty(len(at), _RECORD)
                rows["f0"], rows["f1"] = f0[order], f1[order]
                g, lo = np.unique(at[order], return_index=True)
                data = [rows[x:y].tobytes() for x, y in zip(lo, [*lo[1:], len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(data, pa.binary())], names=["g", "rows"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pair, rows in in_groups(batches, _RECORD):
            order, key, found = partnered(rows, masks, g % count, far)
            rows = rows[order[found]]
            k = mix(mix(mix(np.array([g], np.uint64)) + np.uint64(pair)) + key[found])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k, rows["f0"], rows["f1"])], names=["k", "f0", "f1"])
        give_back()

    blobs = paired(prints.mapInArrow(pack, "g long, rows binary"), prints.mapInArrow(sizes, "g long, n long"), _RECORD, GROUP, "near-crowds")
    return blobs.repartition("g", "pair").sortWithinPartitions("g", "pair").mapInArrow(search, "k long, f0 long, f1 long")


def linked(filed: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, label`` of the ids that have links.

    ``filed``: ``k`` and a struct ``s`` whose first field is the id ``h``, once for each key
    of a row. ``near`` tells of two structs, by their names, whether they may link;
    ``verify`` adds ``ok`` to pairs ``a, b`` and gives a written table.
    """
    pair = lambda x, y: [F.least(f"{x}.h", f"{y}.h").alias("a"), F.greatest(f"{x}.h", f"{y}.h").alias("b")]
    lead = filed.groupBy(F.col("k").alias("lk")).agg(F.count("*").alias("size"), F.min("s").alias("p")).where("size > 1")
    rows = written(filed.join(lead, F.col("k") == F.col("lk")).select("k", "s", "p"), "near-buckets")
    star = written(rows.where((F.col("s.h") != F.col("p.h")) & near("s", "p")).select(*pair("s", "p")).distinct(), "near-pairs")
    first = verify(star)
    links = lambda df: df.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = written(components(links(first)), "near-labels")
    named = rows.select("k", "s").join(label, F.col("s.h") == F.col("node"), "left").select("k", "s", F.coalesce("label", "s.h").alias("g"))
    named = written(named, "near-named")
    dropped(rows)
    most = named.groupBy("k", "g").agg(F.count("*").alias("c")).groupBy(F.col("k").alias("mk")).agg(F.max_by("g", "c").alias("most"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    rivals = written(named.join(most, F.col("k") == F.col("mk")).drop("mk"), "near-rivals")
    dropped(named)
    other = rivals.select(*(F.col(c).alias(f"{c}2") for c in ("k", "s", "g")))
    once = (F.col("g2") == F.col("most")) | (F.col("s.h") < F.col("s2.h"))
    apart = rivals.where("g <> most").join(other, (F.col("k") == F.col("k2")) & (F.col("g") != F.col("g2")) & once & near("s", "s2")).select(*pair("s", "s2")).distinct()
    second = verify(written(apart.join(star, ["a", "b"], "left_anti"), "near-pairs"))
    dropped(rivals)
    return components(links(first).union(links(second)))
