"""SimHash near-duplicates by a generalised pigeonhole over unequal bit partitions.

Fingerprints link at ``distance`` or fewer differing bits. The 64 bits are dealt into
partitions, correlated bits together; thresholds ``t_i >= -1`` with
``sum(t_i + 1) = distance + 1`` are chosen by dynamic programming on the estimated cost
of probes and candidates, so every link agrees to within ``t_i`` bits on some partition.
Each fingerprint is filed under its own value of a partition and probes all values within
``t_i`` bits; pairs that meet are verified on all 64 bits.

Exact copies collapse to one fingerprint before the search. Within a bucket the verified
links are reduced to a spanning forest where they are found, so that a dense group of g
near copies emits about g links and never g^2. A bucket of more than ``CHUNK`` rows is
cut by hash into chunks, and each pair of chunks is its own task group.

``deduplicated`` serves a corpus and has a rule of its own: five-word shingles and an exact
Jaccard similarity, with a wide SimHash that finds the candidates by sampled bits.

Defined cases: null and empty texts have no words and the fingerprint zero, which links
like any other; rows with a null doc_id are fingerprinted and linked but never name a
component unless it holds no other id (then component_id is null); repeated rows give
repeated results; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import dropped, give_back, maybe, member, set_bits, written
from rasterlens.llm.components import components
from rasterlens.llm.near import linked, met

BITS = 64
#: Documents link at this Jaccard similarity of their distinct shingles (``deduplicated``).
SIMILARITY = 0.8
#: Bits of the fingerprint that finds candidates there, and chance that two at the similarity meet.
WIDE, RECALL = 128, 0.998
#: Differing bits beyond which candidates are not looked at: of pairs at the similarity 19 differ
#: on average, and in more than these in 3 of 10,000 pairs (binomial, bits taken as independent).
FAR = 34
#: Rows of a bucket that one task group compares at once; larger buckets are cut.
CHUNK = 512
#: Fingerprints (least hash first) on which partitions and thresholds are fitted.
SAMPLE = 8192
#: Shingles that are held at once while a text is fingerprinted.
_SLAB = 1 << 16
#: Cost of a probe row (shuffled) in units of one compared pair.
_PROBE = 150.0


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, count = b" ".join(words), np.zeros(BITS, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _SLAB):
        hi = min(n, lo + _SLAB)
        spans = zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    # the bytes as they are: lower() and split() then know ASCII only
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bit positions into ``m`` partitions of like width, correlated ones together."""
    x = bits - bits.mean(0)
    sd = np.sqrt((x * x).mean(0))
    corr = np.abs(x.T @ x) / max(1, len(x)) / np.maximum(np.outer(sd, sd), 1e-9)
    left, out = list(range(BITS)), []
    for k in range(m):
        room = len(left) // (m - k)
        first = max(left, key=lambda i: (corr[i, left].sum(), -i))
        part = [first]
        while len(part) < room:
            rest = [i for i in left if i not in part]
            part.append(max(rest, key=lambda i: (corr[i, part].sum(), -i)))
        out.append(sorted(part))
        left = [i for i in left if i not in part]
    return out


def _near(bits: np.ndarray, part: list[int], top: int) -> list[float]:
    """Estimated share of pairs within 0..top bits on a partition."""
    some = bits[:1024, part].astype(np.int32)
    d = some.sum(1)[:, None] + some.sum(1)[None, :] - 2 * (some @ some.T)
    pairs = d[np.triu_indices(len(some), 1)]
    p = bits[:, part].mean(0) if len(bits) else np.full(len(part), 0.5)
    dist = np.zeros(top + 2)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):  # as if the bits were independent, for shares too small to be seen
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return [max(float((pairs <= t).mean()) if len(pairs) else 0.0, float(dist[: t + 1].sum())) for t in range(top + 1)]


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i (from -1, which leaves a partition out) with sum(t_i + 1) = total, of least cost.

    ``cost[i][t + 1]`` is the estimated cost of partition i at threshold t; dynamic
    programming over partitions and the budget spent.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for step, extra in enumerate(row):
                key = spent + step
                if key <= total and (key not in nxt or c + extra < nxt[key][0]):
                    nxt[key] = (c + extra, [*ts, step - 1])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, n: int, distance: int = 3) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost for ``n`` fingerprints."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    best = (math.inf, [])
    for m in range(2, distance + 3):
        parts = _groups(bits, m) if len(bits) > 1 else [list(range(BITS))[i::m] for i in range(m)]
        cost = []
        for part in parts:
            near = _near(bits, part, distance)
            probes = list(itertools.accumulate(math.comb(len(part), t) for t in range(distance + 1)))
            cost.append([0.0, *(n * _PROBE * probes[t] + n * n * near[t] / 2 for t in range(distance + 1))])
        c, ts = allocate(cost, distance + 1)
        if c < best[0]:
            best = (c, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


def _masks(part: list[int], t: int) -> np.ndarray:
    """All ways to flip 1..t bits of a partition."""
    one = [np.uint64(1) << np.uint64(i) for i in part]
    return np.array([np.bitwise_xor.reduce(np.array(c, np.uint64)) for k in range(1, t + 1) for c in itertools.combinations(one, k)], np.uint64)


def keyed(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, val, fp, home``: filed under its own value (home) and under all it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.bitwise_or.reduce(np.array([1 << i for i in p], np.uint64)) for p, _ in parts]
        flips = [np.concatenate(([np.uint64(0)], _masks(p, t))) for p, t in parts]
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for k, (mask, flip) in enumerate(zip(masks, flips, strict=True)):
                step = max(1, 200_000 // len(flip))
                for lo in range(0, len(x), step):
                    y = x[lo : lo + step]
                    val = ((y & mask)[:, None] ^ flip[None, :]).ravel()
                    home = np.tile(np.arange(len(flip)) == 0, len(y))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(val), k, np.int32)), pa.array(val.view(np.int64)), pa.array(np.repeat(y, len(flip)).view(np.int64)), pa.array(home)],
                        names=["part", "val", "fp", "home"],
                    )

    return fps.select("fp").mapInArrow(run, "part int, val long, fp long, home boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: (node, least node of its component)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        nxt = label.copy()
        np.minimum.at(nxt, label[u], low)
        np.minimum.at(nxt, label[v], low)
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        nxt = nxt[label]
        if np.array_equal(nxt, label):
            break
        label = nxt
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def verify(group: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the true links among rows that share a group (rows sorted by group)."""
    n = len(fp)
    change = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.repeat(np.concatenate((change[1:], [n])), np.diff(np.concatenate((change, [n]))))
    a_all, b_all, held = [], [], 0
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < ends[at]]
        if not len(at):
            break
        x, y = fp[at], fp[at + d]
        ok = (np.bitwise_count(x ^ y) <= distance) & (x != y) & (home[at] | home[at + d])
        if ok.any():
            a_all.append(x[ok])
            b_all.append(y[ok])
            held += int(ok.sum())
            if held > 1 << 20:  # keep what is held in proportion to the rows
                a, b = forest(np.concatenate(a_all), np.concatenate(b_all))
                a_all, b_all, held = [a], [b], 0
        d += 1
    if not a_all:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(a_all), np.concatenate(b_all))


def links(fps: DataFrame, distance: int = 3, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """Edges ``u, v`` with the same components as all pairs of distinct fingerprints within ``distance`` bits."""
    n = fps.count()
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow().column(0).to_numpy()
    keys = written(keyed(fps, plan(some.view(np.uint64), n, distance)), "keys")
    sizes = keys.groupBy("part", "val").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").select(F.col("part").alias("p"), F.col("val").alias("w"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("chunks")).cast("int")
    met = (
        keys.join(sizes, (F.col("part") == F.col("p")) & (F.col("val") == F.col("w")))
        .withColumn("c", mine)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("part", "val", F.least("c", "o"), F.greatest("c", "o")).alias("g"), "fp", "home")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = verify(cols[0], cols[1], cols[2], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for b in batches:
            cols = [np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on in the next batch
            if cut:
                yield emit([x[:cut] for x in cols])
            rest = [x[cut:] for x in cols]
        if rest is not None and len(rest[0]):
            yield emit(rest)

    return met.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def classes(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for rows ``doc_id, fp``; the search is over distinct fingerprints."""
    fps = written(fps, "fps")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    parts = components(links(groups, distance))
    named = groups.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "lab")
    by_fp = written(named.join(least, F.col("label") == F.col("lab")).select(F.col("fp").alias("f"), "component_id"), "classes")
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    return classes(fingerprints(docs), distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(text: bytes | None, width: int) -> tuple[int, set[bytes]]:
    """Hash of the words of a text and the 128-bit digests of its distinct shingles."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))] if words else []
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        spans = zip([0, *ends], (e - 1 for e in ends[width - 1 :]), strict=False)
    digest = xxhash.xxh3_128_digest
    return xxhash.xxh64_intdigest(joined, 42), {digest(joined[a:b]) for a, b in spans}


def _wide(shingles: set[bytes]) -> np.ndarray:
    """SimHash of ``WIDE`` bits of distinct shingles, as two words."""
    rows = np.frombuffer(b"".join(shingles), np.uint8).reshape(-1, WIDE // 8)
    count = np.zeros(WIDE, np.int64)
    for lo in range(0, len(rows), _SLAB):
        count += np.unpackbits(rows[lo : lo + _SLAB], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(rows)).view(np.int64)


def band_masks(n: int) -> list[tuple[int, int]]:
    """Fixed choices of bits, one a key, for ``n`` fingerprints.

    A key has so many bits (16, 20, 24, ...) that a value has some 2^7 fingerprints or less,
    and there are as many keys as let two texts at ``SIMILARITY`` share one with probability
    ``RECALL``.
    """
    bits = max(16, 4 * math.ceil((math.log2(max(n, 2)) - 7) / 4))
    differ = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi  # chance that a bit does
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** bits))
    rng = np.random.default_rng(42)
    out = []
    for _ in range(count):
        on = np.zeros(WIDE, np.uint8)
        on[rng.choice(WIDE, bits, replace=False)] = 1
        out.append(tuple(np.packbits(on).view(np.int64).tolist()))
    return out


def _sets(docs: DataFrame, ids: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """``h, x``: the distinct shingles of the texts ``ids`` (id)."""
    need = written(groups.join(ids, F.col("h") == F.col("id")).select("rk").distinct(), "near-texts")
    text = F.col("text").cast("string")
    bits = set_bits(need.count())
    some = docs.select(F.xxhash64(text).alias("t_rk"), text.cast("binary").alias("t"), member(need, bits).alias("set")).where(maybe(F.col("set"), F.col("t_rk"), bits)).drop("set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                got = [sketch(t, width) for t in b.column(1)[lo : lo + 256].to_pylist()]
                x = [np.frombuffer(b"".join(s), np.int64)[:: WIDE // 64] for _, s in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in got], np.uint64).view(np.int64)), pa.array(x, pa.list_(pa.int64()))], names=["h", "x"])
        give_back()

    one = some.join(need, F.col("t_rk") == F.col("rk")).select("rk", "t").dropDuplicates(["rk"])
    return one.mapInArrow(run, "h long, x array<long>")


def near_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, component_id`` of every row: texts link at a Jaccard similarity of ``SIMILARITY``
    or more of their distinct shingles; SimHash finds the candidates, the shingles decide."""
    text = F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [sketch(t, width) for t in part.column(2).to_pylist()]
                fp = np.array([_wide(s) for _, s in got], np.int64).reshape(-1, 2)
                h = np.array([h for h, _ in got], np.uint64).view(np.int64)
                size = np.array([len(s) for _, s in got], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(h), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array(size)], names=["doc_id", "rk", "h", "f0", "f1", "size"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.cast("binary").alias("t"))
    rows = written(rows.mapInArrow(run, "doc_id long, rk long, h long, f0 long, f1 long, size long"), "sketches")
    groups = written(rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("rk").alias("rk"), *(F.first(c).alias(c) for c in ("f0", "f1", "size"))), "groups")
    alike = written(groups.groupBy("f0", "f1").agg(F.count("*").alias("n")), "prints")
    n = alike.count()
    buckets = met(alike.select("f0", "f1"), n, band_masks(n), FAR)
    # texts of one fingerprint share a bucket of their own
    buckets = buckets.unionByName(alike.where("n > 1").select(F.xxhash64(F.lit("alike"), "f0", "f1").alias("k"), "f0", "f1"))
    buckets = buckets.select("k", F.col("f0").alias("p0"), F.col("f1").alias("p1"))
    filed = buckets.join(groups, (F.col("p0") == F.col("f0")) & (F.col("p1") == F.col("f1"))).select(F.struct("h", "f0", "f1", "size").alias("s"), "k")
    filed = written(filed, "near-filed")
    dropped(alike)

    def near(a: str, b: str) -> Column:
        bits = F.bit_count(F.col(f"{a}.f0").bitwiseXOR(F.col(f"{b}.f0"))) + F.bit_count(F.col(f"{a}.f1").bitwiseXOR(F.col(f"{b}.f1")))
        # sets of sizes further apart cannot be similar
        return (bits <= FAR) & (F.least(f"{a}.size", f"{b}.size") >= SIMILARITY * F.greatest(f"{a}.size", f"{b}.size") - 1e-9)

    def verify(pairs: DataFrame) -> DataFrame:
        sets = written(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), groups, width), "shingles")
        left, right = (sets.select(F.col("h").alias(f"h{c}"), F.col("x").alias(f"x{c}")) for c in "ab")
        both = F.size(F.array_intersect("xa", "xb"))
        met = pairs.join(left, F.col("a") == F.col("ha")).join(right, F.col("b") == F.col("hb"))
        out = written(met.select("a", "b", (both >= SIMILARITY * (F.size("xa") + F.size("xb") - both) - 1e-9).alias("ok")), "near-links")
        dropped(sets)
        return out

    parts = linked(filed, near, verify)
    dropped(filed)
    named = written(groups.join(parts, F.col("h") == F.col("node"), "left").select("h", "rep", F.coalesce("label", "h").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "lab")
    by_h = written(named.join(least, F.col("label") == F.col("lab")).select(F.col("h").alias("g"), "component_id"), "classes")
    return rows.join(by_h, F.col("h") == F.col("g")).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class (``near_classes``), all columns as they were.

    Rows that share a doc_id count as one document and stay or go together, but for a
    null doc_id, whose rows stay.
    """
    gone = written(near_classes(docs, width).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    bits = set_bits(gone.count())
    key = F.col("__row.doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), member(gone, bits).alias("__set")).withColumn("__maybe", F.coalesce(maybe(F.col("__set"), key, bits), F.lit(False))).drop("__set")
    # only rows that the bit array lets through are shuffled; the join decides about them
    some = rows.where("__maybe").join(gone, key == F.col("__gone"), "left_anti")
    return some.unionByName(rows.where("not __maybe")).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
