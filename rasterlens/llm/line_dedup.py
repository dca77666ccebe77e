"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, groups.

Lines are normalised (lower case, ASCII punctuation and white space to single spaces).
Two lines link if their normal forms are equal, or if they meet in a block of their SimHash,
differ in at most ``FAR`` of 128 of its bits, and have an edit similarity of at least
``SIMILARITY``, counted in characters at every length. Of each connected group the first
occurrence (least doc_id, then line number) is kept, everywhere in the corpus.

The SimHash is taken over the distinct words of a line and is as wide as the blocks need:
``blocks`` of ``width`` bits each, a row standing under every block. The width grows with the
number of lines, so that strangers seldom meet, and the number of blocks with the width, so
that lines that differ in a tenth of their bits meet with probability ``RECALL``. The edit
similarity is the only rule that a near line has to pass; blocks make the search probable and
not certain (README tells the measured share).

Fingerprints travel to their blocks as packed arrays, a few rows in place of millions, and
only lines that found a partner are joined with their texts. A crowded block is cut into
chunks, and each pair of chunks is a task group of its own; within a group the links are
sought from one line to all others at once, and lines that are connected already are not
compared again, so g near-equal lines take about g comparisons and give about g links.

Defined cases: a null text stays null and has no lines; lines whose normal form is empty
are never removed; a document that loses all its lines keeps its row with an empty text;
rows that repeat a doc_id with its text are one document and are treated alike; a null
doc_id is the least; extra columns stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import dropped, give_back, let, maybe, member, set_bits, written
from rasterlens.llm.components import components
from rasterlens.llm.near import apart, gathered, in_groups, mix, paired

SIMILARITY = 0.8
#: Differing bits, of the first 128, beyond which two lines of a block are not compared.
FAR = 30
#: Share of its bits in which a near line differs that the number of blocks is laid out for,
#: and the probability that such a line is met.
DIFFER, RECALL = 0.1, 0.985
#: Bytes of text that are looked at in one go; a longer line is one go of its own.
SLAB = 1 << 19
#: Fingerprints of a task group of the search, rows of a task group of the comparison.
GROUP, CHUNK = 1 << 17, 1 << 16
#: Blocks of more fingerprints are searched from one fingerprint to all at once.
_CROWD = 1024
#: Lines that are compared in one go; pairs whose edits are counted at once, of at most so many characters.
_ROWS, _BATCH, _TOGETHER = 1 << 15, 1024, 1024
#: ASCII punctuation and white space, which part words.
_PARTS = b"\t\x0b\x0c\r" + bytes([*range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_TABLE = bytes(32 if c in _PARTS else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_ONES = np.uint64(0x0101010101010101)
#: Lengths are filed by ratio: near lines are at most ``_REACH`` classes apart.
_RATIO = 1.06
_REACH = math.ceil(math.log(1 / SIMILARITY) / math.log(_RATIO))
_RECORD = np.dtype([("key", "<u2"), ("f0", "<u8"), ("f1", "<u8"), ("len", "u1")])


def width_of(n: int) -> int:
    """Bits of a block for ``n`` lines: 16, 20, 24, ... so that a block has some 2^7 values a line or less."""
    return max(16, 4 * math.ceil((math.log2(max(n, 2)) - 7) / 4))


def blocks_of(width: int) -> int:
    """Number of blocks of ``width`` bits."""
    return max(math.ceil(128 / width), math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFER) ** width)))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLAB + 1)
            one = np.ones(1, np.uint64)
            cls.up, cls.down = (np.concatenate((one, np.multiply.accumulate(np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each span, by differences of one running sum."""
    up, down = _Powers.get(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def line_prints(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, hashes, lengths and SimHashes (rows of bytes) of the lines of ``text`` that have words.

    ``text`` is lower-cased UTF-8; the hash and the length (code points) are those of the normal form.
    """
    raw = np.frombuffer(text.translate(_TABLE), np.uint8)
    part = (raw == 32) | (raw == 10)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], part, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = math.ceil(bits / 64)
    if not len(starts):
        return (*(np.empty(0, t) for t in (np.int64, np.uint64, np.int64)), np.empty((0, size * 8), np.uint8))
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    word = _spans(raw.astype(np.uint64) + np.uint64(1), starts, ends)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.concatenate((first[1:], [len(line)]))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    length = np.add.reduceat(points[ends] - points[starts], first) + (last - first) - 1
    # distinct words of each line: sorted by line and 42 bits of their hash
    at = np.repeat(np.arange(len(first), dtype=np.uint64), last - first)
    keys = np.sort(at << np.uint64(42) | word >> np.uint64(22))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    owner = (keys >> np.uint64(42)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.concatenate((begin, [len(keys)])))
    # eight counters of a byte each in one sum: no more than 255 words a sum
    sums = np.flatnonzero((np.arange(len(keys)) - begin[owner]) % 255 == 0)
    joins = np.searchsorted(sums, begin)
    seed = keys & np.uint64((1 << 42) - 1)
    out = np.empty((len(first), size, 8, 8), bool)
    for s in range(size):
        x = mix(seed + np.uint64((s + 1) * _BASE & (1 << 64) - 1))
        for k in range(8):
            lanes = np.add.reduceat(x >> np.uint64(k) & _ONES, sums).view(np.uint8).reshape(-1, 8)
            if len(sums) > len(begin):
                lanes = np.add.reduceat(lanes, joins, axis=0, dtype=np.int64)
            out[:, s, k] = 2 * lanes.astype(np.int64) > count[:, None]
    return line[first], _spans(word, first, last), length, np.packbits(out.reshape(len(first), -1), axis=1)


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """``text`` in pieces of whole lines of about ``SLAB`` bytes, with the number of their first line."""
    at = number = 0
    while len(text) - at > SLAB:
        cut = text.rfind(b"\n", at, at + SLAB)
        cut = cut if cut >= 0 else text.find(b"\n", at + SLAB)
        if cut < 0:
            break
        yield text[at:cut], number
        number += text.count(b"\n", at, cut) + 1
        at = cut + 1
    yield (text[at:] if at else text), number


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def simhashed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, rk, pos, h, len, f0, f1, f`` of every line with words: the first 128 bits and the rest."""
    bits = width * blocks_of(width)

    def slab(held: list[tuple]) -> pa.RecordBatch:
        lines = np.array([p.count(b"\n") + 1 for _, _, p, _ in held])
        base = np.concatenate(([0], np.cumsum(lines)))
        number, h, length, fp = line_prints(b"\n".join(p for _, _, p, _ in held), bits)
        owner = np.searchsorted(base, number, "right") - 1
        pos = number - base[owner] + np.array([n for *_, n in held])[owner]
        ids, rks = (pa.array([x[c] for x in held], pa.int64()).take(pa.array(owner)) for c in (0, 1))
        fp = np.ascontiguousarray(fp)
        front = np.ascontiguousarray(fp[:, :16]).view(np.int64).reshape(-1, 2)
        tail = np.ascontiguousarray(fp[:, 16:])
        rest = pa.Array.from_buffers(pa.binary(tail.shape[1]), len(tail), [None, pa.py_buffer(tail)]).cast(pa.binary())
        cols = [ids, rks, pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(front[:, 0].copy()), pa.array(front[:, 1].copy()), rest]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "rk", "pos", "h", "len", "f0", "f1", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for doc_id, rk, text in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True):
                    for piece, number in _pieces(text.lower().encode()) if text else ():
                        held.append((doc_id, rk, piece, number))
                        size += len(piece)
                        if size >= SLAB:
                            yield slab(held)
                            held, size = [], 0
        if held:
            yield slab(held)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(docs).alias("rk"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rk long, pos int, h long, len int, f0 long, f1 long, f binary")


def _block_keys(bits: np.ndarray, block: int, width: int) -> np.ndarray:
    part = np.zeros((len(bits), 64), np.uint8)
    part[:, 64 - width :] = bits[:, block * width : (block + 1) * width]
    return np.packbits(part, axis=1).view(">u8").ravel().astype(np.uint64)


def _subgroups(n: int) -> int:
    """Leading bits of a block's key that part a block into task groups of ``GROUP`` fingerprints."""
    return max(0, math.ceil(math.log2(max(n, 1) / GROUP)))


def _prints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """f0, f1, length class and all bits of the rows ``f0, f1, f, len`` of a batch."""
    f0, f1 = (np.asarray(batch.column(c)).view(np.uint64) for c in (0, 1))
    rest = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(f0), -1)
    cls = np.minimum(255, np.log(np.asarray(batch.column(3)).astype(np.float64)) / math.log(_RATIO)).astype(np.uint8)
    both = np.stack((f0, f1), axis=1).view(np.uint8)
    return f0, f1, cls, np.unpackbits(np.concatenate((both, rest), axis=1), axis=1)


def packed(prints: DataFrame, width: int, low: int) -> DataFrame:
    """``g, pair, rows``: packed records of the fingerprints of a task group.

    A task group is a block and the leading bits of its key. Those that turn out larger than
    planned are cut into chunks by fingerprint, and every ``pair`` of chunks meets.
    """
    count = blocks_of(width)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1 << 16):
            bits = _prints(b)[3]
            for j in range(count):
                g, n = np.unique(_block_keys(bits, j, width) >> np.uint64(low), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((g * np.uint64(count) + np.uint64(j)).view(np.int64)), pa.array(n)], names=["g", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1 << 16):
            f0, f1, cls, bits = _prints(b)
            for j in range(count):
                key = _block_keys(bits, j, width)
                order = np.argsort(key, kind="stable")
                rows = np.empty(len(key), _RECORD)
                for name, x in (("key", key & np.uint64((1 << low) - 1)), ("f0", f0), ("f1", f1), ("len", cls)):
                    rows[name] = x[order]
                g, at = np.unique(key[order] >> np.uint64(low), return_index=True)
                data = [rows[x:y].tobytes() for x, y in zip(at, [*at[1:], len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((g * np.uint64(count) + np.uint64(j)).view(np.int64)), pa.array(data, pa.binary())], names=["g", "rows"])

    return paired(prints.mapInArrow(pack, "g long, rows binary"), prints.mapInArrow(sizes, "g long, n long"), _RECORD, GROUP, "line-crowds")


def _first_met(f0: np.ndarray, f1: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, width: int) -> np.ndarray:
    """Pairs that agree on no block before ``block`` of those in the first 128 bits."""
    n = min(block, 128 // width)
    x = np.unpackbits(np.stack((f0[a] ^ f0[b], f1[a] ^ f1[b]), axis=1).view(np.uint8), axis=1)[:, : n * width]
    return x.reshape(len(a), n, width).any(axis=2).all(axis=1)


def partnered(rows: np.ndarray, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and marks of the records that have a partner in their block's value.

    In blocks of usual size a pair counts where it first meets; in crowded ones everywhere.
    """
    order = np.lexsort((rows["len"], rows["key"]))
    key, f0, f1, cls = (np.ascontiguousarray(rows[c][order]) for c in ("key", "f0", "f1", "len"))
    cls = cls.astype(np.int16)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    found = np.zeros(len(key), bool)
    ends = np.repeat(begin + size, size)
    at, d = np.flatnonzero(np.repeat((size > 1) & (size <= _CROWD), size)), 1
    while len(at):
        at = at[at + d < ends[at]]
        at = at[cls[at + d] - cls[at] <= _REACH]
        near = at[apart(f0, f1, at, at + d) <= FAR]
        if len(near):
            near = near[_first_met(f0, f1, near, near + d, block, width)]
            found[near] = found[near + d] = True
        d += 1
    for lo, n in zip(begin[size > _CROWD].tolist(), size[size > _CROWD].tolist(), strict=True):
        left = np.arange(lo, lo + n)
        while len(left):
            lead = left[0]
            near = lo + np.flatnonzero((apart(f0, f1, slice(lo, lo + n), lead) <= FAR) & (np.abs(cls[lo : lo + n] - cls[lead]) <= _REACH))
            if len(near) > 1:
                found[near] = True
            found_now = found[left]
            found_now[0] = True
            left = left[~found_now]
    return order, found


def candidates(prints: DataFrame, n: int, width: int) -> DataFrame:
    """``b, f0, f1``: fingerprints that have a partner in block value ``b``."""
    count = blocks_of(width)
    low = width - min(width, max(_subgroups(n), width - 16))
    groups = packed(prints, width, low).repartition("g", "pair").sortWithinPartitions("g", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pair, rows in in_groups(batches, _RECORD):
            order, found = partnered(rows, g % count, width)
            rows = rows[order[found]]
            b = mix(mix(mix(np.array([g], np.uint64)) + np.uint64(pair)) + rows["key"].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (b, rows["f0"], rows["f1"])], names=["b", "f0", "f1"])
        give_back()

    return groups.mapInArrow(run, "b long, f0 long, f1 long").distinct()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or any number above ``most`` where it is greater.

    Equal ends are cut off; the columns of the table are held as bits of one integer.
    """
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) - len(b) > most:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, top, more, less, d, left = (1 << len(b)) - 1, 1 << (len(b) - 1), (1 << len(b)) - 1, 0, len(b), len(a)
    for c in a:
        same = where.get(c, 0)
        carried = ((same & more) + more ^ more) | same | less
        up, down = less | ~(carried | more) & full, more & carried
        if up & top:
            d += 1
        elif down & top:
            d -= 1
        left -= 1
        if d - left > most:
            return most + 1
        up = up << 1 | 1
        more = (down << 1 | ~(carried | up)) & full
        less = up & carried & full
    return d


def aligned(a: list[str], b: list[str]) -> int:
    """Characters that one way to turn words ``a`` into ``b`` changes: never below the edit distance."""
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i += 1
            j += 1
        elif i + 1 < n and a[i + 1] == b[j] and (j + 1 == m or a[i + 1] != b[j + 1]):
            cost += len(a[i]) + 1
            i += 1
        elif j + 1 < m and a[i] == b[j + 1] and (i + 1 == n or a[i + 1] != b[j + 1]):
            cost += len(b[j]) + 1
            j += 1
        else:
            cost += max(len(a[i]), len(b[j]))
            i += 1
            j += 1
    return cost + sum(len(w) + 1 for w in a[i:]) + sum(len(w) + 1 for w in b[j:])


def edits_of(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Edit distances of many pairs of texts at once, or any numbers above ``most`` where they are greater.

    A number holds 64 rows of a table; rows farther than ``most`` from the diagonal stay as
    they are, which counts their edits too high and never too low.
    """
    n, m = np.array([[len(x) for x in a], [len(x) for x in b]])
    order = np.argsort(-n, kind="stable")  # those that still have columns are always the first
    n, m = n[order], m[order]
    count, words = len(n), max(1, -(-int(m.max()) // 64))
    points, code = np.unique(np.frombuffer("".join([*(a[i] for i in order), *(b[i] for i in order)]).encode("utf-32-le"), "<u4"), return_inverse=True)
    text = np.zeros((int(n.max()), count), np.int64)  # column, pair
    text[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(count), n)] = code[: n.sum()]
    at, pair = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m), np.repeat(np.arange(count), m)
    same = np.zeros((words, count, len(points)), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    np.bitwise_or.at(same, (at >> 6, pair, code[n.sum() :]), one << (at & 63).astype(np.uint64))
    same = same.reshape(words, -1)
    text += np.arange(count) * len(points)
    more, less = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    left = np.searchsorted(-n, -np.arange(len(text)), "left")
    for j, k in enumerate(left.tolist()):
        up, down = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(max(0, (j - most) // 64), min(words, (j + most + 1) // 64 + 1)):
            eq, p, q = same[w][text[j, :k]], more[w, :k], less[w, :k]
            x = eq | q
            eq |= down
            y = ((eq & p) + p ^ p) | eq
            rise, fall = q | ~(y | p), p & y
            here, up, below, down = up, rise >> top, down, fall >> top
            rise = rise << one | here
            more[w, :k] = fall << one | below | ~(x | rise)
            less[w, :k] = rise & x
    rows = np.clip(m - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(rows == 64, ~np.uint64(0), (one << (rows % 64).astype(np.uint64)) - one)
    out = np.empty(count, np.int64)
    out[order] = n + (np.bitwise_count(more & mask).astype(np.int64) - np.bitwise_count(less & mask)).sum(axis=0)
    return out


def _most(a: str, b: str) -> int:
    return math.floor(max(len(a), len(b)) * round(1 - SIMILARITY, 6) + 1e-9)


def similar_of(pairs: list[tuple[str, str]]) -> list[bool]:
    """``similar`` of many pairs."""
    out, open_ = [False] * len(pairs), []
    for i, (a, b) in enumerate(pairs):
        most = _most(a, b)
        if abs(len(a) - len(b)) <= most:
            if aligned(a.split(" "), b.split(" ")) <= most:
                out[i] = True
            elif max(len(a), len(b)) <= _TOGETHER:
                open_.append(i)
            else:
                out[i] = edits(a, b, most) <= most
    open_.sort(key=lambda i: len(pairs[i][0]))
    for lo in range(0, len(open_), _BATCH):
        part = open_[lo : lo + _BATCH]
        if len(part) < _BATCH // 8:
            found = [edits(*pairs[i], _most(*pairs[i])) for i in part]
        else:
            found = edits_of([pairs[i][0] for i in part], [pairs[i][1] for i in part], max(_most(*pairs[i]) for i in part)).tolist()
        for i, d in zip(part, found, strict=True):
            out[i] = d <= _most(*pairs[i])
    return out


def similar(a: str, b: str) -> bool:
    """Whether two normal forms have an edit similarity of ``SIMILARITY`` or more."""
    most = _most(a, b)
    return abs(len(a) - len(b)) <= most and (aligned(a.split(" "), b.split(" ")) <= most or edits(a, b, most) <= most)


def linked_within(h: np.ndarray, f0: np.ndarray, f1: np.ndarray, norm: list[str]) -> Generator[list[tuple[str, str]], list[bool], list[tuple[int, int]]]:
    """Links (places in the group) that join all lines within ``FAR`` bits which are similar.

    Yields pairs of texts and is sent whether they are similar.
    """
    n, out = len(h), []
    if n == 2:  # they are in the group for each other
        return [(0, 1)] if (yield [(norm[0], norm[1])])[0] else []
    label = np.arange(n)
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(apart(f0, f1, slice(i + 1, n), i) <= FAR)
        near = near[label[near] != label[i]]
        left: dict[int, list[int]] = {}  # of each label one line after the other, until one is similar
        for j in near[::-1].tolist():
            left.setdefault(label[j], []).append(j)
        joined = []
        while left:
            heads = [(x, js.pop()) for x, js in left.items()]
            for (x, j), ok in zip(heads, (yield [(norm[i], norm[j]) for _, j in heads]), strict=True):
                if ok:
                    out.append((i, j))
                    joined.append(x)
                if ok or not left[x]:
                    del left[x]
        if joined:
            label[np.isin(label, joined)] = label[i]
            if (label == label[0]).all():
                break
    return out


def linked(groups: list[Generator]) -> list[list[tuple[int, int]]]:
    """What the ``groups`` of ``linked_within`` return: their pairs are compared together, round by round."""
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    sent: list[list[bool] | None] = [None] * len(groups)
    open_ = list(range(len(groups)))
    while open_:
        asked, pairs = [], []
        for i in open_:
            try:
                some = groups[i].send(sent[i])
            except StopIteration as e:
                out[i] = e.value
                continue
            asked.append((i, len(pairs), len(pairs) + len(some)))
            pairs += some
        found = similar_of(pairs)
        for i, lo, hi in asked:
            sent[i] = found[lo:hi]
        open_ = [i for i, *_ in asked]
    return out


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``h, norm`` of the lines at ``places`` (h, rk, pos): only their documents are shuffled.

    The bit array says no only where a document has no place; the join decides.
    """
    by_doc = written(places.groupBy("rk").agg(F.collect_set(F.struct("pos", "h")).alias("at")), "line-places")
    bits = set_bits(by_doc.count())
    some = docs.select(_row_key(docs).alias("rk"), F.col("text").cast("string").alias("t"), member(by_doc.select("rk"), bits).alias("set")).where(maybe(F.col("set"), F.col("rk"), bits)).select("rk", "t")
    rows = some.join(by_doc.withColumnRenamed("rk", "rk_"), F.col("rk") == F.col("rk_"))
    taken = let(F.split("t", "\n"), lambda x: F.transform("at", lambda a: F.struct(a["h"].alias("h"), F.get(x, a["pos"]).alias("line"))))
    lines = rows.select(F.explode(taken).alias("l")).select("l.h", "l.line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [b" ".join(t.lower().encode().translate(_TABLE).split()).decode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm, pa.string())], names=["h", "norm"])

    return lines.mapInArrow(run, "h long, norm string").dropDuplicates(["h"])


def links(docs: DataFrame, uniq: DataFrame, width: int) -> DataFrame:
    """Edges ``u, v`` of the distinct lines ``uniq`` (h, first, len, f0, f1, f)."""
    met = written(candidates(uniq.select("f0", "f1", "f", "len"), uniq.count(), width), "line-met")
    print_ = [F.col("f0").alias("p0"), F.col("f1").alias("p1")]
    same = (F.col("f0") == F.col("p0")) & (F.col("f1") == F.col("p1"))
    ids = uniq.join(met.select(*print_).distinct(), same, "left_semi").select("h", "f0", "f1", F.col("first.rk").alias("rk"), F.col("first.pos").alias("pos"))
    ids = written(ids, "line-ids")
    texts = _texts(docs, ids.select("h", "rk", "pos")).withColumnRenamed("h", "th")
    texts = written(ids.join(texts, F.col("h") == F.col("th")).select("h", "f0", "f1", "norm"), "line-texts")
    met = met.select("b", *print_)
    hot = met.join(ids.select("f0", "f1"), same).groupBy(F.col("b").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = written(hot.select("hot", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "line-hot")
    rows = met.join(texts, same).select("b", "h", "f0", "f1", "norm").join(hot, F.col("b") == F.col("hot"), "left")
    mine = F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")), lambda c: F.least("mine", c) * F.col("chunks") + F.greatest("mine", c))
    rows = rows.withColumn("mine", mine).withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)))
    rows = rows.select(F.xxhash64("b", "pair").alias("g"), "h", "f0", "f1", "norm").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def verified(t: pa.Table) -> pa.RecordBatch:
            g, h = np.asarray(t.column(0)), np.asarray(t.column(1))
            f0, f1 = (np.asarray(t.column(c)).view(np.uint64) for c in (2, 3))
            begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist()
            u, v = [], []
            norm = t.column(4)
            spans = [(lo, hi) for lo, hi in zip(begin, [*begin[1:], len(g)], strict=True) if hi - lo > 1]
            found = linked([linked_within(h[lo:hi], f0[lo:hi], f1[lo:hi], norm.slice(lo, hi - lo).to_pylist()) for lo, hi in spans])
            for (lo, _), pairs in zip(spans, found, strict=True):
                for i, j in pairs:
                    u.append(h[lo + i])
                    v.append(h[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

        for b in gathered(batches, _ROWS):
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            g = np.asarray(t.column(0))
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if len(g) and g[0] != g[-1] else 0
            if cut:  # the last group may go on in the next batch
                yield verified(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield verified(rest.combine_chunks())
        give_back()

    return rows.mapInArrow(run, "u long, v long")


def removed_lines(docs: DataFrame) -> DataFrame:
    """``rk, gone array<int>``: numbers of the lines of a document that stand elsewhere first."""
    text = F.col("text").cast("string")
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    width = width_of(n)
    lines = written(simhashed(docs, width), "lines")
    firsts = [F.first(c).alias(c) for c in ("len", "f0", "f1", "f")]
    uniq = written(lines.groupBy("h").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("first"), F.count("*").alias("n"), *firsts), "line-groups")
    label = written(components(links(docs, uniq, width)), "line-labels")
    named = uniq.select("h", "first", "n").join(label, F.col("h") == F.col("node"), "left").select("h", "first", "n", "label")
    least = named.where("label is not null").groupBy("label").agg(F.min("first").alias("least")).withColumnRenamed("label", "lab")
    kept = named.where("n > 1 or label is not null").join(least, F.col("label") == F.col("lab"), "left").select(F.col("h").alias("kh"), "n", F.coalesce("least", "first").alias("keep"))
    kept = written(kept, "line-kept")
    here = F.struct("doc_id", "rk", "pos")
    # the commonest lines, 10,000 of them at the most, do not go through the shuffle
    common = max(10_000, math.ceil(n / 10_000))
    few = F.broadcast(kept.where(F.col("n") >= common))
    at = lines.select("doc_id", "rk", "pos", "h")
    met = at.join(few, F.col("h") == F.col("kh")).unionByName(at.join(few.select("kh"), F.col("h") == F.col("kh"), "left_anti").join(kept.where(F.col("n") < common), F.col("h") == F.col("kh")))
    gone = met.where(~here.eqNullSafe(F.col("keep"))).select("rk", "pos")
    return gone.groupBy(F.col("rk").alias("gone_rk")).agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with every removed line cut out of ``text``.

    ``counts`` adds ``n_lines`` and ``n_removed`` in place of columns of these names.
    """
    gone = written(removed_lines(docs), "line-gone")
    bits = set_bits(gone.count())
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_key(docs).alias("rk"), member(gone.select("gone_rk"), bits).alias("set")).withColumn("maybe", maybe(F.col("set"), F.col("rk"), bits)).drop("set")
    # documents outside the set lose nothing and are not shuffled
    rest = rows.where(~F.col("maybe")).select("row", F.lit(None).cast("array<int>").alias("gone"))
    rows = rows.where("maybe").join(gone, F.col("rk") == F.col("gone_rk"), "left").select("row", "gone").unionByName(rest)
    lines = F.split(F.col("row.text"), "\n")
    stays = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(stays)
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return rows.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in names), *more)
