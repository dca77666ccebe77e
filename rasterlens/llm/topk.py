"""Exact top-k by inner product: descending norms, SVD-rotated partial sums, residual bounds.

Vectors are integers ``floor(64 x)``. Candidates are packed into blocks in descending
order of length. For a block of queries, a block of candidates is skipped for every
query whose k-th best score already exceeds ``|q| * longest``; for the others the inner
product over the leading rotated components plus the Cauchy-Schwarz bound of the rest,
``|q_rest| * |x_rest|``, prunes pairs, and what survives is scored in integers.

Every task holds one block of queries and a run of candidate blocks; the blocks of
queries are a share of the input by contract, and neither side is broadcast or collected.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part, neither as queries nor as candidates; shorter vectors count as padded with zeros;
a null id takes no part; rows that repeat a query's id are its own rows and no
candidates of it; repeated candidates stand as often as they occur; ties go to the
smaller id; an empty table gives an empty result. Scores must stay below 2^53 in magnitude
(exact in doubles and in 64-bit integers), else the query fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, score long"
#: Queries of a block, candidates of a block, blocks of a run.
QUERIES, ROWS, RUN = 1024, 2048, 32
#: Surviving pairs that are scored at once.
SLAB = 1 << 15
#: Vectors (least hash first) on which the rotation is fitted.
SAMPLE = 4096


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, x array<long>`` of the vectors that take part; components beyond a long are its ends."""
    edge = 9223372036854774784.0  # the greatest double below 2^63
    whole = lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(edge)), F.lit(-edge)))
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    kept = vectors.where(F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("x"))
    return kept


def rotation(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Right singular vectors of a bounded sample, strongest first (an orthogonal matrix)."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow().column(0).to_pylist()
    width = max(map(len, rows), default=0)
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return np.linalg.svd(m, full_matrices=True)[2].T if width and len(rows) else np.eye(max(1, width))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), np.int64)
    if (lens == width).all():
        return flat.reshape(-1, width)
    m = np.zeros((len(lens), max(width, int(lens.max(initial=0)))), np.int64)
    m[np.arange(m.shape[1])[None, :] < lens[:, None]] = flat
    return m


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, score, id) triples the k best of each row, best first."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.searchsorted(row, np.arange(n))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], score[keep], ids[keep]


def exact(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for components so large that a score may pass 2^53: whole-number arithmetic.

    Scores beyond 2^63 - 1 either way are that number.
    """
    small = int(max(abs(int(q.min(initial=0))), int(q.max(initial=0)))) * int(max(abs(int(c.min(initial=0))), int(c.max(initial=0)))) * q.shape[1] < 1 << 63
    row, score, ids = (np.empty(0, np.int64) for _ in range(3))
    step = 256 if not small else ROWS
    for lo in range(0, len(c), step):
        block = c[lo : lo + step]
        got = q @ block.T if small else np.clip(q.astype(object) @ block.astype(object).T, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
        at, col = np.nonzero(q_ids[:, None] != c_ids[None, lo : lo + step])
        row, score, ids = _best(np.concatenate((row, at)), np.concatenate((score, got[at, col])), np.concatenate((ids, c_ids[lo + col])), len(q), k)
    return row, score, ids


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, score, id) of the k best candidates of each query, exactly."""
    width = max(q.shape[1], c.shape[1], len(turn))
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * width >= 2.0**53:
        # only the vectors that make it so: the rest is searched as ever, and the bests are merged
        limit = np.sqrt(2.0**52 / width)
        big = [np.abs(m.astype(float)).max(1, initial=0) >= limit for m in (q, c)]
        parts = []
        for mine, other in ((~big[0], ~big[1]), (~big[0], big[1]), (big[0], np.ones(len(c), bool))):
            if mine.any() and other.any():
                one = (q_ids[mine], q[mine], c_ids[other], c[other], k)
                r, s, i = search(*one, turn, rows) if not (big[0][mine].any() or big[1][other].any()) else exact(*one)
                parts.append((np.flatnonzero(mine)[r], s, i))
        cols = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        return _best(*cols, len(q), k)
    if len(turn) < width:  # what the sample never saw stays as it is
        turn = np.block([[turn, np.zeros((len(turn), width - len(turn)))], [np.zeros((width - len(turn), len(turn))), np.eye(width - len(turn))]])
    head = max(1, width // 4)
    norm = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.lexsort((c_ids, -norm))
    c, c_ids, norm = c[order], c_ids[order], norm[order]
    qf, q_norm = q.astype(float), np.sqrt((q.astype(float) ** 2).sum(1))
    qt = qf @ turn
    q_rest = np.sqrt((qt[:, head:] ** 2).sum(1))
    slack = 1e-9 * (1 + q_norm * (norm[0] if len(norm) else 0))
    floor = np.full(len(q), -np.inf)
    row, score, ids = (np.empty(0, np.int64) for _ in range(3))
    lo, step = 0, min(rows, max(256, 4 * k))  # a short first block gives the first floors
    while lo < len(c):
        block, block_ids, longest = c[lo : lo + step], c_ids[lo : lo + step], norm[lo]
        lo, step = lo + step, min(rows, 2 * step)
        live = np.flatnonzero(q_norm * longest + slack >= floor)
        if not len(live):
            break  # later blocks are shorter still
        dense = not np.isfinite(floor[live]).all()
        if dense:  # no floor yet: the scores themselves (exact: below 2^53) give one
            bound = qf[live] @ block.astype(float).T
            bound[q_ids[live, None] == block_ids[None, :]] = -np.inf
            least = np.partition(bound, -k, axis=1)[:, -k] if bound.shape[1] >= k else np.full(len(live), -np.inf)
        else:
            ct = block.astype(float) @ turn
            bound = qt[live, :head] @ ct[:, :head].T
            bound += q_rest[live, None] * np.sqrt((ct[:, head:] ** 2).sum(1))[None, :]
            least = floor[live] - slack[live]
        at, col = np.nonzero((bound >= least[:, None]) & (bound > -np.inf))
        own = q_ids[live[at]] != block_ids[col]
        at, col = at[own], col[own]
        if dense:
            got = bound[at, col].astype(np.int64)
        elif len(at) > bound.size // 16:  # for so many pairs one product is less work; below 2^53 it is exact
            got = np.matmul(qf[live], block.astype(float).T, out=bound)[at, col].astype(np.int64)
        else:
            got = np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", q[live[at[i : i + SLAB]]], block[col[i : i + SLAB]]) for i in range(0, len(at), SLAB))])
        at = live[at]
        best = got >= floor[at]
        at, col, got = at[best], col[best], got[best]
        row, score, ids = _best(np.concatenate((row, at)), np.concatenate((score, got)), np.concatenate((ids, block_ids[col])), len(q), k)
        full = np.bincount(row, minlength=len(q)) >= k
        last = np.searchsorted(row, np.arange(len(q)), side="right") - 1
        floor[full] = score[last[full]]
    return row, score, ids


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all vectors for each query.

    Queries are the rows whose id is divisible by ``every``.
    """
    usable_ = usable(vectors, scale, id_col, vec_col)
    n, n_q = usable_.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    turn = rotation(usable_)
    width = len(turn)
    q_blocks, runs = max(1, -(-n_q // QUERIES)), max(1, -(-n // (ROWS * RUN)))
    runs = max(runs, min(RUN, -(-n // ROWS)))  # while blocks are few, no fewer tasks than blocks
    # each run holds every length, so that each can stop early
    deal = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    cand = usable_.select("vec_id", "x", deal(runs, 1).alias("run")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    quer = usable_.where(F.col("vec_id") % every == 0).select("vec_id", "x", deal(q_blocks, 2).alias("qb")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q_ids, c_ids = (np.asarray(t.column("vec_id").combine_chunks(), np.int64) for t in (left, right))
        row, score, ids = search(q_ids, _matrix(left.column("x"), width), c_ids, _matrix(right.column("x"), width), k, turn)
        return pa.table({"query_id": q_ids[row], "vec_id": ids, "score": score})

    near = quer.groupBy("qb", "run").cogroup(cand.groupBy("qb", "run")).applyInArrow(meet, OUT)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
