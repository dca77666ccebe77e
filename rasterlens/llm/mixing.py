"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Each source's share of tokens p is raised to an exponent and normalised. The exponent is
bisected until the entropy of the weights meets a target, then, if need be, raised
until no source repeats more than ``max_passes`` times within the budget. Weights are
realised on blocks: a source's documents are dealt by keyed hash into blocks of about
``block_tokens`` tokens; a pass over a source is a keyed permutation of its blocks, and
of the documents in each; the last pass takes blocks in permuted order until the budget
is met, and of the block at the edge the documents that still fit.

DataFrame functions only; every table that is broadcast has one row a source, and their
number is checked against ``MAX_SOURCES``. Which documents a pass takes follows from three
numbers a source, so texts are never shuffled. Prefix sums are two-level: over ``BINS``
bins of a source, then over the blocks of one bin, then over the documents of one block.
The driver sees the sums of tokens by source only.

Defined cases: a null source is a source of its own; a null or empty text has no tokens
and is taken in every whole pass; rows that repeat a doc_id fall into the same block and
are taken or left together; ties in order follow doc_id; extra columns stay; an empty
table, or one without tokens, gives every row once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlens.llm.common import literal_rows, words_of, written

BLOCK_TOKENS, BINS, MAX_SOURCES, SEED = 1 << 16, 1024, 10_000, 17
#: Entropy of the weights as a share of that of equal weights, and passes over a source at most.
ENTROPY, MAX_PASSES = 0.97, 2.0


def key(*parts) -> Column:
    """Sixty keyed bits, the same in any SQL engine: the start of an MD5."""
    texts = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = F.concat_ws("|", *(F.coalesce(t.cast("string"), F.lit("~")) for t in texts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def weights(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    raw = [(t / top) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisect(good, low: float, high: float, steps: int = 60) -> float:
    """The least exponent in [low, high] that is ``good``; ``good`` holds at ``high`` and above its first point."""
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def temperature(tokens: list[int], share: float = ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None) -> tuple[float, list[float], float]:
    """Exponent, weights and budget. Without a budget, the least that passes over every source once.

    Entropy falls as the exponent rises, and so do the passes over small sources: the
    exponent is the greatest that reaches the target entropy, unless the limit on passes
    asks for a greater one. Exponents lie in [0, 1]; natural shares (1) are never sharpened.
    """
    some = [float(t) for t in tokens if t > 0]
    if not some:
        return 1.0, [0.0 for _ in tokens], 0.0

    def spent(e: float) -> float:
        w = weights(some, e)
        return float(budget) if budget is not None else max(t / x for t, x in zip(some, w, strict=True))

    goal = share * math.log(len(some))
    by_entropy = 1.0 - bisect(lambda x: entropy(weights(some, 1.0 - x)) >= goal, 0.0, 1.0)
    fits = lambda e: max(spent(e) * x / t for t, x in zip(some, weights(some, e), strict=True)) <= max_passes * (1 + 1e-9)
    if not fits(1.0):
        raise ValueError("the budget asks for more passes than max_passes even at natural shares")
    exponent = round(bisect(fits, by_entropy, 1.0), 9)
    w = iter(weights(some, exponent))
    return exponent, [next(w) if t > 0 else 0.0 for t in tokens], spent(exponent)


def quotas(sums: list[tuple[str | None, int]], **how) -> list[tuple[str | None, int, int, int, int]]:
    """``source, tokens, blocks, passes, rest``: whole passes and the tokens of the last one."""
    block_tokens = how.pop("block_tokens", BLOCK_TOKENS)
    _, w, budget = temperature([t for _, t in sums], **how)
    out = []
    for (source, tokens), x in zip(sums, w, strict=True):
        quota = math.floor(budget * x + 1e-6)
        passes, rest = divmod(quota, tokens) if tokens else (1, 0)
        out.append((source, tokens, max(1, -(-tokens // block_tokens)), passes, rest))
    return out


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` of every row; a token is a word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"))


def plan(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """One row a source: ``psource, blocks, passes, edge_key, edge_block, edge_doc``.

    Of the last pass, blocks with a key below ``edge_key`` are taken, and of the block
    ``edge_block`` the documents with a key up to ``edge_doc``.
    """
    spark = docs.sparkSession
    rows = written(counted(docs), "tokens")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    quota = literal_rows(spark, quotas(sorted(((r["source"], r["t"]) for r in sums), key=lambda x: (x[0] is not None, x[0] or "")), **how), ["psource", "all_tokens", "blocks", "passes", "rest"], ["string", "long", "long", "long", "long"])
    dealt = rows.join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("psource"))).withColumn("block", F.pmod(key(seed, "block", F.col("doc_id")), "blocks"))
    blocks = dealt.groupBy("psource", "block", "passes", "rest").agg(F.sum("tokens").alias("t")).withColumn("bkey", key(seed, "order", F.col("passes"), F.col("psource"), F.col("block")))
    blocks = written(blocks.withColumn("bin", F.shiftright("bkey", 60 - BINS.bit_length() + 1)), "blocks")
    at = lambda *order: Window.partitionBy("psource").orderBy(*order)
    # the edge: the first bin, then block, at which the running sum passes the rest
    bins = blocks.groupBy("psource", "bin", "rest").agg(F.sum("t").alias("t")).withColumn("upto", F.sum("t").over(at("bin"))).where("upto > rest")
    bins = bins.groupBy("psource").agg(F.min(F.struct("bin", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(F.col("psource").alias("s"), F.col("e.bin").alias("ebin"), F.col("e.before").alias("before"))
    inside = blocks.join(F.broadcast(bins), F.col("psource").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("ebin"))).withColumn("upto", F.col("before") + F.sum("t").over(at("bkey", "block"))).where("upto > rest")
    edge = inside.groupBy("psource").agg(F.min(F.struct("bkey", "block", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(F.col("psource").alias("s"), "e.bkey", F.col("e.block").alias("eb"), "e.before")
    edge = written(edge, "edges")
    last = dealt.join(F.broadcast(edge), F.col("psource").eqNullSafe(F.col("s")) & (F.col("block") == F.col("eb"))).withColumn("dkey", key(seed, "doc", F.col("passes"), F.col("doc_id")))
    same = last.groupBy("psource", "dkey", "before", "rest").agg(F.sum("tokens").alias("t")).withColumn("upto", F.col("before") + F.sum("t").over(at("dkey")))
    docs_in = same.where("upto <= rest").groupBy("psource").agg(F.max("dkey").alias("edge_doc")).withColumnRenamed("psource", "s2")
    out = quota.join(F.broadcast(edge), F.col("psource").eqNullSafe(F.col("s")), "left").join(F.broadcast(docs_in), F.col("psource").eqNullSafe(F.col("s2")), "left")
    return written(out.select("psource", "blocks", "passes", F.col("bkey").alias("edge_key"), F.col("eb").alias("edge_block"), "edge_doc"), "mix")


def mixed(docs: DataFrame, seed: int = SEED, marks: bool = True, **how) -> DataFrame:
    """Every row as often as the mixture takes it, with ``pass, block, block_key, doc_key``.

    Columns of ``docs`` with one of these names give way. Without ``marks`` the rows have the columns of ``docs`` alone. Sorting by ``(pass, block_key, doc_key)`` runs through the mixture as block permutations.
    """
    by_source = F.broadcast(plan(docs, seed, **how))
    m = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"))
    m = m.join(by_source, F.col("src").eqNullSafe(F.col("psource"))).withColumn("block", F.pmod(key(seed, "block", F.col("id")), "blocks"))
    last = key(seed, "order", F.col("passes"), F.col("psource"), F.col("block"))
    in_last = F.when(F.col("edge_key").isNull(), F.lit(False)).otherwise((last < F.col("edge_key")) | ((F.col("block") == F.col("edge_block")) & F.coalesce(key(seed, "doc", F.col("passes"), F.col("id")) <= F.col("edge_doc"), F.lit(False))))
    times = F.col("passes") + in_last.cast("long")
    m = m.withColumn("times", times).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    if not marks:
        return m.select("row.*")
    names = [c for c in docs.columns if c not in ("pass", "block", "block_key", "doc_key")]
    return m.select(*(F.col("row").getField(c).alias(c) for c in names), "pass", "block", key(seed, "order", F.col("pass"), F.col("psource"), F.col("block")).alias("block_key"), key(seed, "doc", F.col("pass"), F.col("id")).alias("doc_key"))
