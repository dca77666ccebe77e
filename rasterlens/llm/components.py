"""Connected components by alternating large-star and small-star contractions.

Edges are pairs of long ids; every round is two grouped minima and two equi-joins, and
each round's edges are written to the shared folder. Nothing is collected: the driver
sees only a count and a checksum a round. Edges of a hub are split by the adaptive
skew join; minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import dropped, written


def _sign(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges ``u > v``; returns edges of the same form."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # each neighbour above u hangs on the least node around u
        out = edges.join(low, F.col("v") == F.col("k")).select("u", F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        out = edges.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, label`` for every id in ``edges`` (columns ``u, v``, any direction).

    ``label`` is the least id of the component. Self-loops and nulls are left out;
    an empty table gives an empty result.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v and u is not null and v is not null").distinct(), "edges"
    )
    sign = _sign(now)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        nxt = written(_star(_star(now, large=True), large=False), "edges")
        dropped(now)
        now, last, sign = nxt, sign, _sign(nxt)
        if sign == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: stars whose centre is the least id of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
