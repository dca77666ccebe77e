"""Linking of line segments: grid distance join, link scores, mutual best, forests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rasterlens.functions.geometry import angle_between


#: A cell asks itself and the half of its neighbours that does not ask it.
HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
#: Up to this gap the points between two ends are looked up by the way from one to the other.
TABLE_GAP = 64.0


def grid_pairs(ends: DataFrame, gap: float) -> DataFrame:
    """Pairs of endpoints of different components within ``gap``, each once (a_id < b_id).

    Endpoints are filed under their grid cell; one side also asks half of the cells around.
    An equi-join on (image, cell): a dense cell costs what its own neighbourhood holds. Both
    sides are dealt by cell and neither is broadcast; the pairs are far more than the ends, so
    the number of tasks does not follow the ends' bytes.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(F.col(c) / gap).cast("long")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in HALF)))
    a = ends.select(F.struct(*ends.columns).alias("a"), F.col("image_id").alias("im"), (cell("x")).alias("cx"), cell("y").alias("cy"), around.alias("o"))
    a = a.select("a", "im", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    b = ends.select(F.struct(*ends.columns).alias("b"), F.col("image_id").alias("im"), cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    at = ["im", "cx", "cy"]
    met = a.repartition(n, *at).join(b.repartition(n, *at).hint("merge"), at)
    met = met.where((F.col("b.id") > F.col("a.id")) | (~F.col("own") & (F.col("b.id") < F.col("a.id")))).where(F.col("a.component_id") != F.col("b.component_id"))
    met = met.withColumn("gap", F.sqrt((dx * dx + dy * dy).cast("double"))).where(F.col("gap") <= gap)
    in_order = F.col("a.id") < F.col("b.id")
    first, second = F.when(in_order, F.col("a")).otherwise(F.col("b")), F.when(in_order, F.col("b")).otherwise(F.col("a"))
    return fixed(met, a=first, b=second, gap=F.col("gap"))


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out here, once a row: rules on them do not move into what is below, where
    they would be spelt out many times over, in code too long for the JVM to compile."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(one.alias("r_")).select(*(F.col(f"r_.{n}").alias(n) for n in columns))


def samples(gap: Column, start: tuple[Column, Column], way: tuple[Column, Column]) -> Column:
    """Distinct whole points from a start along a way of length ``gap``, sorted by (x, y)."""
    n = F.greatest(F.ceil(gap).cast("int") + 1, F.lit(2))
    along = lambda c, i: F.bround(start[c] + way[c] * i / (n - F.lit(1.0)), 0).cast("long")
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(along(0, i).alias("x"), along(1, i).alias("y")))))


def sampled(pairs: DataFrame, gap: float, inner: bool = False) -> DataFrame:
    """``pairs`` with ``x0, y0, rel``: the sample points between two ends are ``(x0, y0) + rel``, sorted by (x, y).

    ``inner`` leaves out the outer two of more than two. Between whole points ``rel`` depends on
    the way and, as halves go to the even number, on whether the start's coordinates are odd; so
    it is made once for each of these (about ``4 pi gap^2``, a parameter) and looked up.
    """
    x, y = (F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xy")
    asked = lambda p: F.when(F.size(p) > 2, F.slice(p, F.lit(2), F.size(p) - 2)).otherwise(p) if inner else p
    whole = all(isinstance(pairs.schema[s].dataType[c].dataType, IntegralType) for s in "ab" for c in "xy")
    if not whole or gap > TABLE_GAP:
        return pairs.withColumn("x0", F.lit(0).cast("long")).withColumn("y0", F.lit(0).cast("long")).withColumn("rel", asked(samples(F.col("gap"), (F.col("a.x"), F.col("a.y")), (x, y))))
    r = int(gap)
    side, odd = (lambda: F.explode(F.sequence(F.lit(-r), F.lit(r)))), (lambda: F.explode(F.array(F.lit(0), F.lit(1))))
    ways = pairs.sparkSession.range(1).select(side().alias("dx")).select("dx", side().alias("dy")).select("*", odd().alias("px")).select("*", odd().alias("py"))
    key = lambda dx, dy, px, py: (((dx + r) * (2 * r + 1) + dy + r) * 4 + px * 2 + py).cast("long")
    length = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    table = fixed(ways.where(length <= gap), k_=key(*map(F.col, ("dx", "dy", "px", "py"))), all_=samples(length, (F.col("px"), F.col("py")), (F.col("dx"), F.col("dy"))))
    parity = lambda c: F.pmod(F.col(f"a.{c}"), F.lit(2))
    met = pairs.withColumn("k_", key(x, y, parity("x"), parity("y"))).join(F.broadcast(fixed(table, k_=F.col("k_"), rel=asked(F.col("all_")))), "k_").drop("k_")
    return fixed(met, **{c: F.col(c) for c in pairs.columns}, x0=F.col("a.x") - parity("x"), y0=F.col("a.y") - parity("y"), rel=F.col("rel"))


def allowed(pairs: DataFrame, direction: float = 60.0, connection: float = 75.0, lateral: float = 15.0) -> DataFrame:
    """Pairs that no rule of geometry rejects, cheapest rules first, with ``turn, ca, cb, offset_px``."""
    # rules may be looked at before the gap is known not to be 0
    ux, uy = (F.try_divide((F.col(f"b.{c}") - F.col(f"a.{c}")).cast("double"), F.col("gap")) for c in "xy")
    p = pairs.where("gap > 1e-9").withColumn("ux", ux).withColumn("uy", uy)
    p = p.withColumn("turn", angle_between(F.col("a.tx"), F.col("a.ty"), F.col("b.tx"), F.col("b.ty"), undirected=True)).where(F.col("turn") <= direction)
    p = p.withColumn("ca", angle_between(F.col("a.tx"), F.col("a.ty"), F.col("ux"), F.col("uy"), undirected=True)).withColumn("cb", angle_between(F.col("b.tx"), F.col("b.ty"), F.col("ux"), F.col("uy"), undirected=True))
    p = p.where((F.col("ca") <= connection) & (F.col("cb") <= connection))
    off = lambda s: F.abs(F.col("gap") * (F.col("ux") * F.col(f"{s}.ty") - F.col("uy") * F.col(f"{s}.tx")))
    return p.withColumn("offset_px", F.greatest(off("a"), off("b"))).where(F.col("offset_px") <= lateral).drop("ux", "uy")


def scores(pairs: DataFrame, gap: float, direction: float = 60.0, connection: float = 75.0, lateral: float = 15.0, response: float | None = None, support: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links that no rule rejects, cheapest rules first, with their score (less is better).

    With ``response`` the pairs also hold ``inside`` (all points of the gap lie in the mask) and
    ``share`` (of them at or above the threshold): links that leave the mask or have a lesser
    share go, and ``1 - share`` is part of the score. ``support`` adds the two columns to the
    pairs that geometry leaves.
    """
    eps = 2.220446049250313e-16
    p = allowed(pairs, direction, connection, lateral)
    score = F.col("gap") / gap + F.col("turn") / max(direction, eps) + F.greatest("ca", "cb") / max(connection, eps) + F.col("offset_px") / max(lateral, eps)
    more = []
    if response is not None:
        p = (support(p) if support else p).where(F.col("inside") & (F.col("share") >= response))
        score, more = score + 1 - F.col("share"), ["share"]
    return p.select(F.col("a.image_id").alias("image_id"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("a.component_id").alias("a_comp"), F.col("b.component_id").alias("b_comp"), F.round("gap", 6).alias("gap"), F.round("turn", 6).alias("turn"), F.round("offset_px", 6).alias("offset_px"), *more, F.round(score, 6).alias("score"))


def mutual_best(links: DataFrame) -> DataFrame:
    """``image_id, a_id, b_id, score`` of the links that are the best of both their ends (ties to the lower ids).

    For one end the order by (a_id, b_id) is the order by its other end. So a score (of six
    decimals) and the other end make one whole number, whose least is found in each task
    before anything is shuffled: at most one row an end and task travels.
    """
    base, zero = F.lit(str(10**20)).cast("decimal(21,0)"), F.lit(str(2**63)).cast("decimal(19,0)")
    role = lambda end, other: F.struct(F.col(end).alias("end"), F.col(other).alias("other"))
    ends = links.select("image_id", "score", F.explode(F.array(role("a_id", "b_id"), role("b_id", "a_id"))).alias("e"))
    key = F.rint(F.col("score") * 1e6).cast("long").cast("decimal(17,0)") * base + (F.col("e.other").cast("long").cast("decimal(19,0)") + zero)
    first = ends.groupBy("image_id", F.col("e.end").alias("end")).agg(F.min(key.cast("decimal(38,0)")).alias("k"))
    rest = F.pmod("k", base)
    first = first.select("image_id", "end", (rest - zero).cast("long").alias("other"), ((F.col("k") - rest) / base).cast("long").alias("micro"))
    both = first.groupBy("image_id", F.least("end", "other").alias("a_id"), F.greatest("end", "other").alias("b_id"), "micro").agg(F.count("*").alias("n")).where("n = 2")
    return both.select("image_id", "a_id", "b_id", (F.col("micro") / F.lit(1e6)).alias("score"))


def mutual_links(ends: DataFrame, gap: float) -> DataFrame:
    """The links of ``scores`` that are the best of both their ends, all columns; they alone are looked up again."""
    best = mutual_best(scores(grid_pairs(ends, gap), gap)).select("image_id", "a_id", "b_id")
    once = ends.dropDuplicates(["image_id", "id"])
    side = lambda s: once.select(F.struct(*ends.columns).alias(s), F.col("image_id"), F.col("id").alias(f"{s}_id"))
    met = best.hint("merge").join(side("a").hint("merge"), ["image_id", "a_id"]).join(side("b").hint("merge"), ["image_id", "b_id"])
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return scores(met.select("a", "b", F.sqrt((dx * dx + dy * dy).cast("double")).alias("gap")), gap)


def forest(links: DataFrame) -> DataFrame:
    """Greedy selection by score: an end is used once, and components are joined once (one image a task)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        used, keep = set(), []
        for r in pdf.sort_values(["score", "a_id", "b_id"]).itertuples():
            x, y = find(r.a_comp), find(r.b_comp)
            ok = r.a_id not in used and r.b_id not in used and x != y
            keep.append((r.Index, ok))
            if ok:
                used |= {r.a_id, r.b_id}
                root[max(x, y)] = min(x, y)
        return pdf.loc[[i for i, ok in keep if ok]]

    return links.groupBy("image_id").applyInPandas(pick, links.schema)
