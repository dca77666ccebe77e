"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors.

A logistic regression on a few text statistics, trained in numpy on a bounded sample of
labelled rows, gives each document its evidence. The evidence is then grouped: the
expected number of good documents of each host and of each path within it. Beta priors
are fitted by the method of moments, the hosts' around the global rate and the paths'
around their host, so that sparse sites shrink toward what stands above them. A document's
posterior log-odds are its evidence plus what its path (leaving the document itself out)
says beyond the global rate.

Only one row a document (id, site, evidence) is shuffled; host and path sums are
pre-aggregated, so a host with a third of all rows costs what any other does.

Defined cases: null and empty texts have all statistics at zero; a null host or path is a
site of its own; repeated rows are scored alike and counted as often as they stand;
labels that repeat a doc_id count as good if all do; without labels of both classes the
evidence is the rate of the class there is (one half without labels); extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import written

MAX_LABELLED, THRESHOLD = 8000, 0.5
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "marks", "distinct", "top_word", "dup_lines", "line_words", "end_marks", "bars")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, each of the order of one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), sum(map(len, words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = Counter(text)
    share = lambda cs: sum(kinds[c] for c in cs) / chars
    upper = sum(v for c, v in kinds.items() if c.isupper()) / chars
    digits = sum(v for c, v in kinds.items() if c.isdigit()) / chars
    return [
        math.log1p(n) / 5, chars / n / 5, upper, digits, share("#*$%&<>@"), share("!?"), len(count) / n, max(count.values()) / n,
        1 - len(set(lines)) / len(lines), min(n / len(lines), 200.0) / 100, share(".,;:"), share("|[]{}"),
    ]


def train(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(mean, scale, weights, bias)`` of a ridge logistic regression with squared terms (Newton steps)."""
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        k = 2 * len(NAMES)
        return np.zeros(k), np.ones(k), np.zeros(k), math.log(rate / (1 - rate))
    z = widened(x)
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = np.column_stack([(z - mean) / scale, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    pen = np.full(len(w), ridge * len(z))
    pen[-1] = 0
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pen * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def widened(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x * x])


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents (least hash first), of whole texts of any length."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.min("quality").cast("double").alias("q")).orderBy(F.xxhash64("i"), "i").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("d") == F.col("i")).select("i", "text", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64())), b.column(2)], names=["i", "x", "q"])

    got = rows.mapInArrow(run, "i long, x array<double>, q double").distinct().toArrow().sort_by("i")
    return np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES)), np.asarray(got.column("q"), float)


def evidence(docs: DataFrame, model: tuple, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, z``: log-odds of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w, bias = model
        for b in batches:
            x = np.array([statistics(t) for t in b.column(3).to_pylist()], float).reshape(-1, len(NAMES))
            z = np.clip(((widened(x) - mean) / scale) @ w + bias, -12, 12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(z)], names=["doc_id", "host", "path", "z"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, z double")


def _strength(rate: Column, n: Column, prior: Column) -> list[Column]:
    """Sums from which the method of moments fits the weight of a Beta prior."""
    v = prior * (1 - prior)
    return [F.sum(n * (rate - prior) * (rate - prior)).alias("between"), F.sum(v).alias("noise"), F.sum(n * v).alias("room"), F.count("*").alias("groups")]


def strength(r) -> float:
    """The prior's weight in documents: high where groups differ no more than chance has it.

    Each group's squared distance from its prior is v/n by chance and v/(s+1) beside it.
    """
    between, noise, room = (float(r[k] or 0.0) for k in ("between", "noise", "room"))
    spread = max(between - noise, 0.0) / room if room > 0 else 0.0
    return min(1 / spread - 1, 1e6) if spread > 1e-6 else 1e6


def posterior(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Host and path posteriors joined back to every document."""
    rows = written(scored.withColumn("p", 1 / (1 + F.exp(-F.col("z")))), "evidence")
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(max((total["good"] or 0.0) / total["n"], 1e-4), 1 - 1e-4) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hg")).withColumnRenamed("host", "h")
    s_host = strength(hosts.agg(*_strength(F.col("hg") / F.col("hn"), F.col("hn"), F.lit(rate))).first())
    both = paths.join(hosts.withColumn("h_rate", (F.col("hg") + s_host * rate) / (F.col("hn") + s_host)), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    both = written(both, "sites")
    s_path = strength(both.agg(*_strength(F.col("good") / F.col("n"), F.col("n"), F.col("h_rate"))).first())
    sites = both.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "good", "hn", "hg")
    m = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # the document itself is left out of its host and path
    host_rate = (F.col("hg") - F.col("p") + s_host * rate) / (F.col("hn") - 1 + s_host)
    path_rate = (F.col("good") - F.col("p") + s_path * F.col("host_rate")) / (F.col("n") - 1 + s_path)
    odds = lambda r: F.log(F.greatest(F.least(r, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(r, F.lit(1 - 1e-6)), F.lit(1e-6))))
    m = m.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    m = m.withColumn("posterior", 1 / (1 + F.exp(-(F.col("z") + odds(F.col("path_rate")) - math.log(rate / (1 - rate))))))
    return m.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def classified(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """Every document with its evidence, site rates, posterior and verdict.

    The host of ``documents`` is its source and the path its language, unless given.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    return posterior(evidence(docs, train(*labelled(docs, labels)), host, path))


def url_host(url: Column) -> Column:
    """Host of a URL, lower case, without port."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def url_path(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` segments of a URL's path."""
    whole = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_join(F.slice(F.filter(F.split(whole, "/"), lambda s: s != ""), 1, depth), "/")
