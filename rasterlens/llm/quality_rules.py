"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and word pairs are hashed into ``buckets``; their counts over every document make
the raw multinomial, those over trusted documents the target multinomial (both smoothed
by one count a bucket share). A document's score is the mean log ratio over its n-grams,
in integer millionths, so sums do not depend on the order of rows. ``kept`` compares it
with a fixed threshold; the base rules (length, repetition) come first.

DataFrame functions only. The counting pass pre-aggregates into at most ``buckets`` rows
a task; the ratios (``buckets`` integers, a proven bound) come back as a scalar
subquery. Scoring is one pass over the rows without a shuffle. Repeated windows are found
within a row by sorting hashes and then comparing the words themselves.

Defined cases: a null text has no words and fails the base rules; a document without
n-grams scores 0; repeated rows and extra columns are harmless (rows are scored one by
one); without trusted documents all ratios are 0 and the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import let, words_of, written

BUCKETS = 1 << 14
#: Least mean log ratio that is kept.
THRESHOLD = -0.07
SYMBOLS = "#*$%&|<>"
_LOW = (1 << 28) - 1


def grams(words: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    two = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def neighbours_equal(rows: Column, key) -> Column:
        # rows are sorted by key; F.get is null outside, which equals nothing
        same = lambda v, i: F.coalesce(key(v) == key(F.get(rows, i - 1)), F.lit(False)) | F.coalesce(key(v) == key(F.get(rows, i + 1)), F.lit(False))
        return F.filter(rows, same)

    def found(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        hashed = F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
        maybe = let(F.sort_array(hashed), lambda s: neighbours_equal(s, lambda v: v.bitwiseAND(F.lit(~_LOW))))
        spelt = F.transform(
            maybe, lambda v: let(v.bitwiseAND(F.lit(_LOW)).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p")))
        )
        sure = let(F.sort_array(spelt), lambda s: neighbours_equal(s, lambda v: v["s"]))
        at = F.sort_array(F.transform(sure, lambda v: v["p"]))
        start = F.struct(F.lit(-3).alias("e"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("e"), (a["n"] + F.least(F.lit(3), p - a["e"])).cast("long").alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    return let(words, found)


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, llr`` (millionths) of every bucket that occurs. ``trusted_ids``: doc_id."""
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("__t")).where("__t is not null").distinct()
    # texts are joined, not words; always dealt by id, so nothing depends on whether the ids would fit a broadcast
    marked = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(ids.hint("merge"), F.col("d") == F.col("__t"), "left").select("__t", words_of(F.col("text")).alias("w"))
    counts = marked.select(F.explode(grams(F.col("w"), buckets)).alias("bucket"), F.col("__t").isNotNull().cast("long").alias("t")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = written(counts, "grams")
    total = counts.agg(F.sum("raw").alias("raw_n"), F.sum("target").alias("target_n")).first()
    raw_n, target_n = total["raw_n"] or 0, total["target_n"] or 0
    if not target_n:
        return counts.select("bucket", F.lit(0).cast("long").alias("llr"))
    p = lambda c, n: (F.col(c) + 1.0) / F.lit(float(n + buckets))
    return counts.select("bucket", F.round(F.log(p("target", target_n) / p("raw", raw_n)) * 1e6).cast("long").alias("llr"))


def scored(docs: DataFrame, llr: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, ``llr`` (mean log ratio), ``base_failed`` and ``kept`` of every row."""
    # one array of ``buckets`` numbers: its size is a parameter, not the data's
    slots = docs.sparkSession.range(buckets).join(llr, F.col("id") == F.col("bucket"), "left").select(F.struct("id", F.coalesce("llr", F.lit(0).cast("long")).alias("v")).alias("s"))
    table = slots.groupBy().agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias("a"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"), words_of(F.col("text")).alias("w"), table.scalar().alias("a"))
    total = let(F.col("a"), lambda a: F.aggregate(grams(F.col("w"), buckets), F.lit(0).cast("long"), lambda s, g: s + F.coalesce(F.get(a, g), F.lit(0).cast("long"))))
    got = rows.select("doc_id", *(c.alias(k) for k, c in base_columns(F.col("t"), F.col("w")).items()), total.alias("total"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return got.withColumn("base_failed", failed).withColumn("llr", F.col("total") / n / 1e6).withColumn("kept", ~failed & (F.col("total") >= n * int(threshold * 1e6))).drop("total")


def quality(docs: DataFrame, trusted_ids: DataFrame, **how) -> DataFrame:
    """All rules for every document."""
    return scored(docs, ratios(docs, trusted_ids), **how)
