"""Helpers shared by the corpus operators: the shared folder, written tables, lookups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only where that
    is unset and the session is local (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="rasterlens-"))
            named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/rasterlens-{sc.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterlens_path = path
    del df
    gc.collect()  # shuffle files of plans that nothing refers to any more can go now
    spark._jvm.System.gc()
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later plan reads."""
    path = getattr(df, "_rasterlens_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def set_bits(n: int) -> int:
    """Power of two of the bits that ``member`` takes for ``n`` ids: 16 bits an id, 8 MB at most."""
    return min(26, max(14, (16 * max(n, 1) - 1).bit_length()))


def member(ids: DataFrame, bits: int) -> Column:
    """A set of ids (its one column) as an array of ``2^bits`` bits, for ``maybe``."""
    at = F.xxhash64(ids.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = ids.select(F.shiftright(at, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = ids.sparkSession.range(0, 1 << (bits - 6), 1, 1).join(found, F.col("id") == F.col("w"), "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("s"))
    return dense.groupBy().agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]).alias("a")).scalar()


def maybe(array: Column, key: Column, bits: int) -> Column:
    """Whether ``key`` may be in the set ``array``; false only for keys that are not."""
    at = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(array, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none where the text is null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A few rows as a JVM-side relation (no Python objects reach the executors)."""
    cells = [F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True))) for r in rows]
    if not cells:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)))
    return spark.range(1).select(F.inline(F.array(*cells)))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; ``RASTERLENS_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("RASTERLENS_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A bounded cache of two generations of what ``make`` gives for a key.

    A key that was used lately survives the turn of generations; long keys are not kept.
    """

    def __init__(self, most: int, make, longest: int = 64):
        super().__init__()
        self.most, self.make, self.longest, self.old = most, make, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old.clear()
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Return what this worker no longer needs to the system; idle workers count as memory."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
