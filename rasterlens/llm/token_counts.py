"""Token counts by a separator scan of flat, unindexed token files.

A token file is an array of little-endian token ids in which every document ends with an
end-of-document id; nothing says where. The files are cut into blocks of a fixed size
without regard to documents; the scan finds the separators of a block with one vectorised
comparison and yields the lengths that end in it. A prefix scan over the blocks of a file
(running sums of block lengths and the last separator before each block) then adds to the
first length of a block what the document had in the blocks before.

Defined cases: a null or empty text has no tokens and still its separator; tokens behind
the last separator of a file are an unterminated document and are reported as such, with
``unterminated`` true; an empty file or table gives an empty result; a block without
separators passes its whole length on; a trailing odd byte of a file is an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlens.llm.common import tokenizer_path, written

EOD, DTYPE = 50256, "<u2"
#: Tokens of a block.
BLOCK = 1 << 19
BLOCKS = "file string, block long, data binary, doc_ids array<long>"


@functools.cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_blocks(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Token files of ``docs``, one a task, as blocks ``file, block, data, doc_ids``.

    ``data`` is the flat file cut every ``block`` tokens; ``doc_ids`` lists the documents
    that end in a block, in order. It names the results and is never looked at by the scan.
    """
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = _encoding(path), f"part-{TaskContext.get().partitionId():06d}"
        held, size, ids, no = [], 0, [], 0

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ids, no
            flat = np.concatenate(held) if held else np.empty(0, DTYPE)
            while len(flat) >= block or (final and len(flat)):
                head, flat = flat[:block], flat[block:]
                ends = int((head == EOD).sum())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([no], pa.int64()), pa.array([head.tobytes()], pa.binary()), pa.array([ids[:ends]], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])
                ids, no = ids[ends:], no + 1
            held, size = [flat], len(flat)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = enc.encode_ordinary(text) if text else []
                held.append(np.array([*tokens, EOD], DTYPE))
                size += len(tokens) + 1
                ids.append(doc_id)
                if size >= block:
                    yield from cut(False)
        yield from cut(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def read_files(spark: SparkSession, paths: str | list[str], dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """Blocks of flat token files of any length: each task opens its file and reads its own ranges.

    Only names and lengths are listed; no file is held whole. An empty file is one empty block.
    """
    step = block * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "length")
    at = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / step))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for file, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(file if "://" in file else re.sub("^file:", "", file))
                with system.open_input_file(path) as f:
                    f.seek(number * step)
                    data = f.read(step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])

    return at.select("file", "block").repartition("file", "block").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, eod: int = EOD, dtype: str = DTYPE) -> DataFrame:
    """Per block: ``n`` tokens, ``ends`` (lengths that end in it, the first as of the block), ``tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends, tail = [], [], []
            for data in b.column(2):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype)
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                ends.append(np.diff(at, prepend=-1) - 1)
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(tail, pa.int64())], names=["file", "block", "doc_ids", "n", "ends", "tail"])

    return blocks.select("file", "block", "data", "doc_ids").mapInArrow(run, "file string, block long, doc_ids array<long>, n long, ends array<long>, tail long")


def stitched(scanned: DataFrame) -> DataFrame:
    """``file, ordinal, doc_id, n_tokens, unterminated``: the lengths of whole documents.

    ``scanned`` is read twice: give a written table where the scan is dear.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # the prefix scan sees a few numbers a block; the lists of lengths stay where they are
    few = scanned.select("file", "block", "n", "tail", F.size("ends").cast("long").alias("k"))
    few = few.withColumn("stop", F.sum("n").over(upto)).withColumn("open", F.when(F.col("k") > 0, F.col("stop") - F.col("tail")))
    few = few.withColumn("carry", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.coalesce(F.max("open").over(before), F.lit(0)))
    few = few.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    few = few.select(F.col("file").alias("f_"), F.col("block").alias("b_"), "carry", "first", "final")
    rows = scanned.join(few, F.col("file").eqNullSafe(F.col("f_")) & (F.col("block") == F.col("b_")))
    lens = F.transform("ends", lambda x, i: x + F.when(i == 0, F.col("carry")).otherwise(0))
    rest = F.when(F.size("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    done = F.transform(lens, lambda x, i: F.struct((F.col("first") + i).alias("ordinal"), F.get("doc_ids", i).alias("doc_id"), x.alias("n_tokens"), F.lit(False).alias("unterminated")))
    left = F.when(F.col("final") & (rest > 0), F.array(F.struct((F.col("first") + F.size("ends")).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), rest.alias("n_tokens"), F.lit(True).alias("unterminated"))))
    return rows.select("file", F.explode(F.when(left.isNull(), done).otherwise(F.concat(done, left))).alias("d")).select("file", "d.*")


def count(docs: DataFrame) -> DataFrame:
    """``file, ordinal, doc_id, n_tokens, unterminated`` of every document, by way of token files."""
    return stitched(written(scan(written(flat_blocks(docs), "token-files")), "token-scan"))
