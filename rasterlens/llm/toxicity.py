"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word marks) and itself, each hashed to
a row of the embedding table; a text is the mean of the rows of all its n-grams; a
linear softmax gives the two classes. Embeddings and softmax are trained together by
Adam on the cross-entropy, so misspellings that were never seen share n-gram vectors
with the words they distort. A word counts with the square root of its number. As the model is linear in the mean, a worker keeps one
number a word and scores whole texts of any length in one pass.

Training takes a bounded sample of labelled rows (``MAX_PER_CLASS`` of each class, of
texts up to ``MAX_CHARS`` characters, least hash first); held-out rows never take part.

Defined cases: null and empty texts have no words and score the softmax's bias; rows
with a null doc_id are not held out; labels that repeat a doc_id count as toxic if any
does; null labels are ignored; without any label, or with one class only, every score is
the share of that class (0 without labels); extra columns are left out.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import Recent, give_back

BUCKETS, DIM, LOW, HIGH = 1 << 16, 8, 3, 5
MAX_PER_CLASS, MAX_CHARS = 5000, 20_000
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, EPS = 10, 500, 128, 0.05, 0.1, 1e-6
THRESHOLD = 0.3
#: N-grams without weight that every mean holds besides its own: short texts lean on the bias.
PRIOR = 500.0
_CACHE = 100_000
#: Words whose n-gram rows are held at once in training.
_WORDS = 1024
OUT = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word}>"
    n = len(marked)
    grams = [marked[i : i + k] for k in range(LOW, HIGH + 1) for i in range(n - k + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in [*grams, f"={marked}"]]


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def damped(count: np.ndarray) -> np.ndarray:
    """Weight of a word that stands so often in a text."""
    return np.sqrt(count)


@dataclass
class Model:
    """``weight``: what each bucket adds to the log-odds of a mean; ``bias``: theirs without words."""

    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = Recent(_CACHE, self._word)

    def __reduce__(self):
        return Model, (self.weight, self.bias)

    def _word(self, w: str) -> tuple[float, int]:
        ids = subwords(w)
        return float(self.weight[ids].sum()), len(ids)

    def score(self, text: str | None) -> float:
        count = Counter(words(text))
        at = np.array(list(map(self.known.__getitem__, count))).reshape(-1, 2)
        share = damped(np.fromiter(count.values(), np.float64, len(count)))
        z = self.bias + float(share @ at[:, 0]) / (PRIOR + float(share @ at[:, 1]))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(texts: Iterable, toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and softmax, jointly; deterministic for given rows in a given order."""
    y = np.asarray(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -np.inf if not len(y) or not y[0] else np.inf)
    vocab: dict[str, int] = {}
    rows = []
    for t in texts:
        t = t.as_py() if isinstance(t, pa.Scalar) else t
        ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words(t)), np.int32)
        ids, count = np.unique(ids, return_counts=True)
        rows.append((ids, damped(count).astype(np.float32)))
    # buckets of all words in one flat array of 16 bits each: the driver holds little
    buckets, lens = array("H"), np.zeros(max(1, len(vocab)), np.int32)
    for i, w in enumerate(vocab):
        got = subwords(w)
        buckets.extend(got)
        lens[i] = len(got)
    del vocab, texts
    flat = np.frombuffer(buckets, np.uint16) if len(buckets) else np.zeros(1, np.uint16)
    starts = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)[:-1]))
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(y)))  # a small sample is seen more often
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = np.zeros((DIM, 2)), np.zeros(2)
    soft[:, 1] = rng.normal(0, 0.1, DIM)
    params = [table, soft, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            if not len(doc):
                continue
            word, count = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
            used, at = np.unique(word, return_inverse=True)
            size = lens[used]
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            ids = flat[np.repeat(starts[used] - begin, size) + np.arange(size.sum())]
            # words by words, then axis by axis: a whole batch of n-gram rows would be most of the worker's memory
            vec = np.concatenate([np.add.reduceat(table[ids[begin[i] : begin[i] + size[i : i + _WORDS].sum()]], begin[i : i + _WORDS] - begin[i]) for i in range(0, len(used), _WORDS)])
            total = PRIOR + np.bincount(doc, count * size[at], len(batch))
            share = count / total[doc]
            mean = np.stack([np.bincount(doc, share * vec[at, k], len(batch)) for k in range(DIM)], 1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = p @ soft.T
            per_word = np.stack([np.bincount(at, share * back[doc, k], len(used)) for k in range(DIM)], 1)
            grads = [np.stack([np.bincount(ids, np.repeat(per_word[:, k], size), BUCKETS) for k in range(DIM)], 1), mean.T @ p, p.sum(0)]
            step += 1
            for param, grad, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + EPS)
                if param is table:
                    param *= 1 - rate * DECAY
    line = soft[:, 1] - soft[:, 0]
    return Model(table @ line, float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``i, text, toxic``: the bounded sample, at most ``per_class`` ids of each class, none held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("i")))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("i"), "i").limit(per_class) for k in (0, 1)]
    # both limits bound what is broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(picked[0].union(picked[1])), F.col("d") == F.col("i")).select("i", "text", "toxic").distinct()


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """A model trained in one task on the bounded sample; the driver gets its weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("i", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])
        rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema).sort_by([("i", "ascending"), ("text", "ascending")])
        model = train(rows.column("text"), rows.column("toxic").to_pylist())
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    got = labelled(docs, labels, **how).coalesce(1).mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(bytes(got["weight"]), "<f8"), got["bias"]) if got else train([], [])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
