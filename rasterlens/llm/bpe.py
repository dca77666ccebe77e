"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold ``(rank, position)`` of each adjacent pair of symbols, and
each inner node the lesser of its children, so that the root is the leftmost pair of
lowest rank. A merge changes three leaves, each in logarithmic time; it ends when the
root holds no mergeable pair. Long unbroken runs therefore cost n log n, never n^2.

Defined cases: a null text counts as the empty text (no ids); repeated rows give
repeated results; further columns of the input are left out; an empty table gives an
empty result of the same schema. A character whose bytes are not in the vocabulary
cannot occur: all 256 byte symbols are.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import Recent, give_back, tokenizer_path

#: Words whose encoding a worker keeps in each of two generations.
CACHE_WORDS = 150_000
#: Texts whose ids a worker holds at once.
SLICE = 1000
_NONE = 1 << 62
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tree_of(keys: list[int]) -> list[int]:
    """Segment tree of minima: ``tree[1]`` is the least key, leaves start at ``len(tree) // 2``."""
    size = 1 << max(0, (len(keys) - 1).bit_length())
    tree = [_NONE] * size + keys + [_NONE] * (size - len(keys))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    return tree


def put(tree: list[int], at: int, key: int) -> None:
    """Set one leaf, and the minima above it as far as they change."""
    i = at + len(tree) // 2
    tree[i] = key
    while i > 1:
        other = tree[i ^ 1]
        low = key if key < other else other
        i >>= 1
        if tree[i] == low:
            return
        tree[i] = key = low


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges. ``pairs``: (left, right) -> (rank << 32, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    get, none = pairs.get, (_NONE, 0)
    # a leaf is (rank, position) of the pair that starts there: the root is leftmost among equals
    tree = tree_of([get(p, none)[0] | i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))])
    while (top := tree[1]) < _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        ids[i] = new = pairs[ids[i], ids[j]][1]
        after[i] = k = after[j]
        if j < n - 1:
            put(tree, j, _NONE)
        if k < n:
            before[k] = i
            put(tree, i, get((new, ids[k]), none)[0] | i)
        else:
            put(tree, i, _NONE)
        b = before[i]
        if b >= 0:
            put(tree, b, get((ids[b], new), none)[0] | b)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def byte_symbols() -> dict[int, str]:
    """Printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(plain))
    return names


#: Text of ASCII and Latin letters only (no other code points, no separator controls) and its
#: word pattern: the same words as WORDS finds, by ranges instead of Unicode properties.
PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7fà-öø-ɏ]")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ɏ]+|[0-9]|[^\\s0-9a-zà-öø-ɏ]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


@functools.cache
def _later() -> regex.Pattern:
    """Code points that came to Unicode after this Python's tables: left to the tokenizer's own."""
    known = regex.compile(r"\P{Cn}")
    spans: list[list[int]] = []
    for c in range(0x378, 0x110000):
        if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return regex.compile("[" + ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) or r"\p{Cs}") + "]")


@functools.cache
def _library(path: str):
    """The tokenizer file as the library reads it, once a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordBpe:
    """Word-end BPE of a tokenizers JSON file: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank << 32, vocab[left + right])
        names = byte_symbols()
        self.inner = [vocab[names[b]] for b in range(256)]
        self.final = [vocab[names[b] + self.end] for b in range(256)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.path = path
        self.bytes = {c: b for b, c in names.items()}
        self.cache = Recent(CACHE_WORDS, self._word)

    def normal(self, text: str) -> str:
        """NFC and lower case; white space only ever parts words and may stay as it is."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # only whole-string lower() knows a final sigma
                return "".join(c.lower() for c in text)
        return text.lower()

    def words(self, text: str) -> list[str]:
        low = self.normal(text)
        if not PLAIN.search(low):
            return PLAIN_WORDS.findall(low)
        if not _later().search(text):
            return WORDS.findall(low)
        own = _library(self.path)
        cut = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in x).decode() for x, _ in cut]

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        return merge([*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]], self.pairs)

    def decode(self, ids: list[int]) -> str:
        """The library's decode without a decoder: the symbols, joined by spaces."""
        return " ".join([s for s in map(self.names.get, ids) if s is not None])

    def _word(self, word: str) -> bytes:
        return np.asarray(self.word_ids(word), "<u4").tobytes()

    def raw(self, text: str | None) -> bytes:
        """Ids of the text as little-endian bytes; the cache holds nothing else, symbols are looked up by id."""
        text = text or ""
        parts = [text] if self.split is None or "<|" not in text else self.split.split(text)
        out: list[bytes] = []
        for part in parts:
            if part in self.special:
                out.append(np.asarray([self.special[part]], "<u4").tobytes())
                continue
            out.extend(map(self.cache.__getitem__, self.words(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(text), "<u4").tolist()


@functools.cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: ``doc_id, n_tokens, ids array<int>, decoded``."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [np.frombuffer(bpe.raw(t), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Counts and SHA-256 digests of the ids and of the decoded text, one row a document.

    The digests are made where the ids are, so that texts never leave a worker; ``ids``
    adds the ids themselves.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            raw, texts = [], []
            for text in b.column(1).to_pylist():
                raw.append(bpe.raw(text))
                shown = bpe.decode(np.frombuffer(raw[-1], "<u4").tolist())
                texts.append(hashlib.sha256(shown.encode()).hexdigest())
            cols = {
                "doc_id": b.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                "decoded_sha256": pa.array(texts, pa.string()),
            }
            if ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in raw)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT + (", ids array<int>" if ids else ""))
