from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlens.llm import line_dedup
from rasterlens.llm.common import written

SF = "/root/testdata/sf0.001"


def _norm(line: str) -> str:
    return b" ".join(line.lower().encode().translate(line_dedup._TABLE).split()).decode()


def _slow_edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _near_pairs(forms: list[str]) -> list[tuple[str, str]]:
    """All pairs with an edit similarity of 0.8 or more, by edit distance alone."""
    forms = sorted(forms, key=len)
    out = []
    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            if len(b) - len(a) > 0.2 * len(b) + 1e-9:
                break
            most = int(0.2 * len(b) + 1e-9)
            if line_dedup.edits(a, b, most) <= most:
                out.append((a, b))
    return out


def _edges(df, width: int) -> list[tuple[str, str]]:
    lines = written(line_dedup.simhashed(df, width), "t-lines")
    firsts = [F.first(c).alias(c) for c in ("len", "f0", "f1", "f")]
    uniq = written(lines.groupBy("h").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("first"), *firsts), "t-uniq")
    text = {r.doc_id: r.text for r in df.collect()}
    form = {r.h: _norm(text[r.doc_id].split("\n")[r.pos]) for r in lines.collect()}
    return [(form[r.u], form[r.v]) for r in line_dedup.links(df, uniq, width).collect()]


def _groups(edges) -> dict[str, str]:
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in list(root)}


def test_edit_distance_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 15))) for _ in "ab")
        want, most = _slow_edits(a, b), int(rng.integers(0, 15))
        got = line_dedup.edits(a, b, most)
        assert got == want if want <= most else got > most
        words = ["".join(rng.choice(list("ab"), rng.integers(1, 4))) for _ in range(rng.integers(1, 7))]
        other = [w for w in words if rng.random() < 0.8] + words[:1]
        assert line_dedup.aligned(words, other) >= _slow_edits(" ".join(words), " ".join(other))


def test_all_lines_by_edit_similarity_alone(spark):
    """Nine of ten pairs of the given documents that edit similarity alone calls near, and nothing else."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    forms = {_norm(x) for r in df.collect() for x in (r.text or "").split("\n")} - {""}
    pairs = _near_pairs([f for f in forms if len(f) <= 400])
    edges = _edges(df, 16)
    assert all(line_dedup.similar(a, b) for a, b in edges)
    group = _groups(edges)
    met = sum(a in group and group[a] == group.get(b) for a, b in pairs)
    print(f"near line pairs: {met} of {len(pairs)} linked")
    assert len(pairs) >= 30 and met >= 0.9 * len(pairs)


def _fixture() -> list[tuple[int, str]]:
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab, rng.integers(1, 90))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(5):
            w = base[rng.integers(40)].split(" ")
            if rng.random() < 0.6:
                w[rng.integers(len(w))] = vocab[rng.integers(300)]
            lines.append(("  " if rng.random() < 0.3 else "") + " ".join(w).capitalize() + rng.choice(["", ".", "!"]))
        docs.append((i, "\n".join(lines)))
    return docs


def _kept(docs, edges) -> dict[int, str]:
    group = _groups(edges)
    at = sorted((i, p, group.get(f, f)) for i, x in docs for p, line in enumerate(x.split("\n")) if (f := _norm(line)))
    first: dict[str, tuple[int, int]] = {}
    for i, p, g in at:
        first.setdefault(g, (i, p))
    gone = {(i, p) for i, p, g in at if first[g] != (i, p)}
    return {i: "\n".join(line for p, line in enumerate(x.split("\n")) if (i, p) not in gone) for i, x in docs}


def test_first_line_of_each_group_stays(spark):
    docs = _fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    edges = _edges(df, 16)
    assert edges and {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == _kept(docs, edges)
    near = _near_pairs(sorted({_norm(x) for _, t in docs for x in t.split("\n")} - {""}))
    group = _groups(edges)
    assert sum(a in group and group[a] == group.get(b) for a, b in near) >= 0.9 * len(near)


def test_chunks_of_crowded_groups_lose_nothing(spark, monkeypatch):
    df = spark.createDataFrame(_fixture(), "doc_id long, text string")
    want = _groups(_edges(df, 16))
    monkeypatch.setattr(line_dedup, "GROUP", 3)
    monkeypatch.setattr(line_dedup, "CHUNK", 2)
    got = _groups(_edges(df, 16))
    parts = lambda g: {frozenset(x for x in g if g[x] == r) for r in g.values()}
    assert parts(got) == parts(want)


def test_prints_do_not_depend_on_what_stands_beside():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(3000)])
    lines = [" ".join(rng.choice(words, n)) for n in (1, 2, 300, 2000, 7, 40)] + ["", " .,;", "ß ñ ñ x"]
    number, h, length, fp = line_dedup.line_prints("\n".join(lines).encode(), 336)
    assert number.tolist() == [0, 1, 2, 3, 4, 5, 8] and length.tolist() == [len(_norm(lines[i])) for i in number]
    for k, i in enumerate(number):
        alone = line_dedup.line_prints(lines[i].encode(), 336)
        assert alone[1][0] == h[k] and (alone[3][0] == fp[k]).all()
    # a bit is set where it is in over half the distinct words
    one = {w: np.unpackbits(line_dedup.line_prints(w.encode(), 336)[3][0]) for w in set(lines[2].split())}
    assert (np.unpackbits(fp[2]) == (2 * sum(x.astype(int) for x in one.values()) > len(one))).all()
    again = line_dedup.line_prints(("Z  " + lines[0] + "\t.").lower().encode(), 336)
    assert again[1][0] == line_dedup.line_prints(f"z {lines[0]}".encode(), 336)[1][0]


def test_long_texts_are_cut_between_lines(monkeypatch):
    monkeypatch.setattr(line_dedup, "SLAB", 10)
    for text in (b"", b"abc", b"a\nb\nc" * 9, b"x" * 50 + b"\ny\n" + b"z" * 40, b"\n" * 30):
        got = list(line_dedup._pieces(text))
        assert b"\n".join(p for p, _ in got) == text
        assert [n for _, n in got] == [sum(q.count(b"\n") + 1 for q, _ in got[:i]) for i in range(len(got))]


@pytest.mark.parametrize("crowd", [4, 1024])
def test_partners_of_a_block(monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "_CROWD", crowd)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, (6, 2), dtype=np.uint64)
    rows = np.zeros(90, line_dedup._RECORD)
    for i in range(90):
        f = base[rng.integers(6)].copy()
        for bit in rng.choice(128, rng.integers(0, 30), replace=False):
            f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows[i] = (rng.integers(0, 3), f[0], f[1], rng.integers(80, 90))
    for block in (0, 3, 12):
        order, found = line_dedup.partnered(rows, block, 16)
        got = {int(i) for i in order[found]}
        bits = np.unpackbits(np.stack((rows["f0"], rows["f1"]), axis=1).view(np.uint8), axis=1)
        own, near = set(), set()
        for i in range(90):
            for j in range(i):
                x = bits[i] ^ bits[j]
                if rows["key"][i] == rows["key"][j] and x.sum() <= line_dedup.FAR and abs(int(rows["len"][i]) - int(rows["len"][j])) <= line_dedup._REACH:
                    near |= {i, j}
                    if all(x[16 * b : 16 * b + 16].any() for b in range(min(block, 8))):
                        own |= {i, j}
        assert own <= got <= near and (crowd > 90 and got == own or crowd < 90)


def test_blocks_grow_with_the_lines():
    assert [line_dedup.width_of(n) for n in (0, 10**5, 2 * 10**6, 10**8, 10**11)] == [16, 16, 16, 20, 32]
    for width in (16, 20, 32):
        assert 1 - (1 - 0.9**width) ** line_dedup.blocks_of(width) >= line_dedup.RECALL
