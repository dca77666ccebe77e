from __future__ import annotations

import numpy as np

from rasterlens.llm import line_dedup


def _pairs(rng, count: int) -> list[tuple[str, str]]:
    """Lines of 0 to 400 characters and copies of them with edits in many places or few."""
    out = []
    for _ in range(count):
        a = "".join(rng.choice(list("abcdé ñ中"), rng.integers(0, 400)))
        b = list(a)
        for _ in range(rng.integers(0, 1 + len(a) // 2)):
            i = rng.integers(0, len(b) + 1)
            b[i : i + rng.integers(0, 2)] = rng.choice(list("abcdé ñ中"), rng.integers(0, 2))
        out.append((a, "".join(b)))
    return out


def test_edits_of_many_pairs_at_once():
    pairs = _pairs(np.random.default_rng(3), 300)
    a, b = zip(*pairs, strict=True)
    want = [line_dedup.edits(x, y, 1000) for x, y in pairs]
    assert line_dedup.edits_of(a, b, 1000).tolist() == want
    for most in (0, 5, 70):
        got = line_dedup.edits_of(a, b, most).tolist()
        assert all(x == y if y <= most else x > most for x, y in zip(got, want, strict=True))
    assert line_dedup.edits_of([""], [""], 0).tolist() == [0]


def test_pairs_compared_together_get_the_verdicts_of_pairs_alone(monkeypatch):
    pairs = [(" ".join(a.split()), " ".join(b.split())) for a, b in _pairs(np.random.default_rng(4), 300)]
    want = [line_dedup.similar(a, b) for a, b in pairs]
    assert 50 < sum(want) < 250
    for batch in (16, 1024, 4096):
        monkeypatch.setattr(line_dedup, "_BATCH", batch)
        assert line_dedup.similar_of(pairs) == want


def test_groups_compared_together_give_the_links_of_groups_alone():
    rng = np.random.default_rng(5)
    groups = []
    for n in (2, 2, 3, 12, 40):
        base = ["".join(rng.choice(list("abcde "), 60)).strip() for _ in range(4)]
        norm = [x[:i] + "z" + x[i:] for x, i in ((base[rng.integers(4)], rng.integers(0, 50)) for _ in range(n))]
        f = rng.integers(0, 1 << 12, (2, n)).astype(np.uint64)
        groups.append((np.arange(n), *f, norm))
    alone = [line_dedup.linked([line_dedup.linked_within(*g)])[0] for g in groups]
    assert line_dedup.linked([line_dedup.linked_within(*g) for g in groups]) == alone
    for (_, _, _, norm), links in zip(groups, alone, strict=True):
        root = list(range(len(norm)))
        for i, j in links:
            root = [root[i] if r == root[j] else r for r in root]
        for i in range(len(norm)):  # every similar pair is joined, by as few links as that takes
            assert all(root[i] == root[j] for j in range(i) if line_dedup.similar(norm[i], norm[j]))
        assert len(links) == len(norm) - len(set(root)) and all(line_dedup.similar(norm[i], norm[j]) for i, j in links)
