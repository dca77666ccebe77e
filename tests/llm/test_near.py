"""The search for near fingerprints against all pairs."""

import numpy as np
import pytest

from rasterlens.llm import near, simhash


def _prints(n: int) -> np.ndarray:
    """Distinct 128-bit fingerprints, half of them in families of near ones."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 1 << 63, (n, 2), np.uint64) * np.uint64(2)
    for i in range(n // 2):
        rows[i] = rows[i % 9]
        for bit in rng.choice(128, rng.integers(0, 26), replace=False).tolist():
            rows[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return np.unique(rows, axis=0)


def _buckets(rows: np.ndarray, masks) -> set[tuple[int, int, int]]:
    """All pairs within the distance that agree on a mask, each with the first such mask."""
    out = set()
    for i in range(len(rows)):
        for j in range(i):
            x = rows[i] ^ rows[j]
            if np.bitwise_count(x).sum() <= simhash.FAR:
                for k, mask in enumerate(masks):
                    if not any(int(v) & m & (1 << 64) - 1 for v, m in zip(x, mask, strict=True)):
                        out.add((j, i, k))
                        break
    return out


@pytest.mark.parametrize("crowd", [1024, 4])
def test_partnered_against_all_pairs(monkeypatch, crowd):
    monkeypatch.setattr(near, "_CROWD", crowd)
    rows = _prints(200)
    masks = [(m & 0xFFF, 0) for m, _ in simhash.band_masks(len(rows))[:6]]  # a few bits: large buckets
    wanted = _buckets(rows, masks)
    records = rows.view(near._RECORD).ravel()
    some = 0
    for block in range(len(masks)):
        order, key, found = near.partnered(records, masks, block, simhash.FAR)
        got = {int(order[i]) for i in np.flatnonzero(found)}
        first = {x for a, b, k in wanted if k == block for x in (a, b)}
        anywhere = {x for a, b, _ in _buckets(rows, [masks[block]]) for x in (a, b)}
        assert first <= got <= anywhere and np.array_equal(key, np.sort(key))
        some += len(got)
    assert some > 50  # the case is not an empty one


@pytest.mark.parametrize("group", [1 << 17, 64, 16])
def test_met_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(near, "GROUP", group)
    rows = _prints(300)
    masks = simhash.band_masks(len(rows))[:12]
    df = spark.createDataFrame([tuple(x) for x in rows.view(np.int64).tolist()], "f0 long, f1 long").repartition(3)
    at = {tuple(x): i for i, x in enumerate(rows.view(np.int64).tolist())}
    buckets: dict[int, set[int]] = {}
    for r in near.met(df, len(rows), masks, simhash.FAR).collect():
        buckets.setdefault(r.k, set()).add(at[r.f0, r.f1])
    wanted = _buckets(rows, masks)
    together = {(a, b) for x in buckets.values() for a in x for b in x if a < b}
    assert len(wanted) > 100 and {(a, b) for a, b, _ in wanted} <= together
    for x in buckets.values():  # none stands alone in its bucket
        for a in x:
            assert any(np.bitwise_count(rows[a] ^ rows[b]).sum() <= simhash.FAR for b in x - {a})


def test_no_fingerprints(spark):
    df = spark.createDataFrame([], "f0 long, f1 long")
    assert near.met(df, 0, simhash.band_masks(0), simhash.FAR).collect() == []
