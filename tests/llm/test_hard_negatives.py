"""Hard negatives against a plain version."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidewright.llm import hard_negatives

INF = float("inf")


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256.0):
    use = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x * scale) for x in vector):
            continue
        use.append((vec_id, [math.floor(scale * x) for x in vector], label))
    out = []
    for i, (anchor, a, label) in enumerate(use):
        if anchor % every:
            continue
        scored = [(-max(-(2**61), min(2**61, sum(map(int.__mul__, a, b)))), vec_id, other) for j, (vec_id, b, other) in enumerate(use) if i != j and len(a) == len(b)]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            found = sorted(x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(anchor, positive, rank, negative, -p, -s) for rank, (s, negative, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **kind):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(frame, **kind).collect())


def vectors(n, seed, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, width))
    v = base[rng.integers(0, 9, n)] + rng.normal(size=(n, width)) * 0.4
    return [(int(k), v[k].tolist(), int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize(("tile", "block", "few", "digit"), [(2048, 1024, 64, 8), (60, 3, 12, 3)])
def test_mining_is_exact(spark, monkeypatch, tile, block, few, digit):
    for name, value in (("TILE", tile), ("BLOCK", block), ("FEW", few), ("DIGIT", digit), ("TOGETHER", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(500, 1)
    want = plain(rows, every=25)
    assert mined(spark, rows, every=25) == want and len(want) > 500


def test_ties_are_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FEW", 11)
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    same = [(10 * k - 2**62 if k % 2 else 3 * k, [0.5, 0.25], k % 3) for k in range(300)]
    rows = [*same, (100, [1.0, 1.0], 0), (200, [1.0, 1.0], 1), (2**63 - 1, [0.5, 0.25], 1), (-(2**63), [0.5, 0.25], 2)]
    want = plain(rows)
    assert mined(spark, rows) == want and want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (5, [1.0, 1.0], 1), (6, [0.5, 1.0], 2), (6, [0.5, 1.0], 2), (7, [0.5, 0.5], 3)]
    rows += [(None, [1.0, 1.0], 1), (8, None, 1), (9, [1.0, 1.0], None), (10, [1.0, None], 1), (11, [1.0, INF], 2), (12, [1.0, float("nan")], 2), (13, [1e307, 1.0], 2)]
    rows += [(100, [], 1), (14, [], 1), (15, [], 2), (16, [1.0], 2), (200, [1e200, -1e200], 4), (17, [1e200, 0.0], 4), (18, [0.5e200, 0.0], 5), (300, [1e6, 1e6], 6), (19, [1e6, 3e6], 6), (20, [1e6, 1e6], 7)]
    want = plain(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} == {0, 100, 300}
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(0, None, 1)]) == []
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]
    assert mined(spark, negative) == plain(negative) == []


def test_scores_are_exact():
    rng = np.random.default_rng(2)
    for most in (2**10, 2**22, 2**30):
        a, b = (rng.integers(-most, most, (5, 7)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        kind = object if most == 2**30 else np.int32
        assert hard_negatives.scores(a.astype(kind), b.astype(kind)).tolist() == want
