"""Measures of labelled vectors over all of their components, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.plans import evaluation, serving
from tidewright.plans.base import with_medians


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with vectors whose labels differ in the last components alone, two of them equal; and the same as arrays."""
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 64)).round(3), np.arange(60) % 3
    x[:, 40:] += 4.0 * label[:, None]
    x[3] = x[0]
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(60)], "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, x, label


def test_silhouette_whole(spark, vectors):
    folder, x, label = vectors
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want: dict[int, list[float]] = {}
    for i in range(60):
        others = {c: d[i, (label == c) & (np.arange(60) != i)].mean() for c in range(3)}
        a = others.pop(label[i])
        b = min(others.values())
        want.setdefault(int(label[i]), []).append((b - a) / max(a, b))
    for made in (evaluation.silhouette(spark, folder), evaluation.silhouette(spark, folder, 7)):
        assert {r.label: r.silhouette for r in made.collect()} == pytest.approx({c: float(np.mean(v)) for c, v in want.items()}, abs=2e-6)
    assert min(np.mean(v) for v in want.values()) > 0.3  # which the first components alone don't show


def test_a_tile_meets_each_other_once(spark):
    """Every pair of tiles has the rows of both, on its two sides, and a tile alone has its own once."""
    v = spark.range(50).withColumnRenamed("id", "vec_id")
    rows = evaluation.paired(v, "vec_id", 4).collect()
    own = {r.vec_id: r.i for r in rows if r.i == r.j}
    assert len(rows) == 50 * 4 and len(own) == 50
    for i in range(4):
        for j in range(i, 4):
            for side, tile in ((0, i), (1, j))[: 1 if i == j else 2]:
                assert {r.vec_id for r in rows if (r.i, r.j, r.side) == (i, j, side)} == {v for v, t in own.items() if t == tile}


def test_rows_go_to_few_tiles():
    """A row goes to as many groups as there are tiles: a few a core, not one for each 2,000 rows."""
    assert [evaluation._tiles(n, 65_536, 8) for n in (0, 500, 4000, 51_282, 600_000)] == [1, 1, 4, 8, 10]


@pytest.mark.parametrize("n, cells", [(700, 3), (700, 300), (40, 40)])
def test_distances_are_summed_by_cells(monkeypatch, n, cells):
    for name, size in (("ACROSS", 50), ("ALONG", 130), ("CELLS", 64)):
        monkeypatch.setattr(evaluation, name, size)
    rng = np.random.default_rng(8)
    x, y, to = rng.normal(size=(n, 3)), rng.normal(size=(n // 2, 3)), rng.integers(0, 2, (cells, 5)).astype(float)
    y[:5] = x[:5]  # at no distance
    of_x, of_y = np.sort(rng.integers(0, cells, n)), np.sort(rng.integers(0, cells, n // 2))
    there, back = evaluation._cell_sums(x, of_x, to, y, of_y, to, False)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert there == pytest.approx(d @ to[of_y]) and back == pytest.approx(d.T @ to[of_x])


def test_measured_groups(spark):
    """Metrics whose median comes from counted errors are those of the plain median, null targets and one-row groups included."""
    rows = [("a", 1.0, 2.0), ("a", 5.0, 2.5), ("a", None, 1.0), ("a", 9.0, 9.0), ("b", 4.0, 1.5), (None, 7.0, 7.5), (None, 7.0, 6.0), ("c", None, 2.0)]
    x = spark.createDataFrame(rows, "g string, actual double, predicted double")
    made = {r.g: r.asDict() for r in evaluation.measured(x, ["g"]).collect()}
    assert made == {r.g: r.asDict() for r in x.groupBy("g").agg(*evaluation.metrics()).collect()} and len(made) == 4


def test_medians_of_several_values(spark):
    x = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, None), ("b", None, 4), ("b", None, 7), (None, 3.0, 1)], "g string, x double, y int")
    made = with_medians(x.groupBy("g").count(), x, ["g"], {"mx": F.col("x"), "my": F.col("y")})
    assert {r.g: (r["count"], r.mx, r.my) for r in made.collect()} == {"a": (2, 1.5, 5.0), "b": (2, None, 5.5), None: (1, 3.0, 1.0)}


def test_cluster_validity_whole(spark, vectors):
    folder, x, label = vectors
    centres = np.array([x[label == c].mean(axis=0) for c in range(3)])
    gap = ((x - centres[label]) ** 2).sum(axis=1)
    between = sum((label == c).sum() * ((centres[c] - x.mean(axis=0)) ** 2).sum() for c in range(3))
    s = np.array([np.sqrt(gap[label == c]).mean() for c in range(3)])
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    db = np.mean([max((s[p] + s[q]) / apart[p, q] for q in range(3) if q != p) for p in range(3)])
    r = evaluation.cluster_validity(spark, folder).first()
    assert (r.calinski_harabasz, r.davies_bouldin, r.inertia) == pytest.approx((between / 2 / (gap.sum() / 57), db, gap.sum()), abs=1e-4)


def test_block_norms_whole(spark, vectors):
    folder, x, _ = vectors
    for r in evaluation.block_norms(spark, folder).collect():
        own = x[:, :2] if r.family == "narrow" else x[:, 2:]
        rows = np.sqrt((own**2).sum(axis=1))
        want = np.array([np.sqrt((rows**2).sum()), rows.mean()])
        assert (r.norm_before, r.row_before) == pytest.approx(want, abs=2e-6)
        assert (r.norm_after, r.row_after) == pytest.approx(want / np.sqrt(own.shape[1]), abs=2e-6)


def test_gaps_of_near_rows_keep_their_digits():
    x = np.full((2, 64), 1e4)
    x[1, 0] += 1e-5
    assert evaluation._gaps(x, x)[0] == pytest.approx([0, 1e-5], rel=1e-6)


@pytest.mark.parametrize(("rows", "splits", "block"), [(16, 4, 3), (17, 4, 3), (1501, 5, 200), (1000, 5, 200), (301, 5, 200), (45, 5, 200), (6, 2, 200)])
def test_block_folds(spark, rows, splits, block):
    """Blocks by position in time; the last validation block has all the rest; few rows have shorter blocks; the last month is no part of it."""
    months = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(rows)] if rows < 100 else [f"2020-{1 + 11 * i // rows:02d}" for i in range(rows)]
    p = spark.createDataFrame([(str(i), m) for i, m in enumerate(months)], "job_id string, period string").repartition(3)
    dev = [m for m in months if m < max(months)]
    n, bs = len(dev), block
    if n // bs < 2:
        bs = max(20, n // (splits + 1))
    folds = min(splits, max(1, n // bs - 1))
    want = []
    for k in range(1, folds + 1):
        train, valid = dev[(k - 1) * bs : k * bs], dev[k * bs : (k + 1) * bs if k < folds else n]
        if train and valid:
            label = lambda x: x[0] if x[0] == x[-1] else f"{x[0]}..{x[-1]}"
            want.append((k, len(train), len(valid), label(train), label(valid), train[-1] == valid[0]))
    assert sorted(tuple(r) for r in evaluation.block_folds(p, splits, block).collect()) == want


def test_conclusions_make_records_and_histories_once(spark, sf, monkeypatch):
    made = {"postings": 0, "pay_histories": 0}
    for module, name in ((serving, "postings"), (evaluation, "pay_histories")):
        own = getattr(module, name)

        def counted(*a, own=own, name=name):
            made[name] += 1
            return own(*a)

        monkeypatch.setattr(module, name, counted)
    assert serving.conclusions(spark, sf).count() == 6
    assert made == {"postings": 1, "pay_histories": 1}
