"""Boosting, families' components and frozen inference against plain versions on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidewright.plans import base, ensembles, models


def points(spark, rows):
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double"))


def test_one_round_is_the_formula(spark):
    """Two groups with an outlier each: leaves move by the median gap plus the mean of the clipped rest."""
    rows = [(0.0, float(v)) for v in (1, 2, 3, 4, 90)] + [(1.0, float(v)) for v in (11, 12, 13, 14, -70)]
    df = points(spark, rows)
    model = ensembles.HuberBoosting("y", rounds=1, step=1.0, depth=1, alpha=0.6).fit(df)
    y = np.array([r[1] for r in rows])
    start = np.sort(y)[len(y) // 2 - 1]  # the sketch gives the lower of the two in the middle
    assert model.start == start
    gap = y - start
    delta = np.sort(np.abs(gap))[int(np.ceil(0.6 * len(gap))) - 1]
    want = {}
    for x in (0.0, 1.0):
        own = gap[[r[0] == x for r in rows]]
        middle = np.sort(own)[len(own) // 2]
        want[x] = start + middle + np.clip(own - middle, -delta, delta).mean()
    got = {r.x: r.predicted for r in model.transform(df).select("x", "predicted").distinct().collect()}
    assert got == pytest.approx(want)


def test_tasks_of_a_fit_have_few_rows(spark, monkeypatch):
    """However few parts the records are stored in, a task's rows stay few; small records are left as they are."""
    x = spark.range(5000).select(F.col("id").cast("string").alias("job_id")).coalesce(1)
    assert models.dealt(x).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    assert models.dealt(x).rdd.getNumPartitions() == 50 and models.dealt(x).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200


def test_outliers_hardly_move_it(spark):
    rows = [(float(i % 10), 10.0 * (i % 10) + (5000.0 if i % 20 == 0 else 0.0)) for i in range(200)]
    model = ensembles.HuberBoosting("y", rounds=10, step=0.5, depth=2).fit(points(spark, rows))
    out = model.transform(points(spark, [(float(x), 10.0 * x) for x in range(1, 10)]))
    assert out.agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).first()[0] < 15


def test_no_rows_or_labels(spark):
    empty = points(spark, [])
    assert ensembles.HuberBoosting("y").fit(empty).transform(empty).count() == 0
    nulls = points(spark, [(1.0, None), (2.0, 4.0)])
    assert {r.predicted for r in ensembles.HuberBoosting("y", rounds=1).fit(nulls).transform(nulls).collect()} == {4.0}


def test_family_components(spark, sf):
    p = base.postings(spark, sf).filter(F.col("job_id").cast("long") % 5 == 0)
    space, rows = ensembles.family_spaces(p)
    x = models.prepared(p)
    f = models.Features(x)
    m = {r.job_id: r.features.toArray() for r in f.transform(x).select("job_id", "features").collect()}
    ids = sorted(m)
    a = np.array([m[i] for i in ids])
    a -= a.mean(axis=0)
    got = {r.job_id: r.z.toArray() for r in space.collect()}
    family = np.array([n for c, k in f.blocks() for n, own in models.FAMILIES.items() if c in own for _ in range(k)])
    at = 0
    for name in dict.fromkeys(family):
        own = [r for r in rows if r[0] == name]
        used = sum(r[4] for r in own)
        _, s, vt = np.linalg.svd(a[:, family == name], full_matrices=False)
        share = s**2 / (s**2).sum()
        assert [r[2] for r in own] == pytest.approx(share[: len(own)], abs=1e-5)
        assert used == min(int((np.cumsum(share) < 0.85).sum()) + 1, ensembles.CAPS[name])
        z = np.array([got[i][at : at + used] for i in ids])
        assert (z**2).sum(axis=0) == pytest.approx(s[:used] ** 2 / used, rel=1e-6)  # whatever a component's sign
        at += used
    assert at == len(got[ids[0]])
