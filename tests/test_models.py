"""Folds, features and families that the model tables cover, with real fits on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.plans import models
from tidewright.plans.base import postings
from tidewright.plans.evaluation import N_OUTER


@pytest.fixture(scope="module")
def p(spark, sf):
    return postings(spark, sf).persist()


@pytest.fixture
def small_ladder(monkeypatch):
    made = models.ladder

    def ladder(*a):
        own = made(*a)
        own["Random Forest"].setNumTrees(2).setMaxDepth(3)
        own["Gradient Boosting"].setMaxIter(2)
        return own

    monkeypatch.setattr(models, "ladder", ladder)


FOLDS = set(range(1, N_OUTER + 1))


def test_ladder_on_every_fold(p, small_ladder):
    rows = models.model_ladder(p).collect()
    assert {(r.model, r.fold) for r in rows} == {(m, f) for m in models.LADDER for f in FOLDS}
    assert all(r.fit_s >= 0 and r.score_s > 0 and r.scored_rows == r.n and r.train_rows > r.n for r in rows)
    assert len({r.mae for r in rows if r.fold == 5}) == len(models.LADDER)
    assert {r.encoded_columns for r in rows if r.fold == 5 and r.model != models.DUMMY} == {sum(n for _, n in next(models.folds_of(p, 1)).features.blocks())}


def test_folds_read_the_records_once(spark):
    """Whatever the folds, models and sets of features: each record is made once, and a fold's history alone is seen."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def city(c):
        seen.add(1)
        return c

    months = [f"2000-{m:02d}" for m in range(5, 13)]
    rows = [(str(i), months[i % 8], 100.0 + i, *["ab"[i // 8 % 2]] * 8, float(i % 5), float(i % 7), 1.0, "x|y", "Mid") for i in range(160)]
    made = spark.createDataFrame(rows, ["job_id", "period", models.TARGET, *models.NOMINAL, "years_of_experience", "demand_score", "benefits_score_10", "required_skills", "experience_level"])
    made = made.withColumn("city", city.asNondeterministic()("city"))
    rows = models.fold_scores(made, [models.DUMMY, "Ridge"]).collect()
    assert seen.value == 160
    assert {(r.fold, r.train_rows, r.scored_rows) for r in rows} == {(f, 20 * (f + 2), 20) for f in FOLDS}


def test_runtime_summary(p):
    rows = models.runtime_summary(p, (models.DUMMY, "Ridge")).collect()
    assert {(r.model, r.phase, r.samples) for r in rows} == {(m, x, N_OUTER) for m in (models.DUMMY, "Ridge") for x in ("fit", "score")}
    assert all(r.min_s <= r.p50_s <= r.p90_s <= r.p95_s <= r.max_s and r.ms_per_row == pytest.approx(1000 / r.rows_per_s) for r in rows)


def test_variants_take_every_fold(p, small_ladder):
    rows = models.variants(p).collect()
    assert {(r.variant, r.fold) for r in rows} == {(v, f) for v in ("full", "top2") for f in FOLDS} and all(r.mae > 0 for r in rows)
    assert max(r.encoded_columns for r in rows if r.variant == "top2") <= 6


def test_ablations_fit_every_set_on_every_fold(p, small_ladder):
    rows = models.ablations(p, at_once=4).collect()
    assert len(rows) == 14 * 2 * N_OUTER and {r.model for r in rows} == {"Ridge", "Random Forest"} and all(r.mae > 0 for r in rows)
    own = {(r.kind, r.name, r.fold): r for r in rows if r.model == "Ridge"}
    assert {n for k, n, _ in own if k == "leave_one_out"} == set(models.FAMILIES)
    for f in FOLDS:
        whole = own["option", models.OPTIONS[0], f]
        assert whole.mae_delta_vs_full == 0 and own["experiment", "A6_SKILLS", f].mae == whole.mae and whole.features == 13
        assert own["leave_one_out", "geography", f].mae_delta_vs_full == pytest.approx(own["leave_one_out", "geography", f].mae - whole.mae)
    # a slice of the whole encoding gives what an encoding of its own gives
    plain = models.fold_scores(p, ["Ridge"], nominal=["job_category"], numeric=["years_of_experience"], skills=False)
    assert {r.fold: r.mae for r in plain.collect()} == pytest.approx({f: own["option", models.OPTIONS[1], f].mae for f in FOLDS})


def test_ablation_summary(p):
    rows = {(r.kind, r.name): r for r in models.ablation_summary(p).collect()}
    core = rows["experiment", "A0_CONSERVATIVE_CORE"]
    assert len(rows) == 14 and core.gain_on_core_pct == 0
    assert all(r.gain_on_core_pct == pytest.approx(100 * (core.mae_mean - r.mae_mean) / core.mae_mean) for r in rows.values())


def test_importance_by_fold(p, small_ladder):
    rows = models.importance(p).collect()
    for fold in FOLDS:
        for level in ("encoded", "raw", "family"):
            own = [r for r in rows if (r.fold, r.level) == (fold, level)]
            assert sum(r.importance for r in own) == pytest.approx(1)
        assert {r.feature for r in rows if (r.fold, r.level) == (fold, "family")} == set(models.FAMILIES)
        assert {r.feature for r in rows if (r.fold, r.level) == (fold, "raw")} == {*models.NOMINAL, *models.NUMERIC, "skills"}
    share = lambda f, n: next(r.importance for r in rows if (r.fold, r.level, r.feature) == (f, "family", n))
    drift = {(r.previous_fold, r.fold): r.half_l1_drift for r in models.importance_drift(p).collect()}
    assert drift == pytest.approx({(f, f + 1): sum(abs(share(f + 1, n) - share(f, n)) for n in models.FAMILIES) / 2 for f in range(1, N_OUTER)})


@pytest.mark.parametrize("part", [50_000, 10])
def test_a_family_moves_together(spark, part):
    rows = [(str(i), "2000-01", i, 10 * i, None if i % 2 else i) for i in range(40)]
    x = spark.createDataFrame(rows, "job_id string, period string, a int, b int, c int")
    made = models.dealt_anew(x, [("raw_feature", "a", ["a"]), ("raw_feature", "c", ["c"]), ("joint_family", "ab", ["a", "b"])], 3, part).collect()
    assert len(made) == 40 * 3 * 3
    for repeat in range(3):
        own = {n: [r for r in made if (r.feature, r.repeat) == (n, repeat)] for n in ("a", "c", "ab")}
        assert all(r.b == 10 * r.a and r.a != int(r.job_id) for r in own["ab"])
        assert all(r.b == 10 * int(r.job_id) and r.a != int(r.job_id) for r in own["a"])
        for n in ("a", "ab"):
            assert sorted(r.a for r in own[n]) == list(range(40))
        assert sorted(r.c or -1 for r in own["c"]) == sorted(x[4] or -1 for x in rows)


def test_permutation_covers_features_and_families(p, small_ladder):
    names = {(k, n) for k, n, _ in models.GROUPS}
    assert len(names) == 19
    made = models.permutation(p, 2).collect()
    assert {(r.fold, r.kind, r.feature) for r in made} == {(f, *n) for f in FOLDS for n in names} and {r.repeats for r in made} == {2}
    assert sum(r.mean_increase for r in made if r.feature == "job_title") != 0
    locked = models.locked_permutation(p, 2).collect()
    assert {(r.kind, r.feature) for r in locked} == names and {r.repeats for r in locked} == {2}


def test_grid_on_inner_folds(p):
    rows = models.tuning(p, trees=(2, 4), depths=(2, None), selected="Random Forest").collect()
    assert {(r.trees, r.depth) for r in rows} == {(t, d) for t in (2, 4) for d in (2, None)} and {r.status for r in rows} == {"completed"}
    assert all(len(r.fold_mae) == 3 and r.mae_mean == pytest.approx(np.mean(r.fold_mae)) for r in rows)
    assert [r.place for r in sorted(rows, key=lambda r: r.mae_mean)] == [1, 2, 3, 4]
    (skipped,) = models.tuning(p, selected="Ridge").collect()
    assert skipped.status == "skipped" and skipped.reason == "selected family is Ridge" and skipped.trees is None


def test_family_selection(spark):
    rows = [("Random Forest", 100.0, 8.0), ("Linear Regression", 105.0, 5.0), (models.DUMMY, 150.0, 5.0), ("Ridge", 130.0, 5.0), ("Gradient Boosting", 140.0, 5.0)]
    scores = spark.createDataFrame([(m, mae + d * sd) for m, mae, sd in rows for d in (-1, 0, 1)], "model string, mae double")
    assert models.select_family(scores) == "Linear Regression"
    assert models.select_family(scores.filter(F.col("model") != "Linear Regression")) == "Random Forest"
    assert tuple(models.family_choice(scores).first()) == ("Random Forest", "Linear Regression", "Linear Regression,Random Forest")


def test_diagnoses(spark):
    rows = [(models.DUMMY, f, 100.0, 100.0, 0.0) for f in range(1, 6)] + [("over", f, 10.0, 90.0, 0.1) for f in range(1, 6)] + [("under", f, 101.0, 100.0, 0.0) for f in range(1, 6)]
    rows += [("good", f, 80.0, 85.0, 0.3) for f in range(1, 5)] + [("good", 5, 80.0, 85.0, -0.1)] + [("mixed", f, 80.0, 85.0, 0.3 if f < 3 else None) for f in range(1, 6)]
    made = models.diagnosed(spark.createDataFrame(rows, "model string, fold int, train_mae double, mae double, r2 double")).collect()
    own = {(r.model, r.fold): r for r in made}
    assert {m: own[m, 1].aggregate_indication for m in ("over", "under", "good", "mixed")} == {"over": "overfitting_indication", "under": "underfitting_indication", "good": "good_fit_indication", "mixed": "mixed_or_inconclusive"}
    assert own["good", 5].fold_indication == "inconclusive" and own[models.DUMMY, 1].fold_indication == own[models.DUMMY, 1].aggregate_indication == "baseline" and own[models.DUMMY, 1].gap is None
    assert own["over", 2].gap == pytest.approx(0.8) and own["over", 2].train_gain == pytest.approx(0.9)


def test_ladder_is_diagnosed(p):
    rows = models.ladder_diagnostics(p, (models.DUMMY, "Ridge")).collect()
    assert {(r.model, r.fold) for r in rows} == {(m, f) for m in (models.DUMMY, "Ridge") for f in FOLDS} and all(r.gap is not None for r in rows if r.model == "Ridge")


def test_too_many_values_are_refused(p, monkeypatch):
    monkeypatch.setattr(models, "MOST_VALUES", 5)
    with pytest.raises(ValueError, match="job_title"):
        models.Features(models.prepared(p))
