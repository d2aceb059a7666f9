"""Spaces, fits, candidates and stability of segments."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.plans import clustering, ensembles, models, segments
from tidewright.plans.audit import ALLOW
from tidewright.plans.base import postings
from tidewright.plans.clustering import Fit, Places
from tidewright.plans.evaluation import silhouettes


@pytest.fixture(scope="module")
def p(spark, sf):
    return postings(spark, sf).persist()


def test_features_and_families_are_the_contracts():
    named = ["required_skills" if c == "skills" else c for own in models.FAMILIES.values() for c in own]
    assert sorted(named) == sorted(ALLOW) and len(named) == 13
    assert sorted([*models.NOMINAL, *models.NUMERIC, "skills"]) == sorted(c for own in models.FAMILIES.values() for c in own)
    assert set(ensembles.CAPS) == set(models.FAMILIES)


def test_blocks_take_every_feature(p):
    widths = {r.family: r.width for r in models.family_blocks(p).collect()}
    values = {c: p.select(c).distinct().count() for c in models.NOMINAL}
    assert set(widths) == set(models.FAMILIES) and widths["geography"] == values["city"] + values["country"] and widths["demand_benefits"] == 2


def test_spaces_leave_out_single_columns(p):
    x = models.prepared(p)
    names = {n: [c for c, _ in models.balancer(x, without)[2]] for n, without in segments.SPACES.items() if without is not None}
    whole = set(names["R0_GLOBAL_PCA"])
    assert {n: whole - set(own) for n, own in names.items()} == {n: set(segments.SPACES[n]) for n in names}


def test_components_reach_the_share():
    assert [models.components_for(x) for x in ([0.9, 0.05, 0.01], [0.5, 0.2, 0.1, 0.1, 0.05], [0.1] * 5)] == [2, 4, 5]


def test_reduced_keeps_the_share(p):
    assert len(models.reduced(p).first().z) == models.pca_variance(p).count() > 5


@pytest.mark.parametrize("tile", [7, 8000])
def test_silhouettes_of_labellings(spark, tile):
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(50, 4)), rng.integers(0, 3, (50, 2))
    labels[:, 1] = 0
    labels[7, 1] = 2
    made = silhouettes(spark.createDataFrame([(i, labels[i].tolist(), x[i].tolist()) for i in range(50)], "id long, labels array<int>, x array<double>"), tile)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for at in range(2):
        s = []
        for i in range(50):
            own = labels[:, at] == labels[i, at]
            a = d[i, own].sum() / max(1, own.sum() - 1)
            b = min(d[i, labels[:, at] == c].mean() for c in set(labels[:, at]) - {labels[i, at]})
            s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
        assert made[at] == pytest.approx(np.mean(s), abs=1e-9)


def blobs(n=400, d=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [4, 0, 1], [0, 5, -1], [3, 3, 3]])[:, :d]
    spread = [0.4, 0.8, 0.6, 1.0]
    at = rng.integers(0, 4, n)
    return centres[at] + rng.normal(size=(n, d)) * np.array(spread)[at][:, None]


@pytest.fixture(scope="module")
def places(spark):
    z = blobs()
    frame = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(z)], "id string, z array<double>").repartition(3)
    return z, Places(frame, draws=3)


def plain_means(z, centres, most=300):
    spread = z.var(axis=0).mean()
    for _ in range(most):
        at = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([z[at == k].mean(axis=0) if (at == k).any() else c for k, c in enumerate(centres)])
        if ((moved - centres) ** 2).sum() <= clustering.SHIFT_TOLERANCE * spread:
            break
        centres = moved
    return centres, at


def plain_mixture(z, centres, most=300):
    n, d = z.shape
    share = np.eye(len(centres))[((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    before = None
    for _ in range(most):
        w = share.sum(axis=0)
        means = share.T @ z / w[:, None]
        cov = [((z - m).T * share[:, k]) @ (z - m) / w[k] + clustering.ADDED * np.eye(d) for k, m in enumerate(means)]
        log = np.stack([np.log(w[k] / n) - 0.5 * (np.linalg.slogdet(cov[k])[1] + d * np.log(2 * np.pi) + np.einsum("ij,jk,ik->i", z - means[k], np.linalg.inv(cov[k]), z - means[k])) for k in range(len(w))], axis=1)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        if before is not None and abs(total.sum() - before) / n < clustering.EM_TOLERANCE:
            break
        before, share = total.sum(), np.exp(log - total[:, None])
    return means, float(total.sum()), log.argmax(axis=1)


def test_fits_are_the_plain_ones(places):
    z, own = places
    fits = [Fit(a, k, seed, draw) for a in ("KMeans", "GMM") for k, seed, draw in ((2, 1, -1), (3, 2, -1), (4, 3, 1))]
    starts = [own._started(f) for f in fits]
    own.fit(fits)
    rows = own.table.collect()
    ids, draws = [int(r.id[1:]) for r in rows], np.array([r.draws for r in rows])
    labels = {int(r.id[1:]): r.labels for r in own.labelled(fits).collect()}
    for i, (f, start) in enumerate(zip(fits, starts, strict=True)):
        seen = np.array(ids)[draws >> f.draw & 1 == 1] if f.draw >= 0 else np.array(ids)
        centres, at = plain_means(z[seen], start)
        if f.algorithm == "GMM":
            centres, score, at = plain_mixture(z[seen], centres)
            assert f.score == pytest.approx(score, rel=1e-9) and f.converged
            free = f.k * 3 + f.k * 6 + f.k - 1
            assert f.criteria() == pytest.approx((free * np.log(len(seen)) - 2 * score, 2 * free - 2 * score))
        assert f.centres == pytest.approx(centres, rel=1e-6, abs=1e-9) and f.rows == len(seen)
        assert [labels[j][i] for j in seen] == at.tolist()


def test_moments_of_many_fits_are_each_ones(monkeypatch):
    """Steps of several fits at once, over more rows than are taken at once, against sums row by row."""
    monkeypatch.setattr(clustering, "AT_ONCE", 64)
    rng = np.random.default_rng(3)
    z, centres = blobs(150), [rng.normal(size=(k, 3)) for k in (2, 4, 1)]
    centres[1][3] = centres[1][0]  # the first of equals
    draws, of = rng.integers(0, 4, 150), [-1, 0, 1]
    sees = lambda d: np.ones(150) if d < 0 else (draws >> d & 1).astype(float)
    for c, d, got in zip(centres, of, clustering.mean_moments(z, [(d, "KMeans", c) for c, d in zip(centres, of, strict=True)], draws), strict=True):
        far = ((z[:, None] - c[None]) ** 2).sum(axis=2)
        on = np.eye(len(c))[far.argmin(axis=1)] * sees(d)[:, None]
        assert got == pytest.approx(np.concatenate([[far.min(axis=1) @ sees(d)], on.sum(axis=0), (on.T @ z).ravel()]))
    fits = []
    for k in (2, 3):
        root = rng.normal(size=(k, 3, 3))
        fits.append(Fit("GMM", k, centres=rng.normal(size=(k, 3)), weights=rng.dirichlet(np.ones(k)), covariances=root @ root.transpose(0, 2, 1) + 0.3 * np.eye(3)))
    fits.append(Fit("GMM", 3, centres=rng.normal(size=(3, 3))))
    for f, d in zip(fits, of, strict=True):
        f.draw = d
    for f, got in zip(fits, clustering.mixture_moments(z, [f.payload() for f in fits], draws), strict=True):
        if f.weights is None:
            d = ((z[:, None] - f.centres[None]) ** 2).sum(axis=2)
            share, score = np.eye(3)[d.argmin(axis=1)], d.min(axis=1)
        else:
            log = np.stack([np.log(w) - 0.5 * (np.linalg.slogdet(c)[1] + 3 * np.log(2 * np.pi) + np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)) for w, m, c in zip(f.weights, f.centres, f.covariances, strict=True)], axis=1)
            total = np.log(np.exp(log).sum(axis=1))
            share, score = np.exp(log - total[:, None]), total
        share, score = share * sees(f.draw)[:, None], score @ sees(f.draw)
        products = np.einsum("ik,ia,ib->kab", share, z, z)
        assert got == pytest.approx(np.concatenate([[score], share.sum(axis=0), (share.T @ z).ravel(), products.ravel()]))


def test_sums_are_the_same_whoever_adds_them(places, monkeypatch):
    _, own = places
    each = lambda z, draws: [z.sum(axis=0), np.array([len(z), draws.sum()], float)]
    small = own.summed(each, 40)
    monkeypatch.setattr(clustering, "SENT", 0)
    for a, b in zip(small, own.summed(each, 40), strict=True):
        assert a == pytest.approx(b)


def test_draws_have_their_size(places):
    _, own = places
    draws = np.array([r.draws for r in own.table.collect()])
    assert [(draws >> d & 1).sum() for d in range(3)] == [own.size] * 3 == [340] * 3
    assert len({tuple(draws >> d & 1) for d in range(3)}) == 3


def test_agreement_and_validity_are_the_plain_ones(places):
    z, own = places
    fits = own.best([Fit("KMeans", 3, 5), Fit("GMM", 4, 6), Fit("KMeans", 2, 7, 0)], lambda s: 2)
    rows = own.labelled(fits).join(own.table.select("id", "draws"), "id").collect()
    labels, draws, x = np.array([r.labels for r in rows]), np.array([r.draws for r in rows]), np.array([r.z for r in rows])

    def pair_counts(a, b):
        same = lambda v: v[:, None] == v[None, :]
        up = np.triu_indices(len(a), 1)
        both, sa, sb, n = (same(a) & same(b))[up].sum(), same(a)[up].sum(), same(b)[up].sum(), len(up[0])
        return (both - sa * sb / n) / ((sa + sb) / 2 - sa * sb / n)

    found = own.agreement(fits, [(0, 1, -1), (1, 2, 0)])
    on = draws & 1 == 1
    assert found == pytest.approx([pair_counts(labels[:, 0], labels[:, 1]), pair_counts(labels[on, 1], labels[on, 2])])
    for i, v in enumerate(own.validity(fits)):
        at = labels[:, i]
        names = sorted(set(at.tolist()))
        means = np.array([x[at == c].mean(axis=0) for c in names])
        gap = np.array([np.sqrt(((x[at == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(names, means, strict=True)])
        far = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
        db = np.mean([max((gap[a] + gap[b]) / far[a, b] for b in range(len(names)) if b != a) for a in range(len(names))])
        within = sum(((x[at == c] - m) ** 2).sum() for c, m in zip(names, means, strict=True))
        between = sum((at == c).sum() * ((m - x.mean(axis=0)) ** 2).sum() for c, m in zip(names, means, strict=True))
        assert v["davies_bouldin"] == pytest.approx(db) and v["inertia"] == pytest.approx(within) and v["clusters"] == len(names)
        assert v["calinski_harabasz"] == pytest.approx(between / (len(names) - 1) / (within / (len(x) - len(names))))


def row(algorithm, k, silhouette, **gates):
    every = ("balance_gate", "convergence_gate", "stability_evaluated", "seed_convergence_gate", "eligible")
    return {"algorithm": algorithm, "k": k, "silhouette": silhouette, **dict.fromkeys(every, False), **gates}


def test_choice_takes_the_first_pool_with_any():
    fine = {"balance_gate": True, "convergence_gate": True}
    rows = [row("KMeans", 5, 0.300, **fine), row("GMM", 4, 0.295, **fine), row("KMeans", 4, 0.291, **fine), row("KMeans", 2, 0.2, **fine), row("GMM", 2, 0.9, convergence_gate=True), row("GMM", 8, 0.99)]
    assert segments.choose(rows) == (rows[2], "balanced_converged")
    assert segments.choose(rows[4:]) == (rows[4], "converged") and segments.choose(rows[5:]) == (rows[5], "all")
    rows.append(row("GMM", 7, 0.1, stability_evaluated=True, seed_convergence_gate=True, **fine))
    assert segments.choose(rows) == (rows[6], "tested")
    rows.append(row("KMeans", 8, 0.01, eligible=True))
    assert segments.choose(rows) == (rows[7], "eligible")


def test_trials_in_order_of_silhouette():
    fine = {"balance_gate": True, "convergence_gate": True}
    rows = [row("KMeans", k, 0.1 * k, **fine) for k in range(2, 7)] + [row("GMM", 2, 0.3, convergence_gate=True), row("GMM", 3, 0.9)]
    assert [(r["algorithm"], r["k"]) for r in segments.to_try(rows)] == [("KMeans", 6), ("KMeans", 5), ("KMeans", 4), ("GMM", 2)]
    assert [r["k"] for r in segments.to_try(rows, segments.Rules(full=True))] == [2, 3, 4, 5, 6, 2, 3]


def test_gates_of_stability():
    rules = segments.Rules()
    fits = lambda n, converged: [Fit("GMM", 3, converged=converged) for _ in range(n)]
    fresh = lambda: row("GMM", 3, 0.4, balance_gate=True, convergence_gate=True) | dict.fromkeys(("stability_gate", "resample_gate", "resample_convergence_gate"), False)
    for seeds, draws, seed_ari, draw_ari, tested, eligible in ((True, True, 0.95, 0.8, True, True), (True, True, 0.85, 0.8, False, False), (False, True, 0.95, 0.8, False, False), (True, True, 0.95, 0.7, True, False), (True, False, 0.95, 0.8, True, False)):
        r = fresh()
        segments.stability(r, fits(3, seeds), fits(2, draws), [seed_ari] * 3, [draw_ari, draw_ari + 0.02], rules)
        assert ("resample_runs" in r, r["eligible"]) == (tested, eligible)
    assert r["resample_ari_mean"] == pytest.approx(0.81) and r["resample_ari_min"] == 0.8 and r["resample_ari_p10"] == pytest.approx(0.802)


SMALL = segments.Rules(ks=(2, 3), seeds=(11, 42), draws=2, main_starts=(2, 1), tried=1, most_steps=8)


def test_judged_candidates(p):
    j = segments.judge(segments.in_components(p.limit(300)), SMALL)
    assert {(r["algorithm"], r["k"]) for r in j.rows} == {(a, k) for a in segments.ALGORITHMS for k in SMALL.ks}
    assert sum(r["selected"] for r in j.rows) == 1 and j.chosen["selected"] and j.fit.k == j.chosen["k"]
    tried = [r for r in j.rows if r["stability_evaluated"]]
    assert len(tried) == 2 and len(j.pairs) == 2 and all((r["bic"] is None) == (r["algorithm"] == "KMeans") for r in j.rows)
    assert {(a, k) for a, k, *_ in j.runs} == {(r["algorithm"], r["k"]) for r in tried if r["stability_gate"]}
    made = segments.as_table(p.sparkSession, j.rows)
    assert made.count() == 4 and made.columns == list(segments.COLUMNS)


def test_tables_of_stability(p):
    some = p.limit(300).persist()
    pairs = segments.seed_stability(some, SMALL).collect()
    assert {(r.seed_a, r.seed_b) for r in pairs} == {(11, 42)} and all(r.stability_ari == pytest.approx(r.ari) for r in pairs)
    runs = segments.subsample_stability(some, segments.Rules(**{**SMALL.__dict__, "least_seed_ari": -1.0, "least_converged": 0.0})).collect()
    assert {r.sample_rows for r in runs} == {255} and len(runs) == 4
    one = [r for r in runs if r.algorithm == "KMeans"]
    assert one[0].resample_ari_mean == pytest.approx(np.mean([r.ari for r in one]))
    assert {(r.algorithm, r.k): r.cluster for r in segments.cluster_assignments(some, SMALL).filter(F.col("job_id") == some.first().job_id).collect()}.keys() == {(a, k) for a in segments.ALGORITHMS for k in SMALL.ks}


def test_choices_among_spaces():
    own = lambda n, s, cross, draws, eligible=True, d=5, k=13: {"space": n, "silhouette": s, "mean_cross_ari": cross, "resample_ari_mean": draws, "stability_ari": 0.9, "min_cluster_share": 0.2, "eligible": eligible, "dimensions": d, "inputs": k}
    rows = [own("A", 0.30, 0.5, 0.9), own("B", 0.29, 0.8, 0.7), own("C", 0.2, 1.0, 1.0), own("D", 0.9, 1.0, 1.0, False), own("E", 0.29, 0.8, 0.8)]
    assert segments.choose_space(rows, 0.03) == (rows[4], "eligible") and segments.choose_space(rows[3:4], 0.03) == (rows[3], "all")
    options = [own("O1_PCA", 0.3, 0, 0.8), own("O2_CORRELATION", 0.295, 0, 0.8)]
    assert segments.choose_option(options, 0.01)[0] is options[1]
    options[0]["dimensions"] = 4
    assert segments.choose_option(options, 0.01)[0] is options[0]
    options[1]["resample_ari_mean"] = 0.81
    assert segments.choose_option(options, 0.01)[0] is options[1] and segments.choose_option(options, 0.001)[0] is options[0]


def test_greedy_columns():
    corr = np.array([[1, 0.95, 0.1], [0.95, 1, -0.92], [0.1, -0.92, 1]])
    assert models.greedy_columns(corr, np.array([2.0, 1.0, 1.0]), ["a", "b", "c"]) == ([0, 2], {1: (0, 0.95)})
    assert models.greedy_columns(corr, np.array([1.0, 3.0, 2.0]), ["a", "b", "c"]) == ([1, 2], {0: (1, 0.95)})  # two at least
    assert models.greedy_columns(corr, np.array([1.0, 0.0, 2.0]), ["a", "b", "c"])[0] == [0, 2]


def test_spaces_are_compared(p, monkeypatch):
    some = p.limit(200).persist()
    rules = segments.Rules(**{**SMALL.__dict__, "ks": (2,), "main_starts": (1, 1), "most_steps": 4})
    rows, made, ari = segments.space_rows(some, rules, 0.03)
    assert [r["space"] for r in rows] == list(segments.SPACES) and sum(r["chosen"] for r in rows) == 1
    assert rows[0]["ari_to_r0"] == 1 and {r["inputs"] for r in rows} == {13, 12, 11} and len(ari) == 25
    assert rows[2]["mean_cross_ari"] == pytest.approx(np.mean([ari[rows[2]["space"], n] for n in made if n != rows[2]["space"]]))
    monkeypatch.setattr(segments, "space_rows", lambda *a: ([dict(r) for r in rows], made, ari))
    assert segments.representations(some, rules).count() == 5
    options = segments.space_options(some, rules).collect()
    assert [r.space for r in options] == ["O1_PCA", "O2_CORRELATION"] and sum(r.chosen for r in options) == 1 and [r.reason == "chosen" for r in options].count(True) == 1
