"""Edit fingerprints against a plain walk, and the classes of near texts against all pairs and true edits."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_groups import joined
from tidewright.llm import edit_fingerprint as edit

LETTERS = "etaoin shrdlu,cmfwyp"


def mixed(x):
    """The 64-bit finaliser in plain numbers."""
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def plain_walk(text):
    """One character at a time: write its class, move on if the shared function of step and class says so."""
    out = []
    for k in range(0, len(text), edit.WALK):
        part, at = text[k : k + edit.WALK], 0
        for t in range(3 * len(part)):
            c = mixed(ord(part[at]) + 1) % 255 + 1 if at < len(part) else 0
            out.append(c)
            at += int(edit._MOVES[t][c]) if at < len(part) else 0
    return out


def plain_print(text):
    walk = plain_walk(text)
    level = 0
    while len(walk) > edit.SAMPLES << level:
        level += 1
    at = [j for j in range(len(walk)) if mixed((j * 0x9E3779B97F4A7C15 + 5) & ((1 << 64) - 1)) & ((1 << level) - 1) == 0]
    out = {}
    for j in at:
        value = 0
        for x in [*walk[j : j + edit.GRAM], *[0] * edit.GRAM][: edit.GRAM]:
            value = (value * 257 + x) & ((1 << 64) - 1)
        out[j] = mixed(value) % 255 + 1 if value else 0
    return level, len(walk), out


def as_plain(a):
    level, n, x = a
    return f"{level}:{n}:" + bytes(x[j] for j in sorted(x)).hex()


def plain_likeness(a, b):
    if a == b:
        return 1.0
    level = max(a[0], b[0])
    kept = lambda x: {j: v for j, v in x[2].items() if v and mixed((j * 0x9E3779B97F4A7C15 + 5) & ((1 << 64) - 1)) & ((1 << level) - 1) == 0}
    x, y = kept(a), kept(b)
    return sum(y.get(j) == v for j, v in x.items()) / max(1, len(x.keys() | y.keys()))


def random_text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def with_edits(rng, text, share):
    text = list(text)
    for _ in range(max(1, int(share * len(text)))):
        at = rng.randrange(len(text))
        text[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(LETTERS)])
    return "".join(text)


def print_of(text):
    return edit.fingerprint(edit.embed([edit._code_points(text)])[0])


def test_walk_fingerprint_and_likeness_are_the_plain_ones():
    rng = random.Random(1)
    texts = ["", "a", "ab", "🙂 é", random_text(rng, 70), random_text(rng, 2048), random_text(rng, 5000)]
    texts += [with_edits(rng, t, 0.01) for t in texts[4:]]
    plain = [plain_print(t) for t in texts]
    for t, own, want in zip(texts, edit.embed(list(map(edit._code_points, texts))), plain, strict=True):
        assert own.tolist() == plain_walk(t) and edit.fingerprint(own) == as_plain(want)
    for (a, x), (b, y) in itertools.product(zip(texts, plain, strict=True), repeat=2):
        assert edit.likeness(print_of(a), print_of(b)) == pytest.approx(plain_likeness(x, y))


def test_texts_apart_are_not_like_each_other():
    rng = random.Random(2)
    prints = [print_of(random_text(rng, n)) for n in (60, 300, 900, 3000, 9000) for _ in range(8)]
    assert max(edit.likeness(a, b) for a, b in itertools.combinations(prints, 2)) < 0.2


def near_texts(rng, n, families, share):
    out = []
    for f in range(families):
        base = random_text(rng, n)
        out += [base, with_edits(rng, base, share), with_edits(rng, base, share)]
        if f % 3 == 0:
            out.append(base)
    return out


@pytest.mark.parametrize("tile", [1024, 2])
def test_classes_against_all_pairs(spark, monkeypatch, tile):
    """All pairs with a likeness of NEAR, tried one by one, join what the bands join, but for the loss that near_classes() states."""
    monkeypatch.setattr(edit, "TILE", tile)
    rng = random.Random(3)
    texts = near_texts(rng, 250, 12, 0.01) + near_texts(rng, 900, 12, 0.01) + near_texts(rng, 5000, 6, 0.01) + ["", None, "a", "a", "ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in edit.fingerprints(docs).collect()}
    prints = [print_of(t or "") for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if edit.likeness(prints[i], prints[j]) >= edit.NEAR]
    want = joined(range(len(texts)), links)
    assert found.pop(None) is None
    assert sum(found[i] == found[j] for i, j in links) / len(links) > 0.97
    assert all(want[i] == want[c] for i, c in found.items())  # nothing is joined that likeness doesn't join


@pytest.mark.parametrize("n", [300, 900, 5000])
def test_recall_of_true_edits(spark, n):
    """Of texts at MOST_EDITS of their characters (insertions, deletions, replacements anywhere) over nine in ten are found."""
    rng = random.Random(n)
    base = [random_text(rng, n) for _ in range(60)]
    texts = [x for t in base for x in (t, with_edits(rng, t, edit.MOST_EDITS))]
    out = {r.doc_id: r.class_id for r in edit.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([out[2 * i] == out[2 * i + 1] for i in range(len(base))]) >= 0.9
    assert len({out[2 * i] for i in range(len(base))}) == len(base)


def plain_likenesses(texts):
    prints = [print_of(t) for t in texts]
    return [edit.likeness(a, b) for a, b in zip(prints[::2], prints[1::2], strict=True)]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.1, 0.2, 0.4])
def test_recall_over_lengths(spark, share):
    """Pairs of a likeness of NEAR are found at all lengths: around 64 * 2^k characters, where levels change, and with tails of up to 40 %."""
    rng = random.Random(int(share * 100))
    sizes = [64 * 2**k + d for k in range(7) for d in (-5, -1, 0, 1, 5)] if share == 0 else [rng.randrange(300, 4000) for _ in range(60)]
    base = [random_text(rng, n) for n in sizes for _ in range(2 if share == 0 else 1)]
    texts = [x for t in base for x in (t, t + random_text(rng, max(rng.randrange(1, 6), int(share * len(t)))))]
    near = [i for i, s in enumerate(plain_likenesses(texts)) if s >= edit.NEAR]
    out = {r.doc_id: r.class_id for r in edit.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 0.9 * len(base) and np.mean([out[2 * i] == out[2 * i + 1] for i in near]) >= 0.97


def test_members_that_fail_against_the_least_meet_each_other(spark, monkeypatch):
    def one_bucket(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1] * b.num_rows, pa.int64()), b["node"]], ["key", "rep"])

    monkeypatch.setattr(edit, "_banded", one_bucket)
    rng = random.Random(12)
    x, y = random_text(rng, 400), random_text(rng, 400)
    docs = [(1, random_text(rng, 400)), (2, x), (3, x[:300] + "zz" + x[300:]), (4, y), (5, y), (6, y[:-9]), (7, random_text(rng, 400)), (8, "ab"), (9, "")]
    for tile in (2, 128):
        monkeypatch.setattr(edit, "TILE", tile)
        found = {r.doc_id: r.class_id for r in edit.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert found == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}


def test_a_hot_id_over_many_parts(spark):
    """Rows of one doc_id are dealt apart, and wait for the next doc_id, wherever it begins."""
    rng = random.Random(5)
    rows = [(5, random_text(rng, 30)) for _ in range(400)] + [(9, "nine " * 9), (3, "three " * 9), (None, "none " * 9)]
    out = edit.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text = {r.n_chars: r for r in out if r.doc_id == 9}
    assert len(out) == 403
    import hashlib

    edited = {hashlib.sha256(edit.edited(t, "three " * 9).encode()).hexdigest() for d, t in rows if d == 5}
    assert {r.edited_sha256 for r in out if r.doc_id == 5} == edited and len(text) == 1


def test_what_a_part_waits_for():
    ends = [(0, "first", 9), (0, "second", 7), (0, "last", 5), (2, "first", 5), (2, "last", 5), (3, "first", 5), (3, "second", None), (3, "last", None)]
    assert edit._later(ends) == [(0, 3, "second"), (2, 3, "second"), (3, 0, "first")]
    assert edit._later([(1, "first", 4), (1, "last", 4)]) == [(1, 1, "first")]
