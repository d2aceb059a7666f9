"""Periodic runs and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import periodic_runs, substring_dedup
from tidewright.llm.common import table
from tidewright.llm.words import Words, rolled, text_slices

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def test_words_are_the_contracts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t \x0b\x1c\xa0\x00z0") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 600 + " y", "x" * 599 + "z y", "abcdefgh abcdefgh1 abcdefghabcdefgh"]
    column = pa.array(texts)
    for own, plain in ((column, texts), (column.slice(7, 200), texts[7:207]), (column.slice(3, 0), [])):
        words = Words(own)
        want = [words_of(t) for t in plain]
        flat = [w for ws in want for w in ws]
        assert [[words.data[a:b].tobytes() for a, b in zip(words.begin[i:j], words.end[i:j], strict=True)] for i, j in zip(words.first[:-1], words.first[1:], strict=True)] == want
        keep = np.array([rng.random() < 0.6 for _ in flat], bool)
        left = iter(keep)
        assert words.joined(keep).to_pylist() == [b" ".join(w for w in ws if next(left)).decode() for ws in want]
        h = words.hashes()
        for k in (1, 2, 6, 7, 18, 35):
            grams = [tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)]
            found = rolled(h, k).tolist()
            assert len(found) == len(grams) and len(set(zip(grams, found, strict=True))) == len(set(grams)) == len(set(found))
    assert [s for t in (column,) for s in text_slices(t, 50)][-1].stop == len(column)


def plain_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j + p), p)
            i = j
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def periodic_texts(n, seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        w = [rng.choice("ab" if k % 3 == 0 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4) if k % 3 else 0):
            a, p, m = rng.randrange(max(1, len(w))), rng.randrange(1, 20), rng.randrange(60)
            for i in range(a + p, min(len(w), a + m)):
                w[i] = w[i - p]
        out.append(" ".join(["x"] * len(w) if k % 7 == 0 else w))
    return out


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_are_exact(least):
    texts = periodic_texts(400, least)
    words = Words(pa.array(texts))
    begin, end, period = periodic_runs.runs_of(words.hashes(), words, least)
    row = np.searchsorted(words.first, begin, "right") - 1
    found = [[] for _ in texts]
    for r, a, length, p in zip(row, begin - words.first[row], end - begin, period, strict=True):
        found[r].append((int(a), int(length), int(p)))
    assert found == [plain_runs(t.split(), least) for t in texts]


def test_grid_in_pieces(monkeypatch):
    words = Words(pa.array(periodic_texts(60)))
    whole = periodic_runs.runs_of(words.hashes(), words)
    monkeypatch.setattr(periodic_runs, "POINTS", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs_of(words.hashes(), words), strict=True))


def test_collapse_rows(spark):
    texts = [*periodic_texts(40), None, "", " \n", "w " * 30_000, "one"]
    rows = [(t, "kept", i) for i, t in enumerate(texts)] + [(texts[4], "kept", 4)]
    out = periodic_runs.collapse_runs(spark.createDataFrame(rows, "text string, runs string, start int"))
    assert out.columns == ["text", "start", "runs"]
    found = sorted((r.start, r.text, [tuple(x) for x in r.runs]) for r in out.collect())
    own = {i: plain_runs(words_of(t)) if i != 43 else [(0, 30_000, 1)] for i, t in enumerate(texts)}
    assert found == sorted((i, plain_collapsed(words_of(t), own[i]), own[i]) for t, _, i in rows)
    assert periodic_runs.collapse_runs(out.select("text").limit(0)).count() == 0


def planted(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op12_by_its_contract(spark, sf):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want, long = {}, 0
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        w = planted(r.doc_id, r.text)
        if len(w) > 1500:  # the plain version is quadratic
            long += 1
            continue
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(plain_collapsed(w, runs).encode()))
    found = {r[0]: tuple(r)[1:] for r in periodic_runs.query(spark, sf).collect()}
    assert len(found) == len(want) + long and {d: found[d] for d in want} == want and sum(v[0] for v in want.values()) > 10


def plain_removed(texts, window):
    words, seen = [words_of(t) for t in texts], {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = {(k, j) for at in seen.values() if len(at) > 1 for k, i in at for j in range(i, i + window)}
    return [(len(w), sum((k, i) in gone for i in range(len(w))), b" ".join(x for i, x in enumerate(w) if (k, i) not in gone).decode()) for k, w in enumerate(words)]


def shared_passages(n, window, seed=5):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 3 * window))] for _ in range(12)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(2 * window))] if rng.random() < 0.6 else passages[rng.randrange(12)]
        texts.append(" ".join(w))
    return texts + [texts[3], texts[3], "x " * 200, "y y " * window, None, "", "  "] + [" ".join(f"h{i}" for i in range(window))] * 70


@pytest.mark.parametrize(("window", "together"), [(35, 8_000_000), (35, 400), (8, 300), (3, 200), (2, 8_000_000)])
def test_repeats_are_exact(spark, monkeypatch, window, together):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)  # texts meet in a worker's slice, or only in buckets
    texts = shared_passages(120, window)
    frame = spark.createDataFrame([(t, "clash", k) for k, t in enumerate(texts)], "text string, n_words string, key int").repartition(5)
    out = substring_dedup.remove_repeats(frame, window)
    assert out.columns == ["text", "key", "n_words", "n_removed"]
    found = sorted((r.key, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert found == [(k, *x) for k, x in enumerate(plain_removed(texts, window))]


def test_repeats_without_broadcast(spark, monkeypatch):
    from tidewright.llm import common

    monkeypatch.setattr(substring_dedup, "light", lambda df, weight: common.light(df, weight, -1))
    texts = shared_passages(40, 35)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).select("n_words", "n_removed", "text").collect())
    assert found == sorted(plain_removed(texts, 35))
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(frame, 1)
