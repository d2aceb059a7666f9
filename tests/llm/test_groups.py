"""Near-dedup, fingerprints, chat repair and url reputation: small cases and plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from tidewright.llm import chat_format, edit_fingerprint, embedding_dedup, minhash, url_filter
from tidewright.llm.common import components, forest


def joined(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(9999, i) for i in range(1500)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "none": []}[kind]
    found = {r.node: r.component for r in components(spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")).collect()}
    want = joined({x for e in links for x in e}, links)
    assert found == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}


def shingle_set(text, words=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_groups(docs, words=4):
    sets = {d: shingle_set(t, words) for d, t in docs.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in joined(docs, links).items()}


def near_copies(n, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_minhash_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    texts = near_copies(90) + near_copies(3, 5) + [" ".join(f"x{rng.randrange(90)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += ["a", "A", "a b c", "a  b\tc", "", None, " \n", "one two three four", "one two three four five"]
    docs = {100 + i: t for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs.items()], "doc_id long, text string, rep string")
    want = plain_groups(docs)
    for tile in (1024, 8):  # small tiles: buckets and families are cut
        monkeypatch.setattr(minhash, "TILE", tile)
        rows = minhash.near_groups(frame).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(None, text), (4, text), (4, text), (4, "other words here and more"), (9, "other words here and more"), (2, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(frame).collect()), key=repr)
    assert rows == [(2, 2, True), (4, 4, True), (4, 4, True), (4, 4, True), (9, 4, False), (None, None, True)]
    assert minhash.near_groups(frame.limit(0)).count() == 0
    assert minhash.keep_one(frame).count() == 5


def test_links_within_is_exact():
    rng = np.random.default_rng(4)
    base = rng.choice(5000, 300, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.06], rng.choice(5000, rng.integers(0, 60))])).astype(np.uint64) for _ in range(40)]
    true = [(i, j) for i, j in itertools.combinations(range(40), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert joined(range(40), minhash.links_within(sets)) == joined(range(40), true)
    side = np.arange(40) % 2
    across = [(i, j) for i, j in true if side[i] != side[j]]
    assert joined(range(40), minhash.links_within(sets, side)) == joined(range(40), across)


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(5)
    for j in (0.8, 0.9, 0.97):
        shared = rng.integers(0, 2**63, int(2000 * j), dtype=np.uint64)
        rest = [rng.integers(0, 2**63, (2000 - len(shared)) // 2, dtype=np.uint64) for _ in range(2)]
        a, b = (np.frombuffer(minhash.odd_sketch(minhash.samples(np.unique(np.concatenate([shared, r])))), np.uint64) for r in rest)
        assert abs(minhash.estimate(np.bitwise_count(a ^ b).sum()) - j) < 0.15


def test_quantised_bounds_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 40))
    v = base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 40)) * 0.12
    v[:5] *= 1e-12
    v[280:] = v[260:280]  # equal vectors
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if (v[a] * v[b]).sum() / (np.sqrt((v[a] ** 2).sum()) * np.sqrt((v[b] ** 2).sum())) >= 0.98}
    code, scale, error = known = embedding_dedup.quantise(n)
    assert np.allclose(np.linalg.norm(n - scale[:, None] * code, axis=1), error)
    sure, maybe = embedding_dedup.bounded(known, known, 0.98)
    found = {(i, j) for i, j in zip(*np.nonzero(np.triu(sure, 1)), strict=True)}
    doubt = {(i, j) for i, j in zip(*np.nonzero(np.triu(maybe, 1)), strict=True)}
    assert found <= want <= found | doubt and doubt and found and len(doubt) < 300 * 299 / 8
    links = {i: sum(i in p for p in want) for i in range(300)}
    groups = joined(range(300), want)
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    for tile in (1024, 50):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        out = embedding_dedup.near_groups(frame).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (links[i], groups[i]) for i in range(300)}


@pytest.mark.parametrize("across", [None, 30])
def test_forest_joins_what_links_join(across):
    rng = np.random.default_rng(8)
    linked = rng.random((50, 50)) < 0.03
    if across is None:
        linked |= linked.T
        np.fill_diagonal(linked, False)
        pairs = list(zip(*np.nonzero(linked), strict=True))
    else:
        linked = linked[:across, across:]
        pairs = [(i, across + j) for i, j in zip(*np.nonzero(linked), strict=True)]
    edges = forest(linked, across)
    want = joined(range(50), pairs)
    assert joined(range(50), edges.tolist()) == want and len(edges) == 50 - len(set(want.values()))


def test_embedding_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 2)
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, two, 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1), (9, one, None), (10, [5.0, 0.01], 1), (11, [1.0], 1), (12, [], 1), (None, one, 1), (13, [float("inf"), 0.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, tile string")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_groups(frame).collect()}
    want = {r[0]: (0, r[0], True) for r in rows} | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)}
    assert out == want and embedding_dedup.near_groups(frame).columns == [*frame.columns, "n_links", "component_id", "kept"]
    twice = frame.union(spark.createDataFrame([(9, [3.0, 3.0], 1, "y"), (9, two, 1, "y")], frame.schema))
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_groups(twice).filter("vec_id in (4, 9)").collect()}
    assert out == {4: (1, 4), 9: (1, 4)}
    assert embedding_dedup.near_groups(frame.limit(0)).count() == 0


def test_fingerprints_follow_the_contract(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdef \n") for _ in range(rng.randrange(1, 6000))) for _ in range(30)] + ["", None, "ab", "🙂🙂🙂🙂", "ab"]
    docs = {7 * i: t for i, t in enumerate(texts)}
    rows = {r.doc_id: r for r in edit_fingerprint.fingerprints(spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, start string")).collect()}
    ids = sorted(docs, reverse=True)
    alone = lambda t: edit_fingerprint.fingerprint(edit_fingerprint.embed([edit_fingerprint._code_points(t)])[0])
    for i, d in enumerate(ids):
        text, following = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = rows[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (alone(text), alone(edited))
        assert r.near_edited == edit_fingerprint.likeness(alone(text), alone(edited))
        assert r.near_next == edit_fingerprint.likeness(alone(text), alone(following))


def test_fingerprint_odd_tables(spark):
    shape = "doc_id long, text string"
    assert edit_fingerprint.fingerprints(spark.createDataFrame([], shape)).count() == 0
    one = edit_fingerprint.fingerprints(spark.createDataFrame([(3, "alone in here")], shape)).first()
    assert one.near_next == 1.0
    twice = edit_fingerprint.fingerprints(spark.createDataFrame([(1, "b" * 9), (1, "a" * 9), (None, "n" * 9), (None, "m" * 9)], shape)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in twice) == [(0, 9), (0, 9), (1, 9), (1, 9)]


def test_likeness_follows_edits():
    rng = random.Random(8)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(5000))
    print_of = lambda t: edit_fingerprint.fingerprint(edit_fingerprint.embed([edit_fingerprint._code_points(t)])[0])
    other = "".join(rng.choice("etaoin shrdlu") for _ in range(5000))
    like = [edit_fingerprint.likeness(print_of(text), print_of(t)) for t in (text, text[:900] + "x" + text[900:], text[:4000] + other[:1000], other)]
    assert like[0] == 1 and like[1] > 0.8 and 0.9 > like[2] > 0.6 and like[3] < 0.5  # four fifths are the same in the third


def cost_of(roles, new):
    p, total = 0, 0
    for r, q in zip(roles, new, strict=True):
        total, p = total + chat_format.MOVES[r][p][q], q
    return total


@pytest.mark.parametrize("chunk", [512, 3, 1])
def test_repair_costs_least(spark, chunk):
    rng = random.Random(11)
    names = {0: [None, "tool", ""], 1: ["system", "System "], 2: ["user", "human"], 3: ["assistant", "bot"]}
    convs = {c: [rng.randrange(4) for _ in range(rng.randrange(1, 8))] for c in range(60)}
    rows = [(c, t, rng.choice(names[r]), f"t{t}", "x") for c, roles in convs.items() for t, r in enumerate(roles)]
    turns = spark.createDataFrame([*rows, (None, 0, "assistant", "lone", "x"), (None, 0, "assistant", "lone", "x"), (99, None, "user", None, "x")], "conv_id long, turn long, role string, text string, cost string")
    made = chat_format.repair(turns, chunk).collect()
    assert len(made) == len(rows) + 3
    for c, roles in convs.items():
        own = sorted((r for r in made if r.conv_id == c), key=lambda r: r.turn)
        new = [chat_format.ROLES.index(r.new_role) for r in own]
        least = min(cost_of(roles, x) for x in itertools.product((1, 2, 3), repeat=len(roles)))
        # of equal ways the lowest roles, the last turn deciding first, wherever chunks and parts are cut
        assert tuple(new) == min((x for x in itertools.product((1, 2, 3), repeat=len(roles)) if cost_of(roles, x) == least), key=lambda x: x[::-1])
        assert sum(r.cost for r in own) == cost_of(roles, new) == least
        text = "".join(r.piece for r in own)
        shown = [x.split("\n")[0].strip("<|>") for x in text.split("<|end|>\n")[:-1]]
        assert all((chat_format.ROLES.index(a), chat_format.ROLES.index(b)) in chat_format.LEGAL for a, b in zip(["", *shown], shown, strict=False))
    assert [(r.new_role, r.action, r.piece) for r in made if r.conv_id is None] == [("user", "relabel", "<|user|>\nlone<|end|>\n")] * 2
    assert chat_format.repair(turns.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "equal"])
def test_a_hot_conversation_over_many_parts(spark, kind):
    """A conversation of most rows, its turns all null or time stamps, is what the plain programme makes of it."""
    rng = random.Random(12)
    if kind == "long":
        rows = [(7, 1_000_003 * t, rng.choice(["user", "assistant", "system", "?", None]), f"t{t}", {"k": t}) for t in range(3000)]
    else:
        rows = [(7, None, "?", "same", {"k": 0})] * 1500
    rows += [(8 + i, 0, "assistant", "x", None) for i in range(50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra map<string,int>").repartition(5)
    made = [r for r in chat_format.repair(frame, 64).collect() if r.conv_id == 7]
    number = lambda r: chat_format.ROLES.index(r) if r in chat_format.ROLES else 0
    roles = [number(r[2]) for r in rows if r[0] == 7]
    way = chat_format.solve(roles)
    if kind == "long":
        made.sort(key=lambda r: r.turn)
        assert [chat_format.ROLES.index(r.new_role) for r in made] == way[1:] and [r.extra["k"] for r in made] == list(range(3000))
    least = sum(chat_format.MOVES[r][p][q] for r, p, q in zip(roles, way, way[1:], strict=False))
    assert sum(r.cost for r in made) == least and sum(r.piece.endswith("<|end|>\n") for r in made) == 1


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://foo.net", "http://foo.net/", "http://notexample.com/de/", "http://x.example.com/de/#a", "http://b.org/fr/y", "http://b.org/fr", None, "no scheme", "http://u/p://v/w", "http://h?x://y/", ""]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)] + [(None, "http://z.com/a", "keep")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "page_id long, bad int")
    out = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    parts = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("foo.net", "", None, None), ("foo.net", "/", "net/", "block"), ("notexample.com", "/de/", None, None), ("x.example.com", "/de/", "example.com/de/", "block"), ("b.org", "/fr/y", "org/fr/", "allow"), ("b.org", "/fr", None, None), ("", "", None, None), ("", "", None, None), ("u", "/p://v/w", None, None), ("h", "", None, None), ("", "", None, None)]
    for i, (host, path, rule, verdict) in enumerate(parts):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert verdict is None or out[i].verdict == verdict
        assert out[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    assert url_filter.judge(pages, labels.limit(0)).count() == 13


def test_reputation_shrinks_to_the_domain(spark):
    pages = [(i, f"http://bad{i % 4}.evil.com/{i}") for i in range(200)] + [(200 + i, f"http://ok{i % 4}.fine.com/{i}") for i in range(200)] + [(400, "http://new.evil.com/"), (401, "http://new.fine.com/")]
    labels = [(i, 1) for i in range(200)] + [(200 + i, 0) for i in range(200)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert out[0].verdict == "block" and out[200].verdict == "allow"
    assert out[400].posterior > 0.5 > out[401].posterior


def test_domains_and_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk:80", "com", "co.uk", "x.y.z.github.io", "10.0.0.1", "99.7.0.1:8080", "[::1]:80", "", "a..b")], "host string")
    want = {"a.b.co.uk:80": ("b.co.uk", "co.uk"), "com": ("com", "com"), "co.uk": ("co.uk", "co.uk"), "x.y.z.github.io": ("github.io", "io"), "10.0.0.1": ("10.0.0.1", url_filter.ADDRESSES), "99.7.0.1:8080": ("99.7.0.1", url_filter.ADDRESSES), "[::1]:80": ("[::1]", url_filter.ADDRESSES), "": ("", ""), "a..b": (".b", "b")}
    assert {r.host: (r.domain, r.suffix) for r in url_filter.with_domains(hosts, url_filter.default_suffixes(spark)).collect()} == want
    own = spark.createDataFrame([("github.io",), ("y.z.github.io",), (None,)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_domains(hosts, own).collect()}
    assert got["x.y.z.github.io"] == ("x.y.z.github.io", "y.z.github.io") and got["a.b.co.uk:80"] == ("co.uk", "uk")
