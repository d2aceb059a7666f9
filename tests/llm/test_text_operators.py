"""Line dedup, token counts, byte-level BPE, the classifier and the mix: small cases and plain versions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, line_dedup, mixing, quality, token_count

DOC = "doc_id long, text string, lang string, source string, n_chars long, __drop string, tokens string, __extra_0 string"
ODD = ["", None, " ", "\n", "a\n\nb\r\n", "<|endoftext|> <s>", "word " * 30_000, "x" * 20_000, "ünïcödé 漢字 🙂\u2581 \u2581\u2581x", "1 22 333\t\t  end  ", "'s 'Re I'LL"]


def frame(spark, texts, ids=None, sources=None):
    rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def test_frequent_lines_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"hot\nown {i}\nshared {i % 3}\nhot") for i in range(60)] + [(None, "hot"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "HOT", 2)
    assert sorted(map(repr, line_dedup.dedup_lines(docs).collect())) == want and "own 5" in str(want) and "hot" not in str(want)


def test_line_dedup_small(spark):
    common = [f"own {i}\n  Common LINE \t\n\nlast" for i in range(9)]
    docs = frame(spark, [*common, "common line", None, "", "common line\ncommon line"], ids=[*range(9), 9, None, None, 9])
    out = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {(i, f"own {i}\n\nlast") for i in range(9)} | {(9, ""), (None, "")}
    rows = line_dedup.dedup_lines(docs)
    assert rows.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows.count() == 13
    assert [(r.n_lines, r.n_dropped) for r in rows.filter("doc_id = 0").collect()] == [(4, 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def bpe():
    tokens = list(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items())
    return tokens, byte_bpe.PerfectHash([t for t, _ in tokens])


def test_perfect_hash_is_minimal(bpe):
    tokens, hashed = bpe
    assert [hashed.find(t) for t, _ in tokens] == list(range(len(tokens)))
    assert sorted(hashed.slots) == list(range(len(tokens)))
    for n in (1, 2, 3, 7):
        keys = [bytes([i, i]) for i in range(n)]
        small = byte_bpe.PerfectHash(keys)
        assert [small.find(k) for k in keys] == list(range(n))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_is_the_librarys(bpe, tiktoken_encoding, text):
    own = byte_bpe.Encoder(*bpe, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_very_long_texts(spark, tiktoken_encoding, pieces):
    """Texts of megabytes go through every operator on texts whole."""
    texts = ["The quiet river. " * 150_000, "one line\n" * 100_000, "x" * 300_000]
    docs = frame(spark, texts)
    coded = byte_bpe.digests(byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).collect()
    assert {r.doc_id: r.n_tokens for r in coded} == {i: len(tiktoken_encoding.encode_ordinary(t)) for i, t in enumerate(texts[:2])} | {2: next(r.n_tokens for r in coded if r.doc_id == 2)}
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    counted = token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.n_tokens == len(pieces[2].encode(texts[r.doc_id])) for r in counted)
    lined = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, 1).collect()}
    assert lined == {0: (1, 1), 1: (100_001, 100_000), 2: (1, 1)}
    from tidewright.llm import edit_fingerprint, minhash

    assert {r.doc_id: r.n_shingles for r in minhash.near_groups(docs).collect()} == {0: 3, 1: 2, 2: 1}
    assert {r.doc_id: r.n_chars for r in edit_fingerprint.fingerprints(docs).collect()} == {i: len(t) for i, t in enumerate(texts)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, labels).collect())


def test_bpe_over_frames(spark, tiktoken_encoding):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = frame(spark, ODD)
    rows = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD):
        want = tiktoken_encoding.encode_ordinary(t or "")
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want and rows[i].n_tokens == len(want)
        assert bytes(rows[i].decoded) == (t or "").encode() and rows[i]["__drop"] == "clash"
    assert byte_bpe.encode_documents(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    digest = byte_bpe.digests(byte_bpe.encode_documents(docs.filter("doc_id = 1"), path, public_tokenizers.PATTERN)).first()
    assert digest.ids_sha256 == digest.decoded_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    read = token_count.read_pieces(path)
    return read, token_count.prove(*read), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁the")), max_size=80))
def test_counts_are_the_librarys(pieces, text):
    (table, by_bytes), whole, library = pieces
    assert token_count.PieceCounts(table, by_bytes, whole).count(text) == len(library.encode(text))


def test_token_counts_over_frames(spark, pieces):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in token_count.count_tokens(frame(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        n = len(pieces[2].encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert token_count.count_tokens(frame(spark, ODD).limit(0), path).count() == 0


def test_a_model_whose_pieces_cross_words_is_refused():
    with pytest.raises(ValueError, match="cross"):
        token_count.prove({"a b": -1.0}, True)


def test_a_model_that_is_counted_otherwise_is_refused(pieces):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(pieces[2].serialized_model_proto())
    assert token_count.unfit(proto) == []
    proto.trainer_spec.byte_fallback = False
    proto.normalizer_spec.precompiled_charsmap = b"x"
    proto.pieces[5].type = proto.pieces[5].USER_DEFINED
    assert len(token_count.unfit(proto)) == 3
    proto.trainer_spec.model_type = 1
    assert len(token_count.unfit(proto)) == 4


def plain_learn(examples, epochs):
    """FTRL-proximal one weight at a time, from dictionaries."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 0 else quality.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for x, label in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_are_the_plain_ones(spark):
    """Weights, and the whole way from rows to scores, against one-by-one updates over the same order."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["river", "mill", "$$$", "NOW", "7"], 12)) for _ in range(60)]
    examples = [(*quality.features(t), int(i % 3 > 0)) for i, t in enumerate(texts)]
    want = plain_learn([(dict(zip(at.tolist(), x.tolist(), strict=True)), y) for at, x, y in examples], 3)
    got = quality.learn(examples, 3)
    assert np.flatnonzero(got).tolist() == sorted(i for i, w in want.items() if w) and all(abs(got[i] - w) < 1e-9 for i, w in want.items())

    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    given = docs.filter(~quality.held_out(docs.doc_id)).select("doc_id", "text", F.xxhash64("doc_id", F.lit("place")).alias("place")).orderBy("place").collect()
    shards = [[r for r in given if r.place % quality.SHARDS == s] for s in range(quality.SHARDS)]
    fitted = [plain_learn([(dict(zip(*(v.tolist() for v in quality.features(r.text)), strict=True)), int(r.doc_id % 3 > 0)) for r in own], quality.EPOCHS) for own in shards if own]
    mean = {i: sum(f.get(i, 0.0) for f in fitted) / len(fitted) for i in {i for f in fitted for i in f}}
    for r in quality.score(docs, labels).collect():
        at, x = quality.features(r.text)
        assert abs(r.score - 1 / (1 + np.exp(-sum(mean.get(i, 0.0) * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))) < 1e-4


def test_classifier_learns_and_generalises(spark):
    good, junk = "The quiet river runs past the old mill number {}.", "The$$$ quiet%%% river### {}"
    texts = [(good if i % 3 else junk).format(i) for i in range(300)]
    docs = frame(spark, [*texts, None, ""], ids=[*range(300), 300, None])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 302 and all(0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, int(r.doc_id % 3 > 0)) for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_count(spark):
    import zlib

    docs = frame(spark, [f"text {i} of some words" for i in range(40)])
    mark = docs.select("doc_id", quality.held_out(docs.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in mark)
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id % 2), 0) for r in mark], "doc_id long, quality int, toxic int")
    changed = labels.withColumn("quality", (labels.quality + quality.held_out(labels.doc_id).cast("int")) % 2)
    assert (quality.train(docs, labels) == quality.train(docs, changed)).all()


def test_held_out_accuracy(spark, sf):
    out = quality.query(spark, sf.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    both = out.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in both) / len(both) > 0.93


def test_features_of_empty_texts_are_the_bias():
    for t in (None, "", " \n"):
        at, x = quality.features(t)
        assert at.tolist() == [0] and x.tolist() == [1.0]


def test_mix_weights(spark):
    sources = spark.createDataFrame([("big", 10, 9000), ("mid", 10, 900), ("few", 10, 100), ("none", 3, 0), (None, 1, 50)], "source string, docs long, tokens long")
    rows = {r.source: r for r in mixing.weights(sources, entropy=0.7, most_epochs=1e9).collect()}
    w = np.array([r.weight for r in rows.values() if r.weight > 0])
    assert abs(w.sum() - 1) < 1e-9
    assert abs(-(w * np.log(w)).sum() - 0.7 * np.log(4)) < 1e-6
    assert rows["none"].weight == 0 and rows["none"].epochs == 1 and rows["big"].epochs == 1
    limited = {r.source: r for r in mixing.weights(sources, entropy=0.99, most_epochs=3.0).collect()}
    assert abs(limited[None].epochs - 3.0) < 1e-6 and limited["big"].epochs == 1
    assert mixing.weights(sources.limit(0)).count() == 0


def plain_schedule(rows, entropy, most_epochs, block):
    """(doc_id, text, source) -> sorted (epoch, block, position) of each row, by one list a source."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:12], 16)
    named = lambda s: "null" if s is None else f"s:{s}"
    key = lambda r: f"{'n' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}|{named(r[2])}|{mixing.SEED}"
    sources = sorted({r[2] for r in rows}, key=named)
    tokens = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sources}
    p = np.array([tokens[s] / sum(tokens.values()) for s in sources if tokens[s]])

    def bisect(low_is_good, good):
        lo, hi = 0.0, 1.0
        for _ in range(mixing.HALVINGS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) == low_is_good else (lo, mid)
        return lo if low_is_good else hi

    def enough(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() >= entropy * np.log(len(p)) - 1e-13

    within = lambda a: (p.min() / p.max()) ** (a - 1) <= most_epochs
    alpha = 1.0 if len(p) < 2 or enough(1.0) else bisect(True, enough)
    alpha = alpha if len(p) < 2 or within(alpha) else bisect(False, within)
    out = {}
    for s in sources:
        share = tokens[s] / sum(tokens.values())
        epochs = max(1.0, (share / p.max()) ** (alpha - 1)) if share else 1.0
        budget = round(epochs * tokens[s])
        own = [r for r in rows if r[2] == s]
        blocks = -(-len(own) // block)
        size = lambda r: len((r[1] or "").split())
        at = {key(r): number("b|" + key(r)) % blocks for r in own}
        for epoch in range(max(1, int(np.ceil(epochs)))):
            place = epoch * tokens[s]
            for b in sorted(set(at.values()), key=lambda b: (number(f"{named(s)}|{b}|{epoch}|{mixing.SEED}"), b)):
                for k in sorted({k for k in at if at[k] == b}, key=lambda k: (number(f"{k}|{epoch}"), k)):
                    same = [r for r in own if key(r) == k]
                    if place < budget or not size(same[0]) and epoch < int(epochs):
                        for r in same:
                            out.setdefault(r, []).append((epoch, b, round(min(place / budget, 1.0) if budget else 0.0, 9)))
                    place += size(same[0]) * len(same)
    return {r: sorted(x) for r, x in out.items()}


def test_mix_is_the_plain_one_whatever_the_order_of_rows(spark):
    """Repeated ids with other texts, equal rows, null ids, sources and texts; long texts; two orders of rows."""
    rng = np.random.default_rng(2)
    rows = [(int(i % 90), "w " * int(1 + i % 7), ["hot", "hot", "hot", "s1", "s2"][i % 5]) for i in range(200)] + [(None, "w w", "hot"), (None, None, "s1"), (3, "", None), (4, "word " * 60_000, None)]
    rows += [rows[0]] * 3 + [(None, "w w", "hot")] * 4
    want = plain_schedule(rows, 0.98, 2.0, 16)
    for order in (rows, [rows[i] for i in rng.permutation(len(rows))]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        got = {}
        for r in mixing.schedule(docs, entropy=0.98, most_epochs=2.0, block=16).collect():
            got.setdefault((r.doc_id, r.text, r.source), []).append((r.epoch, r.block, round(r.position, 9)))
        assert {r: sorted(x) for r, x in got.items()} == {r: sorted(x) for r, x in want.items()}


def test_mixed_files_are_in_order(spark, tmp_path):
    docs = frame(spark, ["w " * (1 + i % 7) for i in range(400)], sources=["hot" if i % 4 else f"s{i % 3}" for i in range(400)])
    mixing.mixed(docs, 4).write.parquet(str(tmp_path / "mix"))
    order = [(r.position, r.source, r.doc_id) for r in mixing.schedule(docs).collect()]
    import glob

    got = [r.doc_id for f in sorted(glob.glob(str(tmp_path / "mix/part-*.parquet"))) for r in spark.read.parquet(f).collect()]
    assert got == [d for _, _, d in sorted(order)]
    placed = mixing.with_places(spark.read.parquet(str(tmp_path / "mix")))
    assert [r.doc_id for r in placed.orderBy("mix_part", "mix_row").collect()] == got
    assert mixing.with_places(docs.filter("doc_id = 1")).first().mix_part is None


def test_mixed_parts_of_several_files_are_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 5 + 1), "abc"[i % 3]) for i in range(200)], "doc_id long, text string, source string")
    mixing.mixed(docs, parts=2).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "cut"))
    mixing.mixed(docs, parts=2).write.parquet(str(tmp_path / "whole"))
    cut, whole = (mixing.with_places(spark.read.parquet(str(tmp_path / n))).orderBy("mix_part", "mix_row").collect() for n in ("cut", "whole"))
    assert [r.doc_id for r in cut] == [r.doc_id for r in whole] and len({(r.mix_part, r.mix_row) for r in cut}) == len(cut)


def test_exponent_of_many_sources_needs_no_list(spark):
    """As many sources as documents: the weights are those of plain bisection."""
    sources = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1).cast("long").alias("docs"), (F.col("id") * F.col("id") + 1).alias("tokens"))
    rows = mixing.weights(sources, entropy=0.98, most_epochs=1e18).collect()
    w = np.array([r.weight for r in rows])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 0.98 * np.log(3000)) < 1e-6


def test_mix_reads_budgets(spark):
    texts = ["w " * (1 + i % 7) for i in range(400)] + [None, ""]
    sources = ["hot" if i % 4 else f"s{i % 3}" for i in range(400)] + [None, "hot"]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.schedule(docs, entropy=0.98, most_epochs=2.0, block=16).collect()
    assert {r.doc_id for r in rows} == set(range(402))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for source, own in by.items():
        tokens = sum(len((t or "").split()) for t, s in zip(texts, sources, strict=True) if s == source)
        read = sum(r.n_tokens for r in own)
        if tokens:
            share = next(r.weight for r in own)
            hot = sum(r.n_tokens for r in by["hot"]), next(r.weight for r in by["hot"])
            assert abs(read - hot[0] * share / hot[1]) <= 8 + 0.02 * read
        assert all(0 <= r.position <= 1 for r in own)
        seen = [(r.doc_id, r.epoch) for r in own]
        assert len(seen) == len(set(seen))
    assert mixing.schedule(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert re.fullmatch(mixing.WORD, "abc")
