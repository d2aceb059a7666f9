"""The pipeline against a plain version of each of its stages."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_groups import plain_groups
from tests.llm.test_text_operators import plain_schedule
from tidewright.llm import byte_bpe, line_dedup, mixing
from tidewright.llm.common import SPACE, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    good = corpus_pipeline.good(spark, docs, sf)
    assert good.columns == docs.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    assert 0.5 * docs.count() < len(texts) < docs.count()

    lined = corpus_pipeline.without_common_lines(spark, good, sf)
    key = lambda line: line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    seen = collections.Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    want = {d: "\n".join(x for x in t.split("\n") if seen[key(x)] < line_dedup.MIN_DOCS) for d, t in texts.items()}
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in lined.collect()} == want

    single = corpus_pipeline.one_of_each_group(spark, lined, sf)
    kept = {d for d, (_, c) in plain_groups(want, 5).items() if d == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == kept

    rows = [tuple(r) for r in single.select("doc_id", "text", "source").collect()]
    reads = plain_schedule(rows, mixing.ENTROPY, mixing.MOST_EPOCHS, mixing.BLOCK)
    mix = corpus_pipeline.mixed(spark, single, sf)
    assert mix.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mix.collect()) == {r[0]: len(x) for r, x in reads.items()}

    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {d: enc.encode_ordinary(want[d]) for d in kept}

    # the whole run: the same stages, the mix's order and the ids at its end
    made = corpus_pipeline.run(spark, sf).orderBy("mix_part", "mix_row").collect()
    position = {r[0]: [p for *_, p in x] for r, x in reads.items()}
    assert collections.Counter(r.doc_id for r in made) == {d: len(x) for d, x in position.items()}
    for r in made:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id] and r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    places = [(p, source, d) for d, _, source in rows for p in position[d]]
    assert [r.doc_id for r in made] == [d for *_, d in sorted(places)]


def test_stages_are_named():
    assert corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"
