"""Substring dedup: aligned blocks as anchors, probed by every rolling window and extended to whole repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import aside, cut, light, restored, table
from tidewright.llm.runs import bounds, groups
from tidewright.llm.words import Words, mix, rolled, text_slices

#: Words of the shortest repeat.
WINDOW = 35
#: Bytes of text that a worker looks at together; what it has twice in them is settled there.
TOGETHER = 8_000_000
#: Hashes that meet in a bucket, on average, and the least number of buckets as a power of two.
BUCKET, LEAST_BITS = 1_000_000, 9


def _block(window: int) -> int:
    """Words of a block: each window holds a whole one of the blocks that its text is cut into."""
    return (window + 1) // 2


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of values, cut at the places `at`."""
    values = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _numbers(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _rows(bits: int, sure: bool, cuts: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]], seed: int = 0) -> pa.RecordBatch:
    """A row for each bucket with what falls into it. What is settled already is one row, dealt to any bucket."""
    bucket = np.full(1, seed % (1 << bits)) if sure else cuts
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([sure] * len(bucket)), *(_blobs(v, at) for v, at in columns.values())], ["bucket", "sure", *columns])


def _seed(keys: np.ndarray) -> int:
    """A number of a slice's texts together: slices with one hot passage have different ones."""
    return int(mix(np.array([keys.sum()]).view(np.uint64))[0])


def _spread(bucket: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bounds of each of the buckets `cuts` in sorted bucket numbers."""
    return np.append(np.searchsorted(bucket, cuts), len(bucket))


def _probes(window: int, bits: int):
    block = _block(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of every rolling block of the texts, once each, and the aligned blocks, by bucket; those found twice here are settled."""
        for batch in batches:
            for part in text_slices(batch["text"], TOGETHER):
                words, keys = Words(batch["text"][part]), batch["key"][part].to_numpy()
                at = words.starts(block)
                row = words.row[at]
                at, row = (x[words.counts[row] >= window] for x in (at, row))
                if not len(at):
                    continue
                h = rolled(words.hashes(), block)[at]
                order = np.argsort(h)
                h, at, row = h[order], at[order], row[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                alone = new & np.append(new[1:], True)
                no, rest = np.divmod(at - words.first[row], block)
                aligned = rest == 0
                known = np.unique(np.stack([keys[row[aligned & ~alone]], no[aligned & ~alone]]), axis=1)
                own = aligned & alone
                spread = (h >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.unique(spread)
                probe, found = _spread(spread[new], cuts), _spread(spread[own], cuts)
                low = h.astype(np.uint32)
                yield _rows(bits, False, cuts, {"probe": (low[new], probe), "low": (low[own], found), "key": (keys[row[own]], found), "no": (no[own].astype(np.int32), found)})
                if known.shape[1]:
                    none, all_of = np.zeros(2, np.int64), np.array([0, known.shape[1]])
                    yield _rows(bits, True, cuts, {"probe": (low[:0], none), "low": (low[:0], none), "key": (known[0], all_of), "no": (known[1].astype(np.int32), all_of)}, _seed(keys))

    return run


def _again(values: np.ndarray) -> np.ndarray:
    """The values that come more than once, sorted."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _within(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The aligned blocks of each bucket that some other part of the texts has too, aligned or not."""
    for t in groups(batches, ["bucket"]):
        ends, sure = bounds(t, ["bucket"]), t["sure"].to_numpy()
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            own = t.slice(begin, end - begin)
            key, no = _numbers(own["key"], "<i8"), _numbers(own["no"], "<i4")
            settled = np.repeat(sure[begin:end], [len(x) // 4 for x in own["no"].to_pylist()])
            hit = settled.copy()
            hit[~settled] = _within(_numbers(own["low"], "<u4"), _again(_numbers(own["probe"], "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(no[hit])], ["key", "no"])


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values in a row."""
    span = 1
    while 2 * span <= k:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (k - span)], x[k - span :])


def _windows(window: int, bits: int):
    block, gram = _block(window), max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the windows that hold a hit block, as runs of neighbours with the same least gram, which is their bucket."""
        for batch in batches:
            for part in text_slices(batch["text"], TOGETHER):
                words, keys, nos = Words(batch["text"][part]), batch["key"][part].to_numpy(), batch["nos"][part]
                row = np.repeat(np.arange(len(nos)), nos.value_lengths().to_numpy())
                at = words.first[row] + nos.flatten().to_numpy().astype(np.int64) * block
                fine = at < words.first[row + 1]
                at, row = at[fine], row[fine]
                size = len(words) + 1
                step = np.bincount(np.maximum(at - block + 1, words.first[row]), minlength=size) - np.bincount(at + 1, minlength=size)
                start = words.starts(window)
                start = start[np.cumsum(step)[start] > 0]
                if not len(start):
                    continue
                h = words.hashes()
                lead = _least(rolled(h, gram), window - gram + 1)[start]
                h, row = rolled(h, window)[start], words.row[start]
                order = np.argsort(h)
                same = h[order][1:] == h[order][:-1]
                twice, first = np.empty(len(h), bool), np.empty(len(h), bool)
                twice[order] = np.append(same, False) | np.concatenate([[False], same])
                first[order] = np.concatenate([[True], ~same])
                new = np.concatenate([[True], (np.diff(start) != 1) | (row[1:] != row[:-1]) | (lead[1:] != lead[:-1]) | (twice[1:] != twice[:-1])])
                begin = np.flatnonzero(new)
                length, settled = np.diff(np.append(begin, len(h))), twice[begin]
                run_key, run_start = keys[row[begin]], (start - words.first[row])[begin].astype(np.int32)
                spread = (mix(lead) >> np.uint64(64 - bits)).astype(np.int64)
                # runs that are alone here, in their buckets, with each window's hash; and what is known to be twice
                own = np.flatnonzero(~settled)
                own = own[np.argsort(spread[begin[own]], kind="stable")]
                upto = np.concatenate([[0], np.cumsum(length[own])])
                each = np.arange(upto[-1]) + np.repeat(begin[own] - upto[:-1], length[own])
                known = np.flatnonzero(twice & first)
                known = known[np.argsort(spread[known], kind="stable")]
                cuts = np.unique(np.concatenate([spread[begin[own]], spread[known]]))
                runs_at = _spread(spread[begin[own]], cuts)
                yield _rows(bits, False, cuts, {"known": (h[known], _spread(spread[known], cuts)), "key": (run_key[own], runs_at), "start": (run_start[own], runs_at), "len": (length[own].astype(np.int32), runs_at), "hash": (h[each], upto[runs_at])})
                if settled.any():
                    marks = np.unique(np.stack([run_key[settled], run_start[settled].astype(np.int64), length[settled], h[begin[settled]].view(np.int64)]), axis=1)
                    all_of = np.array([0, marks.shape[1]])
                    yield _rows(bits, True, cuts, {"known": (h[:0], np.zeros(2, np.int64)), "key": (marks[0], all_of), "start": (marks[1].astype(np.int32), all_of), "len": (marks[2].astype(np.int32), all_of), "hash": (marks[3], all_of)}, _seed(keys))

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that are found elsewhere too: key, number of the first window's first word, windows, and that window's hash."""
    for t in groups(batches, ["bucket"]):
        ends, sure = bounds(t, ["bucket"]), t["sure"].to_numpy()
        out = []
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            for settled in (True, False):
                own = t.slice(begin, end - begin).filter(pa.array(sure[begin:end] == settled))
                key, start, length, h = (_numbers(own[c], k) for c, k in (("key", "<i8"), ("start", "<i4"), ("len", "<i4"), ("hash", "<u8")))
                if settled:
                    out.append((key, start, length, h))
                    continue
                again = _within(h, _again(np.concatenate([h, _numbers(own["known"], "<u8")])))
                first = np.zeros(len(h) + 1, bool)
                first[np.concatenate([[0], np.cumsum(length)])] = True
                run, inner = np.repeat(np.arange(len(length)), length), np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
                a = np.flatnonzero(again & (first[:-1] | ~np.concatenate([[False], again[:-1]])))
                b = np.flatnonzero(again & (first[1:] | ~np.append(again[1:], False)))
                out.append((key[run[a]], (start[run[a]] + inner[a]).astype(np.int32), (b - a + 1).astype(np.int32), h[a]))
        key, start, length, h = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array(length), pa.array(h.view(np.int64))], ["key", "start", "len", "h"])


def _removed(window: int):
    @F.arrow_udf("text string, n_words long, n_removed long")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Texts without the words of their repeated windows."""
        for texts, marks in columns:
            parts = []
            for part in text_slices(texts):
                words, own = Words(texts[part]), marks[part]
                row = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy())
                begin, end, h = (own.flatten().field(c).to_numpy() for c in ("start", "end", "h"))
                begin, end = words.first[row] + begin, words.first[row] + end
                fine = end <= words.first[row + 1]
                begin, end, row, h = (x[fine] for x in (begin, end, row, h))
                if len(begin):  # a mark of another text of the same key has another hash
                    fine = rolled(words.hashes(), window)[begin].view(np.int64) == h
                    begin, end = begin[fine], end[fine]
                gone = np.cumsum(np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1))[: len(words)] > 0
                n = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                parts.append(pa.StructArray.from_arrays([words.joined(~gone), pa.array(words.counts), pa.array(n)], ["text", "n_words", "n_removed"]))
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64())], ["text", "n_words", "n_removed"])

    return run


def _dealt(rows: DataFrame, maps, schema: str, reduces, found: str) -> DataFrame:
    return rows.mapInArrow(maps, f"bucket int, sure boolean, {schema}").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduces, found)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, spans) of the texts of docs with words in repeated windows: key is xxhash64 of the text, spans an array of (start, end, h) in words.

    1. Each text is cut into blocks of (window + 1) / 2 words, so that every window holds a whole block. The hash of each
       block, and of every rolling window of that many words, goes to a bucket. A rolling hash is four bytes there, once for all the texts that a worker
       sees together. Blocks that come again are hits.
    2. In the texts with hits, the windows that hold a hit block are extended to and compared by 64-bit hashes (a bucket adds nine
       bits at least): those found again, anywhere, are repeats. A window's bucket is its least gram, so neighbours go as one run.
    3. Runs of neighbouring windows are merged into the maximal repeats of each text.

    What a worker finds twice in its own texts is settled there, so a passage of a third of all texts costs a bucket one entry for each
    worker's slice, and no pairs are made.
    """
    if window < 2:
        raise ValueError("window must be two words at least")
    rows = docs.select("text", F.xxhash64("text").alias("key")).filter("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(LEAST_BITS, int(np.ceil(np.log2(max(1, size / 6 / BUCKET))))))
    hits = cut(_dealt(rows, _probes(window, bits), "probe binary, low binary, key binary, no binary", _hits, "key long, no int").distinct())
    hits = cut(hits.groupBy("key").agg(F.collect_list("no").alias("nos")))
    near = rows.join(light(hits, 40 + 4 * F.size("nos")), "key").select("text", "key", "nos")
    marks = _dealt(near, _windows(window, bits), "known binary, key binary, start binary, len binary, hash binary", _repeats, "key long, start int, len int, h long").distinct()
    # neighbouring and overlapping runs of windows become one span of words
    w = W.partitionBy("key").orderBy("start", "end")
    spans = marks.select("key", "start", (F.col("start") + F.col("len") + (window - 1)).alias("end"), "h")
    apart = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(w))
    spans = spans.groupBy("key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("h", "start").alias("h"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end", "h")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text rewritten, plus n_words (before) and n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if some `window` consecutive words of its text that cover it also start
    anywhere else, in the same text or another; windows are judged on the input. The words left are joined by one blank.

    Every row counts as a text, with or without a doc_id; equal rows lose all their words if they have a window. Null and empty
    texts become '' with no words; so do texts of which all words go. Texts of fewer words than a window lose none. A very long
    text is split by a worker as a whole, some eighty bytes a word. Columns other than text pass through, whatever their names (n_words
    and n_removed are replaced). An empty table gives an empty one. Windows are compared by 64-bit hashes in at least 512
    buckets: among two billion windows under comparison some two different ones meet with probability 2e-4; a text's marks are
    found by a 64-bit key and one window's hash.
    """
    own, back = aside(docs, ("text",), ("n_words", "n_removed"))
    spans = cut(repeated_spans(own, window).withColumnRenamed("key", "__key"))
    joined = own.withColumn("__key", F.xxhash64("text")).join(light(spans, 40 + 48 * F.size("spans")), "__key", "left")
    made = joined.withColumn("__made", _removed(window)("text", "spans"))
    return restored(made.withColumns({c: F.col(f"__made.{c}") for c in ("text", "n_words", "n_removed")}), back, "n_words", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
g AS (SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS g FROM s),
again AS (SELECT r, i FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
each AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
judged AS (SELECT e.*, coalesce(max(CASE WHEN a.i IS NOT NULL THEN e.pos END) OVER (PARTITION BY e.r ORDER BY e.pos) >= e.pos - {WINDOW - 1}, false) AS gone
           FROM each e LEFT JOIN again a ON a.r = e.r AND a.i = e.pos),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
