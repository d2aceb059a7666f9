"""Periodic runs of words: a harmonic grid of longest common extensions over suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import aside, restored, table
from tidewright.llm.words import Words, mix, rolled, text_slices

#: Words of the shortest run.
LEAST = 12
#: Points of the grid that are looked at together.
POINTS = 1_000_000


class Extensions:
    """Longest common extensions of a sequence's suffixes: a suffix array by doubling, neighbours' common prefixes, range minima.

    The last symbol must occur once. Some four bytes a symbol and doubling are held.
    """

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        at = np.arange(n)
        new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        rank = np.empty(n, np.int64)  # the first place of those that are equal so far
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        levels, k = [rank.astype(np.int32)], 1
        active = order[~new | np.append(~new[1:], False)]
        while len(active):  # places whose next k symbols aren't theirs alone; by these, k further ones are in the sequence
            key = rank[active] * n + rank[active + k]
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            own, at = rank[active], np.arange(len(active))
            begins = np.concatenate([[True], own[1:] != own[:-1]])
            place = own + at - np.maximum.accumulate(np.where(begins, at, 0))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[active] = place[np.maximum.accumulate(np.where(new, at, 0))]
            order[place] = active
            levels.append(rank.astype(np.int32))
            active = active[~new | np.append(~new[1:], False)]
            k *= 2
        a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
        for t in range(len(levels) - 2, -1, -1):
            common += (levels[t][a + common] == levels[t][b + common]) * np.int64(1 << t)
        self.rank = levels[-1]
        del levels
        least = [common.astype(np.int32)]
        while 2 << (len(least) - 1) <= n - 1:
            half = 1 << (len(least) - 1)
            least.append(np.concatenate([np.minimum(least[-1][:-half], least[-1][half:]), least[-1][-half:]]))
        self.least = np.array(least)
        self.log = np.zeros(n + 1, np.int8)
        for t in range(1, 63):
            if 1 << t > n:
                break
            self.log[1 << t :] = t

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at x and y (never the same) have in common."""
        i, j = self.rank[x], self.rank[y]
        low, high = np.minimum(i, j), np.maximum(i, j)
        k = self.log[high - low]
        return np.minimum(self.least[k, low], self.least[k, high - (1 << k.astype(np.int64))]).astype(np.int64)


def repeated_stretches(h: np.ndarray, words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words, as begin and end, that hold every run of at least so many words.

    A run of n words and period q <= n / 2 agrees with itself q words on over n - q >= least / 2 words. So each of its
    words is in a gram of that length that its row has twice; what such grams cover is cut at its rows' bounds.
    """
    gram = max(1, (least + 1) // 2)
    at = words.starts(gram)
    key = mix(rolled(h, gram)[at] + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.append(same, False) | np.concatenate([[False], same])]] if len(at) else at
    step = np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + gram, minlength=len(h) + 1)
    inside = np.cumsum(step)[: len(h)] > 0
    edge = np.zeros(len(h) + 1, bool)
    edge[words.first] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = end - begin >= least
    return begin[long], end[long]


def runs_of(h: np.ndarray, words: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the runs in the words of rows, as word numbers of the column, by begin and period.

    For each period p and each j, the words at jp and (j + 1)p of a stretch are extended forwards and backwards as
    long as they agree, by suffix arrays of the stretches and of their reverse; a run of period p holds such a pair of
    equal words, as at least p of its places have their word again p later. Extensions that together reach p make the
    stretch from the backward end to the forward end a run, the same for each j in it. Multiples of a run's smallest
    period give its bounds again, and the smallest one is kept.
    """
    begin, end = repeated_stretches(h, words, least)
    if not len(begin):
        return (np.empty(0, np.int64),) * 3
    size = end - begin
    offset = np.cumsum(size + 1) - size  # a symbol of its own stands before each stretch and after the last
    total = int(size.sum()) + len(size) + 1
    source = np.repeat(begin - offset, size) + (at := np.delete(np.arange(total), np.append(offset - 1, total - 1)))
    s = np.empty(total, np.int64)
    stretch = np.repeat(np.arange(len(size)), size)
    _, s[at] = np.unique(mix(h[source] + stretch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    s[np.append(offset - 1, total - 1)] = total + np.arange(len(size) + 1)
    forward, backward = Extensions(s), Extensions(s[::-1])
    of = np.repeat(np.arange(len(size)), size // 2)
    period = np.arange(len(of)) - np.repeat(np.cumsum(size // 2) - size // 2, size // 2) + 1
    points = (size[of] - 1) // period
    upto, found, k = np.concatenate([[0], np.cumsum(points)]), [], 0
    while k < len(of):
        stop = max(k + 1, int(np.searchsorted(upto, upto[k] + POINTS, "right")) - 1)
        p = np.repeat(period[k:stop], points[k:stop])
        j = np.arange(len(p)) - np.repeat(upto[k:stop] - upto[k], points[k:stop])
        x = np.repeat(offset[of[k:stop]], points[k:stop]) + j * p
        equal = s[x] == s[x + p]
        x, p = x[equal], p[equal]
        ahead, behind = forward.common(x, x + p), backward.common(total - x, total - x - p)
        run = (ahead + behind >= p) & (p + ahead + behind >= least)
        found.append(np.unique(np.stack([(x - behind)[run], (x + p + ahead)[run], p[run]]), axis=1))
        k = stop
    a, b, p = np.concatenate(found, axis=1)
    by = np.lexsort([p, b, a])
    a, b, p = a[by], b[by], p[by]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    a, b, p = a[first], b[first], p[first]
    by = np.lexsort([p, a])
    shift = (begin - offset)[np.searchsorted(offset, a[by], "right") - 1] if len(a) else a
    return a[by] + shift, b[by] + shift, p[by]


def _collapsed(least: int):
    @F.arrow_udf("text string, runs array<struct<start: long, length: long, period: long>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for part in text_slices(column):
                words = Words(column[part])
                a, b, p = runs_of(words.hashes(), words, least)
                step = np.bincount(a + p, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1)
                text = words.joined(np.cumsum(step)[: len(words)] == 0)
                row = np.searchsorted(words.first, a, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (a - words.first[row], b - a, p)], ["start", "length", "period"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))])
                parts.append(pa.StructArray.from_arrays([text, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["text", "runs"]))
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))], ["text", "runs"])

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with text collapsed, and runs: an array of (start, length, period) in words, by start, then period.

    A run is a stretch of consecutive words of smallest period q and of at least `least` and 2 q words that no word on
    either side extends with that period. Of each run the first q words stay; a word goes if any run has it after
    those. The words left are joined by one blank.

    Each row is worked by itself, whole, in one pass without a shuffle. Null and empty texts become '' without runs;
    repeated rows repeat their result, an empty table stays empty, other columns pass through (a column named
    runs is replaced). A very long text takes n log n numbers a stretch of its repeated words. Words are compared by 64-bit hashes: two of a
    text's million different words meet with probability 3e-8.
    """
    own, back = aside(docs, ("text",), ("runs",))
    # not evaluated again for each field that is taken of it
    made = own.withColumn("__made", _collapsed(least)("text"))
    return restored(made.withColumns({"text": F.col("__made.text"), "runs": F.col("__made.runs")}), back, "runs")


def planted(docs: DataFrame) -> DataFrame:
    """The query's texts: where crc32 of doc_id is divisible by 10, the words from a certain one on repeat with a certain period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumns({"h": h, "w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))})
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("w").cast("long")
    placed = chosen.withColumns({"n": n, "a": F.pmod(g, F.nullif(n, F.lit(0))), "parts": 3 + F.pmod(g, F.lit(8))})
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("parts"))).cast("long"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    rewritten = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", source(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
