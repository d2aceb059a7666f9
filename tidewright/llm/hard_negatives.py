"""Hard-negative mining: radix selection in windows of integer scores, over blocks of anchors and tiles of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import cut, small, table

#: An anchor's positives, a positive's negatives, and the window of negative scores in hundredths of the positive one.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Every so many ids are anchors; components are multiplied by SCALE and floored.
EVERY, SCALE = 100, 256
#: Rows of a tile and anchors of a block, on average; a task scores a few anchors of a block against a tile at a time.
TILE, BLOCK, TOGETHER = 2048, 1024, 128
#: Bits of a digit, and the rows up to which a window's part is gathered without another digit.
DIGIT, FEW = 8, 64
#: Longer rows are scored in whole numbers of any size, apart from the others, whose products are exact in doubles.
WIDE = 2.0**26
#: Scores are kept within these bounds.
MOST = 2**61


def _coded(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The floors of scaled components, packed, of the rows that take part."""
        for batch in batches:
            vectors, keep, codes, wide, norms = batch["embedding"], [], [], [], []
            size = vectors.value_lengths().fill_null(0).to_numpy()
            upto = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls become NaN
                for k in np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    if np.isfinite(own := x[upto[k] : upto[k + 1]]).all():
                        norms.append(float(np.linalg.norm(own)))
                        wide.append(not norms[-1] < WIDE)
                        codes.append(own.astype("<f8" if wide[-1] else "<i4").tobytes())
                        keep.append(k)
            keep = np.array(keep, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(keep)) for c in ("vec_id", "label")), pa.array(codes, pa.binary()), pa.array(size[keep], pa.int32()), pa.array(wide, pa.bool_()), pa.array(norms, pa.float64())], ["vec_id", "label", "code", "width", "wide", "norm"])

    return run


def _unpacked(codes: pa.Array, width: int, wide: bool) -> np.ndarray:
    flat = np.frombuffer(b"".join(codes.to_pylist()), "<f8" if wide else "<i4").reshape(len(codes), width)
    return np.array([[int(x) for x in row] for row in flat.tolist()], object).reshape(flat.shape) if wide else flat


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as longs; those beyond MOST are kept there."""
    if object in (a.dtype, b.dtype):
        return np.array([[max(-MOST, min(MOST, sum(map(int.__mul__, x, y)))) for y in b.tolist()] for x in a.tolist()], np.int64).reshape(len(a), len(b))
    length = lambda v: float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    # every partial sum is a whole number of at most the lengths' product
    kind = np.float32 if length(a) * length(b) < 2**23 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window of each unit: its anchor's row, the window, and rows' places below its upper bound, ids and rows, of those that may count."""
    for batch in batches:
        for k in range(batch.num_rows):
            width, tile, block = batch["width"][k].as_py(), batch["members"][k].values, batch["anchors"][k].values
            rows, ids, labels = (tile.field(c).to_numpy() for c in ("row", "vec_id", "label"))
            other = _unpacked(tile.field("code"), width, batch["wide"][k].as_py())
            own, anchors = _unpacked(block.field("code"), width, batch["anchor_wide"][k].as_py()), block.field("row").to_numpy()
            label, windows = block.field("label").to_numpy(), block.field("windows")
            for begin in range(0, len(own), TOGETHER):
                s = scores(own[begin : begin + TOGETHER], other)
                for i in range(len(s)):
                    a = begin + i
                    alike = labels == label[a]
                    use = {True: np.flatnonzero(alike & (rows != anchors[a])), False: np.flatnonzero(~alike)}
                    for window in windows[a].as_py():
                        at = use[window["same"]]
                        yield int(anchors[a]), window, window["hi"] - s[i, at], ids[at], rows[at]


def _shift(size: int) -> int:
    """Bits below the first digit of numbers up to size."""
    return max(0, int(size).bit_length() - DIGIT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of the next digit in each window, up to the digit with which a unit alone has what is needed."""
    out: list[tuple] = []

    def flushed():
        anchor, pick, digit, n = zip(*out, strict=True) if out else ((),) * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(pick, pa.int32()), pa.array(digit, pa.int32()), pa.array(n, pa.int64())], ["anchor", "pick", "digit", "n"])

    for anchor, w, below, ids, _ in _units(batches):
        if w["tied"]:
            at = ids[(below == w["a"]) & (ids >= w["c"]) & (ids <= w["d"])]
            digit = (at.astype(np.uint64) - np.uint64(w["c"] % 2**64)) >> np.uint64(_shift(w["d"] - w["c"]))
        else:
            digit = (below[(below >= w["a"]) & (below <= w["b"])] - w["a"]) >> _shift(w["b"] - w["a"])
        if len(digit):
            n = np.bincount(digit.astype(np.int64))
            n = n[: int(np.searchsorted(np.cumsum(n), w["need"])) + 1]
            out += [(anchor, w["pick"], d, int(n[d])) for d in np.flatnonzero(n).tolist()]
        if len(out) > 50_000:
            yield flushed()
    yield flushed()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each window up to the place that was found, and of a unit the first ones alone."""
    out: list[tuple] = []

    def flushed():
        names = ["anchor", "pick", "score", "vec_id", "row"]
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 5)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "pick" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    for anchor, w, below, ids, rows in _units(batches):
        fits = (below >= 0) & ((below < w["a"]) | (below == w["a"]) & (ids <= w["d"]) if w["tied"] else below <= w["b"])
        at = np.flatnonzero(fits)
        at = at[np.lexsort([rows[at], ids[at], below[at]])[: w["k"]]]
        if len(at):
            out.append((np.full(len(at), anchor), np.full(len(at), w["pick"]), w["hi"] - below[at], ids[at], rows[at]))
        if len(out) > 5_000:
            yield flushed()
    yield flushed()


WINDOW = ["pick", "same", "k", "hi", "a", "b", "tied", "c", "d", "need"]


class Rows:
    """The rows that take part, in tiles; and the first ones of each of many windows of scores."""

    def __init__(self, vectors: DataFrame, scale: float):
        rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
        coded = rows.mapInArrow(_coded(scale), "vec_id long, label long, code binary, width int, wide boolean, norm double")
        self.rows = cut(coded.withColumn("row", F.monotonically_increasing_id()))
        self.longest, self.least_id, self.most_id = self.rows.agg(F.max("norm"), F.min("vec_id"), F.max("vec_id")).first()
        self.kinds = small(cut(self.rows.groupBy("width", "wide").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))))
        dealt = self.rows.join(self.kinds, ["width", "wide"]).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")))
        self.tiles = cut(dealt.groupBy("width", "wide", "tile").agg(F.collect_list(F.struct("row", "vec_id", "label", "code")).alias("members")))

    def _met(self, windows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
        """Each block of anchors, with their windows, beside each tile of rows of their width."""
        own = windows.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct(*WINDOW)).alias("windows")).join(anchors, "row")
        packed = own.groupBy("width", F.col("wide").alias("anchor_wide"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "label", "code", "windows")).alias("anchors"))
        sent = packed.join(self.kinds, "width").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return sent.select("width", "wide", "tile", "anchor_wide", "anchors").join(self.tiles, ["width", "wide", "tile"])

    def first(self, windows: DataFrame, anchors: DataFrame) -> DataFrame:
        """(anchor, pick, rank, score, vec_id, row) of the first k rows in each of the windows (anchor, pick, same, k, lo, hi).

        Rows come by falling score, then by rising vec_id. A row's place below hi is cut into digits: units of a block and a tile count the
        first digit in each window, the counts are summed, and the digit that holds the kth row is cut again until the rows up to its end are
        FEW. Rows of one score are cut by the digits of their ids. Then only those rows are gathered.
        """
        count = anchors.count()
        blocks = max(1, -(-count // BLOCK))
        start = {"a": F.lit(0).cast("long"), "b": F.col("hi") - F.col("lo"), "tied": F.lit(False), "c": F.lit(self.least_id).cast("long"), "d": F.lit(self.most_id).cast("long"), "need": F.col("k").cast("long")}
        left = cut(windows.withColumns(start).select("anchor", *WINDOW))
        done: list[DataFrame] = []
        while not left.isEmpty():
            counts = self._met(left, anchors, blocks).mapInArrow(_counted, "anchor long, pick int, digit int, n long")
            after = cut(self._refined(left, counts))
            done.append(after.filter("done"))
            left = after.filter("not done")
        found = done[0] if done else left.withColumn("done", F.lit(True))
        for more in done[1:]:
            found = found.union(more)
        rows = self._met(found, anchors, blocks).mapInArrow(_gathered, "anchor long, pick int, score long, vec_id long, row long")
        rank = F.row_number().over(W.partitionBy("anchor", "pick").orderBy(F.desc("score"), "vec_id", "row"))
        limits = found.select("anchor", "pick", "k")
        return rows.withColumn("rank", rank).join(limits, ["anchor", "pick"]).filter("rank <= k").drop("k")

    @staticmethod
    def _refined(left: DataFrame, counts: DataFrame) -> DataFrame:
        """The windows with rows, after a digit: the part of the kth row, what is needed of it, and whether the rows up to its end are few enough."""
        summed = counts.groupBy("anchor", "pick", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("anchor", "pick").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        told = summed.withColumn("before", upto - F.col("n")).join(left, ["anchor", "pick"]).filter("before < need")
        state = [c for c in WINDOW if c != "pick"]
        kth = told.groupBy("anchor", "pick").agg(F.max_by(F.struct("digit", "n", "before"), "digit").alias("x"), *(F.first(c).alias(c) for c in state))
        whole = lambda c: c.cast("decimal(38,0)")  # noqa: E731  differences of longs can pass the greatest long
        low, top = (F.when(F.col("tied"), F.col(x)).otherwise(F.col(y)) for x, y in (("c", "a"), ("d", "b")))
        size = whole(top) - whole(low)
        bits = F.when(size >= 1 << DIGIT, F.length(F.conv(size.cast("string"), 10, 2)) - DIGIT).otherwise(0)  # below the digit
        kth = kth.withColumn("bits", bits.cast("int")).withColumn("span", F.expr("shiftleft(1L, bits)"))
        kth = kth.withColumn("low", (whole(low) + whole(F.col("x.digit")) * whole(F.col("span"))).cast("long"))
        kth = kth.withColumn("top", F.least(whole(top), whole(F.col("low")) + whole(F.col("span")) - 1).cast("long")).withColumn("need", F.col("need") - F.col("x.before"))
        few = F.col("k") - F.col("need") + F.col("x.n") <= FEW
        tie = ~F.col("tied") & (F.col("low") == F.col("top"))
        out = kth.withColumn("done", few | F.col("tied") & (F.col("low") == F.col("top")))
        out = out.withColumns({
            "a": F.when(F.col("tied"), F.col("a")).otherwise(F.col("low")),
            "b": F.when(F.col("tied"), F.col("b")).otherwise(F.col("top")),
            "c": F.when(F.col("tied"), F.col("low")).otherwise(F.col("c")),
            "d": F.when(F.col("tied"), F.col("top")).otherwise(F.col("d")),
            "tied": F.col("tied") | tie & ~F.col("done"),
        })
        return out.select("anchor", *WINDOW, "done")


def _hundredths(score: str, percent: int, up: bool) -> Column:
    """percent * score / 100 of scores of 0 and more, rounded down or up, without passing the greatest long."""
    return F.expr(f"({score} div 100) * {percent} + ({score} % 100 * {percent} + {99 if up else 0}) div 100")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for vectors (vec_id, embedding, label).

    Components are multiplied by scale and floored; a row's score is its inner product with the anchor. Anchors are the rows whose vec_id is divisible by
    `every`; an anchor's positives are its first `positives` other rows of the same label. For each positive, the first `negatives` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score are returned; higher scores come first, then smaller ids.

    Anchors in blocks meet all rows in tiles, so a unit of work is a block and a tile, and only counts, then the few first rows, leave it: see
    Rows.first, which finds positives and negatives alike. A hot label or a third of all rows equal is as many tiles as it needs; their ties are
    cut by id. The work is anchors times rows, as the search asked for is.

    Rows with a null vec_id, label or vector, or a null or non-finite component (before or after scaling), take no part. Rows score with those of their length
    alone; empty vectors score 0. Rows that share a vec_id are rows of their own, as anchors too; an anchor without positives, and a positive with no row in
    its window or with a negative score, gives none. Scores beyond 2^61 count as 2^61. An empty table gives an empty one. Other columns aren't read.
    """
    rows = Rows(vectors, scale)
    if rows.longest is None:
        return rows.rows.select(*(F.lit(None).cast("int" if c == "rank" else "long").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    anchors = rows.rows.filter(F.col("vec_id") % every == 0)
    reach = F.ceil(F.least(F.col("norm") * rows.longest * (1 + 1e-9) + 1, F.lit(float(MOST)))).cast("long")
    whole = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("pick"), F.lit(True).alias("same"), F.lit(positives).alias("k"), (-reach).alias("lo"), reach.alias("hi"))
    own = anchors.select("row", "label", "code", "width", "wide")
    near = cut(rows.first(whole, own).select("anchor", F.col("rank").alias("pick"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.filter("positive_score >= 0").select("anchor", "pick", F.lit(False).alias("same"), F.lit(negatives).alias("k"), _hundredths("positive_score", low, True).alias("lo"), _hundredths("positive_score", high, False).alias("hi")).filter("lo <= hi")
    found = rows.first(windows, own).select("anchor", "pick", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(near, ["anchor", "pick"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS c
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_dot_product(a.c, v.c)::BIGINT AS s FROM v a JOIN v ON a.r <> v.r AND len(a.c) = len(v.c) WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) AS pick FROM s WHERE same QUALIFY pick <= {POSITIVES}),
n AS (SELECT s.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.pick ORDER BY s.s DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.s AS positive_score, s.s AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE {LOW} * p.s <= 100 * s.s AND 100 * s.s <= {HIGH} * p.s)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
