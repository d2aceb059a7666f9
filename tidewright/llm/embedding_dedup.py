"""Embedding near-dedup: int8 tile products with error bounds, and full precision for the pairs in doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import aside, components, cut, forest, restored, slices, small, table, tile_pairs
from tidewright.llm.runs import bounds, groups

THRESHOLD = 0.98
#: Vectors in a tile; a task holds two tiles.
TILE = 1024
#: Rounding of a double-precision cosine, added to every bound.
SLACK = 1e-9


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes with a scale each, and the length e of each one's quantisation error.

    v = scale * code + r with |r| = e. For two vectors, |v.w - s*t*code.code| <= e_v * (|w| + e_w) + e_w * |v|
    by Cauchy-Schwarz, with |v| = |w| = 1 up to rounding: e_v + e_w + e_v * e_w.
    """
    scale = np.abs(v).max(axis=1, keepdims=True) / 127
    code = np.rint(v / scale).astype(np.int8)
    return code, scale[:, 0], np.linalg.norm(v - scale * code, axis=1)


def bounded(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of quantised vectors: which pairs surely reach the threshold, and which may (matrices of a's rows and b's).

    The int8 codes are multiplied as float32, which holds their products' sums exactly (under 2^24 up to 1040
    columns; wider vectors are summed in slices, in doubles).
    """
    (ca, sa, ea), (cb, sb, eb) = a, b
    near = np.zeros((len(ca), len(cb)), np.float64 if ca.shape[1] > 1040 else np.float32)
    for k in range(0, ca.shape[1], 1040):
        near += ca[:, k : k + 1040].astype(np.float32) @ cb[:, k : k + 1040].astype(np.float32).T
    cosine = near * sa[:, None] * sb[None, :]
    error = ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + SLACK
    sure = cosine - error >= threshold
    return sure, ~sure & (cosine + error >= threshold)


def exact(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the rows of x and y, pair by pair, have a cosine of at least the threshold: one division of full-precision sums."""
    length = lambda v: np.sqrt((v * v).sum(axis=1))
    return (x * y).sum(axis=1) / (length(x) * length(y)) >= threshold


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles with their codes, scale and error; without those that link with nothing by the contract."""
    for batch in batches:
        for part in slices(batch):
            ids, labels, v, code, scale, error = [], [], [], [], [], []
            for vec, label, e in zip(part["vec_id"].to_pylist(), part["label"].to_pylist(), part["embedding"].to_pylist(), strict=True):
                x = np.array([e], np.float64) if e and None not in e else None
                with np.errstate(over="ignore"):
                    fine = x is not None and np.isfinite(x).all() and 0 < (x * x).sum() < np.inf
                if fine:
                    c, s, r = quantise(unit(x))
                    for own, value in ((ids, vec), (labels, label), (v, x.tobytes()), (code, c.tobytes()), (scale, float(s[0])), (error, float(r[0]))):
                        own.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(v, pa.binary()), pa.array(code, pa.binary()), pa.array(scale, pa.float64()), pa.array(error, pa.float64())], ["vec_id", "label", "v", "code", "scale", "error"])


BY = ["label", "width", "i", "j"]


def _halves(t: pa.Table) -> Iterator[tuple[int, int, int]]:
    """First row, first row of the second tile (or the end, for a tile with itself) and end of each pair of tiles."""
    ends, tile = bounds(t, BY), t["tile"].to_numpy()
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        at = begin + int(np.searchsorted(tile[begin:end], tile[begin], "right"))
        if end - begin > 1 and (at < end or i[begin] == j[begin]):
            yield begin, at, end


def _told(a: list, b: list, n: list) -> pa.RecordBatch:
    flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
    return pa.RecordBatch.from_arrays([flat(a, pa.int64()), pa.concat_arrays([pa.array(x, pa.int64()) for x in b] or [pa.array([], pa.int64())]), flat(n, pa.int64())], ["a", "b", "n"])


def _kept_links(linked: np.ndarray, same: bool, ids: np.ndarray, copies: np.ndarray, na: int, out: tuple[list, list, list]) -> None:
    """Adds each vector's number of links (b null) and a spanning forest of the links (n 0) to out."""
    if same:
        counts, edges = linked @ copies, forest(linked)
    else:
        counts, edges = np.concatenate([linked @ copies[na:], copies[:na] @ linked]), forest(linked, na)
    hit = np.flatnonzero(counts)
    a, b, n = out
    a += [ids[hit], ids[edges[:, 0]]]
    b += [[None] * len(hit), ids[edges[:, 1]].tolist()]
    n += [counts[hit], np.zeros(len(edges), np.int64)]


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pair of tiles, from codes: the sure links, counted and as a forest, and the vectors with a pair in doubt (n -1)."""
        for t in groups(batches, BY):
            out = [], [], []
            node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
            for begin, at, end in _halves(t):
                code = np.frombuffer(b"".join(t["code"][begin:end].to_pylist()), np.int8).reshape(end - begin, -1)
                known = code, t["scale"][begin:end].to_numpy(), t["error"][begin:end].to_numpy()
                same, na = at == end, at - begin
                one, two = (known, known) if same else (tuple(x[:na] for x in known), tuple(x[na:] for x in known))
                sure, maybe = bounded(one, two, threshold)
                if same:
                    np.fill_diagonal(sure, False)
                    np.fill_diagonal(maybe, False)
                ids = node[begin:end]
                _kept_links(sure, same, ids, copies[begin:end], na, out)
                doubt = maybe.any(axis=1) if same else np.concatenate([maybe.any(axis=1), maybe.any(axis=0)])
                doubt = np.flatnonzero(doubt)
                pair = int(t["i"][begin].as_py()) << 32 | int(t["j"][begin].as_py())
                out[0].append(ids[doubt])
                out[1].append([pair] * len(doubt))
                out[2].append(np.full(len(doubt), -1))
            yield _told(*out)

    return run


def _doubted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the vectors in doubt of each pair of tiles: their pairs in doubt, by full precision."""
        for t in groups(batches, BY):
            out = [], [], []
            node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
            for begin, at, end in _halves(t):
                v = np.frombuffer(b"".join(t["v"][begin:end].to_pylist()), np.float64).reshape(end - begin, -1)
                known = quantise(unit(v))
                same, na = at == end, at - begin
                one, two = (known, known) if same else (tuple(x[:na] for x in known), tuple(x[na:] for x in known))
                _, maybe = bounded(one, two, threshold)
                i, j = np.nonzero(np.triu(maybe, 1) if same else maybe)
                linked = np.zeros_like(maybe)
                for k in range(0, len(i), 65536):
                    a, b = i[k : k + 65536], j[k : k + 65536]
                    linked[a, b] = exact(v[a], v[b + (0 if same else na)], threshold)
                _kept_links(linked | linked.T if same else linked, same, node[begin:end], copies[begin:end], na, out)
            yield _told(*out)

    return run


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label), and its other columns.

    Each vector is quantised once. Equal vectors of a label become one class, so a hot vector costs a row. Classes of one
    label are dealt to tiles of about TILE by hash, and every pair of a label's tiles is one
    unit of work over codes, scales and errors: int8 products bound each cosine from both sides, and decide all pairs but
    those whose bounds hold the threshold between them. Only the vectors of such pairs are sent again, as doubles, to
    the pairs of tiles where they are in doubt, and compared in full precision. A unit returns a count for each vector and
    a spanning forest of its links, never the pairs. The work is quadratic in a label's different vectors, as the
    comparison asked for is; it is spread over the pairs of tiles, so a hot label is as many units as it needs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
    vec_id, link with nothing; so do vectors of different lengths. Rows without a vec_id have a null
    component and are kept. Rows sharing a vec_id are separate vectors which share a component, and each
    reports the links of all. Other columns pass through, but for those with the names of the results. A very long
    vector is a row like another: a unit holds two tiles of codes. An empty table gives an empty one. Ids are longs and labels whole
    numbers; texts that are no numbers are an error under Spark's ANSI rules.
    """
    own, back = aside(vectors, ("vec_id", "embedding", "label"), ("n_links", "component_id", "kept"))
    rows = own.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    usable = rows.mapInArrow(_packed, "vec_id long, label long, v binary, code binary, scale double, error double")
    key = {"h": F.xxhash64("label", "v"), "g": F.xxhash64(F.lit(1), "v", "label")}
    usable = cut(usable.withColumns(key))
    first = lambda c: F.first(c).alias(c)
    classes = usable.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *map(first, ("label", "v", "code", "scale", "error")))
    # numbered as they are written: a vec_id of several vectors may be the least of two classes
    classes = cut(classes.withColumns({"width": F.octet_length("v"), "node": F.monotonically_increasing_id()}))
    tiles = small(classes.groupBy("label", "width").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    told = classes.join(tiles, ["label", "width"]).withColumn("tile", F.pmod(F.col("g"), F.col("tiles")).cast("int"))
    light = told.select("label", "width", tile_pairs("tile", "tiles").alias("p"), "tile", "node", "copies", "code", "scale", "error")
    units = light.select("label", "width", "p.i", "p.j", "tile", "node", "copies", "code", "scale", "error")
    sure = cut(units.repartition(*BY).sortWithinPartitions(*BY, "tile").mapInArrow(_compared(threshold), "a long, b long, n long"))
    doubt = sure.filter("n = -1").select(F.col("a").alias("node"), F.shiftright("b", 32).cast("int").alias("i"), F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("j"))
    again = told.select("label", "width", "tile", "node", "copies", "v").join(doubt, "node").select("label", "width", "i", "j", "tile", "node", "copies", "v")
    found = again.repartition(*BY).sortWithinPartitions(*BY, "tile").mapInArrow(_doubted(threshold), "a long, b long, n long")
    found = cut(sure.filter("n >= 0").union(found))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reps = classes.select("h", "g", "node", "rep", "copies").join(counts, "node", "left")
    each = usable.select("vec_id", "h", "g").join(reps, ["h", "g"])
    # links between classes as links between their least ids, and those of an id with several vectors
    named = classes.select("node", "rep")
    edges = found.filter("b is not null").select("a", "b")
    edges = edges.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = each.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("vec_id", "lo")
    edges = edges.union(each.select("vec_id", "rep").join(several, "vec_id").select("lo", "rep"))
    joined = components(edges)
    each = each.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min("rep").alias("rep"))
    each = each.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("vec_id").alias("__vec"), "n_links", F.coalesce("component", "rep").alias("component_id"))
    out = own.join(small(cut(each)), F.col("vec_id") == F.col("__vec"), "left")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "vec_id")})
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return restored(out, back, "n_links", "component_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
SQL = f"""
WITH RECURSIVE vec AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE {_COS} >= {THRESHOLD}::DOUBLE),
reach AS (SELECT vec_id AS node, vec_id AS least FROM embeddings UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.node AND r.least < l.b),
found AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN found ON e.vec_id = node LEFT JOIN links ON e.vec_id = a
"""
