"""What the operators of this subpackage share: tables cut from their lineage, connected components, text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space [\x20\x09-\x0D], upper and lower letters of every text contract.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SQL for SPACE and for a lower-cased column, for the DuckDB texts.
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Rows up to which a table of ids may be broadcast (some tens of MB); beyond, joins shuffle.
BROADCAST_ROWS = 300_000


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def sql_lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, own: tuple[str, ...], added: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with the columns that an operator doesn't know under names that can't clash with its own, and the way back.

    The way back leaves out columns whose names the operator adds.
    """
    names = [c if c in own else f"__extra_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), [(n, c) for n, c in zip(names, df.columns, strict=True) if c not in added]


def restored(df: DataFrame, back: list[tuple[str, str]], *added: str) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for n, c in back), *added)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one the session names; a temporary one only in local runs where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders that cut() wrote in this driver and that are still there.
_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: computed once, with known size, and safe if executors go."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by cut() which no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)
        _CUTS[:] = [x for x in _CUTS if x.rpartition("/")[2] != path.rpartition("/")[2]]


def clear_cuts(spark: SparkSession) -> None:
    """Remove every table that cut() wrote, once the results made from them are written: results read them until then."""
    while _CUTS:
        _remove(spark, _CUTS.pop())


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, which bound what a worker makes of them at once.

    Batches themselves are bounded by Spark, by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB
    unless the session says otherwise), so a run of very long texts comes in short batches.
    """
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def texts_of(column: pa.Array, rows: int = 1000) -> Iterator[str | None]:
    """The texts of a column, as Python's a slice at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


_HELD: list[dict] = []


def alone_in_worker(cache: dict) -> None:
    """Keep one operator's memory of words in a Python worker: what an earlier operator left there goes."""
    if _HELD and _HELD[0] is not cache:
        import ctypes
        import gc

        _HELD[0].clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)  # back to the system, for the worker's executor
    _HELD[:] = [cache]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast when it was counted and holds few enough rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes in memory up to which a table may be broadcast.
BROADCAST_BYTES = 32_000_000


def light(df: DataFrame, weight: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast when the weights of its rows (bytes each takes in memory) come to few enough; else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= most else df


def forest(linked: np.ndarray, across: int | None = None) -> np.ndarray:
    """Edges (rows of two numbers) that join what a symmetric matrix of links joins: at most a row less than nodes.

    With across, linked has the links of nodes 0..across-1 (rows) with the nodes from `across` on (columns).
    """
    n = len(linked) if across is None else sum(linked.shape)
    out, rest = [], np.ones(n, bool)
    for root in range(n if across is None else across):
        if not rest[root]:
            continue
        rest[root], front = False, [root]
        while front:
            x = front.pop()
            if across is None:
                hit = np.flatnonzero(linked[x] & rest)
            elif x < across:
                hit = across + np.flatnonzero(linked[x] & rest[across:])
            else:
                hit = np.flatnonzero(linked[:, x - across] & rest[:across])
            if len(hit):
                rest[hit] = False
                front.extend(hit.tolist())
                out.append(np.column_stack([np.full(len(hit), x), hit]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def tile_pairs(tile: str, tiles: str) -> Column:
    """Each tile meets every tile of its group, itself included: the pairs (i, j), i <= j, that a row goes to."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col(tiles) - 1), lambda u: F.struct(F.least(u, F.col(tile)).alias("i"), F.greatest(u, F.col(tile)).alias("j"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the least node reachable.

    Alternating large-star and small-star steps: each edge is moved towards the least neighbour until
    every component is a star around its least node. A step is one minimum per node (partial
    aggregation) and a join, in which nodes with very many edges are apart at every size: their least
    neighbours are broadcast, so that no task gets a hub's rows. The state is written to the shared folder after each
    round. Self loops and repeated edges are fine; an empty input gives an empty result. Nulls are dropped.
    """

    def with_least(both: DataFrame, rows: int) -> DataFrame:
        """(a, b, m): m is a's least neighbour. A hub has a 10,000th of all rows and 500 at least, so there are 20,000 hubs at most."""
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hub = F.col("n") >= max(500, rows // 10_000)
        if least.filter(hub).isEmpty():
            return both.join(least.drop("n"), "a")
        hubs = F.broadcast(least.filter(hub).select("a", "m"))
        return both.join(hubs, "a", "left_anti").join(least.filter(~hub).select("a", "m"), "a").union(both.join(hubs, "a"))

    def star(e: DataFrame, large: bool, rows: int) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            moved = with_least(both, rows).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        else:
            ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
            moved = with_least(e, rows).select(F.inline(ends))
        return moved.filter("a <> b").distinct()

    # every edge from the larger node to the smaller one
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        half = cut(star(now, True, seen[0]))
        after = cut(star(half, False, seen[0]))
        mark_after = mark(after)
        drop_cut(now)
        drop_cut(half)
        now = after
        if mark_after == seen:
            break
        seen = mark_after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
