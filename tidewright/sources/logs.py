"""Event logs as JSON lines: appended by streams with sequences that go on over restarts, read with faults apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.sources.evidence import MOST_DETAILS, log_lines

#: What a line of the log holds; a line that is none of it comes back whole in _corrupt_record.
LINE = {"writer": "string", "sequence": "long", "ts": "string", "details": "string", "metrics": "map<string,double>", "_corrupt_record": "string"}
#: Rows of a preview. Fixed value of the log contract, as is the bound of its details.
PREVIEW = 200


def _folders(spark: SparkSession, path: str) -> list[int]:
    """The batches that have their sequences written, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_sequences")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_sequences/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def append_batch(events: DataFrame, batch: int, path: str) -> None:
    """Append a batch of events (writer, ts, details, metrics, and what orders equal times: id, if there) as JSON lines.

    Sequences go on from those of the batches before it, which are kept as a table. Both are written under the batch's own
    name, over what a failed attempt left, so a batch that is tried again gives the same lines once.
    """
    spark = events.sparkSession
    earlier = [b for b in _folders(spark, path) if b < batch]
    known = spark.read.parquet(f"{path}/_sequences/batch={earlier[-1]}") if earlier else spark.createDataFrame([], "writer string, last long")
    events = events.withColumn("writer", F.col("writer").cast("string")).persist()
    before = known.select(F.col("writer").alias("__writer"), "last")
    lines = log_lines(events, before)
    lines.select("line").write.mode("overwrite").text(f"{path}/batch={batch}")
    counts = events.groupBy("writer").agg(F.count("*").alias("n"))
    last = counts.join(known, "writer", "full").select("writer", (F.coalesce("n", F.lit(0)) + F.coalesce("last", F.lit(0))).alias("last"))
    last.write.mode("overwrite").parquet(f"{path}/_sequences/batch={batch}")
    events.unpersist()


def append(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The log of a stream of events. The checkpoint keeps which batches are done over restarts."""
    return events.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log, typed; a line that isn't JSON, or not of these types, is null but for _corrupt_record."""
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in LINE.items())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("basePath", path).json(f"{path}/batch=*").select(*LINE)


def preview(log: DataFrame, rows: int = PREVIEW, most: int = MOST_DETAILS) -> DataFrame:
    """The first sound lines by sequence and writer, details cut to so many bytes with the rest counted."""
    whole = F.octet_length("details")
    cut = F.decode(F.substring(F.encode("details", "UTF-8"), 1, most), "UTF-8")
    first = log.filter("_corrupt_record is null").orderBy("sequence", "writer").limit(rows)
    return first.withColumns({"omitted_bytes": F.greatest(whole - most, F.lit(0)), "details": F.when(whole > most, cut).otherwise(F.col("details"))}).drop("_corrupt_record")
