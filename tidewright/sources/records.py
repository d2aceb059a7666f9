"""Record files in and out: typed CSV scans with the contract's null tokens, and tables for later stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewright.functions.records import null_tokens, number
from tidewright.plans.base import once

TEXT = "job_id job_title job_category experience_level education_required city country remote_work company_size industry required_skills salary_tier".split()
DOUBLE = "years_of_experience annual_salary_usd salary_min_usd salary_max_usd ai_salary_premium_pct demand_score demand_growth_yoy_pct benefits_score_10".split()
INTEGER = ["posting_year", "posting_month"]
FLAG = ["is_senior", "is_remote_friendly", "is_llm_role"]
#: Other names of columns.
ALIASES = {"AI Engineering": "job_category"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The contract's columns of a CSV with a header, typed; columns that aren't the contract's are left out.

    Everything is read as text once, so that the tokens for a missing value become null before a type is
    asked for; a number that can't be read is null. A missing column is an error.
    """
    raw = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')
    raw = raw.withColumnsRenamed({a: c for a, c in ALIASES.items() if c not in raw.columns})
    if missing := [c for c in [*TEXT, *DOUBLE, *INTEGER, *FLAG] if c not in raw.columns]:
        raise ValueError(f"columns missing from the records: {missing}")
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    """The contract's columns of texts, typed."""
    own = lambda c: null_tokens(F.col(c))
    values = {c: own(c) for c in TEXT} | {c: number(own(c)) for c in DOUBLE} | {c: number(own(c)).cast("int") for c in INTEGER}
    flags = {c: F.lower(own(c)).isin("true", "1", "1.0", "yes") for c in FLAG}
    return raw.select(*(v.alias(c) for c, v in (values | flags).items()))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1 on, in each file) and value of text files, from their rows written once.

    A block's lines are read one after the other by one task, so their ids follow on from its first; they are moved by the lines of the blocks before it. Only
    blocks are counted and sorted, a row a block.
    """
    own = once(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    blocks = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (before - F.col("first")).alias("__moved"))
    out = own.join(F.broadcast(blocks), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))  # a row a block
    return out.select("file", (F.col("__moved") + F.col("at") + 1).alias("line"), "value")


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sound records of a CSV with a header, typed; and a message (file, line, reason, start of the text) for each line that is none. Both are from one scan.

    A record is one line: a quoted line feed opens a quote that its line doesn't close. Reasons: an open quote, fewer or more values than the
    header, and numbers that can't be read, which name their column. Every file has its own header, with the contract's columns in any order.
    """
    lines = _lines(spark, path)
    headers = lines.filter("line = 1").select(F.col("value")).distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the files have different headers" if headers else "no header")
    names = [ALIASES.get(c.strip('"'), c.strip('"')) for c in headers[0][0].split(",")]
    if missing := [c for c in [*TEXT, *DOUBLE, *INTEGER, *FLAG] if c not in names]:
        raise ValueError(f"columns missing from the records: {missing}")
    bare = F.regexp_replace("value", '"([^"]|"")*"', "")
    values = F.size(F.split(bare, ",", -1))
    shape = F.when(F.contains(bare, F.lit('"')), "open quote").when(values < len(names), "fewer values than columns").when(values > len(names), "more values than columns")
    parsed = lines.filter("line > 1 and value <> ''").select("file", "line", "value", shape.alias("reason"), F.from_csv("value", ", ".join(f"`{c}` string" for c in names), {"escape": '"'}).alias("x"))
    parsed = once(parsed)  # else each column that a filter or a reason asks for parses its line again
    known = lambda c: null_tokens(F.col(f"x.{c}"))
    numbers = F.array_compact(F.array(*(F.when(known(c).isNotNull() & number(known(c)).isNull(), F.lit(f"{c} is no number")) for c in (*DOUBLE, *INTEGER))))
    reason = F.coalesce("reason", F.when(F.size(numbers) > 0, F.array_join(numbers, ", ")))
    parsed = parsed.withColumn("reason", reason)
    faults = parsed.filter("reason is not null").select("file", "line", "reason", F.substring("value", 1, 200).alias("text"))
    return typed(parsed.filter("reason is null").select("x.*")), faults


def schema() -> T.StructType:
    kinds = [(TEXT, T.StringType()), (DOUBLE, T.DoubleType()), (INTEGER, T.IntegerType()), (FLAG, T.BooleanType())]
    return T.StructType([T.StructField(c, t) for own, t in kinds for c in own])


def write_records(df: DataFrame, path: str) -> None:
    """Columnar form of records for later stages, in parts by year, so that a scan of some years reads those alone."""
    df.write.mode("overwrite").partitionBy("posting_year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header that read_records() and other readers take: quotes are doubled, nulls are empty."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", escape='"')
