"""Queries that go through readers, writers and streams."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.audit import CONTRACT, TARGET
from tidewright.plans.base import over_postings, over_tables, shared_path, table
from tidewright.sources import logs, records
from tidewright.streaming.events import read_events, sessions, windowed


@over_tables("stream_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS events, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"))


@over_tables("stream_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS events FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


@over_postings("src10_newest_run", ", r AS (SELECT country AS source_sha256, job_id AS run_id, period AS finished_at FROM p WHERE NOT is_senior), x AS (SELECT *, row_number() OVER (PARTITION BY source_sha256 ORDER BY finished_at DESC, run_id DESC) AS k FROM r) SELECT source_sha256, run_id, finished_at FROM x WHERE k = 1")
def newest_run(p):
    from tidewright.sources.evidence import newest

    return newest(p.select(F.col("country").alias("source_sha256"), F.col("job_id").alias("run_id"), F.col("period").alias("finished_at"), (~F.col("is_senior")).alias("complete")))


@over_postings("snk04_export_stats", ", x AS (SELECT sha256(job_id || '|' || period || '|' || printf('%.2f', annual_salary_usd)) AS h FROM p) SELECT 'records' AS table_name, count(*)::BIGINT AS records, 3::INTEGER AS n_columns, least(count(*), 20)::BIGINT AS shown, greatest(count(*) - 20, 0)::BIGINT AS omitted, sum(('0x' || substr(h, 1, 12))::BIGINT)::BIGINT AS digest FROM x")
def export_stats(p):
    """What an export lists of a table: rows, columns, at most twenty rows shown and the rest counted, and a digest: the sum of 48 bits of each row's SHA-256, whatever the order of rows.

    The sum is taken whole, as a decimal. Of a sum that a long doesn't hold (from about 65,536 rows on, where the text has none) the digest is the low 63 bits.
    """
    row = F.sha2(F.concat_ws("|", "job_id", "period", F.format_string("%.2f", TARGET)), 256)
    total = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(28,0)"))
    digest = (total % F.lit(Decimal(2**63))).cast("long")
    n = F.count("*")
    return p.agg(F.lit("records").alias("table_name"), n.alias("records"), F.lit(3).alias("n_columns"), F.least(n, F.lit(20)).alias("shown"), F.greatest(n - 20, F.lit(0)).alias("omitted"), digest.alias("digest"))


@over_tables("src09_log_preview", "WITH e AS (SELECT user_id::VARCHAR AS writer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS sequence, event_type, round(value, 4) AS value FROM events) SELECT writer, sequence, event_type, value, 0::INTEGER AS omitted_bytes FROM e ORDER BY sequence, writer LIMIT 200")
def log_preview(spark, sf_dir):
    """The events written as a log by a stream, and the first lines of what is read back."""
    path = f"{shared_path(spark)}/log-{uuid.uuid4().hex}"
    metric = F.when(F.col("value").isNotNull(), F.create_map(F.lit("value"), F.col("value"))).otherwise(F.create_map().cast("map<string,double>"))
    events = read_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("writer"), "ts", F.col("event_id").alias("id"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("details"), metric.alias("metrics"))
    logs.append(events, path, f"{path}-checkpoint").awaitTermination()
    first = logs.preview(logs.read_log(spark, path))
    return first.select("writer", "sequence", F.get_json_object("details", "$.event_type").alias("event_type"), F.round(F.col("metrics")["value"], 4).alias("value"), F.col("omitted_bytes").cast("int").alias("omitted_bytes"))


_FAULTY = {"fewer values than columns": "n % 50 = 1", "more values than columns": "n % 77 = 2", "open quote": "n % 91 = 3", "demand_score is no number": "n % 64 = 4"}
_SQL_FAULTY = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in _FAULTY.items()) + " ELSE 'sound' END"


@over_postings("src02_faulty_csv", f", n AS (SELECT job_id::BIGINT AS n, annual_salary_usd FROM p), r AS (SELECT {_SQL_FAULTY} AS reason, annual_salary_usd FROM n) SELECT reason, count(*)::BIGINT AS lines, round(sum(CASE WHEN reason = 'sound' THEN annual_salary_usd END), 2) AS salary FROM r GROUP BY 1")
def faulty_csv(p):
    """The records as a CSV in which some lines lack a value, have one more, open a quote or hold no number, read as sound records and messages."""
    n = F.col("job_id").cast("long")
    own = p.select(n.alias("n"), *CONTRACT)
    own = own.withColumn("demand_score", F.when(F.expr(_FAULTY["demand_score is no number"]), "many").otherwise(F.col("demand_score").cast("string")))
    line = F.concat_ws(",", *(F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in CONTRACT))
    bare = [r for r in _FAULTY if r != "demand_score is no number"]
    change = F.when(F.expr(_FAULTY[bare[0]]), F.regexp_replace(line, ',"[^"]*"$', "")).when(F.expr(_FAULTY[bare[1]]), F.concat(line, F.lit(',"more"'))).when(F.expr(_FAULTY[bare[2]]), F.regexp_replace(line, '"$', "")).otherwise(line)
    path = f"{shared_path(p.sparkSession)}/faulty-{uuid.uuid4().hex}"
    own.select(change.alias(",".join(CONTRACT))).write.option("header", "true").option("quote", "").option("escape", "").option("delimiter", "\x01").csv(path)
    sound, faults = records.read_checked(p.sparkSession, path)
    told = faults.groupBy("reason").agg(F.count("*").alias("lines"), F.lit(None).cast("double").alias("salary"))
    return told.union(sound.agg(F.lit("sound").alias("reason"), F.count("*").alias("lines"), F.round(F.sum(TARGET), 2).alias("salary")))


_RESERVE = "2001-06"
_SQL_EXPOSED = f"""r AS (SELECT DISTINCT period AS month FROM p WHERE period > '{_RESERVE}'), x AS (SELECT city AS source, min(period) AS first_month, max(period) AS last_month FROM p WHERE is_senior AND remote_work = 'P' GROUP BY 1),
o AS (SELECT source, first_month, last_month, count(month)::BIGINT AS overlap, min(month) AS first_overlap, max(month) AS last_overlap FROM x LEFT JOIN r ON month BETWEEN first_month AND last_month GROUP BY ALL)"""


def month_number(c):
    """Months since the year 0 of a text like 2000-12."""
    return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")


def exposures(p):
    """Spans of months that sources have seen (a row a source): here, of each city the months of its senior posts of one kind."""
    seen = p.filter(F.col("is_senior") & (F.col("remote_work") == "P"))
    return seen.groupBy(F.col("city").alias("source")).agg(F.min("period").alias("first_month"), F.max("period").alias("last_month"))


def seen_months(spans):
    """A row for each source and month of its span: joins by month, not by range."""
    every = F.sequence(month_number(F.col("first_month")), month_number(F.col("last_month")))
    return spans.select("source", F.explode(every).alias("__m"))


@over_postings("ml30_exposure", f", {_SQL_EXPOSED} SELECT *, CASE WHEN overlap > 0 THEN 'known-exposed' ELSE 'attested-unexposed' END AS status FROM o")
def exposure(p):
    """Of each source's span, the reserved months that it has seen; a source without any leaves the reserve ready."""
    spans, reserve = exposures(p), p.filter(F.col("period") > _RESERVE).select(F.col("period").alias("month")).distinct().withColumn("__m", month_number(F.col("month")))
    hit = seen_months(spans).join(reserve, "__m").groupBy("source").agg(F.count("*").alias("overlap"), F.min("month").alias("first_overlap"), F.max("month").alias("last_overlap"))
    out = spans.join(hit, "source", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return out.withColumn("status", F.when(F.col("overlap") > 0, "known-exposed").otherwise("attested-unexposed"))


@over_postings("ml30_reserve_months", f", {_SQL_EXPOSED}, m AS (SELECT month, count(source)::BIGINT AS sources FROM r LEFT JOIN x ON month BETWEEN first_month AND last_month GROUP BY 1), k AS (SELECT *, substr(month, 1, 4)::INTEGER * 12 + substr(month, 6, 2)::INTEGER AS i FROM m) SELECT month, sources, sources = 0 AS ready, coalesce(i - lag(i) OVER (ORDER BY month) - 1, 0)::INTEGER AS gap_before FROM k")
def reserve_months(p):
    """Each reserved month: the sources that have seen it, whether it is ready, and the calendar months without records before it."""
    reserve = p.filter(F.col("period") > _RESERVE).select(F.col("period").alias("month")).distinct().withColumn("__m", month_number(F.col("month")))
    hit = seen_months(exposures(p)).groupBy("__m").agg(F.count("*").alias("sources"))
    w = W.orderBy("month")  # a row a month
    out = reserve.join(hit, "__m", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return out.select("month", "sources", (F.col("sources") == 0).alias("ready"), F.coalesce(F.col("__m") - F.lag("__m").over(w) - 1, F.lit(0)).alias("gap_before"))
