"""Logs over restarts, faulty files, pointers and create-only exports."""

from __future__ import annotations

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidewright.plans import base
from tidewright.plans.sources import export_stats, month_number
from tidewright.sources import evidence, logs, records

EVENT = "writer string, ts timestamp, id long, details map<string,string>, metrics map<string,double>"


def events(spark, rows):
    return spark.createDataFrame([(w, t, i, {"n": str(i)}, {"v": float(i)}) for w, t, i in rows], "writer string, ts string, id long, details map<string,string>, metrics map<string,double>").withColumn("ts", F.col("ts").cast("timestamp"))


def test_sequences_go_on_over_restarts(spark, tmp_path):
    first = [("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 05:00:00", 2), ("a", "2024-01-01 09:00:00", 3), ("a", "2024-01-01 09:00:00", 0), (None, "2024-01-01 00:00:00", 7)]
    second = [("a", "2023-12-31 00:00:00", 4), ("c", "2024-01-02 00:00:00", 5)]
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    for rows in (first, second):  # the stream is started anew for each
        events(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, []).schema).parquet(source)
        logs.append(stream, log, checkpoint).awaitTermination()
    want = [("a", 1, "1"), ("a", 2, "0"), ("a", 3, "3"), ("a", 4, "4"), ("b", 1, "2"), ("c", 1, "5"), (None, 1, "7")]
    found = lambda: sorted(((r.writer, r.sequence, json.loads(r.details)["n"]) for r in logs.read_log(spark, log).collect()), key=repr)
    assert found() == sorted(want, key=repr)
    logs.append_batch(events(spark, second), 1, log)  # a batch that is tried again
    assert found() == sorted(want, key=repr)
    # a batch that failed between its lines and its sequences doesn't count
    events(spark, first).limit(1).select(F.lit("x").alias("v")).write.text(f"{log}/batch=2")
    logs.append_batch(events(spark, [("a", "2024-02-01 00:00:00", 8)]), 2, log)
    assert ("a", 5, "8") in found() and len(found()) == 8


def test_faulty_lines_are_apart(spark, tmp_path):
    log = str(tmp_path / "log")
    logs.append_batch(events(spark, [("a", "2024-01-01 00:00:00", 1)]), 0, log)
    (tmp_path / "log" / "batch=0" / "more.txt").write_text('{"writer": "b", "sequence": 1\nplain text\n{"writer":"w","sequence":2,"ts":null,"details":"' + "é" * 9000 + '","metrics":null}\n')
    read = logs.read_log(spark, log)
    assert {r._corrupt_record for r in read.collect() if r._corrupt_record} == {'{"writer": "b", "sequence": 1', "plain text"}
    first, long = logs.preview(read).collect()
    assert (first.writer, first.omitted_bytes) == ("a", 0) and (long.omitted_bytes, len(long.details)) == (18_000 - evidence.MOST_DETAILS, 8192)
    assert logs.preview(read, 1).count() == 1


def a_record(**own):
    return {c: "x" for c in records.schema().names} | {c: "1.5" for c in records.DOUBLE} | {c: "3" for c in records.INTEGER} | {c: "True" for c in records.FLAG} | own


def test_checked_records(spark, tmp_path):
    names = ["AI Engineering" if c == "job_category" else c for c in records.schema().names]
    rows = [a_record(job_id=str(i), city='"x, y"') for i in range(30)]
    lines = [",".join(r[c] for c in records.schema().names) for r in rows]
    lines[4] += ",more"
    lines[9] = lines[9].rpartition(",")[0]
    lines[11] = lines[11].replace('"x, y"', '"x, y')
    lines[20] = lines[20].replace("1.5", "many", 1).replace(",3,", ",three,", 1)
    lines[22] = lines[22].replace("1.5", "NA")
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"part{k}.csv").write_text("\n".join([",".join(names), *lines[k * 15 : k * 15 + 15]]) + "\n")
    sound, faults = records.read_checked(spark, str(folder))
    assert [(f.name, f.dataType) for f in sound.schema] == [(f.name, f.dataType) for f in records.schema()]
    assert {int(r.job_id) for r in sound.collect()} == set(range(30)) - {4, 9, 11, 20} and {r.city for r in sound.collect()} == {"x, y"}
    assert sound.filter("job_id = '22'").first().annual_salary_usd is None
    told = sorted((r.file.rpartition("/")[2], r.line, r.reason) for r in faults.collect())
    assert told == [("part0.csv", 6, "more values than columns"), ("part0.csv", 11, "fewer values than columns"), ("part0.csv", 13, "open quote"), ("part1.csv", 7, "years_of_experience is no number, posting_year is no number")]
    (folder / "odd.csv").write_text("job_id\n1\n")
    with pytest.raises(ValueError, match="headers"):
        records.read_checked(spark, str(folder))


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = records._lines(spark, str(tmp_path / "t.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 5000 and all(r.value == f"line {r.line}" for r in found)


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    """Only blocks are ordered: no text is shuffled for its number."""
    (tmp_path / "t.txt").write_text("a\nb\n")
    lines = records._lines(spark, str(tmp_path))
    assert "row_number" not in lines._jdf.queryExecution().optimizedPlan().toString() and sorted((r.line, r.value) for r in lines.collect()) == [(1, "a"), (2, "b")]


def test_pointers_name_one_pack(spark, tmp_path):
    pointer = str(tmp_path / "latest")
    evidence.point_to(spark, pointer, "pack-1")
    assert evidence.pointed(spark, pointer) == "pack-1"
    evidence.point_to(spark, pointer, "pack-two")
    assert evidence.pointed(spark, pointer) == "pack-two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["latest"]


def test_exports_are_never_replaced(spark, tmp_path):
    path = str(tmp_path / "table.csv")
    df = spark.range(25).select("id", (F.col("id") * 2).alias("v"))
    out = []

    def one():
        try:
            out.append(evidence.export_csv(df, path))
        except FileExistsError:
            out.append(None)

    writers = [threading.Thread(target=one) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    (made,) = [x for x in out if x]
    assert (made["rows"], made["columns"], made["shown"], made["omitted"]) == (25, 2, 20, 5)
    assert spark.read.csv(path, header=True).count() == 25 and [p.name for p in tmp_path.iterdir()] == ["table.csv"]
    with pytest.raises(FileExistsError):
        evidence.export_csv(df.limit(1), path)
    assert evidence.export_csv(df.repartition(5), str(tmp_path / "again.csv"))["digest"] == made["digest"]


@pytest.mark.parametrize("n", [100, 140_000])
def test_digest_beyond_a_long(spark, n):
    p = spark.range(n).select(F.col("id").cast("string").alias("job_id"), F.lit("2000-01").alias("period"), (F.col("id") / 4).alias("annual_salary_usd"))
    total = sum(int(hashlib.sha256(f"{i}|2000-01|{i / 4:.2f}".encode()).hexdigest()[:12], 16) for i in range(n))
    made = export_stats(p).first()
    assert (made.records, made.omitted, made.digest) == (n, n - 20, total % 2**63) and (total >= 2**63) == (n > 100)


def test_any_stray_file_is_a_fault(spark, tmp_path):
    path = tmp_path / "pack"
    evidence.publish({"a": spark.range(5)}, str(path))
    (path / "a" / "notes.txt").write_text("stray")
    assert {(r.name, r.fault) for r in evidence.faults(spark, str(path)).collect()} == {("a/notes.txt", "not listed")}


def test_month_numbers(spark):
    assert spark.range(1).select(month_number(F.lit("2001-01")) - month_number(F.lit("2000-12"))).first()[0] == 1


def test_clearing_leaves_results_alone(spark):
    df = base.once(spark.range(3))
    assert df.count() == 3
