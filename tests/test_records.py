"""Readers, packs, streams, and exact values of small cases."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from tidewright.functions import records as functions
from tidewright.operators import statistics as ops
from tidewright.plans import base, models, serving
from tidewright.sources import evidence, records
from tidewright.streaming import events


def test_csv_null_tokens_and_types(spark, tmp_path):
    columns = [c if c != "job_category" else "AI Engineering" for c in records.schema().names]
    row = {c: "x" for c in columns} | {c: "1.5" for c in records.DOUBLE} | {c: "3" for c in records.INTEGER} | {c: "True" for c in records.FLAG}
    odd = row | {"city": "NA", "demand_score": "nan", "annual_salary_usd": "many", "required_skills": 'a|"b"\nc', "is_senior": "no"}
    text = ",".join([*columns, "extra"]) + "\n"
    for r in (row, odd):
        text += ",".join('"' + r[c].replace('"', '""') + '"' for c in columns) + ",z\n"
    (tmp_path / "r.csv").write_text(text)
    df = records.read_records(spark, str(tmp_path / "r.csv"))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in records.schema()]
    a, b = df.collect()
    assert (a.city, a.demand_score, a.posting_year, a.is_senior, a.job_category) == ("x", 1.5, 3, True, "x")
    assert (b.city, b.demand_score, b.annual_salary_usd, b.is_senior, b.required_skills) == (None, None, None, False, 'a|"b"\nc')
    records.write_records(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "short.csv").write_text("job_id\n1\n")
    with pytest.raises(ValueError, match="missing"):
        records.read_records(spark, str(tmp_path / "short.csv"))


def test_packs(spark, tmp_path):
    path = str(tmp_path / "pack")
    evidence.publish({"a": spark.range(5), "b": spark.range(3)}, path)
    assert evidence.load(spark, path, ["a"])["a"].count() == 5
    with pytest.raises(FileExistsError):
        evidence.publish({"a": spark.range(1)}, path)
    spark.range(9).write.mode("append").parquet(f"{path}/b")
    assert {r.fault for r in evidence.faults(spark, path).collect()} == {"not listed"}
    with pytest.raises(ValueError, match="not listed"):
        evidence.load(spark, path, ["a"])


def test_packs_tell_their_tables(spark, tmp_path):
    path = str(tmp_path / "pack")
    evidence.publish({"a": spark.range(5), "b": spark.range(3)}, path)
    assert evidence.names(spark, path) == ["a", "b"] and {n: d.count() for n, d in evidence.load(spark, path).items()} == {"a": 5, "b": 3}


def test_guarded_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x,\"y\"\nz"), (2, None, None)], "id long, v double, s string")
    evidence.write_json(df, str(tmp_path / "t.jsonl"))
    assert sorted(tuple(r) for r in evidence.guarded(spark, str(tmp_path / "t.jsonl"), ["id", "v"]).select("id", "v", "s").collect()) == sorted(tuple(r) for r in df.collect())
    records.write_csv(df, str(tmp_path / "t.csv"))
    assert evidence.guarded(spark, str(tmp_path / "t.csv"), ["s"]).count() == 2
    with pytest.raises(FileNotFoundError):
        evidence.guarded(spark, str(tmp_path / "none.csv"), [])
    for own, match in (({"columns": ["w"]}, "lacks"), ({"columns": [], "most_rows": 1}, "rows"), ({"columns": [], "most_bytes": 10}, "bytes")):
        with pytest.raises(ValueError, match=match):
            evidence.guarded(spark, str(tmp_path / "t.jsonl"), **own)
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "id long, v double")
    with pytest.raises(Exception, match="JSON"):
        evidence.write_json(odd, str(tmp_path / "odd.jsonl"))
    evidence.write_json(odd, str(tmp_path / "odd.jsonl"), strict=False)
    assert spark.read.schema("id long, v double").json(str(tmp_path / "odd.jsonl")).filter("v is null").count() == 2


def test_log_lines(spark):
    import json

    rows = [("w", 2, {"k": "v"}, {"m": float("nan"), "n": 1.0}), ("w", 1, {"k": "x" * 20_000}, {}), ("u", 1, None, None)]
    out = {(r.writer, r.sequence): json.loads(r.line) for r in evidence.log_lines(spark.createDataFrame(rows, "writer string, ts long, details map<string,string>, metrics map<string,double>")).collect()}
    assert out["w", 2]["metrics"] == {"m": None, "n": 1.0} and "omitted_bytes" in out["w", 1]["details"] and ("u", 1) in out
    many = spark.createDataFrame([("w", 1, None, {str(i): 0.0 for i in range(101)})], "writer string, ts long, details map<string,string>, metrics map<string,double>")
    with pytest.raises(Exception, match="metrics"):
        evidence.log_lines(many).collect()


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(20)], "row_id long, x double, y double")
    fit = lambda scale: Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df.withColumn("y", F.col("y") * scale))
    model = fit(1.0)
    evidence.save_model(model, str(tmp_path / "m"))
    loaded = evidence.load_model(str(tmp_path / "m"), df, model)
    assert loaded.transform(df).first().prediction == pytest.approx(1.0)
    with pytest.raises(ValueError, match="apart"):
        evidence.load_model(str(tmp_path / "m"), df, fit(2.0))


def test_exact_quantiles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 50, 400)] + [("b", 7.0)] * 9 + [(None, float(v)) for v in rng.normal(size=31)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for parts in (4096, 3, 1):
        monkeypatch.setattr(base, "PARTS", parts)
        out = {r.g: (r.lo, r.mid, r.hi) for r in base.exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
        assert set(out) == {"a", "b", None}
        for g, got in out.items():
            assert got == pytest.approx(np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 0.9]))
    assert base.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_quantiles_of_skewed_values(spark, monkeypatch):
    """One value far away, or values over many magnitudes, leave no range with a group's values."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.lognormal(10, 2, 4000)] + [("a", 1e12)] + [("b", float(v)) for v in 10.0 ** rng.integers(-9, 9, 300)] + [(None, -3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(base, "WHOLE", 0)
    shares = {"lo": 0.01, "mid": 0.5, "hi": 0.999}
    for parts in (1, 16, 1024):
        monkeypatch.setattr(base, "PARTS", parts)
        out = {r.g: (r.lo, r.mid, r.hi) for r in base.exact_quantiles(df, ["g"], "v", shares).collect()}
        assert {g: pytest.approx(np.quantile([v for k, v in rows if k == g], list(shares.values()))) for g in ("a", "b", None)} == out
    monkeypatch.setattr(base, "PARTS", 16)
    largest = base.parted(base.counted_values(df, ["g"], "v"), ["g"]).groupBy("g", "__part").count().filter("g = 'a'").agg(F.max("count"), F.count("*")).first()
    assert largest[0] < 2 * 4001 / 16 and largest[1] == 16


def test_once_tables_are_cleared(spark, tmp_path, monkeypatch):
    if not spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("without a shared folder nothing is written")
    base.clear_once(spark)
    monkeypatch.setattr(base, "shared_path", lambda spark: str(tmp_path))
    assert base.once(spark.range(5)).count() == 5 and len(list(tmp_path.iterdir())) == 1
    base.clear_once(spark)
    assert not list(tmp_path.iterdir())


def test_stream_equals_table(spark, sf, tmp_path):
    whole = base.table(spark, sf, "events")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    q = events.windowed(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(events.windowed(whole).collect())
    assert glob.glob(str(tmp_path / "events.parquet/*.parquet"))
    assert events.read_events(spark, sf).isStreaming


def test_tokens_and_slugs(spark):
    df = spark.createDataFrame([(" Python | SQL|Python||  a  b ",), (None,), ("",)], "s string")
    rows = [r[0] for r in df.select(ops.skill_tokens(F.col("s"))).collect()]
    assert rows == [["Python", "SQL", "a b"], None, []]
    assert df.limit(1).select(functions.slug(F.lit("A  b/C!"))).first()[0] == "a-b-c"
    assert df.limit(1).select(functions.redacted(F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("n"), F.lit("1")))).first()[0] == {"API_KEY": "[redacted]", "n": "1"}
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "s string").select(functions.number(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_flags_with_nulls(spark):
    shape = "experience_level string, years_of_experience double, annual_salary_usd double, salary_min_usd double, salary_max_usd double, salary_tier string, required_skills string"
    rows = [("Entry", 2.5, 300000.0, None, 299999.0, "Elite (>$300k)", "a|b"), ("Mid", 3.0, None, 1.0, 2.0, None, None), ("Lead", 10.0, 99999.0, 100000.0, None, "Entry (<$100k)", "a| |b")]
    out = [(r.bad_experience, r.bad_tier, r.bad_range, r.bad_skills) for r in ops.flags(spark.createDataFrame(rows, shape)).collect()]
    assert out == [(True, False, True, False), (False, True, False, True), (False, False, True, True)]


def test_strict_metrics(spark):
    m = lambda rows: spark.createDataFrame(rows, "actual double, predicted double").agg(*ops.metrics()).first()
    assert (m([(10.0, 9.0)]).r2, m([(10.0, 9.0)]).r2_reason) == (None, "fewer_than_two_rows")
    flat = m([(10.0, 9.0), (10.0, 11.0)])
    assert (flat.r2, flat.r2_reason, flat.mae) == (None, "constant_target", 1.0)


def test_rand_index(spark):
    of = lambda a, b: spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert ops.rand_index(of([0, 0, 1, 1], [5, 5, 3, 3])).first().ari == 1.0
    assert ops.rand_index(of([0, 0, 0], [1, 1, 1])).first().ari == 1.0
    assert abs(ops.rand_index(of([0, 0, 1, 1], [0, 1, 0, 1])).first().ari + 0.5) < 1e-12


def test_a_repeated_key_is_an_error(spark):
    left, right = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, 2), (1, 3)], "k int, w int")
    with pytest.raises(Exception, match="repeated"):
        ops.join_many_to_one(left, right, ["k"]).collect()
    assert ops.join_many_to_one(left, right.limit(1), ["k"]).count() == 1


def test_scenarios(spark):
    p = spark.createDataFrame([("R", "Scientist", 4.0), ("R", "Scientist", 9.0), ("A", "Architect", 3.0), ("A", "Architect", 12.0)], "job_category string, job_title string, years_of_experience double")
    rules = serving.policy(p)
    assert {(r.job_title, r.support, r.min_years, r.max_years) for r in rules.collect()} == {("Scientist", 2, 4.0, 9.0), ("Architect", 2, 3.0, 12.0)}
    s = spark.createDataFrame([(1, "R", "Scientist", 5.0, False), (2, "R", "Scientist", 1.0, False), (3, "R", "Scientist", 1.0, True), (4, "R", "Architect", 5.0, True), (5, "A", "Architect", None, True), (6, "A", "Architect", 16.0, True)], "scenario_id long, job_category string, job_title string, years double, benchmark boolean")
    out = {r.scenario_id: (r.validation_mode, r.reason) for r in serving.validated(s, rules).collect()}
    assert out == {1: ("observed", None), 2: ("rejected", "years out of bounds"), 3: ("benchmark", None), 4: ("rejected", "pair not observed"), 5: ("rejected", "years missing"), 6: ("rejected", "years out of bounds")}


def test_unseen_values_are_zeros(spark, sf):
    p = models.prepared(base.postings(spark, sf))
    f = models.Features(p, nominal=("country",), numeric=("years_of_experience",), skills=True)
    odd = p.limit(2).withColumn("country", F.lit("nowhere")).withColumn("skills", F.array(F.lit("new")))
    rows = f.transform(odd).collect()
    width = sum(n for _, n in f.blocks())
    assert all(r.features.size == width and sum(1 for v in r.features.toArray() if v) <= 1 for r in rows)


def test_record_numbers_of_any_ids(spark):
    ids = ["10", "9", "x1", "abc", None, "-5", "x10", "700000", "", "é"] * 2
    rows = [(j, "2000-01" if i % 3 else "1999-12") for i, j in enumerate(ids)]
    df = spark.createDataFrame(rows, "job_id string, period string").repartition(4)
    key = lambda r: (r[1], r[0] is not None and r[0].lstrip("-").isdigit(), int(r[0]) if r[0] and r[0].lstrip("-").isdigit() else 0, r[0] or "")
    found = [(r.job_id, r.period) for r in base.record_numbers(df).orderBy("record_id").collect()]
    assert [(j or "", p) for j, p in found] == [(j or "", p) for j, p in sorted(rows, key=key)]


def test_record_numbers_are_whole(spark, sf):
    numbers = [r.record_id for r in base.record_numbers(base.postings(spark, sf)).select("record_id").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
