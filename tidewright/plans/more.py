"""Further tables of the catalogue: gates, lookups, labels of rows, summaries of repeated measurements, and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.audit import TARGET
from tidewright.plans.base import ORACLES, SQL_NUMBERS, exact_mean, over_postings, over_tables, r4, record_numbers, sql_exact_mean, table
from tidewright.plans.evaluation import _SQL_CANDIDATES as _SQL_PREDICTORS
from tidewright.plans.evaluation import SQL_OOF, out_of_fold, predictor_errors, silhouette


@over_postings("flt01_leaked_header", ", u AS (SELECT job_id, job_category FROM p UNION ALL SELECT 'h' || industry, ' JOB_CATEGORY ' FROM (SELECT DISTINCT industry FROM p)) SELECT trim(lower(job_category)) = 'job_category' AS leaked, count(*)::BIGINT AS records FROM u GROUP BY 1")
def leaked_header(p):
    """Header rows among the data, found by their own column's name."""
    headers = p.select("industry").distinct().select(F.concat(F.lit("h"), "industry").alias("job_id"), F.lit(" JOB_CATEGORY ").alias("job_category"))
    u = p.select("job_id", "job_category").union(headers)
    return u.groupBy((F.trim(F.lower("job_category")) == "job_category").alias("leaked")).agg(F.count("*").alias("records"))


_GATES = ["balance >= 0.9 AND support >= 200 AND growth > 0", "balance >= 0.9 AND support >= 200", "balance >= 0.9", "true"]
_SQL_CANDIDATES = "c AS (SELECT country, avg(benefits_score_10) AS quality, avg(is_senior::INTEGER) * 2 AS balance, count(*) AS support, avg(demand_growth_yoy_pct) AS growth FROM p GROUP BY 1)"


@over_postings("flt07_gate_fallback", f", {_SQL_CANDIDATES}, g AS (SELECT *, CASE " + " ".join(f"WHEN {g} THEN {i}" for i, g in enumerate(_GATES)) + " END AS pool FROM c), b AS (SELECT min(pool) AS best FROM g) SELECT country, pool::INTEGER AS pool, round(quality, 4) AS quality FROM g JOIN b ON pool = best")
def gate_fallback(p):
    """The candidates that pass the strictest gate which any passes: one pass, no retry."""
    c = p.groupBy("country").agg(F.avg("benefits_score_10").alias("quality"), (F.avg(F.col("is_senior").cast("int")) * 2).alias("balance"), F.count("*").alias("support"), F.avg("demand_growth_yoy_pct").alias("growth"))
    pool = F.coalesce(*(F.when(F.expr(g), i) for i, g in enumerate(_GATES)))
    g = c.withColumn("pool", pool)
    best = g.agg(F.min("pool").alias("best"))
    return g.join(F.broadcast(best), F.col("pool") == F.col("best")).select("country", "pool", r4("quality").alias("quality"))


@over_postings("flt09_query_string", ", x AS (SELECT 1) SELECT job_id FROM p WHERE industry = 'ASIA' AND company_size = 'Small' AND years_of_experience >= 10")
def query_string(p):
    return p.filter("industry = 'ASIA' AND company_size = 'Small' AND years_of_experience >= 10").select("job_id")


@over_postings("jn05_lineage_join", ", r AS (SELECT 'years_of_experience' AS feature, corr(years_of_experience, annual_salary_usd) AS r FROM p UNION ALL SELECT 'demand_growth_yoy_pct', corr(demand_growth_yoy_pct, annual_salary_usd) FROM p), l(feature, family) AS (VALUES ('years_of_experience', 'numeric'), ('demand_score', 'numeric')) SELECT feature, round(r, 4) AS r, family FROM r LEFT JOIN l USING (feature)")
def lineage_join(p):
    r = p.agg(*(F.corr(c, TARGET).alias(c) for c in ("years_of_experience", "demand_growth_yoy_pct"))).unpivot([], ["years_of_experience", "demand_growth_yoy_pct"], "feature", "r")
    families = p.sparkSession.createDataFrame([("years_of_experience", "numeric"), ("demand_score", "numeric")], "feature string, family string")
    return r.join(F.broadcast(families), "feature", "left").select("feature", r4("r").alias("r"), "family")


@over_postings("jn04_performance_join", f", {SQL_OOF}, m AS (SELECT fold, {sql_exact_mean('abs(actual - predicted)')} AS mae FROM oof GROUP BY 1), n AS (SELECT fold, count(*) AS n, avg(actual) AS level FROM oof GROUP BY 1) SELECT m.fold, mae, n::BIGINT AS n, round(mae / level, 6) AS relative FROM m LEFT JOIN n ON m.fold = n.fold")
def performance_join(p):
    x = out_of_fold(p)
    m = x.groupBy("fold").agg(exact_mean(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    n = x.groupBy("fold").agg(F.count("*").alias("n"), F.avg("actual").alias("level"))
    return m.join(n, "fold", "left").select("fold", "mae", "n", F.round(F.col("mae") / F.col("level"), 6).alias("relative"))


@over_postings("wn04_group_totals", ", x AS (SELECT 1) SELECT job_id, country, round(demand_score / sum(demand_score) OVER (PARTITION BY country, period), 6) AS share FROM p")
def group_totals(p):
    return p.select("job_id", "country", F.round(F.col("demand_score") / F.sum("demand_score").over(W.partitionBy("country", "period")), 6).alias("share"))


@over_postings("sl02_chronological", f", {SQL_NUMBERS} SELECT record_id, period, job_id FROM numbered")
def chronological(p):
    """The stable order of time: month, then id."""
    return record_numbers(p).select("record_id", "period", "job_id")


@over_postings("ag31_repeat_summary", f", {SQL_OOF}, s AS (SELECT country AS name, 'medae' AS scoring, fold, median(abs(actual - predicted)) AS v FROM oof GROUP BY ALL UNION ALL SELECT country, 'bias', fold, median(actual - predicted) FROM oof GROUP BY ALL) SELECT name, scoring, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high FROM s GROUP BY ALL")
def repeat_summary(p):
    """Mean and spread of repeated scores by name and scoring."""
    e = F.col("actual") - F.col("predicted")
    g = out_of_fold(p).groupBy(F.col("country").alias("name"), "fold").agg(F.median(F.abs(e)).alias("medae"), F.median(e).alias("bias")).unpivot(["name", "fold"], ["medae", "bias"], "scoring", "v")
    return g.groupBy("name", "scoring").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


@over_postings("page_max_abs_r", ", r AS (SELECT 'country' AS original, v AS category, corr((country = v)::INTEGER, annual_salary_usd) AS r FROM p CROSS JOIN (SELECT DISTINCT country AS v FROM p) GROUP BY v UNION ALL SELECT 'job_category', v, corr((job_category = v)::INTEGER, annual_salary_usd) FROM p CROSS JOIN (SELECT DISTINCT job_category AS v FROM p) GROUP BY v), k AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY abs(r) DESC, category) AS place FROM r) SELECT original, category, round(r, 4) AS r FROM k WHERE place = 1")
def max_abs_r(p):
    """The value of each column most correlated with the target, from group sums: no 0/1 columns."""
    y = F.col(TARGET)
    t = p.agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    long = p.select(TARGET, F.inline(F.array(*(F.struct(F.lit(c).alias("original"), F.col(c).alias("category")) for c in ("country", "job_category")))))
    g = long.groupBy("original", "category").agg(F.count("*").alias("n1"), F.sum(TARGET).alias("s1")).crossJoin(F.broadcast(t))
    r = F.expr("(n * s1 - n1 * s) / (sqrt(double(n1) * (n - n1)) * sqrt(n * ss - s * s))")
    return g.withColumn("r", r).groupBy("original").agg(F.max_by("category", F.abs("r")).alias("category"), r4(F.max_by("r", F.abs("r"))).alias("r"))


@over_tables("snk05_event_log", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS sequence, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || '}' AS line FROM events")
def event_log(spark, sf_dir):
    """Log lines, numbered in order within their writer."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user")))
    return e.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"), line.alias("line"))


#: Bands of a silhouette, from the best on. Fixed values of the contract.
QUALITY = ((0.50, "strong separation"), (0.35, "moderate separation"), (0.20, "weak but usable separation"))
POOR = "very weak / overlapping structure"


def quality_band(s):
    """The band of a silhouette."""
    out = F.lit(POOR)
    for least, name in reversed(QUALITY):
        out = F.when(s >= least, name).otherwise(out)
    return out


@over_tables("prj06_quality_bands", f"SELECT label, silhouette, CASE {' '.join(f"WHEN silhouette >= {b} THEN '{n}'" for b, n in QUALITY)} ELSE '{POOR}' END AS band FROM ({ORACLES['ag19_silhouette']})")
def quality_bands(spark, sf_dir):
    """How well each given cluster is apart."""
    return silhouette(spark, sf_dir).select("label", "silhouette", quality_band(F.col("silhouette")).alias("band"))


@over_postings("prj06_baseline_status", f", {_SQL_PREDICTORS}, m AS (SELECT model, avg(mae) AS mae FROM errors GROUP BY 1) SELECT model, round(mae, 4) AS mae, CASE WHEN model = 'Dummy Median' THEN 'reference baseline' WHEN mae < (SELECT mae FROM m WHERE model = 'Dummy Median') THEN 'below baseline' ELSE 'at or above baseline' END AS status FROM m")
def baseline_status(p):
    """Whether each predictor's mean error is below the dummy's."""
    m = predictor_errors(p).groupBy("model").agg(F.avg("mae").alias("mae"))
    dummy = m.filter("model = 'Dummy Median'").select(F.col("mae").alias("d"))
    status = F.when(F.col("model") == "Dummy Median", "reference baseline").when(F.col("mae") < F.col("d"), "below baseline").otherwise("at or above baseline")
    return m.crossJoin(F.broadcast(dummy)).select("model", r4("mae").alias("mae"), status.alias("status"))  # one row


#: Limits of the timed samples' 95th per cent by type; a type without one isn't configured.
BUDGETS = {"click": 95.0, "view": 50.0, "purchase": 10.0}


@over_tables("prj06_budget_verdicts", f"WITH b AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in BUDGETS.items())}) AS t(event_type, most)), s AS (SELECT event_type, quantile_cont(value, 0.95) AS observed FROM events GROUP BY 1) SELECT s.event_type, round(observed, 4) AS observed, most, CASE WHEN most IS NULL THEN 'not_configured' WHEN observed <= most THEN 'pass' ELSE 'fail' END AS verdict FROM s LEFT JOIN b USING (event_type)")
def budget_verdicts(spark, sf_dir):
    """The 95th per cent of each type's samples against its limit."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.95)).alias("observed"))
    most = F.create_map(*(F.lit(x) for kv in BUDGETS.items() for x in kv))[F.col("event_type")]
    verdict = F.when(F.col("most").isNull(), "not_configured").when(F.col("observed") <= F.col("most"), "pass").otherwise("fail")
    return s.withColumn("most", most).select("event_type", r4("observed").alias("observed"), "most", verdict.alias("verdict"))
