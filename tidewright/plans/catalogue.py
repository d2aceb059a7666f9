"""Tables of the reports by their own names: segments of the records, error tables, and page summaries.

Segments are clusters of the numeric columns, found by rounds of K-means in whole numbers, so that SQL can follow them;
ml10_cluster_assignments has those of pyspark.ml in the space of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.audit import SQL_STATS, SQL_TOKENS, TARGET, salary_stats, skill_tokens
from tidewright.plans.base import SQL_NUMBERS, exact_quantiles, once, over_postings, r4, record_numbers, with_medians
from tidewright.plans.evaluation import SQL_OOF, out_of_fold

#: Clusters, rounds, and the columns that a record's place is made from: their range in hundredths.
CLUSTERS, ROUNDS = 4, 6
MEASURES = {"years": "years_of_experience", "demand": "coalesce(demand_score, 0)", "benefits": "coalesce(benefits_score_10, 0)", "skills": "skill_count"}


def places(p: DataFrame) -> DataFrame:
    """p with a whole number from 0 to 100 for each measure: its place between the column's ends."""
    p = p.withColumn("skill_count", F.coalesce(F.size(skill_tokens(F.col("required_skills"))), F.lit(0)))
    p = p.withColumns({f"__{m}": F.expr(c).cast("double") for m, c in MEASURES.items()})
    ends = p.agg(*(f(f"__{m}").alias(f"__{n}_{m}") for m in MEASURES for n, f in (("lo", F.min), ("hi", F.max))))
    own = lambda m: F.when(F.col(f"__hi_{m}") > F.col(f"__lo_{m}"), F.round(100.0 * (F.col(f"__{m}") - F.col(f"__lo_{m}")) / (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")))).otherwise(0.0).cast("long")
    placed = p.crossJoin(F.broadcast(ends)).withColumns({m: own(m) for m in MEASURES})  # one row
    return placed.drop(*ends.columns, *(f"__{m}" for m in MEASURES))


def nearest(centres: dict[int, list[int]]) -> Column:
    """The cluster of the nearest centre (hundredths of places); the lowest of equals."""
    gap = lambda c: sum(((100 * F.col(m) - F.lit(v)) * (100 * F.col(m) - F.lit(v)) for m, v in zip(MEASURES, c, strict=True)), F.lit(0).cast("long"))
    return F.array_min(F.array(*(F.struct(gap(c).alias("d"), F.lit(k).alias("k")) for k, c in centres.items())))["k"]


def centres_of(points: DataFrame, rounds: int = ROUNDS) -> dict[int, list[int]]:
    """The clusters' centres after so many rounds over points (the measures and n, how many records are there).

    The first clusters are quarters of the years. A round is one aggregation of a few rows; clusters that lose all points go.
    """
    cluster = F.least(F.lit(CLUSTERS - 1), F.floor(CLUSTERS * F.col("years") / 101)).cast("int")
    for _ in range(rounds + 1):
        sums = points.groupBy(cluster.alias("k")).agg(*(F.expr(f"sum({m} * n) * 100 div sum(n)").alias(m) for m in MEASURES)).collect()  # a row a cluster
        centres = {r.k: [r[m] for m in MEASURES] for r in sorted(sums)}
        cluster = nearest(centres)
    return centres


def segmented(p: DataFrame) -> DataFrame:
    """p with record_id and cluster, which was found on the different places and their counts."""
    placed = once(places(p))
    points = placed.groupBy(*MEASURES).agg(F.count("*").alias("n"))
    cluster = nearest(centres) if (centres := centres_of(once(points))) else F.lit(0)
    return record_numbers(placed.withColumn("cluster", cluster)).drop(*MEASURES, "skill_count")


def _sql_segmented() -> str:
    names = list(MEASURES)
    place = ", ".join(f"CASE WHEN max({m}) OVER () > min({m}) OVER () THEN round(100.0::DOUBLE * ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())) ELSE 0 END::BIGINT AS {m}" for m in names)
    raw = ", ".join(f"({c})::DOUBLE AS {m}" for m, c in MEASURES.items())
    centre = ", ".join(f"(sum({m} * n)::BIGINT * 100) // sum(n)::BIGINT AS c_{m}" for m in names)
    gap = " + ".join(f"(100 * {m} - c_{m}) * (100 * {m} - c_{m})" for m in names)
    keys = ", ".join(names)
    steps = [f"a0 AS (SELECT *, least({CLUSTERS - 1}, {CLUSTERS} * years // 101)::INTEGER AS k FROM points)"]
    for i in range(ROUNDS + 1):
        steps += [f"c{i} AS (SELECT k, {centre} FROM a{i} GROUP BY k)", f"a{i + 1} AS (SELECT {keys}, n, arg_min(k, (({gap}) * {CLUSTERS} + k)) AS k FROM points CROSS JOIN (SELECT * FROM c{i}) GROUP BY {keys}, n)"]
    return f"""{SQL_NUMBERS}, raw AS (SELECT record_id AS rid, {raw} FROM (SELECT *, coalesce(len({SQL_TOKENS}), 0) AS skill_count FROM numbered)),
placed AS MATERIALIZED (SELECT rid, {place} FROM raw), points AS MATERIALIZED (SELECT {keys}, count(*)::BIGINT AS n FROM placed GROUP BY ALL), {", ".join(steps)},
seg AS MATERIALIZED (SELECT numbered.*, k AS cluster FROM numbered JOIN placed ON record_id = rid JOIN a{ROUNDS + 1} USING ({keys}))"""


SQL_SEGMENTED = _sql_segmented()


@over_postings("out_cluster_assignments", f", {SQL_SEGMENTED} SELECT record_id, job_id, cluster FROM seg")
def assignments(p):
    """Each record's number and cluster."""
    return segmented(p).select("record_id", "job_id", "cluster")


@over_postings("out_cluster_profiles", f", {SQL_SEGMENTED} SELECT cluster, {SQL_STATS}, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM seg GROUP BY 1")
def cluster_profiles(p):
    g = salary_stats(segmented(p), "cluster")
    return g.withColumn("pct", r4(100.0 * F.col("records") / F.sum("records").over(W.partitionBy())))


@over_postings("out_cluster_category_profile", f", {SQL_SEGMENTED}, g AS (SELECT cluster, job_category, count(*) AS n FROM seg GROUP BY ALL) SELECT cluster, job_category, n::BIGINT AS records, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY cluster), 4) AS pct FROM g")
def cluster_category_profile(p):
    g = segmented(p).groupBy("cluster", "job_category").agg(F.count("*").alias("records"))
    return g.withColumn("pct", r4(100.0 * F.col("records") / F.sum("records").over(W.partitionBy("cluster"))))


@over_postings("out_cluster_geography_profile", f", {SQL_SEGMENTED}, u AS (SELECT cluster, 'country' AS dimension, country AS value FROM seg UNION ALL SELECT cluster, 'city', city FROM seg), g AS (SELECT cluster, dimension, value, count(*) AS n FROM u GROUP BY ALL) SELECT cluster, dimension, value, n::BIGINT AS records, row_number() OVER (PARTITION BY cluster, dimension ORDER BY n DESC, value)::INTEGER AS place FROM g")
def cluster_geography_profile(p):
    long = segmented(p).select("cluster", F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("country", "city")))))
    g = long.groupBy("cluster", "dimension", "value").agg(F.count("*").alias("records"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("cluster", "dimension").orderBy(F.desc("records"), "value")))


@over_postings("out_cluster_skill_profile", f", {SQL_SEGMENTED}, e AS (SELECT cluster, unnest({SQL_TOKENS}) AS skill FROM seg), n AS (SELECT cluster, count(*) AS n FROM seg GROUP BY 1) SELECT e.cluster, skill, count(*)::BIGINT AS records, round(100.0::DOUBLE * count(*) / any_value(n.n), 4) AS pct FROM e JOIN n ON e.cluster = n.cluster GROUP BY ALL")
def cluster_skill_profile(p):
    s = segmented(p)
    e = s.select("cluster", F.explode(skill_tokens(F.col("required_skills"))).alias("skill")).groupBy("cluster", "skill").agg(F.count("*").alias("records"))
    n = s.groupBy("cluster").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n), "cluster").select("cluster", "skill", "records", r4(100.0 * F.col("records") / F.col("n")).alias("pct"))


@over_postings("out_cluster_years_distribution", f", {SQL_SEGMENTED} SELECT cluster, years_of_experience, count(*)::BIGINT AS records FROM seg GROUP BY ALL")
def cluster_years_distribution(p):
    return segmented(p).groupBy("cluster", "years_of_experience").agg(F.count("*").alias("records"))


@over_postings("out_cluster_market_signals", f", {SQL_SEGMENTED} SELECT cluster, round(median(demand_score), 4) AS median_demand, round(median(benefits_score_10), 4) AS median_benefits, round(median(demand_growth_yoy_pct), 4) AS median_growth FROM seg GROUP BY 1")
def cluster_market_signals(p):
    s = once(segmented(p).select("cluster", "demand_score", "benefits_score_10", "demand_growth_yoy_pct"))
    return with_medians(s.select("cluster").distinct(), s, ["cluster"], {"median_demand": F.col("demand_score"), "median_benefits": F.col("benefits_score_10"), "median_growth": F.col("demand_growth_yoy_pct")})


@over_postings("out_segment_salary_summary", f", {SQL_SEGMENTED}, m AS (SELECT max(period) AS last FROM p) SELECT cluster, period = last AS locked, {SQL_STATS} FROM seg CROSS JOIN m GROUP BY ALL")
def segment_salary_summary(p):
    s = segmented(p)
    last = s.agg(F.max("period").alias("last"))
    return salary_stats(s.crossJoin(F.broadcast(last)).withColumn("locked", F.col("period") == F.col("last")), "cluster", "locked")


@over_postings("out_raw_range_audit", ", x AS (SELECT 1) SELECT job_id, annual_salary_usd, round(salary_min_usd, 4) AS salary_min_usd, round(salary_max_usd, 4) AS salary_max_usd, CASE WHEN annual_salary_usd < salary_min_usd THEN 'below' WHEN annual_salary_usd > salary_max_usd THEN 'above' END AS side FROM p WHERE annual_salary_usd < salary_min_usd OR annual_salary_usd > salary_max_usd")
def range_audit(p):
    """Records outside their stated range, and on which side."""
    side = F.when(F.col(TARGET) < F.col("salary_min_usd"), "below").when(F.col(TARGET) > F.col("salary_max_usd"), "above")
    return p.select("job_id", TARGET, r4("salary_min_usd").alias("salary_min_usd"), r4("salary_max_usd").alias("salary_max_usd"), side.alias("side")).filter("side is not null")


@over_postings("out_salary_range_status", ", x AS (SELECT 1) SELECT CASE WHEN annual_salary_usd < salary_min_usd OR annual_salary_usd > salary_max_usd THEN 'outside' ELSE 'inside' END AS status, count(*)::BIGINT AS records FROM p GROUP BY 1")
def salary_range_status(p):
    outside = (F.col(TARGET) < F.col("salary_min_usd")) | (F.col(TARGET) > F.col("salary_max_usd"))
    return p.groupBy(F.when(outside, "outside").otherwise("inside").alias("status")).agg(F.count("*").alias("records"))


@over_postings("out_target_summary", ", x AS (SELECT 1) SELECT count(annual_salary_usd)::BIGINT AS n, min(annual_salary_usd) AS lowest, max(annual_salary_usd) AS highest, sum(round(annual_salary_usd * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(*)) AS mean, round(median(annual_salary_usd), 4) AS median, round(stddev_samp(annual_salary_usd), 4) AS sd, CASE WHEN avg(annual_salary_usd) > median(annual_salary_usd) THEN 'right' ELSE 'left' END AS skew FROM p")
def target_summary(p):
    mean = F.sum(F.round(F.col(TARGET) * 100).cast("long")) / (100.0 * F.count("*"))
    x = once(p.select(TARGET))
    g = x.agg(F.count(TARGET).alias("n"), F.min(TARGET).alias("lowest"), F.max(TARGET).alias("highest"), mean.alias("mean"), r4(F.stddev_samp(TARGET)).alias("sd"), F.avg(TARGET).alias("a"))
    g = g.crossJoin(exact_quantiles(x, [], TARGET, {"m": 0.5}))  # one row each
    return g.select("n", "lowest", "highest", "mean", r4("m").alias("median"), "sd", F.when(F.col("a") > F.col("m"), "right").otherwise("left").alias("skew"))


@over_postings("out_before_after", ", x AS (SELECT 1) SELECT 'records' AS measure, count(*)::BIGINT AS before, count(*) FILTER (WHERE required_skills IS NOT NULL)::BIGINT AS after FROM p UNION ALL SELECT 'skills', count(DISTINCT required_skills)::BIGINT, count(DISTINCT CASE WHEN annual_salary_usd > 0 THEN required_skills END)::BIGINT FROM p")
def before_after(p):
    """Accounting of a processing step, a row a measure, in one pass."""
    one = p.agg(F.count("*").alias("a"), F.count("required_skills").alias("b"), F.count_distinct("required_skills").alias("c"), F.count_distinct(F.when(F.col(TARGET) > 0, F.col("required_skills"))).alias("d"))
    return one.select(F.inline(F.array(F.struct(F.lit("records").alias("measure"), F.col("a").alias("before"), F.col("b").alias("after")), F.struct(F.lit("skills").alias("measure"), F.col("c").alias("before"), F.col("d").alias("after")))))


@over_postings("out_error_ecdf", f", {SQL_OOF}, e AS (SELECT fold, job_id, abs(actual - predicted) AS e FROM oof) SELECT fold, job_id, round(e, 4) AS absolute_error, round(row_number() OVER (PARTITION BY fold ORDER BY e, job_id)::DOUBLE / count(*) OVER (PARTITION BY fold), 6) AS share FROM e")
def error_ecdf(p):
    e = out_of_fold(p).select("fold", "job_id", F.abs(F.col("actual") - F.col("predicted")).alias("e"))
    own = W.partitionBy("fold")
    return e.select("fold", "job_id", r4("e").alias("absolute_error"), F.round(F.row_number().over(own.orderBy("e", "job_id")) / F.count("*").over(own), 6).alias("share"))


@over_postings("out_prediction_summary", f", {SQL_OOF} SELECT job_category, count(*)::BIGINT AS records, round(median(actual), 4) AS median_actual, round(median(predicted), 4) AS median_predicted, round(median(abs(actual - predicted)), 4) AS median_error FROM oof GROUP BY 1")
def prediction_summary(p):
    x = once(out_of_fold(p))
    return with_medians(x.groupBy("job_category").agg(F.count("*").alias("records")), x, ["job_category"], {"median_actual": F.col("actual"), "median_predicted": F.col("predicted"), "median_error": F.abs(F.col("actual") - F.col("predicted"))})


@over_postings("out_rare_skills", f", s AS (SELECT unnest({SQL_TOKENS}) AS skill FROM p), g AS (SELECT skill, count(*) AS n FROM s GROUP BY 1), m AS (SELECT avg(n) AS m FROM g) SELECT count(*)::BIGINT AS skills, count(*) FILTER (WHERE n < m)::BIGINT AS rare, round(100.0::DOUBLE * count(*) FILTER (WHERE n < m) / count(*), 4) AS rare_pct FROM g CROSS JOIN m")
def rare_skills(p):
    """Tokens with less than the mean number of records."""
    g = p.select(F.explode(skill_tokens(F.col("required_skills"))).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    rare = F.count_if(F.col("n") < F.col("m"))
    return g.crossJoin(F.broadcast(g.agg(F.avg("n").alias("m")))).agg(F.count("*").alias("skills"), rare.alias("rare"), r4(100.0 * rare / F.count("*")).alias("rare_pct"))


@over_postings("out_fold_timeline", ", x AS (SELECT DISTINCT posting_year AS fold, period FROM p) SELECT fold, min(period) AS first_period, max(period) AS last_period, count(*)::BIGINT AS months FROM x GROUP BY 1")
def fold_timeline(p):
    return p.select(F.col("posting_year").alias("fold"), "period").distinct().groupBy("fold").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("*").alias("months"))


def stacked(s: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Counts of each column's values in each cluster, and their share of the cluster."""
    long = s.select("cluster", F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns))))
    g = long.groupBy("cluster", "dimension", "value").agg(F.count("*").alias("records"))
    return g.withColumn("pct", r4(100.0 * F.col("records") / F.sum("records").over(W.partitionBy("cluster", "dimension"))))


for _name, _columns in {"out_cluster_experience_level_profile": ("experience_level",), "out_cluster_company_profile": ("company_size", "industry", "remote_work")}.items():
    _parts = " UNION ALL ".join(f"SELECT cluster, '{c}' AS dimension, {c} AS value FROM seg" for c in _columns)
    over_postings(_name, f", {SQL_SEGMENTED}, u AS ({_parts}), g AS (SELECT cluster, dimension, value, count(*) AS n FROM u GROUP BY ALL) SELECT cluster, dimension, value, n::BIGINT AS records, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY cluster, dimension), 4) AS pct FROM g")(lambda p, c=_columns: stacked(segmented(p), c))


@over_postings("out_segment_city_country_summary", f", {SQL_SEGMENTED} SELECT cluster, country, city, {SQL_STATS} FROM seg GROUP BY ALL")
def segment_city_country(p):
    return salary_stats(segmented(p), "cluster", "country", "city")


@over_postings("out_predicted_salary_by_segment", f", {SQL_SEGMENTED}, {SQL_OOF} SELECT cluster, fold, count(*)::BIGINT AS records, round(median(actual), 4) AS median_actual, round(median(predicted), 4) AS median_predicted, round(median(actual - predicted), 4) AS median_residual FROM oof JOIN seg USING (job_id) GROUP BY ALL")
def predicted_by_segment(p):
    """Predictions meet their segment by record id."""
    s = segmented(p).select("job_id", "cluster")
    gap = F.col("actual") - F.col("predicted")
    x = once(out_of_fold(p).join(s, "job_id"))
    return with_medians(x.groupBy("cluster", "fold").agg(F.count("*").alias("records")), x, ["cluster", "fold"], {"median_actual": F.col("actual"), "median_predicted": F.col("predicted"), "median_residual": gap})


@over_postings("jn03_column_to_index", f", {SQL_SEGMENTED}, i AS (SELECT cluster AS id, count(*)::BIGINT AS size FROM seg GROUP BY 1 HAVING cluster <> 3), r AS (SELECT cluster, industry, max(demand_growth_yoy_pct) AS growth FROM seg GROUP BY ALL) SELECT cluster, industry, growth, size FROM r LEFT JOIN i ON cluster = id")
def column_to_index(p):
    """A table's column meets another's key; keys that aren't there give null."""
    s = segmented(p)
    keyed = s.groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("size")).filter("id <> 3")
    rows = s.groupBy("cluster", "industry").agg(F.max("demand_growth_yoy_pct").alias("growth"))
    return rows.join(keyed, F.col("cluster") == F.col("id"), "left").drop("id")


@over_postings("jn15_row_labels", f", {SQL_SEGMENTED} SELECT record_id, job_category, cluster FROM seg")
def row_labels(p):
    """Labels made elsewhere meet their rows by an explicit number, never by position."""
    labels = segmented(p).select("record_id", "cluster")
    return record_numbers(p).select("record_id", "job_category").join(labels, "record_id")
