"""Cleaning and audit tables: scans, projections, filters, profiles and group statistics of the records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.base import SQL_NUMBERS, TIERS, counted_values, exact_quantiles, money_mean, once, over_postings, over_tables, quantiles_of, r4, record_numbers, sql_money_mean, sql_tier, table, tier, with_medians, with_quantiles

#: The record contract's columns. Fixed values.
CONTRACT = ("job_id job_title job_category experience_level education_required city country remote_work company_size industry required_skills salary_tier years_of_experience annual_salary_usd salary_min_usd salary_max_usd ai_salary_premium_pct demand_score demand_growth_yoy_pct benefits_score_10 posting_year posting_month is_senior is_remote_friendly is_llm_role").split()
TEXT, NUMERIC, FLAGS = CONTRACT[:12], CONTRACT[12:22], CONTRACT[22:]
#: Columns of few values: texts that aren't ids or lists, and flags.
CATEGORICAL = [c for c in TEXT if c not in ("job_id", "required_skills")] + FLAGS
#: Columns that a model may read, and those it may not. Names and order are fixed values of the contract.
ALLOW = ["job_title", "job_category", "years_of_experience", "education_required", "city", "country", "remote_work", "company_size", "industry", "demand_score", "benefits_score_10", "required_skills", "skill_count"]
BLOCK = ["job_id", "salary_min_usd", "salary_max_usd", "salary_tier", "experience_level", "posting_year", "posting_month", "is_senior", "is_remote_friendly", "is_llm_role", "ai_salary_premium_pct", "demand_growth_yoy_pct"]
TARGET = "annual_salary_usd"


def q(c: str, share: float) -> Column:
    return F.percentile(c, F.lit(share))


def skill_tokens(c: Column) -> Column:
    """Trimmed tokens with runs of white space made one blank, without empty ones, once each, sorted."""
    cleaned = F.transform(F.split(c, r"\|"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


SQL_TOKENS = r"list_sort(list_distinct(list_filter(list_transform(string_split(required_skills, '|'), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')), lambda x: x <> '')))"
SQL_RAW_TOKENS = "len(string_split(required_skills, '|'))"

#: Whether years fit a level (fixed values of the contract); the gaps between the bands count as misfits.
LEVEL_YEARS = {"Entry": (0, 2), "Mid": (3, 5), "Senior": (6, 9), "Lead": (10, 100)}


def flags(p: DataFrame) -> DataFrame:
    """p with the four integrity flags; nulls count as each rule says (a null level or tier is a misfit, a null bound is not, null skills are)."""
    fits = F.lit(False)
    for level, (lo, hi) in LEVEL_YEARS.items():
        fits = F.when(F.col("experience_level").startswith(level), F.col("years_of_experience").between(lo, hi)).otherwise(fits)
    target = F.col(TARGET)
    outside = F.coalesce(target < F.col("salary_min_usd"), F.lit(False)) | F.coalesce(target > F.col("salary_max_usd"), F.lit(False))
    return p.withColumns({
        "expected_tier": tier(target),
        "bad_experience": ~F.coalesce(fits, F.lit(False)),
        "bad_tier": ~F.coalesce(F.col("salary_tier") == tier(target), F.lit(False)),
        "bad_range": outside,
        "bad_skills": F.coalesce(F.size(F.split("required_skills", r"\|")) > F.size(skill_tokens(F.col("required_skills"))), F.lit(True)),
    })


SQL_FLAGS = f"""flagged AS (SELECT *, {sql_tier("annual_salary_usd")} AS expected_tier,
  NOT coalesce(CASE WHEN experience_level LIKE 'Lead%' THEN years_of_experience BETWEEN 10 AND 100 WHEN experience_level LIKE 'Senior%' THEN years_of_experience BETWEEN 6 AND 9
      WHEN experience_level LIKE 'Mid%' THEN years_of_experience BETWEEN 3 AND 5 WHEN experience_level LIKE 'Entry%' THEN years_of_experience BETWEEN 0 AND 2 END, false) AS bad_experience,
  NOT coalesce(salary_tier = {sql_tier("annual_salary_usd")}, false) AS bad_tier,
  coalesce(annual_salary_usd < salary_min_usd, false) OR coalesce(annual_salary_usd > salary_max_usd, false) AS bad_range,
  coalesce({SQL_RAW_TOKENS} > len({SQL_TOKENS}), true) AS bad_skills FROM p)"""


@over_postings("src01_contract_scan", f", x AS (SELECT 1) SELECT {', '.join(CONTRACT)} FROM p")
def contract_scan(p):
    return p.select(*CONTRACT)


@over_tables("src03_period_scan", "SELECT year(o_orderdate)::INTEGER AS posting_year, month(o_orderdate)::INTEGER AS posting_month, count(*)::BIGINT AS records FROM orders GROUP BY ALL")
def period_scan(spark, sf_dir):
    """Reads the date column alone."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("posting_year"), F.month("o_orderdate").alias("posting_month")).agg(F.count("*").alias("records"))


@over_tables("src09_event_preview", "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events ORDER BY ts, event_id LIMIT 200")
def event_preview(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(200).select("event_id", "user_id", "event_type", r4("value").alias("value"))


@over_postings("prj02_clean_records", ", x AS (SELECT 1) SELECT DISTINCT " + ", ".join(c for c in CONTRACT if c != "job_id") + ", period FROM p WHERE trim(lower(job_category)) <> 'job_category'")
def clean_records(p):
    """Whole-row duplicates and leaked header rows out, the identifier dropped."""
    return p.filter(F.trim(F.lower("job_category")) != "job_category").drop("job_id").distinct()


def _policy() -> list[tuple[str, str]]:
    return [*((c, "ALLOW") for c in ALLOW), *((c, "BLOCK") for c in BLOCK), (TARGET, "TARGET")]


@over_postings("prj03_feature_policy", ", k AS (SELECT *, CASE WHEN required_skills IS NOT NULL THEN 1 END AS skill_count FROM p) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, '{says}' AS policy, count({c})::BIGINT AS known FROM k" for c, says in _policy()))
def feature_policy(p):
    """Each feature's policy, and in how many records it is known; the number of skills is known with the skills."""
    policy = p.sparkSession.createDataFrame(_policy(), "feature string, policy string")
    known = p.withColumn("skill_count", F.col("required_skills")).agg(*(F.count(c).alias(c) for c, _ in _policy())).unpivot([], [c for c, _ in _policy()], "feature", "known")
    return known.join(F.broadcast(policy), "feature").select("feature", "policy", "known")  # a row a feature


@over_postings("prj04_row_identity", f", {SQL_NUMBERS} SELECT job_id, record_id, record_id - 1 AS source_position, sha256('postings:' || (record_id - 1)) AS row_id FROM numbered")
def row_identity(p):
    at = F.col("record_id") - 1
    return record_numbers(p).select("job_id", "record_id", at.alias("source_position"), F.sha2(F.concat_ws(":", F.lit("postings"), at.cast("string")), 256).alias("row_id"))


@over_postings("prj05_integrity_flags", f", {SQL_NUMBERS.replace('FROM p', 'FROM flagged').replace('numbered AS', SQL_FLAGS + ', numbered AS')} SELECT record_id, experience_level, years_of_experience, salary_tier, expected_tier, bad_experience, bad_tier, bad_range, bad_skills FROM numbered")
def integrity_flags(p):
    return record_numbers(flags(p)).select("record_id", "experience_level", "years_of_experience", "salary_tier", "expected_tier", "bad_experience", "bad_tier", "bad_range", "bad_skills")


ISSUES = {"bad_experience": ("experience", "HIGH"), "bad_tier": ("tier", "HIGH"), "bad_range": ("range", "MEDIUM"), "bad_skills": ("skills", "LOW")}


@over_postings("prj05_contradictions", f", {SQL_FLAGS} " + " UNION ALL ".join(f"SELECT '{n}' AS issue, '{s}' AS severity, count(*) FILTER (WHERE {c})::BIGINT AS records, round(100.0::DOUBLE * count(*) FILTER (WHERE {c}) / count(*), 4) AS pct FROM flagged" for c, (n, s) in ISSUES.items()))
def contradictions(p):
    """One pass: four conditional counts, then a row for each."""
    counted = flags(p).agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ISSUES))
    rows = F.array(*(F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"), F.col(c).alias("records")) for c, (n, s) in ISSUES.items()))
    return counted.select("n", F.inline(rows)).select("issue", "severity", "records", r4(100.0 * F.col("records") / F.col("n")).alias("pct"))


@over_postings("prj06_tier_buckets", f", x AS (SELECT {sql_tier('annual_salary_usd')} AS tier, annual_salary_usd AS s FROM p) SELECT tier, count(*)::BIGINT AS records, min(s) AS lowest, max(s) AS highest FROM x GROUP BY tier")
def tier_buckets(p):
    return p.groupBy(tier(F.col(TARGET)).alias("tier")).agg(F.count("*").alias("records"), F.min(TARGET).alias("lowest"), F.max(TARGET).alias("highest"))


#: Both experience binnings: right-closed for the audit, left-closed for the subgroup report.
AUDIT_BANDS = ((2, "Entry (1-2)"), (5, "Mid (3-5)"), (9, "Senior (6-9)"))
REPORT_BANDS = ((3, "0-2"), (7, "3-6"))


def audit_band(y: Column) -> Column:
    out = F.when(y > 9, "Lead (10+)")
    for top, name in reversed(AUDIT_BANDS):
        out = F.when((y >= 0) & (y <= top), name).otherwise(out)
    return out


def report_band(y: Column) -> Column:
    return F.when((y >= 0) & (y < 3), "0-2").when((y >= 3) & (y < 7), "3-6").when(y >= 7, "7+")


SQL_AUDIT_BAND = "CASE WHEN years_of_experience BETWEEN 0 AND 2 THEN 'Entry (1-2)' WHEN years_of_experience BETWEEN 0 AND 5 THEN 'Mid (3-5)' WHEN years_of_experience BETWEEN 0 AND 9 THEN 'Senior (6-9)' WHEN years_of_experience > 9 THEN 'Lead (10+)' END"
SQL_REPORT_BAND = "CASE WHEN years_of_experience >= 0 AND years_of_experience < 3 THEN '0-2' WHEN years_of_experience >= 3 AND years_of_experience < 7 THEN '3-6' WHEN years_of_experience >= 7 THEN '7+' END"


@over_postings("prj07_experience_bands", f", x AS (SELECT {SQL_AUDIT_BAND} AS audit_band, {SQL_REPORT_BAND} AS report_band, annual_salary_usd AS s FROM p) SELECT audit_band, report_band, count(*)::BIGINT AS records, round(avg(s), 4) AS mean_salary, round(median(s), 4) AS median_salary FROM x GROUP BY ALL")
def experience_bands(p):
    y = F.col("years_of_experience")
    x = once(p.select(audit_band(y).alias("audit_band"), report_band(y).alias("report_band"), TARGET))
    by = ["audit_band", "report_band"]
    return with_medians(x.groupBy(*by).agg(F.count("*").alias("records"), r4(F.avg(TARGET)).alias("mean_salary")), x, by, {"median_salary": F.col(TARGET)})


@over_postings("prj08_ratios", ", x AS (SELECT job_category, avg(annual_salary_usd) AS m, avg(salary_min_usd) AS lo, avg(salary_max_usd) AS hi, sqrt(avg(power(annual_salary_usd - salary_min_usd, 2))) AS rmse, median(abs(annual_salary_usd - salary_min_usd)) AS med FROM p GROUP BY 1) SELECT job_category, round(100 * (hi - lo) / nullif(m, 0), 4) AS spread_pct, round(100 * (m - lo) / nullif(lo, 0), 4) AS over_min_pct, round(rmse / nullif(med, 0), 4) AS tail_ratio FROM x")
def ratios(p):
    gap = F.col(TARGET) - F.col("salary_min_usd")
    x = once(p.select("job_category", TARGET, "salary_min_usd", "salary_max_usd", F.abs(gap).alias("gap")))
    g = x.groupBy("job_category").agg(F.avg(TARGET).alias("m"), F.avg("salary_min_usd").alias("lo"), F.avg("salary_max_usd").alias("hi"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    g = with_quantiles(g, x, ["job_category"], "gap", {"med": 0.5})
    over = lambda a, b: a / F.nullif(F.col(b), F.lit(0.0))
    return g.select("job_category", r4(over(100 * (F.col("hi") - F.col("lo")), "m")).alias("spread_pct"), r4(over(100 * (F.col("m") - F.col("lo")), "lo")).alias("over_min_pct"), r4(over(F.col("rmse"), "med")).alias("tail_ratio"))


PREFIXES = ["job_title", "job_category", "education_required", "country", "remote_work", "company_size", "industry"]


@over_postings("prj09_feature_lineage", ", e AS (" + " UNION ".join(f"SELECT 'nominal__{c}_' || {c} AS encoded, '{c}' AS original FROM p WHERE {c} IS NOT NULL" for c in PREFIXES) + " UNION SELECT 'skills__' || unnest(" + SQL_TOKENS + "), 'required_skills' FROM p UNION SELECT * FROM (VALUES ('numeric__years_of_experience', 'years_of_experience'), ('numeric__demand_score', 'demand_score'), ('numeric__benefits_score_10', 'benefits_score_10'))) SELECT encoded, original FROM e")
def feature_lineage(p):
    """Names of encoded columns, and the original that the longest fitting prefix names."""
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in PREFIXES))
    nominal = p.select(F.explode(pairs).alias("x")).filter("x.v is not null").select(F.concat(F.lit("nominal__"), "x.c", F.lit("_"), "x.v").alias("encoded"))
    skills = p.select(F.explode(skill_tokens(F.col("required_skills"))).alias("t")).select(F.concat(F.lit("skills__"), "t").alias("encoded"))
    numeric = p.sparkSession.createDataFrame([(f"numeric__{c}",) for c in ("years_of_experience", "demand_score", "benefits_score_10")], "encoded string")
    names = nominal.union(skills).distinct().union(numeric)
    original = F.when(F.col("encoded").startswith("skills__"), "required_skills").otherwise(F.regexp_extract("encoded", "^numeric__(.*)$", 1))
    for c in sorted(PREFIXES, key=len):
        original = F.when(F.col("encoded").startswith(f"nominal__{c}_"), c).otherwise(original)
    return names.select("encoded", original.alias("original"))


@over_postings("prj10_localised_labels", ", x AS (SELECT 1) SELECT job_id AS ma_tin, CASE remote_work WHEN 'F' THEN 'tai cho' WHEN 'O' THEN 'tu xa' ELSE remote_work END AS hinh_thuc, company_size AS company_size FROM p")
def localised_labels(p):
    """Allow-listed headers and values in another language; what isn't listed stays."""
    return p.select("job_id", "remote_work", "company_size").replace({"F": "tai cho", "O": "tu xa"}, subset=["remote_work"]).withColumnsRenamed({"job_id": "ma_tin", "remote_work": "hinh_thuc"})


@over_postings("prj11_text_frame", ", x AS (SELECT 1) SELECT job_id, printf('%.1f', years_of_experience) AS years_text, coalesce(required_skills, '') AS skills_text, posting_year || '-' || lpad(posting_month::VARCHAR, 2, '0') AS period_text FROM p")
def text_frame(p):
    return p.select("job_id", F.format_string("%.1f", "years_of_experience").alias("years_text"), F.coalesce("required_skills", F.lit("")).alias("skills_text"), F.concat_ws("-", F.col("posting_year").cast("string"), F.lpad(F.col("posting_month").cast("string"), 2, "0")).alias("period_text"))


@over_postings("flt02_temporal_lock", ", m AS (SELECT max(period) AS last FROM p) SELECT job_id, CASE WHEN period = last THEN 'locked' ELSE 'development' END AS split FROM p CROSS JOIN m")
def temporal_lock(p):
    """The latest period is locked; one row is broadcast."""
    last = p.agg(F.max("period").alias("last"))
    return p.crossJoin(F.broadcast(last)).select("job_id", F.when(F.col("period") == F.col("last"), "locked").otherwise("development").alias("split"))


def chosen(p: DataFrame, **values: list[str]) -> DataFrame:
    """Rows whose columns are, as text, among the values; an empty list is no filter."""
    for c, own in values.items():
        if own:
            p = p.filter(F.col(c).cast("string").isin(*own))
    return p


@over_postings("flt03_multi_select", ", x AS (SELECT 1) SELECT job_id, country, posting_year FROM p WHERE country IN ('NATION_3', 'NATION_7', 'NATION_12') AND posting_year::VARCHAR IN ('1996', '1997')")
def multi_select(p):
    return chosen(p, country=["NATION_3", "NATION_7", "NATION_12"], posting_year=["1996", "1997"], industry=[]).select("job_id", "country", "posting_year")


@over_postings("flt04_ranges", ", x AS (SELECT 1) SELECT count(*) FILTER (WHERE posting_month BETWEEN 1 AND 12)::BIGINT AS months_ok, count(*) FILTER (WHERE posting_year BETWEEN 1900 AND 2100)::BIGINT AS years_ok, count(*) FILTER (WHERE years_of_experience BETWEEN 0 AND 15)::BIGINT AS experience_ok, count(*)::BIGINT AS records FROM p")
def ranges(p):
    return p.agg(F.count_if(F.col("posting_month").between(1, 12)).alias("months_ok"), F.count_if(F.col("posting_year").between(1900, 2100)).alias("years_ok"), F.count_if(F.col("years_of_experience").between(0, 15)).alias("experience_ok"), F.count("*").alias("records"))


@over_postings("flt05_near_best", ", g AS (SELECT industry, country, " + sql_money_mean(TARGET) + " AS m FROM p GROUP BY ALL), b AS (SELECT *, max(m) OVER (PARTITION BY industry) AS top FROM g) SELECT industry, country, round(m, 4) AS mean_salary FROM b WHERE m >= top * 0.99::DOUBLE")
def near_best(p):
    """Countries within one hundredth of the best of their industry."""
    g = p.groupBy("industry", "country").agg(money_mean(TARGET).alias("m"))
    return g.withColumn("top", F.max("m").over(W.partitionBy("industry"))).filter(F.col("m") >= F.col("top") * 0.99).select("industry", "country", r4("m").alias("mean_salary"))


@over_postings("flt06_sign_and_text", ", g AS (SELECT job_title, avg(demand_growth_yoy_pct) AS growth, count(*) AS n FROM p GROUP BY 1) SELECT job_title, round(growth, 4) AS growth, n::BIGINT AS records FROM g WHERE abs(growth) >= 0.2 AND n >= 10 AND contains(job_title, 'URGENT')")
def sign_and_text(p):
    g = p.groupBy("job_title").agg(F.avg("demand_growth_yoy_pct").alias("growth"), F.count("*").alias("records"))
    return g.filter((F.abs("growth") >= 0.2) & (F.col("records") >= 10) & F.col("job_title").contains("URGENT")).select("job_title", r4("growth").alias("growth"), "records")


_HIDDEN = "('', 'na', 'n/a', 'nan', 'none', 'null')"
CHECKS = {
    "missing_target": "annual_salary_usd IS NULL",
    "missing_period": "posting_year IS NULL OR posting_month IS NULL",
    "bad_month": "posting_month NOT BETWEEN 1 AND 12",
    "bad_year": "posting_year NOT BETWEEN 1900 AND 2100",
    "range_order": "salary_min_usd > salary_max_usd",
    **{f"missing_{c}": f"{c} IS NULL" for c in CONTRACT},
    **{f"hidden_missing_{c}": f"lower(trim({c})) IN {_HIDDEN}" for c in TEXT},
    **{f"negative_{c}": f"{c} < 0" for c in NUMERIC if c not in ("demand_growth_yoy_pct", "posting_year", "posting_month")},
}


@over_postings("flt08_schema_gate", ", x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER (WHERE {c})::BIGINT AS records FROM p" for n, c in CHECKS.items()) + " UNION ALL SELECT 'duplicate_ids', (count(job_id) - count(DISTINCT job_id))::BIGINT FROM p UNION ALL SELECT 'periods', count(DISTINCT period)::BIGINT FROM p")
def schema_gate(p):
    """All checks as conditional counts in one pass, unpivoted to a row an issue."""
    seen = p.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in CHECKS.items()), (F.count("job_id") - F.count_distinct("job_id")).alias("duplicate_ids"), F.count_distinct("period").alias("periods"))
    return seen.unpivot([], [*CHECKS, "duplicate_ids", "periods"], "issue", "records")


def salary_stats(p: DataFrame, *by: str) -> DataFrame:
    """Size, mean (of whole cents, so that it doesn't depend on their order) and median of each group, from its counted values; records without pay count in the size alone."""
    counted = counted_values(p, list(by), TARGET)
    total = counted.groupBy(*by).agg((F.sum(F.round(F.col("__v") * 100).cast("long") * F.col("__n")) / (100.0 * F.sum("__n"))).alias("mean_salary"))
    sizes = p.groupBy(*by).agg(F.count("*").alias("records"))
    keyed = lambda d, t: d.withColumnsRenamed({c: f"__{t}{c}" for c in by})
    met = lambda t: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{t}{c}")) for c in by))
    out = sizes.join(keyed(total, "t"), met("t"), "left").join(keyed(quantiles_of(counted, list(by), {"m": 0.5}), "q"), met("q"), "left")
    return out.select(*by, "records", "mean_salary", r4("m").alias("median_salary"))


SQL_STATS = f"count(*)::BIGINT AS records, {sql_money_mean(TARGET)} AS mean_salary, round(median(annual_salary_usd), 4) AS median_salary"
for _name, _by in {"ag01_by_level": ["experience_level"], "ag01_by_years": ["years_of_experience"], "ag01_by_domain": ["job_category"], "ag01_by_city": ["country", "city"], "ag01_by_period": ["period"]}.items():
    over_postings(_name, f", x AS (SELECT 1) SELECT {', '.join(_by)}, {SQL_STATS} FROM p GROUP BY ALL")(lambda p, by=tuple(_by): salary_stats(p, *by))


@over_postings("ag02_shares", ", g AS (SELECT industry, country, count(*) AS n FROM p GROUP BY ALL) SELECT industry, country, n::BIGINT AS records, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY industry), 4) AS pct_of_industry, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct_of_all FROM g")
def shares(p):
    g = p.groupBy("industry", "country").agg(F.count("*").alias("records"))
    total = g.agg(F.sum("records").alias("t"))
    of = lambda t: r4(100.0 * F.col("records") / t)
    return g.crossJoin(F.broadcast(total)).select("industry", "country", "records", of(F.sum("records").over(W.partitionBy("industry"))).alias("pct_of_industry"), of(F.col("t")).alias("pct_of_all"))


@over_postings("ag03_distinct_counts", ", x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c})::BIGINT AS n_distinct, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_with_null FROM p" for c in CONTRACT))
def distinct_counts(p):
    """Each column's values grouped once (a row a column and value), then counted."""
    values = p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in CONTRACT)))).distinct()
    return values.groupBy("feature").agg(F.count("v").alias("n_distinct"), F.count("*").alias("n_with_null"))


@over_postings("ag04_frequencies", ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS category FROM p" for c in CATEGORICAL) + "), g AS (SELECT feature, category, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, category NULLS LAST) AS place, sum(n) OVER (PARTITION BY feature) AS t FROM g) SELECT feature, category, n::BIGINT AS records, round(100.0::DOUBLE * n / t, 4) AS pct FROM r WHERE place <= 50")
def frequencies(p):
    """The fifty most frequent values of each column of few values; a missing value is one of them."""
    long = p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in CATEGORICAL))))
    g = long.groupBy("feature", "category").agg(F.count("*").alias("records"))
    own = W.partitionBy("feature")
    g = g.withColumns({"t": F.sum("records").over(own), "place": F.row_number().over(own.orderBy(F.desc("records"), F.asc_nulls_last("category")))})
    return g.filter("place <= 50").select("feature", "category", "records", r4(100.0 * F.col("records") / F.col("t")).alias("pct"))


_TIER_NAMES = [*(n for _, n in TIERS), "Elite (>$300k)"]


@over_postings("ag05_tier_crosstab", f", f AS (SELECT salary_tier, {sql_tier('annual_salary_usd')} AS e FROM p) SELECT salary_tier, " + ", ".join(f"count(*) FILTER (WHERE e = '{n}')::BIGINT AS expected_{i}" for i, n in enumerate(_TIER_NAMES)) + " FROM f GROUP BY 1")
def tier_crosstab(p):
    wide = p.withColumn("e", tier(F.col(TARGET))).groupBy("salary_tier").pivot("e", _TIER_NAMES).count().na.fill(0)
    return wide.withColumnsRenamed({n: f"expected_{i}" for i, n in enumerate(_TIER_NAMES)})


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def describe(p: DataFrame, columns: list[str]) -> DataFrame:
    """Exact count, mean, sample deviation and quartiles of each column, as a row each, from its counted values (a column without a value has no row)."""
    counted = counted_values(p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns)))), ["feature"], "v")
    v, n = F.col("__v"), F.col("__n")
    mean = counted.groupBy("feature").agg((F.sum(v * n) / F.sum(n)).alias("__mean")).withColumnRenamed("feature", "__f")
    around = (v - F.col("__mean")) * (v - F.col("__mean")) * n
    g = counted.join(F.broadcast(mean), F.col("feature") == F.col("__f")).groupBy("feature").agg(F.sum(n).alias("n"), r4(F.first("__mean")).alias("mean"), r4(F.sqrt(F.when(F.sum(n) > 1, F.sum(around) / (F.sum(n) - 1)))).alias("std"), r4(F.min(v)).alias("min"), r4(F.max(v)).alias("max"))  # a row a column
    quartiles = quantiles_of(counted, ["feature"], QUARTILES)
    return g.join(quartiles.select("feature", *(r4(c).alias(c) for c in QUARTILES)), "feature")


@over_postings("ag06_describe", ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM p" for c in NUMERIC) + ") SELECT feature, count(v)::BIGINT AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS q2, round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS max FROM u GROUP BY 1")
def numeric_summary(p):
    return describe(p, NUMERIC)


@over_postings("ag07_quantiles", ", x AS (SELECT 1) SELECT job_category, " + ", ".join(f"round(quantile_cont(annual_salary_usd, {s}), 4) AS q{int(s * 100)}" for s in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + " FROM p GROUP BY 1")
def quantiles(p):
    shares = {f"q{int(s * 100)}": s for s in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)}
    return exact_quantiles(p, ["job_category"], TARGET, shares).select("job_category", *(r4(c).alias(c) for c in shares))


@over_postings("ag08_deviations", ", x AS (SELECT 1) SELECT job_category, round(stddev_samp(annual_salary_usd), 4) AS sample_sd, round(stddev_pop(annual_salary_usd), 4) AS population_sd FROM p GROUP BY 1")
def deviations(p):
    return p.groupBy("job_category").agg(r4(F.stddev_samp(TARGET)).alias("sample_sd"), r4(F.stddev_pop(TARGET)).alias("population_sd"))


_OTHERS = [c for c in NUMERIC if c != "annual_salary_usd"]


@over_postings("ag09_correlations", ", x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE corr({c}, annual_salary_usd) END, 0), 4) AS r FROM p" for c in _OTHERS))
def correlations(p):
    """Pearson r of every number with the target, zero for a constant column."""
    r = lambda c: F.coalesce(F.when(F.stddev_pop(c) == 0, 0.0).otherwise(F.corr(c, TARGET)), F.lit(0.0))
    return p.agg(*(r4(r(c)).alias(c) for c in _OTHERS)).unpivot([], _OTHERS, "feature", "r")


#: What models see: texts as 0/1 columns, numbers (missing ones are 0), and the tokens of skills.
ENCODED = {"text": [c for c in ALLOW if c in TEXT and c != "required_skills"], "number": [c for c in ALLOW if c in NUMERIC]}


@over_postings(
    "ag09_encoded_correlations",
    f""", d AS MATERIALIZED (SELECT *, coalesce(len({SQL_TOKENS}), 0)::DOUBLE AS skill_count, {SQL_TOKENS} AS tokens, annual_salary_usd AS y FROM p WHERE period < (SELECT max(period) FROM p) AND annual_salary_usd IS NOT NULL),
t AS (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM d), u AS ("""
    + " UNION ALL ".join(f"SELECT '{c}=' || {c} AS encoded, y FROM d WHERE {c} IS NOT NULL" for c in ENCODED["text"])
    + " UNION ALL SELECT 'skills=' || unnest(tokens), y FROM d), g AS (SELECT encoded, count(*) AS n1, sum(y) AS s1 FROM u GROUP BY 1), r AS ("
    + "SELECT encoded, CASE WHEN n1 = n OR n * ss = s * s THEN 0 ELSE (n * s1 - n1 * s) / (sqrt(n1::DOUBLE * (n - n1)) * sqrt(n * ss - s * s)) END AS r FROM g CROSS JOIN t"
    + "".join(f" UNION ALL SELECT '{c}', coalesce(CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 0 ELSE corr(coalesce({c}, 0), y) END, 0) FROM d" for c in (*ENCODED["number"], "skill_count"))
    + ") SELECT encoded, round(r, 4) AS r, round(abs(r), 4) AS abs_r FROM r",
)
def encoded_correlations(p):
    """Pearson r of every encoded column with the target over the months before the latest: 0/1 columns from sums alone, constant ones 0."""
    last = p.agg(F.max("period").alias("__last"))
    tokens = F.coalesce(skill_tokens(F.col("required_skills")), F.array().cast("array<string>"))
    d = p.crossJoin(F.broadcast(last)).filter((F.col("period") < F.col("__last")) & F.col(TARGET).isNotNull())  # one row
    d = d.withColumn("tokens", tokens).withColumn("skill_count", F.size("tokens").cast("double"))
    y = F.col(TARGET)
    names = F.array_compact(F.concat(F.array(*(F.concat(F.lit(f"{c}="), F.col(c)) for c in ENCODED["text"])), F.transform("tokens", lambda x: F.concat(F.lit("skills="), x))))
    t = d.agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    g = d.select(y.alias("y"), F.explode(names).alias("encoded")).groupBy("encoded").agg(F.count("*").alias("n1"), F.sum("y").alias("s1")).crossJoin(F.broadcast(t))  # one row
    r = F.when((F.col("n1") == F.col("n")) | (F.col("n") * F.col("ss") == F.col("s") * F.col("s")), 0.0).otherwise(F.expr("(n * s1 - n1 * s) / (sqrt(double(n1) * (n - n1)) * sqrt(n * ss - s * s))"))
    numbers = [*ENCODED["number"], "skill_count"]
    filled = d.na.fill(0.0, numbers)
    own = lambda c: F.coalesce(F.when(F.stddev_pop(c) == 0, 0.0).otherwise(F.corr(c, TARGET)), F.lit(0.0))
    wide = filled.agg(*(own(c).alias(c) for c in numbers)).unpivot([], numbers, "encoded", "r")
    return g.select("encoded", r.alias("r")).union(wide).select("encoded", r4("r").alias("r"), r4(F.abs("r")).alias("abs_r"))


@over_postings("ag14_mode", ", g AS (SELECT industry, education_required, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, education_required) AS k FROM g) SELECT industry, education_required AS dominant, n::BIGINT AS records FROM r WHERE k = 1")
def dominant(p):
    g = p.groupBy("industry", "education_required").agg(F.count("*").alias("records"))
    return g.groupBy("industry").agg(F.min_by("education_required", F.struct(-F.col("records"), "education_required")).alias("dominant"), F.max("records").alias("records"))


_KINDS = {**dict.fromkeys(TEXT, "string"), **dict.fromkeys(NUMERIC, "double"), **dict.fromkeys(("posting_year", "posting_month"), "int"), **dict.fromkeys(FLAGS, "boolean")}


@over_postings("ag16_column_profile", ", x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, '{_KINDS[c]}' AS dtype, count(DISTINCT {c})::BIGINT AS n_unique, round(100.0::DOUBLE * count(DISTINCT {c}) / count(*), 4) AS unique_pct, (count(*) - count({c}))::BIGINT AS n_missing, count(*) FILTER (WHERE {c} IS NULL OR lower(trim({c}::VARCHAR)) IN {_HIDDEN})::BIGINT AS n_hidden FROM p" for c in CONTRACT))
def column_profile(p):
    """Type, distinct values, missing and hidden missing ones of every column: each column's values are grouped once, then counted."""
    kinds = dict(p.dtypes)
    long = p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"), F.col(c).cast("string").alias("v")) for c in CONTRACT))))
    hidden = F.col("v").isNull() | F.expr(f"lower(trim(v)) IN {_HIDDEN}")
    g = long.groupBy("feature", "dtype", "v").agg(F.count("*").alias("n")).withColumn("h", F.when(hidden, F.col("n")).otherwise(0))
    g = g.groupBy("feature", "dtype").agg(F.count("v").alias("n_unique"), F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.sum("h").alias("n_hidden"))
    return g.select("feature", "dtype", "n_unique", r4(100.0 * F.col("n_unique") / F.col("t")).alias("unique_pct"), "n_missing", "n_hidden")


@over_postings("ag17_duplicates", ", g AS (SELECT job_title, country, period, count(*) AS n, min(job_id::BIGINT) AS first_id FROM p GROUP BY ALL) SELECT job_title, country, period, n::BIGINT AS copies, first_id::BIGINT AS first_id FROM g WHERE n > 1")
def duplicates(p):
    """Records alike in title, country and period; the first of them stands for all."""
    return p.groupBy("job_title", "country", "period").agg(F.count("*").alias("copies"), F.min(F.col("job_id").cast("long")).alias("first_id")).filter("copies > 1")


@over_postings("ag21_monthly_split", ", m AS (SELECT max(period) AS last FROM p) SELECT period, count(*)::BIGINT AS records, count(*) FILTER (WHERE period < last)::BIGINT AS development, count(*) FILTER (WHERE period = last)::BIGINT AS locked FROM p CROSS JOIN m GROUP BY 1")
def monthly_split(p):
    g = p.groupBy("period").agg(F.count("*").alias("records"))
    last = F.col("period") == F.col("last")
    return g.crossJoin(F.broadcast(g.agg(F.max("period").alias("last")))).select("period", "records", F.when(~last, F.col("records")).otherwise(0).alias("development"), F.when(last, F.col("records")).otherwise(0).alias("locked"))


@over_postings("ag22_stacked_slices", f", x AS (SELECT *, {SQL_REPORT_BAND} AS band FROM p) SELECT CASE WHEN grouping(job_category) = 0 THEN 'job_category' WHEN grouping(country) = 0 THEN 'country' WHEN grouping(remote_work) = 0 THEN 'remote_work' ELSE 'band' END AS dimension, coalesce(job_category, country, remote_work, band) AS value, {SQL_STATS} FROM x GROUP BY GROUPING SETS ((job_category), (country), (remote_work), (band))")
def stacked_slices(p):
    dims = ["job_category", "country", "remote_work", "band"]
    x = p.withColumn("band", report_band(F.col("years_of_experience")))
    long = x.select(TARGET, F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dims))))
    return salary_stats(long, "dimension", "value")


def skill_rows(p: DataFrame) -> DataFrame:
    """A row for each record and token; records without skills have none."""
    return p.select("job_id", TARGET, F.explode(skill_tokens(F.col("required_skills"))).alias("skill"))


SQL_SKILLS = f"skills AS (SELECT job_id, annual_salary_usd, unnest({SQL_TOKENS}) AS skill FROM p)"


@over_postings("ag23_skill_stats", f", {SQL_SKILLS} SELECT skill, {SQL_STATS} FROM skills GROUP BY 1")
def skill_stats(p):
    return salary_stats(skill_rows(p), "skill")


@over_postings("ag24_skill_correlations", f", {SQL_SKILLS}, t AS (SELECT count(*) AS n, sum(annual_salary_usd) AS s, sum(annual_salary_usd * annual_salary_usd) AS ss FROM p), g AS (SELECT skill, count(*) AS n1, sum(annual_salary_usd) AS s1 FROM skills GROUP BY 1) SELECT skill, n1::BIGINT AS records, round((n * s1 - n1 * s) / (sqrt(n1::DOUBLE * (n - n1)) * sqrt(n * ss - s * s)), 4) AS r FROM g CROSS JOIN t")
def skill_correlations(p):
    """Point-biserial r of each token from sums alone: no 0/1 matrix."""
    y = F.col(TARGET)
    t = p.agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    g = skill_rows(p).groupBy("skill").agg(F.count("*").alias("records"), F.sum(TARGET).alias("s1")).crossJoin(F.broadcast(t))
    r = F.expr("(n * s1 - records * s) / (sqrt(double(records) * (n - records)) * sqrt(n * ss - s * s))")
    return g.select("skill", "records", r4(r).alias("r"))


@over_postings("ag25_missing_months", ", x AS (SELECT city, min(period) AS lo, max(period) AS hi, list_sort(list(DISTINCT period)) AS have FROM p GROUP BY 1), y AS (SELECT *, list_transform(generate_series((lo || '-01')::DATE, (hi || '-01')::DATE, INTERVAL 1 MONTH), lambda d: strftime(d, '%Y-%m')) AS every FROM x) SELECT city, lo AS first_period, hi AS last_period, len(have)::BIGINT AS n_periods, array_to_string(list_filter(every, lambda m: NOT list_contains(have, m)), ',') AS missing FROM y")
def missing_months(p):
    """Calendar months without records between a city's first and last."""
    x = p.groupBy("city").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.sort_array(F.collect_set("period")).alias("have"))
    every = F.transform(F.sequence(F.to_date(F.concat("first_period", F.lit("-01"))), F.to_date(F.concat("last_period", F.lit("-01"))), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    return x.select("city", "first_period", "last_period", F.size("have").cast("long").alias("n_periods"), F.array_join(F.array_except(every, "have"), ",").alias("missing"))


@over_postings("ag29_option_domains", ", x AS (SELECT 1) SELECT country, array_to_string(list_sort(list(DISTINCT city)), ',') AS cities, min(years_of_experience) AS min_years, max(years_of_experience) AS max_years, round(median(years_of_experience), 4) AS median_years FROM p GROUP BY 1")
def option_domains(p):
    return p.groupBy("country").agg(F.array_join(F.sort_array(F.collect_set("city")), ",").alias("cities"), F.min("years_of_experience").alias("min_years"), F.max("years_of_experience").alias("max_years"), r4(F.median("years_of_experience")).alias("median_years"))


@over_postings("ag30_policy_support", ", x AS (SELECT 1) SELECT job_category, job_title, count(*)::BIGINT AS support, min(years_of_experience) AS min_years, max(years_of_experience) AS max_years, round(median(years_of_experience), 4) AS median_years FROM p GROUP BY ALL")
def policy_support(p):
    return p.groupBy("job_category", "job_title").agg(F.count("*").alias("support"), F.min("years_of_experience").alias("min_years"), F.max("years_of_experience").alias("max_years"), r4(F.median("years_of_experience")).alias("median_years"))


@over_tables("ag28_sample_summary", "SELECT event_type, count(*)::BIGINT AS calls, round(min(value), 4) AS low, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS high, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(count(*) / sum(value), 4) AS per_unit FROM events GROUP BY 1")
def sample_summary(spark, sf_dir):
    """Summary of timed samples: spread, tail and throughput."""
    e = table(spark, sf_dir, "events").groupBy("event_type")
    v = lambda s: r4(q("value", s))
    return e.agg(F.count("*").alias("calls"), r4(F.min("value")).alias("low"), v(0.5).alias("p50"), v(0.9).alias("p90"), v(0.95).alias("p95"), r4(F.max("value")).alias("high"), r4(F.avg("value")).alias("mean"), r4(F.stddev_pop("value")).alias("sd"), r4(F.count("*") / F.sum("value")).alias("per_unit"))


@over_tables("ag26_null_sums", "SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS spent, min(event_type) AS first_type FROM events GROUP BY 1")
def null_sums(spark, sf_dir):
    """A sum of nothing is null, not zero."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r4(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))).alias("spent"), F.min("event_type").alias("first_type"))
