"""Joins, windows, sorts, set operations and scalar functions over the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.plans.audit import SQL_SKILLS, SQL_TOKENS, TARGET, skill_rows, skill_tokens
from tidewright.plans.base import money_mean, over_postings, over_tables, r4, sql_money_mean, table

# -- joins


@over_postings("jn01_family_counts", ", f(family, total) AS (VALUES ('BUILDING', 10), ('MACHINERY', 7), ('NONE SUCH', 3)), g AS (SELECT job_category, count(DISTINCT job_title) AS n FROM p GROUP BY 1) SELECT family, total::INTEGER AS total, coalesce(n, 0)::BIGINT AS selected FROM f LEFT JOIN g ON family = job_category")
def family_counts(p):
    """Totals by family and how many were selected; none is zero."""
    f = p.sparkSession.createDataFrame([("BUILDING", 10), ("MACHINERY", 7), ("NONE SUCH", 3)], "family string, total int")
    g = p.groupBy("job_category").agg(F.count_distinct("job_title").alias("n"))
    return f.join(g, F.col("family") == F.col("job_category"), "left").select("family", "total", F.coalesce("n", F.lit(0)).alias("selected"))


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails where a key of the right side isn't unique."""
    marked = right.withColumn("__rows", F.count("*").over(W.partitionBy(*on)))
    checked = marked.filter(F.when(F.col("__rows") > 1, F.raise_error(F.lit("a key of the right side is repeated")).cast("boolean")).otherwise(True)).drop("__rows")
    return left.join(checked, on, "left")


@over_postings("jn02_many_to_one", ", g AS (SELECT country, count(*) AS n FROM p GROUP BY 1) SELECT job_id, country, n::BIGINT AS country_records FROM p LEFT JOIN g USING (country)")
def many_to_one(p):
    g = p.groupBy("country").agg(F.count("*").alias("country_records"))
    return join_many_to_one(p.select("job_id", "country"), g, ["country"])


@over_postings("jn06_required_lookup", ", b AS (SELECT min(period) AS lo FROM p), d AS (SELECT DISTINCT period FROM p) SELECT period, ((left(period, 4)::INTEGER - left(lo, 4)::INTEGER) * 12 + right(period, 2)::INTEGER - right(lo, 2)::INTEGER)::INTEGER AS months_in FROM d CROSS JOIN b")
def required_lookup(p):
    months = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    d = p.select("period").distinct()
    return d.crossJoin(F.broadcast(d.agg(F.min("period").alias("lo")))).select("period", (months("period") - months("lo")).alias("months_in"))


@over_postings("jn07_optional_map", ", x AS (SELECT 1) SELECT job_id, coalesce(CASE remote_work WHEN 'F' THEN 'on site' WHEN 'O' THEN 'remote' END, 'other') AS place FROM p")
def optional_map(p):
    names = F.create_map(F.lit("F"), F.lit("on site"), F.lit("O"), F.lit("remote"))
    return p.select("job_id", F.coalesce(F.try_element_at(names, F.col("remote_work")), F.lit("other")).alias("place"))


@over_postings("jn08_semi", ", k AS (SELECT job_category, job_title FROM p GROUP BY ALL HAVING avg(years_of_experience) > 7.5) SELECT job_id FROM p SEMI JOIN k USING (job_category, job_title)")
def semi(p):
    k = p.groupBy("job_category", "job_title").agg(F.avg("years_of_experience").alias("m")).filter("m > 7.5")
    return p.join(k, ["job_category", "job_title"], "left_semi").select("job_id")


@over_postings("jn09_anti", ", x AS (SELECT 1) SELECT job_id FROM p WHERE period < '2001-07' AND job_id NOT IN (SELECT job_id FROM p WHERE posting_year IN (1996, 1998))")
def anti(p):
    """Records not used yet: all before a month, without those of the years already used."""
    used = p.filter(F.col("posting_year").isin(1996, 1998)).select("job_id")
    return p.filter("period < '2001-07'").select("job_id").join(used, "job_id", "left_anti")


_NUM = ["annual_salary_usd", "salary_min_usd", "salary_max_usd", "years_of_experience", "demand_score", "benefits_score_10"]


@over_postings("jn10_redundant_pairs", ", x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS r FROM p) WHERE abs(r) >= 0.05" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def redundant_pairs(p):
    """Unordered column pairs with a large correlation: all pairs in one pass of the records."""
    pairs = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
    one = p.agg(*(r4(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r").filter("abs(r) >= 0.05")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("feature_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("feature_b"), "r")


@over_postings("jn11_pareto", ", g AS (SELECT country, avg(annual_salary_usd) AS pay, avg(years_of_experience) AS years FROM p GROUP BY 1) SELECT a.country, coalesce(string_agg(b.country, ',' ORDER BY b.country), '') AS dominated_by, count(b.country) = 0 AS on_front FROM g a LEFT JOIN g b ON b.pay >= a.pay AND b.years <= a.years AND (b.pay > a.pay OR b.years < a.years) GROUP BY a.country")
def pareto(p):
    """Groups that no other beats in both measures, and which do for the rest (a row a country on either side)."""
    g = p.groupBy("country").agg(F.avg(TARGET).alias("pay"), F.avg("years_of_experience").alias("years"))
    a, b = g.alias("a"), F.broadcast(g).alias("b")
    beats = F.expr("b.pay >= a.pay AND b.years <= a.years AND (b.pay > a.pay OR b.years < a.years)")
    out = a.join(b, beats, "left").groupBy(F.col("a.country").alias("country")).agg(F.array_join(F.sort_array(F.collect_list("b.country")), ",").alias("dominated_by"), (F.count("b.country") == 0).alias("on_front"))
    return out


_FOLDS = [("outer_1", "1999-01"), ("outer_2", "2000-01"), ("outer_3", "2001-01")]


@over_postings("jn13_expanding_folds", ", f(fold_id, month) AS (VALUES " + ", ".join(map(str, _FOLDS)) + ") SELECT fold_id, CASE WHEN period = month THEN 'validation' ELSE 'train' END AS role, count(*)::BIGINT AS records, min(period) AS first_period, max(period) AS last_period FROM p JOIN f ON period <= month GROUP BY ALL")
def expanding_folds(p):
    """Range join of records and folds: history before the validation month, and the month."""
    f = F.broadcast(p.sparkSession.createDataFrame(_FOLDS, "fold_id string, month string"))
    role = F.when(F.col("period") == F.col("month"), "validation").otherwise("train")
    return p.join(f, F.col("period") <= F.col("month")).groupBy("fold_id", role.alias("role")).agg(F.count("*").alias("records"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@over_postings("jn14_densified", ", a AS (SELECT DISTINCT period FROM p), b AS (SELECT DISTINCT country FROM p), g AS (SELECT period, country, count(*) AS n FROM p GROUP BY ALL) SELECT period, country, coalesce(n, 0)::BIGINT AS records FROM a CROSS JOIN b LEFT JOIN g USING (period, country)")
def densified(p):
    """Every period with every country, from the counts alone."""
    g = p.groupBy("period", "country").agg(F.count("*").alias("n"))
    grid = g.select("period").distinct().crossJoin(F.broadcast(g.select("country").distinct()))
    return grid.join(g, ["period", "country"], "left").select("period", "country", F.coalesce("n", F.lit(0)).alias("records"))


@over_postings("jn16_matched_pairs", ", g AS (SELECT posting_year AS fold, " + sql_money_mean("CASE WHEN is_senior THEN annual_salary_usd END") + " AS a, " + sql_money_mean("CASE WHEN NOT is_senior THEN annual_salary_usd END") + " AS b FROM p GROUP BY 1) SELECT fold, round(a, 4) AS full, round(b, 4) AS top2, round(b - a, 4) AS delta FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
def matched_pairs(p):
    wide = p.withColumn("variant", F.when(F.col("is_senior"), "full").otherwise("top2")).groupBy(F.col("posting_year").alias("fold")).pivot("variant", ["full", "top2"]).agg(money_mean(TARGET))
    return wide.filter("full is not null and top2 is not null").select("fold", r4("full").alias("full"), r4("top2").alias("top2"), r4(F.col("top2") - F.col("full")).alias("delta"))


@over_postings("jn17_symmetric_matrix", ", g AS (SELECT industry, country, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT a.country AS x, b.country AS y, least(a.n, b.n) AS v FROM g a JOIN g b ON a.industry = b.industry AND a.country < b.country) SELECT x, y, v::BIGINT AS v FROM c UNION ALL SELECT y, x, v::BIGINT FROM c UNION ALL SELECT country, country, n::BIGINT FROM g")
def symmetric_matrix(p):
    """The upper half of a matrix completed by its mirror and the diagonal."""
    g = p.groupBy("industry", "country").agg(F.count("*").alias("n"))
    a, b = g.alias("a"), g.alias("b")
    half = a.join(b, F.expr("a.industry = b.industry AND a.country < b.country")).select(F.col("a.country").alias("x"), F.col("b.country").alias("y"), F.least("a.n", "b.n").alias("v"))
    return half.union(half.select(F.col("y"), F.col("x"), "v")).union(g.select("country", "country", "n"))


# -- windows


@over_postings("wn01_average_rank", ", g AS (SELECT country, round(avg(benefits_score_10), 1) AS v FROM p GROUP BY 1) SELECT country, v, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct_asc, round((rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct_desc FROM g")
def average_rank(p):
    """Percentile rank with ties at their mean place, which percent_rank() isn't (a row a country)."""
    g = p.groupBy("country").agg(F.round(F.avg("benefits_score_10"), 1).alias("v"))
    n, ties = F.count("*").over(W.partitionBy()), F.count("*").over(W.partitionBy("v"))
    pct = lambda order: F.round((F.rank().over(W.orderBy(order)) + (ties - 1) / 2.0) / n, 6)
    return g.select("country", "v", pct("v").alias("pct_asc"), pct(F.desc("v")).alias("pct_desc"))


@over_postings("wn02_competition_rank", ", g AS (SELECT industry, country, count(*) AS n FROM p GROUP BY ALL) SELECT industry, country, n::BIGINT AS records, rank() OVER (PARTITION BY industry ORDER BY n DESC)::INTEGER AS place FROM g")
def competition_rank(p):
    g = p.groupBy("industry", "country").agg(F.count("*").alias("records"))
    return g.withColumn("place", F.rank().over(W.partitionBy("industry").orderBy(F.desc("records"))))


@over_postings("wn03_top_of_group", ", g AS (SELECT country, job_title, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, job_title) AS place FROM g) SELECT country, job_title, n::BIGINT AS records, place::INTEGER AS place FROM r WHERE place <= 3")
def top_of_group(p):
    g = p.groupBy("country", "job_title").agg(F.count("*").alias("records"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("country").orderBy(F.desc("records"), "job_title"))).filter("place <= 3")


@over_postings("wn05_cumulative_share", ", g AS (SELECT country, count(*) AS n FROM p GROUP BY 1) SELECT country, n::BIGINT AS records, round(sum(n) OVER (ORDER BY n DESC, country)::DOUBLE / sum(n) OVER (), 6) AS running, round(row_number() OVER (ORDER BY n DESC, country)::DOUBLE / count(*) OVER (), 6) AS ecdf FROM g")
def cumulative_share(p):
    g = p.groupBy("country").agg(F.count("*").alias("records"))
    order, every = W.orderBy(F.desc("records"), "country"), W.partitionBy()
    rows = order.rowsBetween(W.unboundedPreceding, 0)
    return g.select("country", "records", F.round(F.sum("records").over(rows) / F.sum("records").over(every), 6).alias("running"), F.round(F.row_number().over(order) / F.count("*").over(every), 6).alias("ecdf"))


@over_postings("wn06_change_from_previous", ", g AS (SELECT country, posting_year, count(*) AS n FROM p GROUP BY ALL) SELECT country, posting_year, n::BIGINT AS records, (n - lag(n) OVER (PARTITION BY country ORDER BY posting_year))::BIGINT AS added FROM g")
def change_from_previous(p):
    g = p.groupBy("country", "posting_year").agg(F.count("*").alias("records"))
    return g.withColumn("added", F.col("records") - F.lag("records").over(W.partitionBy("country").orderBy("posting_year")))


# -- sorts and limits


@over_postings("sl01_mixed_sort", ", g AS (SELECT country, industry, count(*) AS n, avg(demand_score) AS d FROM p GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, d DESC NULLS LAST, country) AS place, country, n::BIGINT AS records FROM g")
def mixed_sort(p):
    """Several keys in both directions, nulls last; the place stands for the order."""
    g = p.groupBy("country", "industry").agg(F.count("*").alias("records"), F.avg("demand_score").alias("d"))
    return g.select(F.row_number().over(W.orderBy(F.desc("records"), F.desc_nulls_last("d"), "country")).cast("long").alias("place"), "country", "records")


@over_postings("sl03_largest", ", x AS (SELECT 1) SELECT job_id, annual_salary_usd FROM p ORDER BY annual_salary_usd DESC, job_id LIMIT 15")
def largest(p):
    return p.select("job_id", TARGET).orderBy(F.desc(TARGET), "job_id").limit(15)


@over_postings("sl04_best_and_worst", ", a AS (SELECT job_id, annual_salary_usd FROM p ORDER BY annual_salary_usd DESC, job_id LIMIT 5), b AS (SELECT job_id, annual_salary_usd FROM p ORDER BY annual_salary_usd, job_id LIMIT 5) SELECT * FROM a UNION SELECT * FROM b")
def best_and_worst(p):
    x = p.select("job_id", TARGET)
    return x.orderBy(F.desc(TARGET), "job_id").limit(5).union(x.orderBy(TARGET, "job_id").limit(5)).distinct()


@over_postings("sl05_page", ", x AS (SELECT 1) SELECT job_id, period FROM p ORDER BY period, job_id::BIGINT LIMIT 10 OFFSET 20")
def page(p):
    return p.orderBy("period", F.col("job_id").cast("long")).offset(20).limit(10).select("job_id", "period")


@over_postings("sl06_null_is_last", ", x AS (SELECT 1) SELECT job_id, demand_score FROM p ORDER BY demand_score NULLS LAST, job_id LIMIT 25")
def null_is_last(p):
    return p.orderBy(F.asc_nulls_last("demand_score"), "job_id").select("job_id", "demand_score").limit(25)


@over_tables("sl07_event_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY lower(event_type), CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id)::INTEGER AS place FROM events")
def event_order(spark, sf_dir):
    """Events of a user by folded type, its rank, time and id."""
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.lower("event_type"), rank, "ts", "event_id")).alias("place"))


@over_postings("sl09_seeded_sample", ", x AS (SELECT job_id FROM p WHERE annual_salary_usd > 100000) SELECT job_id FROM x ORDER BY md5(job_id || ':2026'), job_id LIMIT 100")
def seeded_sample(p):
    """A fixed sample of eligible records: the least by a seeded hash."""
    return p.filter(F.col(TARGET) > 100000).select("job_id").orderBy(F.md5(F.concat("job_id", F.lit(":2026"))), "job_id").limit(100)


# -- set operations


@over_postings("st01_union_all", ", x AS (SELECT 1) SELECT country AS value, 'country' AS kind FROM p UNION ALL SELECT industry, 'industry' FROM p")
def union_all(p):
    return p.select(F.col("country").alias("value"), F.lit("country").alias("kind")).unionByName(p.select(F.lit("industry").alias("kind"), F.col("industry").alias("value")))


@over_postings("st02_union_by_name", ", a AS (SELECT country, count(*)::BIGINT AS records FROM p GROUP BY 1), b AS (SELECT country, round(avg(years_of_experience), 4) AS years FROM p WHERE is_senior GROUP BY 1) SELECT country, records, NULL::DOUBLE AS years FROM a UNION ALL SELECT country, NULL, years FROM b")
def union_by_name(p):
    a = p.groupBy("country").agg(F.count("*").alias("records"))
    b = p.filter("is_senior").groupBy("country").agg(r4(F.avg("years_of_experience")).alias("years"))
    return a.unionByName(b, allowMissingColumns=True)


@over_postings("st03_except_intersect", ", a AS (SELECT DISTINCT city FROM p WHERE posting_year = 1996 AND annual_salary_usd > 470000), b AS (SELECT DISTINCT city FROM p WHERE posting_year = 1997 AND annual_salary_usd > 470000) SELECT 'both' AS part, city FROM (SELECT city FROM a INTERSECT SELECT city FROM b) UNION ALL SELECT 'gone', city FROM (SELECT city FROM a EXCEPT SELECT city FROM b)")
def except_intersect(p):
    of = lambda y: p.filter((F.col("posting_year") == y) & (F.col(TARGET) > 470000)).select("city")
    a, b = of(1996), of(1997)
    return a.intersect(b).select(F.lit("both").alias("part"), "city").union(a.subtract(b).select(F.lit("gone").alias("part"), "city"))


@over_postings("st04_distinct_profiles", ", x AS (SELECT 1) SELECT DISTINCT job_category, remote_work, company_size FROM p")
def distinct_profiles(p):
    return p.select("job_category", "remote_work", "company_size").distinct()


@over_postings("st05_cover_check", ", s(tier) AS (VALUES ('F'), ('O')), d AS (SELECT DISTINCT remote_work AS tier FROM p) SELECT 'not allowed' AS finding, tier AS value FROM (SELECT tier FROM d EXCEPT SELECT tier FROM s) UNION ALL SELECT 'not seen', tier FROM (SELECT tier FROM s EXCEPT SELECT tier FROM d)")
def cover_check(p):
    """Observed values against the allowed set, both ways; empty is a full cover."""
    s = p.sparkSession.createDataFrame([("F",), ("O",)], "value string")
    d = p.select(F.col("remote_work").alias("value")).distinct()
    return d.subtract(s).select(F.lit("not allowed").alias("finding"), "value").union(s.subtract(d).select(F.lit("not seen").alias("finding"), "value"))


# -- scalar functions


@over_postings("fn01_strings", f", x AS (SELECT 1) SELECT job_id, lower(trim(job_title)) AS folded, regexp_replace(lower(job_title), '[^a-z0-9]+', '-', 'g') AS slug, split_part(job_title, ':', 1) AS head, array_to_string({SQL_TOKENS}, '|') AS skills, lpad(job_id, 8, '0') AS padded, starts_with(job_title, 'B') AS starts_b, regexp_full_match(job_id, '[0-9]+') AS is_number, sha256(job_id) AS digest FROM p")
def strings(p):
    return p.select(
        "job_id",
        F.lower(F.trim("job_title")).alias("folded"),
        F.regexp_replace(F.lower("job_title"), "[^a-z0-9]+", "-").alias("slug"),
        F.split_part("job_title", F.lit(":"), F.lit(1)).alias("head"),
        F.array_join(skill_tokens(F.col("required_skills")), "|").alias("skills"),
        F.lpad("job_id", 8, "0").alias("padded"),
        F.startswith(F.col("job_title"), F.lit("B")).alias("starts_b"),
        F.rlike("job_id", F.lit("^[0-9]+$")).alias("is_number"),
        F.sha2("job_id", 256).alias("digest"),
    )


@over_postings("fn02_dates", ", x AS (SELECT 1) SELECT DISTINCT posting_year, posting_month, make_date(posting_year, posting_month, 1) AS month_start, strftime(make_date(posting_year, posting_month, 1) + INTERVAL 1 MONTH, '%Y-%m') AS next_period FROM p")
def dates(p):
    start = F.make_date("posting_year", "posting_month", F.lit(1))
    return p.select("posting_year", "posting_month").distinct().select("posting_year", "posting_month", start.alias("month_start"), F.date_format(F.add_months(start, 1), "yyyy-MM").alias("next_period"))


@over_postings("fn03_math", ", x AS (SELECT 1) SELECT job_id, abs(demand_growth_yoy_pct) AS size, round(sqrt(annual_salary_usd), 6) AS root, round(ln(annual_salary_usd), 6) AS log, floor(annual_salary_usd / 1000)::BIGINT AS thousands, ceil(annual_salary_usd / 1000)::BIGINT AS up, greatest(annual_salary_usd - 200000, 0) AS clipped, isfinite(annual_salary_usd) AS finite FROM p")
def math(p):
    s = F.col(TARGET)
    finite = ~F.isnan(s) & (F.abs(s) != float("inf"))
    return p.select("job_id", F.abs("demand_growth_yoy_pct").alias("size"), F.round(F.sqrt(s), 6).alias("root"), F.round(F.ln(s), 6).alias("log"), F.floor(s / 1000).alias("thousands"), F.ceil(s / 1000).alias("up"), F.greatest(s - 200000, F.lit(0.0)).alias("clipped"), finite.alias("finite"))


@over_postings("fn04_conversions", ", x AS (SELECT 1) SELECT job_id, TRY_CAST(job_id AS DOUBLE) AS number, TRY_CAST(job_title AS DOUBLE) AS none, TRY_CAST(split_part(city, '-', 2) AS INTEGER) AS branch FROM p")
def conversions(p):
    """Text that isn't a number is null; NaN would be too."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return p.select("job_id", number("job_id").alias("number"), number("job_title").alias("none"), F.split_part("city", F.lit("-"), F.lit(2)).try_cast("int").alias("branch"))


@over_postings("fn05_arrays", f", t AS (SELECT job_id, {SQL_TOKENS} AS a FROM p) SELECT job_id, len(a)::INTEGER AS n, list_contains(a, 'Brand#11') AS has_11, array_to_string(list_filter(a, lambda x: x <> 'Brand#11' AND x <> 'Brand#12'), '|') AS rest FROM t")
def arrays(p):
    a = skill_tokens(F.col("required_skills"))
    return p.select("job_id", F.when(a.isNotNull(), F.size(a)).alias("n"), F.array_contains(a, "Brand#11").alias("has_11"), F.array_join(F.array_except(a, F.array(F.lit("Brand#11"), F.lit("Brand#12"))), "|").alias("rest"))


@over_tables("fn06_json", "SELECT event_id, (props->>'$.k')::INTEGER AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS canonical FROM events")
def json_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("canonical"))


@over_postings("fn07_conditionals", ", x AS (SELECT 1) SELECT job_id, coalesce(demand_score, 0) AS demand, nullif(remote_work, 'P') AS place, CASE WHEN demand_score IS NULL THEN 'no lines' WHEN demand_score > 100 THEN 'large' ELSE 'small' END AS band FROM p")
def conditionals(p):
    band = F.when(F.col("demand_score").isNull(), "no lines").when(F.col("demand_score") > 100, "large").otherwise("small")
    return p.select("job_id", F.coalesce("demand_score", F.lit(0.0)).alias("demand"), F.nullif("remote_work", F.lit("P")).alias("place"), band.alias("band"))


@over_postings("fn08_skill_pairs", f", {SQL_SKILLS} SELECT a.skill AS skill_a, b.skill AS skill_b, count(*)::BIGINT AS records FROM skills a JOIN skills b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY ALL")
def skill_pairs(p):
    """Tokens of one record in pairs, made inside its row."""
    a = skill_tokens(F.col("required_skills"))
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: y > x), lambda y: F.struct(x.alias("skill_a"), y.alias("skill_b")))))
    return p.select(F.inline(pairs)).groupBy("skill_a", "skill_b").agg(F.count("*").alias("records"))


@over_postings("ag15_arg_extremes", f", {SQL_SKILLS}, g AS (SELECT skill, avg(annual_salary_usd) AS m, count(*) AS n FROM skills GROUP BY 1) SELECT arg_max(skill, m) AS best_skill, arg_min(skill, m) AS worst_skill, arg_max(skill, n * 1000 + length(skill)) AS commonest FROM g")
def arg_extremes(p):
    g = skill_rows(p).groupBy("skill").agg(F.avg(TARGET).alias("m"), F.count("*").alias("n"))
    return g.agg(F.max_by("skill", "m").alias("best_skill"), F.min_by("skill", "m").alias("worst_skill"), F.max_by("skill", F.col("n") * 1000 + F.length("skill")).alias("commonest"))
