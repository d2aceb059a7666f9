"""Serving: scenario policy, validation, prediction with an empirical band, growth inputs, exports and narratives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.audit import SQL_REPORT_BAND, TARGET, report_band
from tidewright.plans.base import ORACLES, POSTINGS_SQL, exact_quantiles, once, over_postings, over_tables, postings, r4, table
from tidewright.plans.evaluation import PREDICTORS, SQL_OOF, errors_of, fold_predictions, out_of_fold, uncertainty_of

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Years that a scenario may ask for beyond the observed ones, when it says that it is a benchmark.
BENCHMARK_YEARS = (0.0, 15.0)


def policy(p: DataFrame) -> DataFrame:
    """Observed (category, title) pairs with support and bounds of years."""
    return p.groupBy("job_category", "job_title").agg(F.count("*").alias("support"), F.min("years_of_experience").alias("min_years"), F.max("years_of_experience").alias("max_years"))


def policy_digest(rules: DataFrame) -> DataFrame:
    """One row, policy_hash: the SHA-256 of the policy's lines in order (a line a pair)."""
    number = lambda c: F.format_string("%.1f", c)
    line = F.concat_ws("|", "job_category", "job_title", F.col("support").cast("string"), number("min_years"), number("max_years"))
    return rules.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("policy_hash"))


SQL_DIGEST = "digest AS (SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS policy_hash FROM (SELECT job_category || '|' || job_title || '|' || support || '|' || printf('%.1f', min_years) || '|' || printf('%.1f', max_years) AS line FROM policy))"
SQL_POLICY = "policy AS (SELECT job_category, job_title, count(*) AS support, min(years_of_experience) AS min_years, max(years_of_experience) AS max_years FROM p GROUP BY ALL)"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One what-if request a customer: a category, a title of that or another category, years, and whether it is a benchmark, whose salary is known."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = F.element_at(F.array(*map(F.lit, PRIORITIES)), (key % 5 + 1).cast("int"))
    return c.select(key.alias("scenario_id"), F.col("c_mktsegment").alias("job_category"), F.concat_ws(":", F.when(key % 7 == 0, "BUILDING").otherwise(F.col("c_mktsegment")), own).alias("job_title"), F.when(key % 11 > 0, (key % 19 - 2).cast("double")).alias("years"), (key % 2 == 0).alias("benchmark"), F.when(key % 2 == 0, F.round(F.abs("c_acctbal") * 20, 2)).alias("actual"))


SQL_SCENARIOS = f"s AS (SELECT c_custkey AS scenario_id, c_mktsegment AS job_category, CASE WHEN c_custkey % 7 = 0 THEN 'BUILDING' ELSE c_mktsegment END || ':' || ({PRIORITIES})[c_custkey % 5 + 1] AS job_title, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 19 - 2)::DOUBLE END AS years, c_custkey % 2 = 0 AS benchmark, CASE WHEN c_custkey % 2 = 0 THEN round(abs(c_acctbal) * 20, 2) END AS actual FROM customer)"


def validated(s: DataFrame, rules: DataFrame) -> DataFrame:
    """s with validation_mode (observed, benchmark or rejected) and the reason of a rejection."""
    x = s.join(rules, ["job_category", "job_title"], "left")
    inside, lenient = F.col("years").between(F.col("min_years"), F.col("max_years")), F.col("benchmark") & F.col("years").between(*BENCHMARK_YEARS)
    reason = F.when(F.col("support").isNull(), "pair not observed").when(F.col("years").isNull() | F.isnan("years"), "years missing").when(~inside & ~lenient, "years out of bounds")
    mode = F.when(reason.isNotNull(), "rejected").when(inside, "observed").otherwise("benchmark")
    return x.withColumns({"validation_mode": mode, "reason": reason})


SQL_VALIDATED = f"""{SQL_POLICY}, {SQL_SCENARIOS}, j AS (SELECT s.*, support, years BETWEEN min_years AND max_years AS inside, benchmark AND years BETWEEN 0 AND 15 AS lenient, min_years, max_years FROM s LEFT JOIN policy USING (job_category, job_title)),
v AS (SELECT *, CASE WHEN support IS NULL THEN 'pair not observed' WHEN years IS NULL THEN 'years missing' WHEN NOT inside AND NOT lenient THEN 'years out of bounds' END AS reason FROM j),
validated AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN inside THEN 'observed' ELSE 'benchmark' END AS validation_mode FROM v)"""


@over_tables("sv02_validate_scenarios", f"WITH RECURSIVE {POSTINGS_SQL}, {SQL_VALIDATED} SELECT scenario_id, job_category, job_title, years, validation_mode, reason FROM validated")
def validate_scenarios(spark, sf_dir):
    return validated(scenarios(spark, sf_dir), policy(postings(spark, sf_dir))).select("scenario_id", "job_category", "job_title", "years", "validation_mode", "reason")


#: The columns of records that served predictions and conclusions read.
READ = ["job_id", "period", "job_category", "job_title", "country", "remote_work", "years_of_experience", TARGET]


def predictions(spark: SparkSession, sf_dir: str, p: DataFrame | None = None, oof: DataFrame | None = None) -> DataFrame:
    """Accepted scenarios with the two-feature prediction and its band: the out-of-fold error's ninth decile either way, not under zero.

    The records and their out_of_fold() may be given.
    """
    p = once(postings(spark, sf_dir).select(*READ)) if p is None else p
    oof = out_of_fold(p) if oof is None else oof
    own = exact_quantiles(p.withColumn("band", report_band(F.col("years_of_experience"))), ["job_category", "band"], TARGET, {"predicted": 0.5})
    e = exact_quantiles(oof.select(F.abs(F.col("actual") - F.col("predicted")).alias("error")), [], "error", {"q90": 0.9})
    ok = validated(scenarios(spark, sf_dir), policy(p)).filter("validation_mode <> 'rejected'").withColumn("band", report_band(F.col("years")))
    out = ok.join(own, ["job_category", "band"]).crossJoin(F.broadcast(e))  # one row
    return out.withColumns({"lower": F.greatest(F.lit(0.0), F.col("predicted") - F.col("q90")), "upper": F.col("predicted") + F.col("q90")})


SQL_PREDICTED = f"""{SQL_VALIDATED}, {SQL_OOF}, own AS (SELECT job_category, band, median(annual_salary_usd) AS predicted FROM x GROUP BY ALL), q AS (SELECT quantile_cont(abs(actual - predicted), 0.9) AS q90 FROM oof),
ok AS (SELECT *, {SQL_REPORT_BAND.replace("years_of_experience", "years")} AS band FROM validated WHERE validation_mode <> 'rejected'),
served AS (SELECT ok.*, own.predicted, q90, greatest(0, own.predicted - q90) AS lower, own.predicted + q90 AS upper FROM ok JOIN own ON ok.job_category = own.job_category AND ok.band = own.band CROSS JOIN q)"""


@over_tables("sv03_predict", f"WITH RECURSIVE {POSTINGS_SQL}, {SQL_PREDICTED} SELECT scenario_id, round(predicted, 4) AS predicted, round(lower, 4) AS lower, round(upper, 4) AS upper FROM served")
def predict(spark, sf_dir):
    return shown(predictions(spark, sf_dir))


def shown(served: DataFrame) -> DataFrame:
    return served.select("scenario_id", r4("predicted").alias("predicted"), r4("lower").alias("lower"), r4("upper").alias("upper"))


@over_tables("sv04_growth_inputs", f"WITH RECURSIVE {POSTINGS_SQL}, {SQL_VALIDATED} SELECT scenario_id, unnest(list_sort(list_distinct(list_concat(CASE WHEN benchmark THEN list_transform(range(0, 16), lambda i: i::DOUBLE) ELSE list_transform(range(ceil(min_years)::BIGINT, floor(max_years)::BIGINT + 1), lambda i: i::DOUBLE) END, [min_years, max_years])))) AS years FROM validated WHERE validation_mode <> 'rejected'")
def growth_inputs(spark, sf_dir):
    """Whole years between the bounds of a scenario's title, and the bounds; a benchmark's from 0 to 15."""
    v = validated(scenarios(spark, sf_dir), policy(postings(spark, sf_dir))).filter("validation_mode <> 'rejected'")
    lo, hi = F.when(F.col("benchmark"), 0).otherwise(F.ceil("min_years")), F.when(F.col("benchmark"), 15).otherwise(F.floor("max_years"))
    years = F.array_distinct(F.concat(F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda i: i.cast("double")), F.array("min_years", "max_years")))
    return v.select("scenario_id", F.explode(years).alias("years"))


#: The export's columns. Names and order are fixed values of its format.
EXPORT = ["schema_version", "scenario_id", "source", "record_id", "evidence_id", "model_id", "feature_variant", "policy_hash", "job_title", "job_category", "years_of_experience", "validation_mode", "exception_reason", "predicted_salary_usd", "lower_bound_usd", "upper_bound_usd", "q90_abs_error_usd", "q90_basis", "actual_salary_usd", "absolute_error_usd", "signed_variance_pct"]
MODEL, EVIDENCE, BASIS = "group-median", "out-of-fold", "historical_test_absolute_errors"
_AMOUNTS = {"predicted_salary_usd": "predicted", "lower_bound_usd": "lower", "upper_bound_usd": "upper", "q90_abs_error_usd": "q90", "actual_salary_usd": "actual", "absolute_error_usd": "abs(predicted - actual)"}
_SQL_EXPORT = {
    "schema_version": "'1'", "scenario_id": "scenario_id::VARCHAR", "source": "CASE WHEN benchmark THEN 'benchmark' ELSE 'manual' END", "record_id": "CASE WHEN benchmark THEN scenario_id::VARCHAR ELSE '' END",
    "evidence_id": f"'{EVIDENCE}'", "model_id": f"'{MODEL}'", "feature_variant": "'top2'", "policy_hash": "policy_hash", "job_title": "job_title", "job_category": "job_category", "years_of_experience": "printf('%.1f', years)",
    "validation_mode": "validation_mode", "exception_reason": "CASE WHEN validation_mode = 'benchmark' THEN 'years out of bounds' ELSE '' END",
    **{c: f"coalesce(printf('%.2f', floor(round({v}, 4) * 100 + 0.5) / 100), '')" for c, v in _AMOUNTS.items()},
    "q90_basis": f"'{BASIS}'", "signed_variance_pct": "coalesce(printf('%.4f', floor(round(CASE WHEN actual > 0 THEN 100.0::DOUBLE * (predicted - actual) / actual END, 7) * 10000 + 0.5) / 10000), '')",
}


@over_tables("snk06_prediction_audit", f"WITH RECURSIVE {POSTINGS_SQL}, {SQL_PREDICTED}, {SQL_DIGEST} SELECT {', '.join(f'{_SQL_EXPORT[c]} AS {c}' for c in EXPORT)} FROM served CROSS JOIN digest")
def prediction_audit(spark, sf_dir):
    """The export's columns, all text: amounts with two decimals, the variance with four, nothing for null."""
    digest = policy_digest(policy(postings(spark, sf_dir)))
    x = predictions(spark, sf_dir).crossJoin(F.broadcast(digest))  # one row
    half_up = lambda c, n: F.floor(F.round(c, n + 2 + (n > 2)) * 10**n + 0.5) / 10**n
    shown = lambda c, n: F.when(c.isNotNull(), F.format_string(f"%.{n}f", half_up(c, n))).otherwise("")
    id_ = F.col("scenario_id").cast("string")
    own = {
        "schema_version": F.lit("1"), "scenario_id": id_, "source": F.when(F.col("benchmark"), "benchmark").otherwise("manual"), "record_id": F.when(F.col("benchmark"), id_).otherwise(""),
        "evidence_id": F.lit(EVIDENCE), "model_id": F.lit(MODEL), "feature_variant": F.lit("top2"), "years_of_experience": F.format_string("%.1f", "years"),
        "exception_reason": F.when(F.col("validation_mode") == "benchmark", "years out of bounds").otherwise(""), "q90_basis": F.lit(BASIS),
        **{c: shown(F.expr(v), 2) for c, v in _AMOUNTS.items()},
        "signed_variance_pct": shown(F.when(F.col("actual") > 0, 100.0 * (F.col("predicted") - F.col("actual")) / F.col("actual")), 4),
    }
    return x.select(*((own[c] if c in own else F.col(c)).alias(c) for c in EXPORT))


@over_tables("sv01_policy_digest", f"WITH RECURSIVE {POSTINGS_SQL}, {SQL_POLICY}, {SQL_DIGEST} SELECT policy_hash, (SELECT count(*) FROM policy)::BIGINT AS pairs FROM digest")
def policy_hash(spark, sf_dir):
    rules = policy(postings(spark, sf_dir))
    return policy_digest(rules).crossJoin(rules.agg(F.count("*").alias("pairs")))  # one row each


@over_postings("sv05_narrative", f", {SQL_OOF}, e AS (SELECT fold, avg(abs(actual - predicted)) AS m, avg(abs(actual - baseline)) AS d FROM oof GROUP BY 1) SELECT 'fold ' || fold || ': the model is ' || CASE WHEN m < d THEN 'ahead of' ELSE 'not ahead of' END || ' the baseline by ' || printf('%.1f', round(abs(100 * (d - m) / d), 1)) || ' %' AS line FROM e")
def narrative(p):
    """A sentence a fold, from the table behind it."""
    e = out_of_fold(p).groupBy("fold").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("m"), F.avg(F.abs(F.col("actual") - F.col("baseline"))).alias("d"))
    side = F.when(F.col("m") < F.col("d"), "ahead of").otherwise("not ahead of")
    gap = F.format_string("%.1f", F.round(F.abs(100 * (F.col("d") - F.col("m")) / F.col("d")), 1))
    return e.select(F.concat(F.lit("fold "), F.col("fold").cast("string"), F.lit(": the model is "), side, F.lit(" the baseline by "), gap, F.lit(" %")).alias("line"))


#: The predictor that stands for a model with all features, and the one for a smaller variant, in the conclusions.
WHOLE, SMALLER = "Category and Band", "Band"


def _words(n: int, c: str) -> str:
    return f"printf('%.{n}f', round({c}, {n}))"


_SQL_CONCLUSIONS = f"""
WITH e AS (SELECT * FROM ({ORACLES["ml22_predictor_errors"]})), m AS (SELECT model, avg(mae) AS mae FROM e GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mae, model) AS k FROM m),
own AS (SELECT fold, mae, max(fold) OVER () AS last FROM e WHERE model = '{WHOLE}'), u AS ({ORACLES["ag27_uncertainty"]}), s AS ({ORACLES["sv03_predict"]})
SELECT 'ranking' AS kind, a.model || ' has the least mean error, ' || {_words(0, "a.mae")} || '; ' || b.model || ' is ' || {_words(0, "b.mae - a.mae")} || ' behind; ' || {_words(1, "100 * (d.mae - a.mae) / d.mae")} || ' % below the dummy' AS finding
  FROM o a JOIN o b ON a.k = 1 AND b.k = 2 JOIN m d ON d.model = 'Dummy Median'
UNION ALL SELECT 'folds', 'fold ' || arg_max(fold, mae) || ' is the weakest, ' || {_words(0, "max(mae)")} || '; errors span ' || {_words(0, "max(mae) - min(mae)")} FROM own
UNION ALL SELECT 'generalisation', 'the last fold''s error ' || CASE WHEN a > b THEN 'increased' WHEN a < b THEN 'decreased' ELSE 'was unchanged' END || ' by ' || {_words(0, "abs(a - b)")} FROM (SELECT avg(CASE WHEN fold = last THEN mae END) AS a, avg(CASE WHEN fold < last THEN mae END) AS b FROM own)
UNION ALL SELECT 'coverage', 'a band of ' || {_words(0, "q90")} || ' covers ' || {_words(1, "100 * coverage")} || ' %' FROM u
UNION ALL SELECT 'variant', 'the smaller variant''s last error is ' || {_words(0, "abs(d)")} || CASE WHEN d < 0 THEN ' lower' WHEN d > 0 THEN ' higher' ELSE ' apart' END FROM (SELECT max(CASE WHEN model = '{SMALLER}' THEN mae END) - max(CASE WHEN model = '{WHOLE}' THEN mae END) AS d FROM e WHERE fold = (SELECT max(fold) FROM e))
UNION ALL SELECT 'batch', count(*) || ' scenarios range from ' || {_words(0, "min(predicted)")} || ' to ' || {_words(0, "max(predicted)")} FROM s
"""


@over_tables("sv05_conclusions", _SQL_CONCLUSIONS)
def conclusions(spark, sf_dir):
    """Six sentences from the tables behind them: ranking, fold spread, generalisation, coverage, variant and batch. Each is one row made of aggregates."""
    p = once(postings(spark, sf_dir).select(*READ))
    told = once(fold_predictions(p))
    oof = told.select("fold", "actual", F.col(f"m{list(PREDICTORS).index(WHOLE)}").alias("predicted"), "baseline")
    e = once(errors_of(told))
    words = lambda n, c: F.format_string(f"%.{n}f", F.round(c, n))
    say = lambda kind, *parts: (F.lit(kind).alias("kind"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("finding"))
    m = e.groupBy("model").agg(F.avg("mae").alias("mae"))
    best = m.agg(F.sort_array(F.collect_list(F.struct("mae", "model"))).alias("o"), F.max(F.when(F.col("model") == "Dummy Median", F.col("mae"))).alias("d"))  # a row a predictor
    a, b = F.col("o")[0], F.col("o")[1]
    ranking = best.select(*say("ranking", a["model"], " has the least mean error, ", words(0, a["mae"]), "; ", b["model"], " is ", words(0, b["mae"] - a["mae"]), " behind; ", words(1, 100 * (F.col("d") - a["mae"]) / F.col("d")), " % below the dummy"))
    own = e.filter(F.col("model") == WHOLE)
    folds = own.agg(*say("folds", "fold ", F.max_by("fold", "mae").cast("string"), " is the weakest, ", words(0, F.max("mae")), "; errors span ", words(0, F.max("mae") - F.min("mae")))[1:]).select(F.lit("folds").alias("kind"), "finding")
    last = e.agg(F.max("fold").alias("last"))
    gap = own.crossJoin(F.broadcast(last)).agg(F.avg(F.when(F.col("fold") == F.col("last"), F.col("mae"))).alias("a"), F.avg(F.when(F.col("fold") < F.col("last"), F.col("mae"))).alias("b"))  # one row
    moved = F.when(F.col("a") > F.col("b"), "increased").when(F.col("a") < F.col("b"), "decreased").otherwise("was unchanged")
    general = gap.select(*say("generalisation", "the last fold's error ", moved, " by ", words(0, F.abs(F.col("a") - F.col("b")))))
    coverage = uncertainty_of(oof).select(*say("coverage", "a band of ", words(0, F.col("q90")), " covers ", words(1, 100 * F.col("coverage")), " %"))
    of = lambda n: F.max(F.when(F.col("model") == n, F.col("mae")))
    d = e.crossJoin(F.broadcast(last)).filter("fold = last").agg((of(SMALLER) - of(WHOLE)).alias("d"))  # one row
    side = F.when(F.col("d") < 0, " lower").when(F.col("d") > 0, " higher").otherwise(" apart")
    variant = d.select(*say("variant", "the smaller variant's last error is ", words(0, F.abs("d")), side))
    s = shown(predictions(spark, sf_dir, p, oof)).agg(F.count("*").alias("n"), F.min("predicted").alias("lo"), F.max("predicted").alias("hi"))
    batch = s.select(*say("batch", F.col("n").cast("string"), " scenarios range from ", words(0, F.col("lo")), " to ", words(0, F.col("hi"))))
    return reduce(DataFrame.union, [ranking, folds, general, coverage, variant, batch])
