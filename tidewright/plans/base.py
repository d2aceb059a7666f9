"""The registry of queries, and the record table that they read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Salary tiers: upper bound (exclusive) and name. Fixed values of the record contract.
TIERS = ((100_000, "Entry (<$100k)"), (150_000, "Mid ($100-150k)"), (200_000, "Upper-Mid ($150-200k)"), (300_000, "Senior ($200-300k)"))
TOP_TIER = "Elite (>$300k)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier(salary: Column) -> Column:
    """Tier of a salary; a null one is in the top tier, as no bound is above it."""
    out = F.lit(TOP_TIER)
    for bound, name in reversed(TIERS):
        out = F.when(salary < bound, name).otherwise(out)
    return out


def sql_tier(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {b} THEN '{n}'" for b, n in TIERS) + f" ELSE '{TOP_TIER}' END"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each order, in the record contract's columns plus period.

    Lines are reduced to their order first; the small dimensions join by broadcast where their size allows.
    Money and rates are summed as whole cents and hundredths, so that sums don't depend on their order.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))).alias("net"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(cents("l_discount")).alias("discounts"),
        F.sum(cents("l_tax")).alias("taxes"),
        F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand"))), lambda x: x["p_brand"]), "|").alias("brands"),
    )
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    first = F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.concat_ws(":", "c_mktsegment", "o_orderpriority").alias("job_title"),
        F.col("c_mktsegment").alias("job_category"),
        F.when(first == "1", "Lead").when(first == "2", "Senior").when(first == "3", "Mid").otherwise("Entry").alias("experience_level"),
        pick(["High School", "Bachelor", "Master", "PhD"], "o_custkey").alias("education_required"),
        F.concat_ws("-", "n_name", (F.col("c_custkey") % 3).cast("string")).alias("city"),
        F.col("n_name").alias("country"),
        F.col("o_orderstatus").alias("remote_work"),
        pick(["Small", "Medium", "Large"], "o_custkey").alias("company_size"),
        F.col("r_name").alias("industry"),
        F.col("brands").alias("required_skills"),
        tier(F.coalesce(F.col("net") / 10000.0, price)).alias("salary_tier"),
        (F.col("o_orderkey") % 16).cast("double").alias("years_of_experience"),
        price.alias("annual_salary_usd"),
        (price * (0.80 + 0.05 * (F.col("o_orderkey") % 6))).alias("salary_min_usd"),
        (price * (0.95 + 0.05 * (F.col("o_custkey") % 6))).alias("salary_max_usd"),
        (F.col("taxes") / F.col("n")).alias("ai_salary_premium_pct"),
        F.col("quantity").alias("demand_score"),
        (F.col("o_orderkey") % 41 - 20).cast("double").alias("demand_growth_yoy_pct"),
        (F.col("discounts") / (10.0 * F.col("n"))).alias("benefits_score_10"),
        F.year("o_orderdate").alias("posting_year"),
        F.month("o_orderdate").alias("posting_month"),
        first.isin("1", "2").alias("is_senior"),
        (F.col("o_orderstatus") != "F").alias("is_remote_friendly"),
        (F.col("o_orderkey") % 2 == 0).alias("is_llm_role"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
    )


POSTINGS_SQL = f"""
per_order AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS net, sum(l_quantity) AS quantity,
     sum(round(l_discount * 100)::BIGINT)::BIGINT AS discounts, sum(round(l_tax * 100)::BIGINT)::BIGINT AS taxes, count(*) AS n,
     string_agg(p_brand, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, p_brand) AS brands FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
p AS (SELECT o_orderkey::VARCHAR AS job_id, c_mktsegment || ':' || o_orderpriority AS job_title, c_mktsegment AS job_category,
     CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Lead' WHEN '2' THEN 'Senior' WHEN '3' THEN 'Mid' ELSE 'Entry' END AS experience_level,
     (['High School', 'Bachelor', 'Master', 'PhD'])[o_custkey % 4 + 1] AS education_required, n_name || '-' || (c_custkey % 3)::VARCHAR AS city, n_name AS country,
     o_orderstatus AS remote_work, (['Small', 'Medium', 'Large'])[o_custkey % 3 + 1] AS company_size, r_name AS industry, brands AS required_skills,
     {sql_tier("coalesce(net / 10000.0::DOUBLE, o_totalprice)")} AS salary_tier, (o_orderkey % 16)::DOUBLE AS years_of_experience, o_totalprice AS annual_salary_usd,
     o_totalprice * (0.80::DOUBLE + 0.05::DOUBLE * (o_orderkey % 6)) AS salary_min_usd, o_totalprice * (0.95::DOUBLE + 0.05::DOUBLE * (o_custkey % 6)) AS salary_max_usd,
     taxes::DOUBLE / n AS ai_salary_premium_pct, quantity AS demand_score, (o_orderkey % 41 - 20)::DOUBLE AS demand_growth_yoy_pct,
     discounts / (10.0::DOUBLE * n) AS benefits_score_10, year(o_orderdate)::INTEGER AS posting_year, month(o_orderdate)::INTEGER AS posting_month,
     substr(o_orderpriority, 1, 1) IN ('1', '2') AS is_senior, o_orderstatus <> 'F' AS is_remote_friendly, o_orderkey % 2 = 0 AS is_llm_role,
     strftime(o_orderdate, '%Y-%m') AS period
     FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN per_order ON o_orderkey = l_orderkey)
"""


def over_postings(name: str, sql: str | None = None):
    """Register f(postings) as a query; sql is the rest of a DuckDB query after the WITH of table p."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(postings(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {POSTINGS_SQL}{sql}"
        return f

    return add


def over_tables(name: str, sql: str | None = None):
    """Register f(spark, sf_dir) as a query, with its whole DuckDB text."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r4(c: Column | str) -> Column:
    return F.round(c, 4)


def money_mean(c: str) -> Column:
    """Mean of amounts as whole cents over their number: the same whatever the order of the rows."""
    return F.sum(F.round(F.col(c) * 100).cast("long")) / (100.0 * F.count(c))


def sql_money_mean(c: str) -> str:
    return f"sum(round({c} * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count({c}))"


def exact_mean(c: Column) -> Column:
    """Mean of numbers at six decimals, summed as decimals: the same whatever the order of the rows, so it needs no rounding."""
    return F.sum(F.round(c, 6).cast("decimal(28,6)")).cast("double") / F.count(c)


def sql_exact_mean(c: str) -> str:
    return f"sum(round({c}, 6)::DECIMAL(28, 6))::DOUBLE / count({c})"


#: Ids of a range: records are numbered in ranges of so many ids of a month.
IDS = 65_536
#: Characters by which ids that are no numbers are told apart into ranges.
BEGINNING = 6


def record_numbers(p: DataFrame, name: str = "record_id") -> DataFrame:
    """p with a number from 1 on, in order of period and job_id (ids that are no numbers first, as texts).

    Each range of IDS ids of a month (of other texts: of one beginning) is numbered by itself, and moved by the rows of the ranges before it in its month (a row a
    range) and of the months before (a row a month), so no task sorts more than a range however large a month.
    """
    number = F.col("job_id").try_cast("long")
    other = F.when(number.isNull(), F.coalesce(F.substring("job_id", 1, BEGINNING), F.lit(""))).otherwise("")
    p = p.withColumns({"__range": F.coalesce(F.floor(number / IDS), F.lit(-(2**62))), "__text": other})
    ranges = p.groupBy(F.col("period").alias("__period"), F.col("__range").alias("__r"), F.col("__text").alias("__t")).agg(F.count("*").alias("n"))
    months = ranges.groupBy("__period").agg(F.sum("n").alias("n")).select(F.col("__period").alias("__month"), F.coalesce(F.sum("n").over(W.orderBy("__period").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__months"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__period").orderBy("__r", "__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = ranges.withColumn("__before", before).join(F.broadcast(months), F.col("__period").eqNullSafe(F.col("__month")))  # a row a month
    moved = moved.select("__period", "__r", "__t", (F.col("__before") + F.col("__months")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("period", "__range", "__text").orderBy(number, "job_id"))
    out = p.withColumn("__in", inside).join(moved, F.col("period").eqNullSafe(F.col("__period")) & (F.col("__range") == F.col("__r")) & (F.col("__text") == F.col("__t")))
    return out.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__period", "__range", "__text", "__r", "__t", "__before", "__in")


def shared_path(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one, and set, only in local runs where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Folders that once() wrote in this driver and that are still there.
_ONCE: list[str] = []


def once(df: DataFrame) -> DataFrame:
    """df as a table written to the folder of spark.checkpoint.dir, for plans that read it several times; as it is where that is unset.

    The tables stay for recovery until clear_once() is called, when results are written.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df
    path = f"{shared_path(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _ONCE.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df as once() gives it, for a block that reads it several times; persisted until the block's end where that leaves it as it is."""
    out = once(df)
    if out is not df:
        yield out
        return
    out = df.persist()
    try:
        yield out
    finally:
        out.unpersist()


def clear_once(spark: SparkSession) -> None:
    """Remove every table that once() wrote, once the results made from them are written: results read them until then."""
    while _ONCE:
        p = spark._jvm.org.apache.hadoop.fs.Path(_ONCE.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def side_by_side(calls: list[Callable], at_once: int = 3) -> list:
    """What the calls return; a few run at once, so that Spark has the jobs of one while another waits for its driver."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda f: f(), calls))


#: Ranges that a group's values are cut into, a power of two, and the rows of counted values up to which none is cut.
PARTS, WHOLE = 1024, 4_000_000


def counted_values(x: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, __v and __n: how often each value comes in each group, as a written table. Rows without a value are left out."""
    x = x.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    return once(x.groupBy(*by, "__v").agg(F.count("*").alias("__n")))


def parted(counted: DataFrame, by: list[str]) -> DataFrame:
    """counted with __part: the range of its group that a value lies in.

    Ranges end at the group's quantiles, by a sketch of its values, so they hold about as many values each, however far apart those
    lie. A value's range is found by halving.
    """
    shares = [(i + 1) / PARTS for i in range(PARTS - 1)]
    ends = counted.groupBy(*by).agg(F.percentile_approx("__v", shares, 4 * PARTS).alias("__ends"))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(PARTS.bit_length() - 1))))
    dealt = counted.join(_renamed(ends, by), _same(by)).drop(*_keys(by))
    at = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("__ends", at + half - 1) < F.col("__v"), at + half).otherwise(at)) if PARTS > 1 else F.lit(0)
    return dealt.withColumn("__part", at).drop("__ends")


def _keys(by: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(by))]


def _renamed(d: DataFrame, by: list[str]) -> DataFrame:
    return d.select(*(F.col(c).alias(k) for c, k in zip(by, _keys(by), strict=True)), *[c for c in d.columns if c not in by])


def _same(by: list[str], other: Column | None = None) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, _keys(by), strict=True)), F.lit(True) if other is None else other)


def quantiles_of(counted: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by and a column for each share: the exact quantiles of counted values, between neighbours by their distance.

    Few counted values are summed up group by group. Beyond WHOLE rows of them, counts are summed in ranges of each group's values, and inside each
    range, so no task holds a group's values, however few groups there are.
    """
    if counted.limit(WHOLE + 1).count() <= WHOLE:
        totals = counted.groupBy(*by).agg(F.sum("__n").alias("__t"))
        dealt = counted.withColumn("__upto", F.sum("__n").over(W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
        dealt = dealt.join(_renamed(totals, by), _same(by)).drop(*_keys(by))
    else:
        dealt = once(parted(counted, by))
        parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
        earlier = F.coalesce(F.sum("__m").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("__m").over(W.partitionBy(*by))
        parts = parts.withColumns({"__earlier": earlier, "__t": total}).withColumnRenamed("__part", "__p").drop("__m")
        dealt = dealt.join(_renamed(parts, by), _same(by, F.col("__part") == F.col("__p"))).drop(*_keys(by), "__p")
        dealt = dealt.withColumn("__upto", F.col("__earlier") + F.sum("__n").over(W.partitionBy(*by, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    holds = lambda rank: (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))
    ends = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__t") - 1)
        ends += [F.max(F.when(holds(F.floor(at)), F.col("__v"))).alias(f"__lo_{name}"), F.max(F.when(holds(F.ceil(at)), F.col("__v"))).alias(f"__hi_{name}"), F.max(at - F.floor(at)).alias(f"__at_{name}")]
    out = dealt.groupBy(*by).agg(*ends)
    return out.select(*by, *((F.col(f"__lo_{n}") * (1 - F.col(f"__at_{n}")) + F.col(f"__hi_{n}") * F.col(f"__at_{n}")).alias(n) for n in shares))


def exact_quantiles(x: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """quantiles_of() the values of a column in each group. Groups without a value are left out."""
    return quantiles_of(counted_values(x, by, value), by, shares)


def with_quantiles(groups: DataFrame, x: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups (a row a group of x) with the exact quantiles of a column; null where a group has no value."""
    own = _renamed(exact_quantiles(x, by, value, shares), by)
    return groups.join(own, _same(by), "left").drop(*_keys(by))


def with_medians(groups: DataFrame, x: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """groups (a row a group of x) with the exact medians of several values, to four decimals: they are unpivoted in the row and counted at once."""
    long = x.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("__of"), c.cast("double").alias("__value")) for n, c in values.items()))))
    found = exact_quantiles(long, [*by, "__of"], "__value", {"__m": 0.5})
    own = found.groupBy(*by).agg(*(r4(F.max(F.when(F.col("__of") == n, F.col("__m")))).alias(n) for n in values))
    return groups.join(_renamed(own, by), _same(by), "left").drop(*_keys(by))


SQL_NUMBERS = "numbered AS (SELECT *, row_number() OVER (ORDER BY period, job_id::BIGINT) AS record_id FROM p)"
