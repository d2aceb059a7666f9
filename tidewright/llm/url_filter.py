"""URL filter: explicit host rules, then empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, aside, cut, restored, small, sql_lower, table

#: (rule, verdict): host, then the path its urls must start with. Fixed by the query's contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Public suffixes of more than one label that the default table has; any other suffix is the last label. The public
#: list has thousands: give it as a table.
SUFFIXES = ("co.uk", "ac.uk", "org.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za")
#: Hosts that are numbers: four of them, or an address in brackets; without the port.
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"
#: The suffix that all addresses share.
ADDRESSES = "(address)"
#: Block where the lower bound of the posterior share of bad pages, Z deviations under its mean, is over LIMIT.
Z, LIMIT = 1.645, 0.2
#: Observations that a parent's share counts for in its children's priors, when the data can't tell.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to / ? # or the end, A-Z lower-cased; path: from there to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null when none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first
        name, _, path_start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{path_start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def default_suffixes(spark: SparkSession) -> DataFrame:
    """SUFFIXES as a table."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, SUFFIXES))).alias("suffix"))


def with_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host) with domain and suffix: the longest listed suffix of a host, else its last label, and one label more.

    suffixes has a column suffix, lower-cased, without a first dot. A port is left out. A host that is a suffix
    itself is its own domain; an address is its own domain, under a suffix that all addresses share. Hosts are
    matched by their tails, of which a host has one fewer than labels.
    """
    name = F.regexp_replace("host", ":[0-9]*$", "")
    labels = F.split("__name", r"\.")
    tail = lambda n: F.array_join(F.slice("__labels", F.greatest(F.lit(1), F.size("__labels") - (n - 1)), n), ".")
    own = hosts.withColumn("__name", name).withColumn("__labels", labels)
    listed = small(suffixes.filter("suffix is not null").select(F.col("suffix").alias("__s")).distinct())
    tails = own.filter(~F.col("__name").rlike(ADDRESS)).select(F.col("host").alias("__host"), F.explode(F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda n: F.struct(n.alias("n"), tail(n).alias("t")))).alias("x"))
    longest = tails.join(listed, F.col("x.t") == F.col("__s")).groupBy("__host").agg(F.max("x.n").alias("__n"))
    own = own.join(longest, F.col("host") == F.col("__host"), "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    address = F.col("__name").rlike(ADDRESS)
    domain = F.when(address, F.col("__name")).otherwise(tail(F.col("__n") + 1))
    suffix = F.when(address, ADDRESSES).otherwise(tail(F.col("__n")))
    return own.withColumns({"domain": domain, "suffix": suffix}).drop("__name", "__labels", "__host", "__n")


def _shrunk(counts: DataFrame, keys: list[str], parent: DataFrame | None, parent_key: str | None) -> DataFrame:
    """For each group: posterior mean m and strength k of its share of bad pages.

    The prior is the parent's mean (over all groups: the share of all pages with a half added to
    either side), worth `strength` observations: the method-of-moments beta-binomial estimate from
    the spread of the groups' shares around their own mean, held between fixed bounds.
    """
    bad, n = F.col("bad"), F.col("n")
    g = counts.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = g.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(n * n), F.lit(0)).alias("q"), F.coalesce(F.sum(F.when(n > 0, F.round(bad * bad / n, 6).cast("decimal(28,6)"))).cast("double"), F.lit(0.0)).alias("s"), F.count(F.when(n > 0, 1)).alias("groups"))
    mean = (F.col("b") + 0.5) / (F.col("t") + 1.0)
    # within-group and between-group variance of the shares, weighted by group size
    ss = F.greatest(F.col("s") - F.col("b") * F.col("b") / F.greatest(F.col("t"), F.lit(1)), F.lit(0.0))
    between = (ss - (F.col("groups") - 1) * mean * (1 - mean)) / F.greatest(F.col("t") - F.col("q") / F.greatest(F.col("t"), F.lit(1)), F.lit(1.0))
    strength = F.when(between > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), mean * (1 - mean) / between - 1))).otherwise(MOST_STRENGTH)
    fit = total.select(mean.alias("all_mean"), strength.alias("strength"))
    g = g.crossJoin(F.broadcast(fit))  # one row
    if parent is None:
        prior = F.col("all_mean")
    else:
        g = g.join(parent.select(F.col(parent_key).alias("__p"), F.col("m").alias("pm")), F.col(parent_key) == F.col("__p"), "left").drop("__p")
        prior = F.coalesce("pm", "all_mean")
    k = F.col("n") + F.col("strength")
    return g.select(*keys, "bad", "n", ((F.col("bad") + F.col("strength") * prior) / k).alias("m"), k.alias("k"))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame, z: float = Z) -> DataFrame:
    """One row per host of pages (host): n and bad labelled pages, posterior mean, and its lower bound.

    outcomes has (page_id, bad 0/1). Pages and outcomes are reduced to a row per host before any
    level is computed; suffix priors come from all pages, domain priors from their suffix, host priors
    from their domain. The bound is the posterior mean less z posterior deviations: a normal approximation of the beta
    posterior's lower quantile (the fifth per cent at 1.645), in whose place no built-in function gives the quantile itself.
    All sums are of whole numbers or decimals, so a host at the limit is judged alike whatever the order of rows.
    """
    labels = outcomes.filter("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("__page")).agg(F.max("bad").cast("long").alias("bad"))
    seen = pages.select("page_id", "host").join(labels, F.col("page_id") == F.col("__page"), "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    hosts = cut(with_domains(hosts, suffixes))
    by_suffix = _shrunk(hosts, ["suffix"], None, None)
    by_domain = _shrunk(hosts, ["domain", "suffix"], by_suffix, "suffix")
    by_host = _shrunk(hosts, ["host", "domain"], by_domain, "domain")
    sd = F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("k") + 1))
    return by_host.select("host", F.col("bad").alias("n_bad"), F.col("n").alias("n_labelled"), F.col("m").alias("posterior"), (F.col("m") - z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """Each row of pages with host, path, rule, verdict, posterior and bound.

    The longest rule that fits decides; else the host's reputation does: block where the bound is over
    limit. Null and malformed urls have an empty host and path, which share one reputation. Repeated
    pages and pages without an id are judged by their url; repeated labels of a page count once, as
    bad if any of them is. Suffixes are a table (suffix), by default SUFFIXES. Other columns pass through, but for
    those with the names of the results; nothing of a very long url is held beyond its row. The join on the host is the only shuffle of
    pages: its hot hosts are split by adaptive execution, or it is a broadcast where the written host table
    is small enough.
    """
    host, path = host_and_path(F.col("url"))
    added = ("host", "path", "rule", "verdict", "n_bad", "n_labelled", "posterior", "bound")
    own, back = aside(pages, ("page_id", "url"), added)
    judged = own.withColumns({"host": host, "path": path})
    suffixes = default_suffixes(pages.sparkSession) if suffixes is None else suffixes
    rated = cut(reputation(judged, outcomes, suffixes)).withColumnRenamed("host", "__host")
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    out = judged.join(rated, F.col("host") == F.col("__host"), "left").withColumns({"rule": rule, "verdict": says})
    out = out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")))
    return restored(out, back, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a page's id as doc_id are taken as that page's outcome."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("posterior", 6).alias("posterior"), F.round("bound", 6).alias("bound"))


def _sql_level(name: str, keys: str, parent: str, parent_key: str) -> str:
    prior = "f.all_mean" if not parent else "coalesce(p.m, f.all_mean)"
    join = f"LEFT JOIN {parent} p ON g.{parent_key} = p.{parent_key}" if parent else ""
    own = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""
{name}_g AS (SELECT {keys}, sum(bad)::DOUBLE AS bad, sum(n)::DOUBLE AS n FROM hosts GROUP BY {keys}),
{name}_t AS (SELECT coalesce(sum(bad), 0) AS b, coalesce(sum(n), 0) AS t, coalesce(sum(n * n), 0) AS q,
                    coalesce(sum(CASE WHEN n > 0 THEN round(bad * bad / n, 6)::DECIMAL(28, 6) END)::DOUBLE, 0) AS s, count(*) FILTER (WHERE n > 0) AS groups FROM {name}_g),
{name}_m AS (SELECT *, (b + 0.5::DOUBLE) / (t + 1.0::DOUBLE) AS all_mean FROM {name}_t),
{name}_v AS (SELECT *, (greatest(s - b * b / greatest(t, 1), 0) - (groups - 1) * all_mean * (1 - all_mean)) / greatest(t - q / greatest(t, 1), 1) AS between_v FROM {name}_m),
{name}_f AS (SELECT all_mean, CASE WHEN between_v > 0 THEN least({MOST_STRENGTH}::DOUBLE, greatest({LEAST_STRENGTH}::DOUBLE, all_mean * (1 - all_mean) / between_v - 1)) ELSE {MOST_STRENGTH}::DOUBLE END AS strength FROM {name}_v),
{name} AS (SELECT {own}, g.n, (g.bad + f.strength * {prior}) / (g.n + f.strength) AS m, g.n + f.strength AS k FROM {name}_g g CROSS JOIN {name}_f f {join})"""


def _sql() -> str:
    rest = "coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '')"
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in longest) + " END"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    longest_tail = f"coalesce(list_max(list_filter(range(1, len(l) + 1), lambda n: list_contains([{listed}], array_to_string(l[greatest(1, len(l) - n + 1):], '.')))), 1)"
    last = lambda n: f"array_to_string(l[greatest(1, len(l) - ({n} - 1)):], '.')"
    return f"""
WITH page AS (SELECT page_id, {sql_lower(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
label AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, coalesce(sum(bad), 0) AS bad, count(bad) AS n FROM page LEFT JOIN label ON page_id = doc_id GROUP BY host),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM seen),
split AS (SELECT *, {longest_tail} AS n_tail, regexp_matches(name, '{ADDRESS}') AS address FROM (SELECT *, string_split(name, '.') AS l FROM named)),
hosts AS (SELECT host, bad, n, CASE WHEN address THEN name ELSE {last("n_tail + 1")} END AS domain, CASE WHEN address THEN '{ADDRESSES}' ELSE {last("n_tail")} END AS suffix FROM split),
{_sql_level("by_suffix", "suffix", "", "")},
{_sql_level("by_domain", "domain, suffix", "by_suffix", "suffix")},
{_sql_level("by_host", "host, domain", "by_domain", "domain")},
rated AS (SELECT host, n::BIGINT AS n_labelled, m AS posterior, m - {Z}::DOUBLE * sqrt(m * (1 - m) / (k + 1)) AS bound FROM by_host)
SELECT page_id, page.host, path, {case(0).replace("host", "page.host")} AS rule,
       coalesce({case(1).replace("host", "page.host")}, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_labelled, round(posterior, 6) AS posterior, round(bound, 6) AS bound
FROM page LEFT JOIN rated ON page.host = rated.host
"""


SQL = _sql()
