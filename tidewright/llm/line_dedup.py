"""Line dedup: drop the lines found in many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import BROADCAST_BYTES, SPACE, SQL_SPACE, ascii_lower, aside, cut, restored, sql_lower, table

MIN_DOCS, MIN_CHARS = 10, 1
#: Beyond the broadcast of all frequent lines, those of more than a HOT-th of all frequent rows are still sent to every task: HOT of them at most.
HOT = 100_000


def _key(line: Column) -> Column:
    """A lower-cased line's key; null for keys that are too short to count."""
    key = F.trim(line, F.lit(SPACE))
    return F.when(F.length(key) >= MIN_CHARS, key)


def _hashes(key: Column) -> Column:
    """Two 64-bit hashes of a key, by different seeds."""
    return F.when(key.isNotNull(), F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _found(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of lines whose key is frequent, by a broadcast of the keys while they are few; else the hot ones apart, so that no task gets a hot key's rows."""
    told = frequent.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if told.keys * 40 <= BROADCAST_BYTES:
        return lines.join(F.broadcast(frequent.select("h", "g")), ["h", "g"], "left_semi")
    hot = F.col("n") * HOT >= told.rows
    hubs = F.broadcast(frequent.filter(hot).select("h", "g"))
    rest = lines.join(hubs, ["h", "g"], "left_anti").join(frequent.filter(~hot).select("h", "g"), ["h", "g"], "left_semi")
    return lines.join(hubs, ["h", "g"], "left_semi").unionByName(rest)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text rewritten, plus n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Lines are exploded as
    key hashes, once for each document; hashes found in at least min_docs documents are
    written as a table (broadcast while they are few; beyond that the hot ones alone are). Exploded hashes with their positions are
    matched against it, positions are gathered for each document, and its text is reassembled from the runs of lines
    between them: work in proportion to its lines, however many of them go.

    Every row of docs counts as a document. A row is known by its doc_id and two hashes of its text, so rows without
    a doc_id, or sharing one, are apart unless they are equal; equal rows lose the same lines. Null or empty text is
    one empty line, whose key is too short to drop: it becomes ''. A very long text is one row of hashes and
    positions at a time; nothing is held but its own lines. Columns other than doc_id and text pass through, whatever
    their names (n_lines and n_dropped are replaced). An empty table gives an empty one. Keys are compared by 128 bits
    of hashes: among a trillion distinct lines two meet with probability 1e-15.
    """
    own, back = aside(docs, ("doc_id", "text"), ("n_lines", "n_dropped"))
    lowered = _lines(ascii_lower(F.col("text")))
    seen = own.filter("text <> ''").select(F.inline(F.transform(F.array_compact(F.array_distinct(F.transform(lowered, _key))), _hashes)))
    frequent = cut(seen.groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs))

    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    key = {"__a": F.xxhash64("doc_id", "text"), "__b": F.xxhash64(F.lit(1), "text", "doc_id")}
    at = own.filter("text <> ''").select(*(v.alias(k) for k, v in key.items()), F.posexplode(F.transform(F.transform(lowered, _key), _hashes)).alias("at", "x")).filter("x is not null")
    hits = at.select("__a", "__b", "at", F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    hits = _found(hits, frequent)
    drops = hits.groupBy("__a", "__b").agg(F.array_sort(F.collect_set("at")).alias("__drop"))
    joined = own.withColumns(key).join(drops, ["__a", "__b"], "left")

    def between(lines: Column, gone: Column) -> Column:
        """The lines that stay: the run before each dropped position and the one after the last."""
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))

    # the lines are bound to a name once: the text isn't split again for each run
    kept = F.transform(F.array(F.struct(_lines(F.col("text")).alias("l"), F.col("__drop").alias("d"))), lambda x: between(x["l"], x["d"]))[0]
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    hit = F.col("__drop").isNotNull()
    out = joined.withColumns({
        "n_lines": n_lines.cast("long"),
        "n_dropped": F.when(hit, F.size("__drop")).otherwise(0).cast("long"),
        "text": F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text")),
    })
    return restored(out, back, "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     line AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
     keyed AS (SELECT *, {sql_lower(f"trim(line, {SQL_SPACE})")} AS k FROM line),
     frequent AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}),
     judged AS (SELECT keyed.*, f.k IS NOT NULL AS dropped FROM keyed LEFT JOIN frequent f ON keyed.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
