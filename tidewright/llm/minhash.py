"""MinHash near-dedup: banded candidates, odd sketches, and exact links on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import alone_in_worker, aside, components, cut, forest, light, restored, small, sql_lower, table, texts_of, tile_pairs
from tidewright.llm.runs import bounds, groups

#: Link at 100 * intersection >= PERCENT * union of the sets of WORDS-word shingles.
PERCENT, WORDS = 80, 4
#: BANDS bands of ROWS samples: a pair at the threshold shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and the most that may differ: an estimated similarity of 0.5, over six deviations under 0.8.
SKETCH_BITS, MOST_BITS = 512, 100
#: Documents, and shingles of all its documents, in a tile of a large bucket or family.
TILE, TILE_SHINGLES = 1024, 1_000_000
#: Words whose hashes a worker remembers.
REMEMBER = 100_000

_U = np.uint64
_A = np.random.default_rng(7).integers(0, 2**63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
_B = np.random.default_rng(8).integers(0, 2**63, SAMPLES, dtype=np.uint64)
_P = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    bytes.lower() and bytes.split() follow the contract: A-Z alone, and white space [\\x20\\x09-\\x0D].
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    rolled = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        rolled = rolled * _P + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(rolled))


def samples(sets: np.ndarray) -> np.ndarray:
    """The MinHash samples of a shingle set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 512):
        np.minimum(least, (sets[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _P + least[i::ROWS])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of the samples folded into SKETCH_BITS bits."""
    at = _mix(least + np.arange(SAMPLES, dtype=np.uint64) * _P) % _U(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity that an XOR population count of two odd sketches stands for."""
    rest = np.maximum(1 - 2 * np.asarray(differing, float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(rest)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    alone_in_worker(_WORDS)
    for batch in batches:
        n, hi, lo, keys, sketches = [], [], [], [], []
        for text in texts_of(batch["text"]):
            own = shingles(text, words)
            n.append(len(own))
            if len(own):
                d, least = xxhash.xxh3_128_digest(own.tobytes()), samples(own)
                hi.append(int.from_bytes(d[:8], "big", signed=True))
                lo.append(int.from_bytes(d[8:], "big", signed=True))
                keys.append(band_keys(least))
                sketches.append(odd_sketch(least))
            else:
                for x in (hi, lo, keys, sketches):
                    x.append(None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "hi", "lo", "keys", "sketch"])


def _shared(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those whose key has another row, with the tile (of size rows) of their place in the bucket."""
    key, rep, at = np.empty(0, np.int64), np.empty(0, np.int64), 0  # held back: the last row, and its place

    def out(keys, reps, places):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array((places // size).astype(np.int32)), pa.array(reps)], ["key", "tile", "rep"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, reps = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([rep, batch["rep"].to_numpy()])
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begins = np.flatnonzero(new)
        places = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
        places[: begins[1] if len(begins) > 1 else len(keys)] += at
        twin = (places[:-1] > 0) | ~new[1:]
        yield out(keys[:-1][twin], reps[:-1][twin], places[:-1][twin])
        key, rep, at = keys[-1:], reps[-1:], int(places[-1])
    if len(key) and at:
        yield out(key, rep, np.array([at]))


def shared_buckets(keyed: DataFrame, size: int) -> DataFrame:
    """(key, tile, rep) of the rows of keyed (key, rep) whose key has another row; tiles of a key have size rows."""
    bucketed = keyed.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "rep"))
    return bucketed.mapInArrow(lambda batches: _shared(batches, size), "key long, tile int, rep long")


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [[]]).astype(np.int64)), pa.array(np.concatenate(b or [[]]).astype(np.int64))], ["a", "b"])


def _alike(sketch: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """Whether pairs may reach the threshold, by sketch and by size."""
    close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=-1, dtype=np.int64) <= MOST_BITS
    return close & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that may link, of each bucket or pair of its tiles."""
    by = ["key", "i", "j"]
    for t in groups(batches, by):
        rep, n, ends = t["rep"].to_numpy(), t["n"].to_numpy(), bounds(t, by)
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(rep), -1)
        size = np.diff(ends)
        two = ends[:-1][size == 2]
        two = two[_alike(sketch, n, two, two + 1)]
        a, b = [rep[two]], [rep[two + 1]]
        for begin, m in zip(ends[:-1][size > 2], size[size > 2], strict=True):
            rest = np.arange(begin, begin + m)  # not reached yet
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = _alike(sketch, n, x, rest)
                    if near.any():
                        hit, rest = rest[near], rest[~near]
                        front.extend(hit)
                        a.append(np.full(len(hit), rep[x]))
                        b.append(rep[hit])
        yield _edges(a, b)


def _resolved(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The shingle sets of family members; a row whose set isn't its class's (a repeated doc_id) goes."""
    import xxhash

    alone_in_worker(_WORDS)
    for batch in batches:
        keep, sets = [], []
        for k, (text, hi, lo) in enumerate(zip(texts_of(batch["text"]), batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True)):
            own = shingles(text, words).tobytes()
            d = xxhash.xxh3_128_digest(own)
            if (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) == (hi, lo):
                keep.append(k)
                sets.append(own)
        rest = batch.select(["rep", "units"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], ["rep", "units", "shingles"])


def links_within(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that link, by exact intersection sizes.

    With side, only pairs across the two sides count. Shingles of few documents add to the counts pair by
    pair, those of many as products of 0/1 blocks.
    """
    m, n = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (n[0] + n[1] - both) > 0 else []
    doc = np.repeat(np.arange(m), n)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = df[col] > 1
    doc, col = doc[use], col[use]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    few = df[col] <= 12
    both = np.zeros(m * m, np.float32)
    d, c = doc[few], col[few]
    for gap in range(1, 12):
        same = c[gap:] == c[:-gap]
        if not same.any():
            break
        both += np.bincount(d[:-gap][same] * m + d[gap:][same], minlength=m * m)
    both = both.reshape(m, m)
    both += both.T
    d, c = doc[~few], col[~few]
    if len(d):
        _, c = np.unique(c, return_inverse=True)
        ends = np.searchsorted(c, np.arange(0, c[-1] + 2048, 2048))
        for k in range(len(ends) - 1):
            block = np.zeros((m, 2048), np.float32)
            block[d[ends[k] : ends[k + 1]], c[ends[k] : ends[k + 1]] - 2048 * k] = 1
            both += block @ block.T
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    linked &= both > 0
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return [tuple(e) for e in forest(linked).tolist()]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the true links of each unit; of a unit of two sides, those across."""
    by = ["family", "i", "j"]
    for t in groups(batches, by):
        a, b, ends = [], [], bounds(t, by)
        rep, side = t["rep"].to_numpy(), t["side"].to_numpy()
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            if end - begin > 1:
                sets = [np.frombuffer(x, np.uint64) for x in t["shingles"][begin:end].to_pylist()]
                own, sides = rep[begin:end], side[begin:end]
                pairs = links_within(sets, sides if sides[0] >= 0 else None)
                a.append(own[[x for x, _ in pairs]])
                b.append(own[[y for _, y in pairs]])
        yield _edges(a, b)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two tiles whose members have components so far: the members with a pair across that may link and isn't joined yet."""
    by = ["family", "i", "j"]
    for t in groups(batches, by):
        ends, keep = bounds(t, by), []
        n, tile, joined = (t[c].to_numpy() for c in ("n", "tile", "joined"))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(n), -1)
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            at = begin + int(np.searchsorted(tile[begin:end], tile[begin], "right"))
            other = np.zeros(end - at, bool)
            for x in range(begin, at):
                may = np.arange(at, end)[joined[at:end] != joined[x]]
                may = may[_alike(sketch, n, x, may)] if len(may) else may
                if len(may):
                    keep.append(x)
                    other[may - at] = True
            keep += (at + np.flatnonzero(other)).tolist()
        out = t.select([*by, "tile", "rep"]).take(pa.array(keep, pa.int64())).combine_chunks()
        yield from out.to_batches()


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text), by shingles of `words` words.

    1. Each text gives its shingle set's size and 128-bit hash, the keys of BANDS bands of MinHash
       samples, and an odd sketch. Documents with equal sets become one class, so exact copies cost a row.
    2. Buckets (rows of one band key) with two classes or more get the sketches; XOR population counts
       find a spanning forest of the pairs that may link. Buckets over TILE classes are cut into
       tiles which meet in pairs, so no task holds a whole bucket and no pair of a group becomes a row.
    3. The components of those forests are families, which hold every link. Full sets are gathered by
       family and intersected exactly; forests of true links remain. A large family is dealt to tiles twice, by two hashes:
       every set is sent twice, and the many copies of one text are joined by that alone. Where parts of a family are still
       apart, its tiles meet in pairs as sketches, and only members with a pair across that may link and isn't joined yet
       send their full sets there.
    4. The components of all links, spread over the classes' members, are the answer.

    Null or wordless texts have no shingles and link with nothing. Rows without a doc_id link with
    nothing, have a null component and are kept. Rows that share a doc_id are one document in the
    graph: each reports its own set, and all share a component. A very long text is eight bytes a word in a
    worker, whole. Other columns of docs aren't returned. An empty table gives an empty one. Ids are longs: others must be cast
    before.
    """
    signed = cut(docs.select("doc_id", "text").mapInArrow(lambda b: _signed(b, words), "doc_id long, n long, hi long, lo long, keys array<long>, sketch binary"))
    usable = signed.filter("doc_id is not null and hi is not null")
    classes = cut(usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    rows = cut(shared_buckets(classes.select(F.explode("keys").alias("key"), "rep"), TILE))
    many = small(rows.filter("tile > 0").groupBy("key").agg((F.max("tile") + 1).alias("tiles")))
    told = rows.join(many, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).join(classes.select("rep", "n", "sketch"), "rep")
    pairs = told.select("key", tile_pairs("tile", "tiles").alias("p"), "rep", "n", "sketch").select("key", "p.i", "p.j", "rep", "n", "sketch")
    likely = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_likely, "a long, b long")
    families = components(likely)

    sized = families.join(classes.select(F.col("rep").alias("node"), "n", "hi", "lo"), "node")
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = small(sized.groupBy("component").agg(tiles.alias("tiles")).filter("tiles > 1"))
    members = sized.join(sizes, "component", "left").select(F.col("component").alias("family"), F.coalesce("tiles", F.lit(1)).alias("tiles"), F.col("node").alias("rep"), "n", "hi", "lo")
    members = cut(members.withColumns({"tile": F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"), "deal": F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("tiles")).cast("int")}))

    def linked(units: DataFrame) -> DataFrame:
        """Links in units (rep, hi, lo, family, i, j, side), from the texts: a row of docs is sent to the units of its class."""
        by_rep = cut(units.groupBy("rep", "hi", "lo").agg(F.collect_list(F.struct("family", "i", "j", "side")).alias("units")))
        by_rep = light(by_rep, 56 + 48 * F.size("units"))
        sets = docs.select("doc_id", "text").join(by_rep, F.col("doc_id") == F.col("rep")).drop("doc_id")
        sets = sets.mapInArrow(lambda b: _resolved(b, words), "rep long, units array<struct<family: long, i: int, j: int, side: int>>, shingles binary")
        sent = sets.select("rep", "shingles", F.inline("units"))
        return sent.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side").mapInArrow(_linked, "a long, b long")

    unit = lambda i, j: F.struct(F.lit(i).alias("i"), F.col(j).alias("j"), F.lit(-1).alias("side"))
    deals = F.inline(F.when(F.col("tiles") > 1, F.array(unit(-1, "tile"), unit(-2, "deal"))).otherwise(F.array(unit(-1, "tile"))))
    # documents that share an id but not a set are one node
    links = cut(linked(members.select("rep", "hi", "lo", "family", deals)).union(_same_id(usable)))
    found = components(links)
    large = members.filter("tiles > 1").join(small(cut(found)).withColumnRenamed("node", "rep"), "rep", "left").withColumn("joined", F.coalesce("component", "rep"))
    split = small(large.groupBy("family").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")).filter("lo < hi").select("family"))
    large = large.join(split, "family", "left_semi").join(classes.select("rep", "sketch"), "rep")
    across = large.select("family", tile_pairs("tile", "tiles").alias("p"), "tile", "rep", "n", "sketch", "joined").select("family", "p.i", "p.j", "tile", "rep", "n", "sketch", "joined").filter("i < j")
    doubt = across.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "tile").mapInArrow(_apart, "family long, i int, j int, tile int, rep long")
    doubt = cut(doubt)
    if not doubt.isEmpty():
        units = doubt.join(members.select("rep", "hi", "lo"), "rep").select("rep", "hi", "lo", "family", "i", "j", F.col("tile").alias("side"))
        found = components(links.union(linked(units)))

    copies = classes.filter("copies > 1").select("hi", "lo", "rep")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(small(copies), ["hi", "lo"], "left")
    out = out.withColumn("node", F.coalesce("rep", "doc_id")).join(small(found), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(usable: DataFrame) -> DataFrame:
    """Edges between the classes that hold rows of one doc_id; none where ids are unique."""
    twice = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    reps = usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    held = usable.join(twice, "doc_id", "left_semi").join(reps, ["hi", "lo"])
    return held.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs, with all of their columns, without the documents whose group by near_groups() has another one of a smaller doc_id."""
    own, back = aside(docs, ("doc_id", "text"))
    gone = near_groups(docs, words).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return restored(own.join(small(cut(gone)), F.col("doc_id") == F.col("__gone"), "left_anti"), back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS ra, b.r AS rb, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY ALL),
link AS (SELECT DISTINCT a, b FROM i JOIN n x ON ra = x.r JOIN n y ON rb = y.r WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
reach AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.node AND r.least < l.b),
found AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(w.doc_id = component_id, true) AS kept FROM w LEFT JOIN n USING (r) LEFT JOIN found ON w.doc_id = node
"""
