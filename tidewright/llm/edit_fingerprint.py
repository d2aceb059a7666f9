"""Document fingerprints by randomised edit embedding, with bit-sampled bands and verified pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import components, cut, slices, small, table, tile_pairs
from tidewright.llm.minhash import shared_buckets
from tidewright.llm.runs import bounds, groups

#: A walk covers WALK characters in 3 * WALK steps and starts anew for the next ones, so that all parts of a
#: text are walked side by side.
WALK = 2048
#: About this many samples at most; each is a byte for GRAM steps of the embedding, 0 where all of them are past its end.
SAMPLES, GRAM = 192, 4
#: Bands of the search for near texts, and samples in each.
BANDS, BAND_SAMPLES = 24, 3
#: Texts are near at this likeness of their fingerprints: half of the embedding's steps. Texts that have nothing in common
#: reach 0.1 at most; of texts with edits at MOST_EDITS of their characters over nine in ten do.
NEAR, MOST_EDITS = 0.5, 0.003
#: Texts of a bucket's tile.
TILE = 1024

_U = np.uint64
_STEPS = 3 * WALK
#: The shared random walks: whether to move on at a step, for each of 256 classes of characters.
_MOVES = np.random.default_rng(11).integers(0, 2, (_STEPS, 256), dtype=np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def embed(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The embedding of each text (code points): a byte for each of 3 steps a character.

    At step t a walk writes its character's class and moves on if the shared random function for (t, class)
    says so; past the end of its part it writes 0. Texts a few edits apart are soon on the same
    characters again at the same steps, so their embeddings have a small Hamming distance.
    """
    classes = [(_mix(t.astype(_U) + _U(1)) % _U(255) + _U(1)).astype(np.uint8) for t in texts]
    parts = [(i, c[k : k + WALK]) for i, c in enumerate(classes) for k in range(0, len(c), WALK)]
    size = np.array([len(p) for _, p in parts], np.int64)
    order = np.argsort(-size, kind="stable")  # the longest first: walks end from the back
    begin = np.concatenate([[0], np.cumsum(size[order] + 1)[:-1]]) if len(parts) else np.empty(0, np.int64)
    flat = np.concatenate([np.append(parts[i][1], np.uint8(0)) for i in order]) if len(parts) else np.empty(0, np.uint8)
    stop, at = begin + size[order], begin.copy()
    out = np.zeros((3 * int(size.max()) if len(parts) else 0, len(parts)), np.uint8)
    walks = np.searchsorted(-3 * size[order], -np.arange(len(out)), "left") if len(parts) else []
    for t in range(len(out)):
        k = walks[t]  # walks with more than t steps
        here = at[:k]
        c = flat[here]
        out[t, :k] = c
        here += _MOVES[t][c]
        np.minimum(here, stop[:k], out=here)
    columns = np.empty(len(parts), np.int64)
    columns[order] = np.arange(len(parts))
    made: list[list[np.ndarray]] = [[] for _ in texts]
    for n, (i, p) in enumerate(parts):
        made[i].append(out[: 3 * len(p), columns[n]])
    return [np.concatenate(m) if m else np.empty(0, np.uint8) for m in made]


def packed_print(embedding: np.ndarray) -> tuple[int, int, bytes]:
    """level, steps and bytes of a fingerprint. Step j is sampled at a level if its hash has so many zero bits at the end.

    The level is the least at which about SAMPLES steps are sampled. The steps of a level are among those of
    any lower one, so fingerprints of any two texts can be compared at the higher level of both.
    """
    n = len(embedding)
    level = max(0, int(np.ceil(np.log2(max(1, n) / SAMPLES))))
    at = sampled(n, level)
    wide = np.concatenate([embedding, np.zeros(GRAM, np.uint8)]).astype(_U)
    value = np.zeros(len(at), _U)
    for k in range(GRAM):
        value = value * _U(257) + wide[at + k]
    return level, n, np.where(value > 0, _mix(value) % _U(255) + _U(1), _U(0)).astype(np.uint8).tobytes()


def fingerprint(embedding: np.ndarray) -> str:
    """packed_print() as text: level:steps:hex bytes."""
    level, n, x = packed_print(embedding)
    return f"{level}:{n}:{x.hex()}"


_SAMPLED: dict[int, np.ndarray] = {}


def sampled(n: int, level: int) -> np.ndarray:
    """The sampled steps under n."""
    known = _SAMPLED.get(level)
    if known is None or len(known) < n:  # zero bits at the end of each step's hash
        size = 1 << max(12, int(n).bit_length())
        h = _mix(np.arange(size, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(5))
        known = _SAMPLED[level] = (h & _U((1 << level) - 1)) == 0
    return np.flatnonzero(known[:n])


def at_level(n: int, own: int, x: np.ndarray, level: int) -> np.ndarray:
    """A fingerprint's bytes at a level not under its own."""
    return x if level == own else x[np.searchsorted(sampled(n, own), sampled(n, level))]


def likeness(a: str, b: str) -> float:
    """Share of the sampled steps within either text, at the higher level of both, at which they agree."""
    if a == b:
        return 1.0
    parts = [(int(p[0]), int(p[1]), np.frombuffer(bytes.fromhex(p[2]), np.uint8)) for p in (a.split(":"), b.split(":"))]
    level = max(p[0] for p in parts)
    x, y = (at_level(n, own, x, level) for own, n, x in parts)
    wide = np.zeros((2, max(len(x), len(y))), np.uint8)
    wide[0, : len(x)], wide[1, : len(y)] = x, y
    return float(alike(wide[0], wide[1:])[0])


def alike(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Likeness of one row of bytes to each of others, at one level: steps past the end of both don't count."""
    both = ((others != 0) | (x != 0)).sum(axis=1)
    return ((others == x) & (x != 0)).sum(axis=1) / np.maximum(both, 1)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the first as many characters of the next one's, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"
#: Characters that a worker fingerprints at once, and rows of one doc_id that it holds back.
_AT_ONCE, _HELD_BACK = 1_000_000, 1000


def _as_bytes(text_print: str) -> bytes:
    """A fingerprint in a column of tables: level in one byte, steps in eight, then its own."""
    level, n, x = text_print.split(":")
    return bytes([int(level)]) + int(n).to_bytes(8, "big") + bytes.fromhex(x)


def as_text(c: Column) -> Column:
    """The text of _as_bytes()."""
    number = lambda at, n: F.conv(F.hex(F.substring(c, at, n)), 16, 10)
    return F.concat_ws(":", number(1, 1), number(2, 8), F.lower(F.hex(F.substring(c, 10, 1 << 30))))


def _finished(rows: list[tuple[int | None, str]], following: list[str]) -> dict[str, pa.Array]:
    """The result's columns for rows whose next texts are known."""
    texts = [t for _, t in rows]
    changed = list(map(edited, texts, following))
    known = list(dict.fromkeys([*texts, *changed, *following]))
    prints = dict(zip(known, map(fingerprint, embed(list(map(_code_points, known)))), strict=True))
    own, other, after = ([prints[t] for t in x] for x in (texts, changed, following))
    columns = [[d for d, _ in rows], list(map(len, texts)), [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], list(map(_as_bytes, own)), list(map(_as_bytes, other)), list(map(likeness, own, other)), list(map(likeness, own, after))]
    return {c: pa.array(x, t) for c, t, x in zip(_NAMES, _TYPES, columns, strict=True)}


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's rows in descending order of doc_id (then hash and text): their results, where the next text is known.

    role: done (a result); first and second (the first row of the part, and of its second doc_id); open (a row whose next
    text comes after the part, or after more rows of its doc_id than are held back); next (the text that such a doc_id's
    rows wait for); last (the part's last doc_id, which waits for a later part).
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def out(role: str, columns: dict[str, pa.Array], texts: list[str] | None = None) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        arrays = [columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.string()), pa.array(texts or [None] * n, pa.string()), *arrays], ["part", "role", "text", *_NAMES])

    def told(role: str, rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        return out(role, {"doc_id": pa.array([d for d, _ in rows], pa.int64())}, [t for _, t in rows])

    seen, waiting, opened = 0, [], False  # doc_ids met; rows of one doc_id that wait; whether some of its rows are out already
    ready, following, size = [], [], 0
    for batch in batches:
        for row in ((d, t) for part in slices(batch) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)):
            if not waiting or row[0] != waiting[0][0]:
                seen += 1
                if seen <= 2:
                    yield told("first" if seen == 1 else "second", [row])
            if waiting and row[0] != waiting[0][0]:
                if opened:
                    yield told("open", waiting)
                    yield told("next", [(waiting[0][0], row[1])])
                else:
                    ready += waiting
                    following += [row[1]] * len(waiting)
                    size += sum(len(t) for _, t in waiting) + len(row[1])
                waiting, opened = [], False
            elif len(waiting) >= _HELD_BACK:
                yield told("open", waiting)
                waiting, opened = [], True
            waiting.append(row)
            if size >= _AT_ONCE:
                yield out("done", _finished(ready, following))
                ready, following, size = [], [], 0
    if ready:
        yield out("done", _finished(ready, following))
    if waiting:
        yield told("open", waiting)
        yield told("last", [(waiting[0][0], "")])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            done = _finished([(batch["doc_id"][k].as_py(), batch["text"][k].as_py())], [batch["following"][k].as_py()])
            yield pa.RecordBatch.from_arrays(list(done.values()), list(done))


def _later(ends: list[tuple[int, str, int | None]]) -> list[tuple[int, int, str]]:
    """For each part with rows: the part and role of the row that its last doc_id waits for, from (part, role, doc_id) of all."""
    known = {(part, role): doc for part, role, doc in ends}
    parts = sorted({part for part, _ in known})
    out = []
    for i, part in enumerate(parts):
        own = known[part, "last"]
        for after in (*parts[i + 1 :], *parts[: i + 1]):
            role = next((r for r in ("first", "second") if (after, r) in known and known[after, r] != own), None)
            if role:
                out.append((part, after, role))
                break
        else:  # there is one doc_id alone
            out.append((part, parts[0], "first"))
    return out


def results(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, print, edited_print, near_edited and near_next of each row of docs, as a written table and a few rows more."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.repartitionByRange(parts, *by).sortWithinPartitions(*by, "text")
    walked = cut(dealt.mapInArrow(_walked, f"part int, role string, text string, {_RESULT}"))
    # the doc_id at each part's end waits for the first text of a later part that has another one
    ends = walked.filter("role in ('first', 'second', 'last')").select("part", "role", "doc_id").collect()  # three rows a part at most
    after = spark.createDataFrame(_later([tuple(r) for r in ends]), "part int, __part int, __role string")
    begins = walked.filter("role in ('first', 'second')").select(F.col("part").alias("__part"), F.col("role").alias("__role"), F.col("text").alias("following"))
    lasts = after.join(begins, ["__part", "__role"]).select(F.col("part").alias("__at"), "following")
    wanting = walked.filter("role = 'last'").select(F.col("doc_id").alias("__id"), F.col("part").alias("__at")).join(lasts, "__at")
    inner = walked.filter("role = 'next'").select(F.col("doc_id").alias("__id"), F.col("part").alias("__at"), F.col("text").alias("following"))
    wanting = wanting.select("__id", "__at", "following").unionByName(inner)
    waiting = walked.filter("role = 'open'").select("doc_id", "part", "text").join(wanting, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("part") == F.col("__at")))
    finished = cut(waiting.select("doc_id", "text", "following").mapInArrow(_closed, _RESULT))
    return walked.filter("role = 'done'").select(*finished.columns).union(finished)


#: band, sampled step -> its place in the band's own order of a level's steps.
_ORDERS: dict[int, np.ndarray] = {}


def band_keys(level: int, n: int, x: np.ndarray) -> np.ndarray:
    """Keys of a fingerprint's bands at its level and at the next one, where it meets the texts beyond a power of two.

    Two texts with a likeness of NEAR are no more than twice as long as each other, so their levels are one apart at most.
    """
    above = at_level(n, level, x, level + 1)
    return np.concatenate([keys_at(level, n, x), *([keys_at(level + 1, n, above)] if np.count_nonzero(above) >= BAND_SAMPLES else [])])


def keys_at(level: int, n: int, x: np.ndarray) -> np.ndarray:
    """Keys of a level's bytes: each band has the first BAND_SAMPLES steps, in an order of its own, that lie within the text."""
    known = _ORDERS.get(level)
    if known is None or known.shape[1] < len(x):
        at = sampled(1 << max(14, int(n).bit_length()), level).astype(_U)
        known = _ORDERS[level] = np.stack([_mix(at * _U(31) + _U(b)) >> _U(1) for b in range(BANDS)])
    within = np.flatnonzero(x)
    if len(within) < BAND_SAMPLES:  # too short: equal bytes alone meet
        return _mix(np.array([int.from_bytes(hashlib.sha256(x.tobytes()).digest()[:7], "big")], _U)) if len(within) else np.empty(0, _U)
    low = within[np.argpartition(known[:, within], BAND_SAMPLES - 1, axis=1)[:, :BAND_SAMPLES]] if len(within) > BAND_SAMPLES else np.tile(within, (BANDS, 1))
    low.sort(axis=1)
    key = np.arange(BANDS, dtype=_U) * _U(64) + _U(level)
    for k in range(BAND_SAMPLES):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + (low[:, k].astype(_U) << _U(8)) + x[low[:, k]])
    return key


def _unpacked(x: bytes) -> tuple[int, int, np.ndarray]:
    return x[0], int.from_bytes(x[1:9], "big"), np.frombuffer(x, np.uint8, offset=9)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [band_keys(*_unpacked(x)) for x in batch["print"].to_pylist()]
        node = np.repeat(batch["node"].to_numpy(), list(map(len, made)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, _U), *made]).view(np.int64)), pa.array(node, pa.int64())], ["key", "rep"])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the near pairs of each bucket, or pair of its tiles: what fails against one root is tried against the others."""
    by = ["key", "i", "j"]
    for t in groups(batches, by):
        a, b, ends, node = [], [], bounds(t, by), t["rep"].to_numpy()
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            if end - begin < 2:
                continue
            known = [_unpacked(x) for x in t["print"][begin:end].to_pylist()]
            level = np.array([k[0] for k in known])
            # each one's bytes at its own level, and at the next one, where it is compared with longer texts
            wide = np.zeros((2, len(known), max(len(k[2]) for k in known)), np.uint8)
            for i, (own, n, x) in enumerate(known):
                wide[0, i, : len(x)] = x
                up = at_level(n, own, x, own + 1)
                wide[1, i, : len(up)] = up
            rest = np.arange(len(known))
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    gap = level[rest] - level[x]
                    near = np.zeros(len(rest), bool)
                    for d, mine, theirs in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
                        of = np.flatnonzero(gap == d)
                        near[of] = alike(wide[mine, x], wide[theirs, rest[of]]) >= NEAR
                    hit, rest = rest[near], rest[~near]
                    front.extend(hit)
                    a += [node[begin + x]] * len(hit)
                    b += node[begin + hit].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_classes(prints: DataFrame) -> DataFrame:
    """node, class_id of the fingerprints that have a near one, or come more than once, among rows (doc_id, node, print).

    node is a hash of the fingerprint, so that equal ones are one node. Bands of sampled steps make buckets; in each,
    tile by tile where it is large, a forest of the pairs with a likeness of NEAR is grown over the whole fingerprints.
    class_id is the least doc_id that such links reach. A pair with a likeness s shares no band with
    probability (1 - s^3)^24: 4 in 100 at NEAR, 1 in 1,000 at 0.64, whatever their lengths (levels are tried one apart
    too). Rows without a doc_id don't count.
    """
    rows = prints.filter("doc_id is not null")
    each = cut(rows.select("node", "print").dropDuplicates(["node"]))
    buckets = cut(shared_buckets(each.mapInArrow(_banded, "key long, rep long"), TILE))
    many = small(buckets.filter("tile > 0").groupBy("key").agg((F.max("tile") + 1).alias("tiles")))
    needed = small(cut(buckets.select(F.col("rep").alias("node")).distinct()))
    known = each.join(needed, "node", "left_semi")
    told = buckets.join(many, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).join(known.withColumnRenamed("node", "rep"), "rep")
    met = told.select("key", tile_pairs("tile", "tiles").alias("p"), "rep", "print").select("key", "p.i", "p.j", "rep", "print")
    found = components(met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_grown, "a long, b long"))
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(small(cut(found)), "node", "left")
    own = cut(own.filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node")))
    least = own.groupBy("component").agg(F.min("least").alias("class_id"))
    return own.join(least, "component").select("node", "class_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and class_id of each row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's, in descending order of doc_id; the last document is followed by the first. Texts
    move once: dealt by range of doc_id and sorted, each row has its next one after it. Only the rows at
    the end of a part wait for the first text of a later part; those pairs, a few a part, are finished apart.
    class_id is the least doc_id of the near documents that near_classes() joins.

    Null texts are empty. A document alone is its own next one. Of rows sharing a doc_id (or having
    none, which comes last) each is fingerprinted by itself, and as a next document the one with the least hash
    stands for all; they are dealt by that hash, so a hot doc_id is many parts. Rows without a doc_id have a null class_id.
    An empty table gives an empty one. Equal texts have equal fingerprints and classes. A very long text is
    walked in parts of WALK characters side by side: a worker holds some forty bytes a character of it. Ids are longs: others must be
    cast before. Other columns of docs aren't
    returned.
    """
    rows = results(docs).withColumn("node", F.xxhash64("print"))
    classes = small(cut(near_classes(rows)))
    out = rows.join(classes, "node", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
