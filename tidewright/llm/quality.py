"""Quality classifier: logistic regression over hashed word n-grams, learned with FTRL updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import alone_in_worker, table, texts_of

#: Weights of the model: 2^BITS hashed features, of which number 0 is the bias.
BITS = 18
#: A document is kept at this score.
KEEP = 0.7
#: About so many labelled documents are learned from (all of them if there are fewer), in so many shards.
SAMPLE, SHARDS, EPOCHS = 24_000, 8, 3
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
REMEMBER = 100_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


def _shape(token: str) -> int:
    """The look of a token: word in lower case, capitalised, upper case, mixed; number; word with digits; marks by kind."""
    if token.isalpha():
        return 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
    if token[0].isalnum() or token[0] == "_":
        return 5 if token.isdigit() else 6
    return 7 if token in ".,;:?!'\"()-" else 8 if len(set(token)) == 1 and len(token) > 1 else 9


class _Tokens(dict):
    """Token -> 60 bits of hash and 4 of shape."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= REMEMBER:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~15 | _shape(token)
        return h


_HASHES = _Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (the bias first) and values of a text: counts of n-grams, scaled to length 1, and 1 for the bias.

    n-grams: words and pairs of words by hash; pairs of shapes, and whether a word repeats the one before it.
    """
    found = _TOKENS(text) if text else []
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    word, shape = h >> _U(4), h & _U(15)
    again = (word[1:] == word[:-1]).astype(np.uint64)
    pair = word[:-1] * _P + word[1:]
    looks = (shape[:-1] * _U(16) + shape[1:]) * _U(2) + again + (_U(1) << _U(62))
    grams = np.concatenate([word, pair, looks]) * _P
    at, n = np.unique((grams >> _U(64 - BITS)).astype(np.int64), return_counts=True)
    at, n = at[at > 0], n[at > 0].astype(float)
    return np.concatenate([[0], at]), np.concatenate([[1.0], n / max(np.sqrt((n * n).sum()), 1e-12)])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the examples, in their order, epochs times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        own = z[at]
        l1 = np.where(at == 0, 0.0, L1) if isinstance(at, np.ndarray) else L1
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in examples:
            w = weights(at)
            g = (sigmoid(w @ x) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (float32) from labels (doc_id, quality) of docs (doc_id, text) that aren't held out.

    About `sample` labelled ids are chosen by hash, so that the join's broadcast side is bounded by it.
    Features are made where the texts are; SHARDS groups learn side by side and their weights are
    averaged. A shard's order is by hashes of id and text, whatever the order of rows. Labels without an id or a quality
    are left out, repeated ones count once; with no usable label every score is a half.
    """
    given = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    given = given.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("label"))
    share = min(1.0, sample / max(1, given.count()))
    pick = F.xxhash64("__id", F.lit("sample"))
    given = given.filter(F.pmod(pick, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone_in_worker(_HASHES)
        for b in batches:
            made = [features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["shard"], b["place"], b["tie"], b["label"], pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], ["shard", "place", "tie", "label", "at", "x"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "tie"], kind="stable")
        examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float), y) for a, x, y in zip(group["at"], group["x"], group["label"], strict=True)]
        return pd.DataFrame({"w": [learn(examples).astype(np.float32).tobytes()]})

    joined = docs.select("doc_id", "text").join(F.broadcast(given), F.col("doc_id") == F.col("__id"))
    place = F.xxhash64("doc_id", F.lit("place"))
    rows = joined.select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), F.xxhash64("text").alias("tie"), "label", "text")
    made = rows.mapInArrow(shown, "shard int, place long, tie long, label int, at binary, x binary")
    fitted = [np.frombuffer(r.w, np.float32) for r in made.groupBy("shard").applyInPandas(fit, "w binary").collect()]  # SHARDS rows of 2^BITS floats
    return np.mean(fitted, axis=0) if fitted else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score and predicted (1 at KEEP or more): sparse dot products with the learned weights.

    Null and empty texts score the bias alone. Repeated rows repeat their score; an empty table stays
    empty; other columns pass through (columns of these two names are replaced). A very long text is scored whole, in
    some numbers a word. The broadcast is the weight vector, of fixed size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, sample))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone_in_worker(_HASHES)
        w = shared.value
        for column in texts:
            yield pa.array([sigmoid(float(w[at] @ x)) for at, x in map(features, texts_of(column))], pa.float64())

    out = docs.withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject, with their own columns."""
    return score(docs, labels).filter("predicted = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
