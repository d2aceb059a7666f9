"""Byte-level BPE encoding and decoding of whole texts, in two tiers.

Tier one: a minimal perfect hash over the vocabulary finds pre-tokens that are one token. Tier two: the
others are merged by rank with a heap over linked bytes. A bounded memory of recent pre-tokens stands
before both, so that each is usually resolved once in a worker.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import alone_in_worker, table, texts_of

#: Pre-tokens remembered in each of two generations; longer ones than REMEMBER_BYTES are never kept.
REMEMBER, REMEMBER_BYTES = 150_000, 64
_MASK, _STRIDE, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, by hash and displacement.

    Keys are dealt to n/4 buckets; for each bucket, largest first, the least displacement is sought that
    sends all its keys to free slots. A lookup is one 128-bit hash, one displacement and one slot; the
    caller compares the slot's key, since other strings fall on slots too.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        deal: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, (b, _) in enumerate(hashes):
            deal[b].append(i)
        self.displacement, self.slots = [0] * self.buckets, [-1] * self.n
        free = np.ones(self.n, bool)
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(deal[b])):
            own = deal[b]
            if len(own) == 1:
                singles.append(b)
            elif own:
                h = np.array([hashes[i][1] for i in own], np.uint64)
                self.displacement[b], at = self._fit(h, free)
                free[at] = False
                for i, s in zip(own, at.tolist(), strict=True):
                    self.slots[s] = i
        for b, s in zip(singles, np.flatnonzero(free).tolist(), strict=False):  # one key: its slot is named outright
            self.displacement[b], self.slots[s] = -1 - s, deal[b][0]

    def _fit(self, h: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The least displacement at which the hashes fall on free slots of their own, and those slots."""
        d, width = 0, 64
        while True:
            x = h[:, None] + np.arange(d, d + width, dtype=np.uint64) * np.uint64(_STRIDE)
            at = ((x ^ (x >> np.uint64(29))) * np.uint64(_FACTOR) >> np.uint64(24)) % np.uint64(self.n)
            for i in np.flatnonzero(free[at].all(axis=0)):
                if len(set(at[:, i].tolist())) == len(h):
                    return d + int(i), at[:, i].astype(np.int64)
            d, width = d + width, 8192

    def _hash(self, key: bytes) -> tuple[int, int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.buckets, h & _MASK

    def find(self, key: bytes) -> int:
        """Index of the only key that this one can be."""
        b, x = self._hash(key)
        d = self.displacement[b]
        if d < 0:
            return self.slots[-1 - d]
        x = x + d * _STRIDE & _MASK
        return self.slots[(((x ^ (x >> 29)) * _FACTOR & _MASK) >> 24) % self.n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens of one pre-token: always the pair of least rank, the leftmost of equals.

    end[i] links the symbol that starts at byte i to the next one, start[j] the symbol that ends at j to
    its beginning; a heap entry is stale when either link has changed.
    """
    n = len(piece)
    end, start = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j], start[k] = k, 0, i
        if i and (r := ranks.get(piece[(h := start[i]) : k])) is not None:
            heapq.heappush(heap, (r, h, i, k))
        if k < n and (r := ranks.get(piece[i : end[k]])) is not None:
            heapq.heappush(heap, (r, i, k, end[k]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; a dict of what was met lately."""

    def __init__(self, tokens: list[tuple[bytes, int]], hashed: PerfectHash, pattern: str):
        import regex

        self.find_all = regex.compile(pattern).findall
        self.tokens, self.hashed, self.ranks, self.older = tokens, hashed, dict(tokens), {}
        self.by_rank = {r: t for t, r in tokens}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            piece = word.encode("utf-8", "surrogatepass")
            token, rank = self.tokens[self.hashed.find(piece)]
            found = [rank] if token == piece else merge(piece, self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(piece) > REMEMBER_BYTES:
                return ids
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find_all(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    alone_in_worker(_ENCODERS)
    key, tokens, hashed, pattern = shared.value
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokens, hashed, pattern)
    return _ENCODERS[key]


class Codec:
    """Column functions for one rank file. The broadcast holds the vocabulary alone, whose size is the file's."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = list(read_ranks(path).items())
        shared = spark.sparkContext.broadcast((f"{path}\n{pattern}", tokens, PerfectHash([t for t, _ in tokens]), pattern))

        @F.arrow_udf("ids binary, decoded binary")
        def round_trip(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _encoder(shared)
            for column in texts:
                ids = pa.array([own.encode(x) if x else b"" for x in texts_of(column)], pa.binary())
                decoded = pa.array([own.decode(x) for x in texts_of(ids)], pa.binary())
                yield pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

        @F.arrow_udf("binary")
        def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _encoder(shared)
            for column in ids:
                yield pa.array([own.decode(x) if x else b"" for x in texts_of(column)], pa.binary())

        self._round_trip, self._decode = round_trip, decode

    def round_trip(self, text: Column) -> Column:
        """ids: a text's ids as little-endian unsigned 32-bit integers, none for null and empty texts; decoded: their bytes again."""
        return self._round_trip(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for."""
        return self._decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids (packed, binary), n_tokens and decoded (binary), in one pass without a shuffle.

    Every row is encoded by itself: null and empty texts give no ids, repeated rows repeat their
    result, an empty table stays empty, other columns pass through (columns of these three names are
    replaced). Special strings inside texts are ordinary text. A very long text is encoded whole; one long pre-token takes
    some numbers a byte.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    coded = docs.withColumn("ids", codec.round_trip(F.col("text")))
    return coded.withColumns({"ids": F.col("ids.ids"), "n_tokens": (F.octet_length("ids.ids") / 4).cast("long"), "decoded": F.col("ids.decoded")})


def digests(coded: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the kept columns, n_tokens and the digests of encode_documents()'s rows."""
    return coded.select("doc_id", *kept, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
