"""Token counts of whole texts by a piece model, with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import alone_in_worker, table, texts_of

LIMIT = 4096
#: Pre-tokens remembered in each of two generations; longer ones than REMEMBER_CHARS are never kept.
REMEMBER, REMEMBER_CHARS = 150_000, 48
#: A pre-token: a run of blanks with the word after it, or a line feed. See PieceCounts.prove().
PRE_TOKEN = " *[^ \n]+| +|\n"


def unfit(proto) -> list[str]:
    """What a model's file says that count() doesn't follow; nothing for a model that it counts as the library does."""
    text, trainer = proto.normalizer_spec, proto.trainer_spec
    faults = {
        "its pieces aren't merged by score (BPE)": trainer.model_type != 2,
        "it normalises texts": bool(text.precompiled_charsmap or text.normalization_rule_tsv),
        "it removes white space": text.remove_extra_whitespaces,
        "it puts no blank before a text": not text.add_dummy_prefix or trainer.treat_whitespace_as_suffix,
        "it doesn't write blanks as U+2581": not text.escape_whitespaces,
        "it has user-defined pieces": any(x.type == x.USER_DEFINED for x in proto.pieces),
        "it joins runs of unknown characters, as it has no bytes for them": not trainer.byte_fallback,
    }
    return [fault for fault, there in faults.items() if there]


def read_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Ordinary piece -> score (blanks written as blanks), and whether unknown characters become bytes. Models that count() can't follow are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    if faults := unfit(proto):
        raise ValueError(f"{path} can't be counted: {'; '.join(faults)}")
    ordinary = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in ordinary}, any(model.is_byte(i) for i in range(model.vocab_size()))


class PieceCounts(dict):
    """Pre-token -> its number of tokens.

    Begins with every vocabulary string that is proven to encode alone as one token, so that matching
    pre-tokens are counted directly; others are merged once and remembered for a while.
    """

    def __init__(self, pieces: dict[str, float], by_bytes: bool, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.pieces, self.by_bytes, self.fixed, self.older = pieces, by_bytes, len(whole), {}
        self.whole = dict(self)

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = count_merged(word, self.pieces, self.by_bytes)
            if len(word) > REMEMBER_CHARS:
                return n
        if len(self) >= REMEMBER + self.fixed:
            self.older = dict(self)
            self.clear()
            self.update(self.whole)
        self[word] = n
        return n

    def count(self, text: str, pre_tokens=re.compile(PRE_TOKEN).findall) -> int:
        """Tokens of a text: a blank is put before it, and U+2581 stands for a blank, as in the model."""
        return sum(map(self.__getitem__, pre_tokens(" " + text.replace("▁", " ")))) if text else 0


def count_merged(word: str, pieces: dict[str, float], by_bytes: bool) -> int:
    """Tokens left when the adjacent pair with the best score is merged as long as there is one (leftmost of equals)."""
    n = len(word)
    end, start = list(range(1, n + 1)), list(range(-1, n))
    heap = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := pieces.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j], start[k] = k, 0, i
        if i and (s := pieces.get(word[(h := start[i]) : k])) is not None:
            heapq.heappush(heap, (-s, h, i, k))
        if k < n and (s := pieces.get(word[i : end[k]])) is not None:
            heapq.heappush(heap, (-s, i, k, end[k]))
    count, i = 0, 0
    while i < n:
        known = end[i] > i + 1 or word[i] in pieces
        count += 1 if known or not by_bytes else len(word[i].encode("utf-8", "surrogatepass"))
        i = end[i]
    return count


def prove(pieces: dict[str, float], by_bytes: bool) -> list[str]:
    """The vocabulary strings that encode alone as one token, after the proof that pre-tokens don't meet.

    No piece holds a blank after another character, nor a line feed with anything else, so no merge
    crosses the bounds of PRE_TOKEN and each pre-token can be counted by itself. A model without that
    property is refused.
    """
    if bad := [p for p in pieces if re.search("[^ ] ", p) or "\n" in p and p != "\n"]:
        raise ValueError(f"pieces that cross pre-tokens, such as {bad[0]!r}")
    return [p for p in pieces if re.fullmatch(PRE_TOKEN, p) and count_merged(p, pieces, by_bytes) == 1]


_COUNTERS: dict[str, PieceCounts] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens), in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens; repeated rows repeat their counts, an empty
    table stays empty, other columns pass through (columns of these three names are replaced). A very long text is
    counted whole, pre-token by pre-token; one long pre-token takes some numbers a character. The
    broadcast holds the vocabulary alone.
    """
    pieces, by_bytes = read_pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast((path, pieces, by_bytes, prove(pieces, by_bytes)))

    @F.arrow_udf("long")
    def n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone_in_worker(_COUNTERS)
        key, *parts = shared.value
        if key not in _COUNTERS:
            _COUNTERS[key] = PieceCounts(*parts)
        own = _COUNTERS[key]
        for column in texts:
            yield pa.array([own.count(x) if x else 0 for x in texts_of(column)], pa.int64())

    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "n_tokens": n_tokens("text")})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
