"""A corpus pipeline of five operators, each stage a table written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import byte_bpe, line_dedup, minhash, mixing, quality
from tidewright.llm.common import cut, table

#: Words of the near-dedup stage's shingles; their sets are linked at a similarity of 0.8.
WORDS = 5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labels of those given."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of many documents."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles."""
    return minhash.keep_one(docs, WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; every document stays, those of small sources come more than once. The files are the mix in order."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (packed), digests, and their place in the mix: in order of mix_part and mix_row."""
    import public_tokenizers

    coded = byte_bpe.encode_documents(mixing.with_places(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(coded, "mix_part", "mix_row", "ids")


STAGES = [("quality classifier", good), ("line dedup", without_common_lines), ("minhash near-dedup", one_of_each_group), ("source mixing", mixed), ("byte-level bpe", encoded)]
#: The classifier is beyond SQL; the tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
