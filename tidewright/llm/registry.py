"""Name -> query, and name -> DuckDB SQL, of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tidewright.llm import byte_bpe, chat_format, edit_fingerprint, embedding_dedup, hard_negatives, line_dedup, minhash, mixing, periodic_runs, quality, substring_dedup, token_count, url_filter

QUERIES = {
    "op1_chat_repair": chat_format.query,
    "op2_source_mixing": mixing.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_url_reputation": url_filter.query,
    "op5_token_count": token_count.query,
    "op6_quality": quality.query,
    "op7_minhash_dedup": minhash.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_edit_fingerprint": edit_fingerprint.query,
    "op10_line_dedup": line_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_substring_dedup": substring_dedup.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_chat_repair": chat_format.SQL,
    "op2_source_mixing": mixing.SQL,
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op4_url_reputation": url_filter.SQL,
    "op7_minhash_dedup": minhash.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
