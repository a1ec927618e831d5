"""The registered queries ``opN_<name>`` of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import (
    bpe, chat_format, jaccard_join, lang_id, line_dedup, mixing, near_vectors, sharding, spelling, substring_dedup,
    token_counts, topk, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.query,
    "op2_token_counts": token_counts.query,
    "op3_line_dedup": line_dedup.query,
    "op4_byte_bpe": bpe.query,
    "op5_exact_topk": topk.query,
    "op6_source_mix": mixing.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_near_vectors": near_vectors.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_language_id": lang_id.query,
    "op11_spelling_variants": spelling.query,
    "op12_sharding": sharding.query,
    "op13_vector_codes": vector_codes.query,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_exact_topk": topk.SQL,
    "op6_source_mix": mixing.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op8_near_vectors": near_vectors.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_sharding": sharding.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
