"""Queries of the training-text operators by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderweave.llm import chat_format, context_tree, fingerprints, language_id, piece_tokens, quality_rules, repeat_removal, secret_scan, simhash_dedup, source_mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_lm_scoring": context_tree.op3_lm_scoring,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_source_mixing": source_mixing.op5_source_mixing,
    "op6_piece_tokens": piece_tokens.op6_piece_tokens,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_repeat_removal": repeat_removal.op8_repeat_removal,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": chat_format.OP4_SQL,
    "op5_source_mixing": source_mixing.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
