"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, credentials, embeddings, lines, mixing, neardup, pages, passages, quality, sharding, tokencount, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_sharding": sharding.op5_sharding,
        "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_substring_dedup": passages.op9_substring_dedup,
        "op10_html_extraction": pages.op10_html_extraction,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_secret_scan": credentials.op12_secret_scan,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op8_quality_rules": quality.SQL, "op12_secret_scan": credentials.SQL}
