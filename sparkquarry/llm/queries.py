"""One query per corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm import (
    bpe,
    chat_format,
    decontaminate,
    embedding_dedup,
    html_extract,
    jaccard_join,
    language_id,
    line_dedup,
    lm_score,
    merkle,
    periodic_runs,
    suffix_dedup,
    token_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_bpe": bpe.op3_bpe,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_token_files": token_files.op6_token_files,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_html_extract": html_extract.op11_html_extract,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op11_html_extract": html_extract.SQL,
        "op12_merkle_manifest": merkle.SQL,
    }
