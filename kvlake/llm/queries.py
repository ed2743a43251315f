"""The registered queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, minhash, packing, pii, sentencepiece_codec, substring_dedup, token_counts, token_output, topk_search, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_topk_search": topk_search.op3_topk_search,
        "op4_pii": pii.op4_pii,
        "op5_minhash": minhash.op5_minhash,
        "op6_packing": packing.op6_packing,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_output": token_output.op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.SQL,
        "op3_topk_search": topk_search.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
    }
