"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, language, media, near_dups, packing, quality, suffix_array, suffix_tree, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_suffix_array_dedup": suffix_array.query,
    "op3_substring_dedup": suffix_tree.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": language.query,
    "op6_byte_bpe": bpe.query,
    "op7_packing": packing.query,
    "op8_minhash_near_dedup": near_dups.query,
    "op9_media_columns": media.query,
    "op10_url_filters": url_filter.query,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_suffix_array_dedup": suffix_array.ORACLE,
    "op3_substring_dedup": suffix_tree.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
}
