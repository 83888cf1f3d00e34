"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from loomrank.llm import (
    byte_bpe, centroids, exact_dedup, language_id, lexical_search, line_dedup, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup, toxicity, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_centroids": centroids.op11_centroids,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_secret_scan": secret_scan.op13_secret_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op11_centroids": centroids.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
    }
