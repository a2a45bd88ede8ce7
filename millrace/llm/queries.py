"""The registered queries of this subpackage and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (compact_windows, decontaminate, divergence, hard_negatives, language, language_model,
                          mixing, ngram_join, pii, quality, suffix_dedup, token_counts, url_filter)

QUERIES = (quality.op1_quality_rules, ngram_join.op2_ngram_jaccard, mixing.op3_mix_sources,
           suffix_dedup.op4_suffix_dedup, language.op5_language_id, url_filter.op6_url_filter,
           token_counts.op7_token_counts, pii.op8_pii, compact_windows.op9_compact_windows,
           decontaminate.op10_decontaminate, hard_negatives.op11_hard_negatives,
           language_model.op12_language_model, divergence.op13_source_divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": hard_negatives.OP11_SQL, "op13_source_divergence": divergence.OP13_SQL}
