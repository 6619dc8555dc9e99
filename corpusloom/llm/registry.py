"""Queries of the training-data operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, cap_filters, chat, decontaminate, histogram_shards, jaccard, katz, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_trees": quality.query,
        "op2_cap_filters": cap_filters.query,
        "op3_relative_lz": substring.query,
        "op4_byte_bpe": bpe.query,
        "op5_chat_templates": chat.query,
        "op6_decontaminate": decontaminate.query,
        "op7_histogram_shards": histogram_shards.query,
        "op8_grouped_prefix_join": jaccard.query,
        "op9_katz_backoff": katz.query,
        "op10_toxicity_automata": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_cap_filters": cap_filters.ORACLE_SQL, "op5_chat_templates": chat.ORACLE_SQL, "op3_relative_lz": substring.ORACLE_SQL}
