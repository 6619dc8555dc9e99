"""From raw documents to token ids, in five stages. Each stage is written and reread before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, jaccard, quality, substring
from corpusloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality.keep_quality),
    ("near_duplicates", jaccard.one_of_each),
    ("repeated_passages", substring.cut_repeats),
    ("decontamination", decontaminate.drop_contaminated),
    ("tokens", bpe.token_stage),
]

#: The classifier, the similarity join and BPE have no SQL form; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
