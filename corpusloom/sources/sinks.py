
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_table(df: DataFrame, path: str, sort: list[str]) -> None:
    """K-01, K-02: a table of the index, by corpus, sorted so that row groups' statistics prune look-ups."""
    df.repartition("corpus", *sort[:1]).sortWithinPartitions("corpus", *sort).write.mode("overwrite").partitionBy("corpus").parquet(path)


def jsonl(df: DataFrame, path: str, partition: str | None = None, once: bool = False) -> None:
    """K-03, K-04: records as lines with keys in column order; `once` never overwrites."""
    columns = [c for c in df.columns if c != partition]
    out = df.select(*([partition] if partition else []), F.to_json(F.struct(*columns)).alias("value"))
    writer = out.write.mode("errorifexists" if once else "overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def long_csv(df: DataFrame, path: str) -> None:
    """K-07."""
    df.write.mode("overwrite").csv(path, header=True)


def aligned_files(df: DataFrame, path: str, line: str, columns: list[str]) -> None:
    """K-08: one file for each column, lines in order of `line`. The range exchange keeps order across part files; merged files aren't needed to stay aligned."""
    ordered = df.repartitionByRange(line).sortWithinPartitions(line).persist()
    for c in columns:
        ordered.select(F.coalesce(F.col(c), F.lit("")).alias("value")).write.mode("overwrite").text(f"{path}/{c}")
    ordered.unpersist()


def report(df: DataFrame, limit: int = 10_000) -> str:
    """K-05, K-09, K-11: a small result as indented JSON; more rows than `limit` are an error."""
    import json

    rows = df.limit(limit + 1).toJSON().collect() if hasattr(df, "rdd") else []
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)
