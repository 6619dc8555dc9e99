
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n, line of text files (gzip, bzip2 or plain; xz through `xz_lines`). Files are units: a line's number counts from its file's beginning."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-02's input: Spark has no xz codec; files are decompressed as streams, line by line."""

    def run(batches: Iterator) -> Iterator:
        import io
        import lzma

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple[int, str]] = []
                for n, line in enumerate(io.TextIOWrapper(lzma.LZMAFile(io.BytesIO(content)), encoding="utf-8", errors="replace")):
                    rows.append((n, line.rstrip("\r\n")))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["path", "n", "line"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["path", "n", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, n int, line string")


def _joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*keys).agg(text.alias("text"))


def line_blocks(lines: DataFrame, size: int = 200, every: int = 1) -> DataFrame:
    """S-01: blocks of `size` lines as documents, of which every k-th is kept; the last may be short."""
    return _joined(lines.withColumn("block", F.floor(F.col("n") / size)).where(F.col("block") % every == 0), ["path", "block"])


def blank_separated(lines: DataFrame, every: int = 1) -> DataFrame:
    """S-02, W-05: documents between blank lines."""
    blank = (F.btrim("line") == "").cast("int")
    island = F.sum(blank).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    docs = _joined(lines.withColumn("island", island).where(F.btrim("line") != ""), ["path", "island"])
    rank = F.row_number().over(Window.partitionBy("path").orderBy("island")) - 1
    return docs.withColumn("doc", rank).where(F.col("doc") % every == 0).drop("island")


def parquet_documents(spark: SparkSession, path: str, types: list[str] | None = None, every: int = 1) -> DataFrame:
    """S-03: doc_id, type and text as far as they are there; `every` counts rows of the wanted types, null texts among them."""
    df = spark.read.parquet(path)
    names = [c for c in ("doc_id", "type", "text") if c in df.columns]
    df = df.select(*names, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    if types and "type" in names:
        df = df.where(F.col("type").isin(types))
    if every > 1:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("row")) - 1).where(F.col("_n") % every == 0).drop("_n")
    return df.where(F.col("text").isNotNull() & (F.col("text") != ""))


def conllu_documents(lines: DataFrame) -> DataFrame:
    """S-04: one document for each file, of its `# text =` lines."""
    return _joined(lines.where(F.col("line").startswith("# text =")).withColumn("line", F.btrim(F.substring_index("line", "=", -1))), ["path"])


def conllu_tokens(lines: DataFrame) -> DataFrame:
    """S-07: path, n, form, upos, feats (map) of plain token lines."""
    parts = F.split("line", "\t")
    return lines.where(~F.col("line").startswith("#") & (F.size(parts) == 10) & ~F.element_at(parts, 1).rlike("[-.]")).select(
        "path", "n", F.element_at(parts, 2).alias("form"), F.element_at(parts, 4).alias("upos"), F.when(F.element_at(parts, 6) != "_", F.str_to_map(F.element_at(parts, 6), F.lit(r"\|"), F.lit("="))).alias("feats")
    )


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """S-05: a file's column as one document."""
    df = spark.read.csv(path, header=True).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), F.col(column).alias("line"))
    return _joined(df.where("line is not null"), ["path"])


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("id", T.LongType()), T.StructField("redirect", T.StringType()), T.StructField("revision", T.StructType([T.StructField("text", T.StringType())]))])


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """S-06: main-space pages with text that are no redirects."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    return pages.where((F.col("ns") == "0") & F.col("redirect").isNull() & (F.coalesce(F.btrim("revision.text"), F.lit("")) != "")).select("id", "title", F.col("revision.text").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-08: records with the folder (model) and file that they are from; a line that isn't JSON is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumns({"file": F.col("_metadata.file_name"), "model": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)})


def last_by_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """S-09: one record for each key, the last in order."""
    columns = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def metric_payloads(spark: SparkSession, path: str) -> DataFrame:
    """S-10: metric, scores; files without scores are left out, of one metric the last file counts."""
    df = spark.read.option("multiLine", True).schema("metric string, scores array<double>").json(path).withColumn("file", F.col("_metadata.file_path"))
    return last_by_key(df.where("scores is not null"), "metric", "file").select("metric", "scores")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-11."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def aligned(files: dict[str, DataFrame]) -> DataFrame:
    """S-12: line files side by side by line number; a difference in length is an error."""
    out = None
    for name, lines in files.items():
        one = lines.select("n", F.col("line").alias(name))
        out = one if out is None else out.join(one, "n", "full")
    whole = [F.coalesce(F.col(c), F.raise_error(F.lit("files differ in length")).cast("string")).alias(c) for c in files]
    return out.select("n", *whole)


def overrides(lines: DataFrame) -> DataFrame:
    """S-15: tab-separated overrides (nine fields; lists by ; and +), blank lines and # comments left out."""
    parts = F.split("line", "\t")
    field = lambda k: F.element_at(parts, k)
    rows = lines.where((F.btrim("line") != "") & ~F.col("line").startswith("#")).where(F.when(F.size(parts) >= 9, True).otherwise(F.raise_error(F.lit("nine fields expected")).cast("boolean")))
    return rows.select(field(1).alias("surface"), field(2).alias("rule"), field(3).alias("mode"), field(4).alias("lemma"), field(5).alias("pos"), F.split(field(6), r"\+").alias("tags"), F.str_to_map(field(7), F.lit(";"), F.lit("=")).alias("bindings"), F.str_to_map(field(8), F.lit(";"), F.lit("=")).alias("features"), field(9).alias("note"))


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """S-14: YAML files as JSON text, one row each, for from_json with an explicit schema."""

    @F.pandas_udf(T.StringType())
    def as_json(text):  # type: ignore[no-untyped-def]
        import json

        import yaml

        return text.map(lambda t: json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str))

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), as_json("value").alias("json"))


def overlaid(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """S-14: records of the overlay replace those of the same key; a key that is twice in one of them is an error."""
    for df in (base, overlay):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is there twice")
    return base.join(overlay.select(key), key, "left_anti").unionByName(overlay, allowMissingColumns=True)
