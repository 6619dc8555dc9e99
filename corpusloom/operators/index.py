
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.stats import wilson


def lines(docs: DataFrame, script: X.Script, least: float = 0.8, keys: tuple[str, ...] = ("corpus", "doc_id")) -> DataFrame:
    """P-01: non-blank lines (line_no, line) that are in the script."""
    out = docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.where((F.btrim("line") != "") & X.in_script(F.col("line"), script, least))


def first_lines(of: DataFrame, script: X.Script) -> DataFrame:
    """D-01: lines at their first occurrence by (doc_id, line_no). Counted before any document gate, as a dropped document's lines have been seen.

    The least place of each key, with the line that stands there, is found by partial aggregation: lines are keyed once, a task sends a line once
    however many documents have it, and nothing is joined.
    """
    rest = [c for c in of.columns if c not in ("doc_id", "line_no")]
    first = of.groupBy(X.line_key(F.col("line"), script).alias("_key")).agg(F.min(F.struct("doc_id", "line_no", *rest)).alias("_first"))
    return first.select(*(F.col("_first")[c].alias(c) for c in of.columns))


def gated(docs: DataFrame, script: X.Script, min_tokens: int = 20, min_signs: float = 0.20, least: float = 0.8) -> DataFrame:
    """P-02: corpus, doc_id, text (kept lines), tokens, drop_reason (null for documents that stay)."""
    kept = first_lines(lines(docs, script, least), script)
    body = kept.groupBy("corpus", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = docs.select("corpus", "doc_id").join(body, ["corpus", "doc_id"], "left").withColumn("tokens", X.tokens(F.coalesce("body", F.lit("")), script))
    reason = F.when(F.col("body").isNull(), "dropped_lang").when(F.size("tokens") < min_tokens, "dropped_short").when(X.vowel_sign_ratio(F.lower("body") if script.fold_case else F.col("body"), script) < min_signs, "dropped_quality")
    return out.select("corpus", "doc_id", F.col("body").alias("text"), "tokens", reason.alias("drop_reason"))


def build_report(gated_docs: DataFrame) -> DataFrame:
    """A-03: counters of each corpus."""
    reason = F.col("drop_reason")
    return gated_docs.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_seen"), F.count_if(reason.isNull()).alias("n_docs"), *(F.count_if(reason == r).alias(r) for r in ("dropped_lang", "dropped_short", "dropped_quality")), F.coalesce(F.sum(F.when(reason.isNull(), F.size("tokens"))), F.lit(0)).cast("long").alias("n_tokens")
    )


def capped(docs: DataFrame, script: X.Script, cap: int = 100_000) -> DataFrame:
    """W-02: sentences (corpus, doc_id, sent_no, sentence, tokens) with a running budget of tokens for each document; the one that crosses it is cut."""
    s = docs.select("corpus", "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_no", "sentence")).withColumn("tokens", X.tokens(F.col("sentence"), script)).where(F.size("tokens") > 0)
    before = Window.partitionBy("corpus", "doc_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_before", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0))).where(F.col("_before") < cap)
    return s.withColumn("tokens", F.slice("tokens", F.lit(1), F.least(F.size("tokens"), F.lit(cap) - F.col("_before")).cast("int"))).drop("_before")


def document_forms(tokenised: DataFrame, candidate: Column | None = None) -> DataFrame:
    """A-02: corpus, doc_id, form, n; of candidates only where a condition is given (P-03)."""
    out = tokenised.select("corpus", "doc_id", F.explode("tokens").alias("form"))
    return (out if candidate is None else out.where(candidate)).groupBy("corpus", "doc_id", "form").agg(F.count(F.lit(1)).alias("n"))


def form_types(doc_forms: DataFrame) -> DataFrame:
    """A-01, exact, in two levels: counts of documents are counts of rows."""
    return doc_forms.groupBy("corpus", "form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))


def counted_forms(docs: DataFrame, script: X.Script) -> DataFrame:
    """A-01 off texts (corpus, doc_id, text), exact: corpus, form, n, df, as form_types of document_forms. Workers count each slice of texts by corpus,
    so that what is shuffled are forms, not each document's forms. Rows that share a doc_id are one document: theirs alone are counted by doc_id."""
    again = docs.groupBy("corpus", "doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("corpus").alias("_c"), F.col("doc_id").alias("_d"))
    marked = docs.join(F.broadcast(again.withColumn("_again", F.lit(True))), F.col("corpus").eqNullSafe(F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    plain = F.lower(F.col("text")) if script.fold_case else X.canonical(F.col("text"), script)
    rows = marked.select("corpus", "doc_id", F.coalesce("_again", F.lit(False)).alias("_again"), plain.alias("text"))
    types = {f.name: f.dataType.simpleString() for f in docs.select("corpus", "doc_id").schema}
    pattern = f"[^{script.letters}]+"

    def count(batches):  # type: ignore[no-untyped-def]
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for low, high in X.text_slices(batch.column("text")):
                part = batch.slice(low, high - low)
                words = pc.split_pattern_regex(pc.replace_substring_regex(part.column("text"), f"[{X.ZERO_WIDTH}]", ""), pattern)
                flat, row = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
                coded = flat.dictionary_encode()
                form, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
                full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[form] if len(form) else np.zeros(0, bool)
                which, pairs = pd.factorize(row[full] * size + form[full])
                each = np.bincount(which, minlength=len(pairs))
                one = part.column("_again").to_numpy(zero_copy_only=False)
                group = np.where(one, np.arange(len(part)), pd.factorize(part.column("corpus").to_pandas(), use_na_sentinel=False)[0] + len(part))
                _, first, place = np.unique(group, return_index=True, return_inverse=True)
                at, keys = pd.factorize(place[pairs // size] * size + pairs % size)
                of = pa.array(first[keys // size])
                single = part.column("_again").take(of)
                yield pa.RecordBatch.from_arrays([
                    part.column("corpus").take(of), pc.if_else(single, part.column("doc_id").take(of), pa.scalar(None, part.column("doc_id").type)), single, coded.dictionary.take(pa.array(keys % size)),
                    pa.array(np.bincount(at, each, len(keys)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)),
                ], ["corpus", "doc_id", "_again", "form", "n", "df"])

    made = rows.mapInArrow(count, f"corpus {types['corpus']}, doc_id {types['doc_id']}, _again boolean, form string, n bigint, df bigint")
    by = made.groupBy("corpus", "form", "_again", "doc_id").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return by.groupBy("corpus", "form").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_again"), 1).otherwise(F.col("df"))).alias("df"))


def postings(sentence_tokens: DataFrame, cap: int = 200) -> DataFrame:
    """W-03: the first `cap` sentence ids of each form; truncated where the cap is reached."""
    s = sentence_tokens.select("corpus", "sid", F.explode(F.array_distinct("tokens")).alias("form"))
    ranked = s.withColumn("_r", F.row_number().over(Window.partitionBy("corpus", "form").orderBy("sid"))).where(F.col("_r") <= cap)
    return ranked.groupBy("corpus", "form").agg(F.array_sort(F.collect_list("sid")).alias("sids"), F.count(F.lit(1)).alias("n_post")).withColumn("truncated", F.col("n_post") >= cap)


def frequency(types: DataFrame, asked: DataFrame) -> DataFrame:
    """I-01: asked forms with n and df, 0 where they are absent."""
    return asked.join(types, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("n", F.lit(0)) > 0).alias("attested"))


def with_prefix(types: DataFrame, prefix: str, min_n: int = 1) -> DataFrame:
    """P-05."""
    return types.where(F.col("form").startswith(prefix) & (F.col("n") >= min_n))


def with_suffix(types: DataFrame, suffix: str, min_n: int = 1) -> DataFrame:
    """P-04."""
    return types.where(F.col("form").endswith(suffix) & (F.col("n") >= min_n))


def kwic(sentence_tokens: DataFrame, form: str, window: int = 8) -> DataFrame:
    """W-01: the form's first place in each sentence with its neighbours."""
    at = F.array_position("tokens", form).cast("int")
    hit = sentence_tokens.where(F.array_contains("tokens", form)).withColumn("_at", at)
    left = F.when(F.col("_at") > 1, F.slice("tokens", F.greatest(F.lit(1), F.col("_at") - window), F.least(F.lit(window), F.col("_at") - 1))).otherwise(F.array().cast("array<string>"))
    return hit.withColumn("left", F.array_join(left, " ")).withColumn("right", F.array_join(F.slice("tokens", F.col("_at") + 1, window), " ")).drop("_at", "tokens")


def _range_parts(df: DataFrame, order: str, least_keys: int = 64) -> Column:
    """The part of the order's range that a row is in, as a function of its value alone; nulls are in the last. Cuts are taken once, off keys of least hash."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(least_keys * n)
    keys = [r[0] for r in some.orderBy(order).collect()]
    cuts = [keys[i] for i in sorted({len(keys) * k // n for k in range(1, n)})] if keys else []

    def at(low: int, high: int) -> Column:
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(order) < F.lit(cuts[mid]), at(low, mid)).otherwise(at(mid + 1, high))

    return at(0, len(cuts))


def systematic_sample(df: DataFrame, order: str, every: int) -> DataFrame:
    """W-04: every k-th row, nulls last. Rows are ranked within parts of the order's range, and offsets are the parts' counts: both read the rows, so
    parts must not depend on how a reading is dealt out."""
    parts = df.withColumn("_part", _range_parts(df, order))
    sizes = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(order)))).join(F.broadcast(sizes), "_part")
    return ranked.where((F.col("_before") + F.col("_r") - 1) % every == 0).drop("_part", "_r", "count", "_before")


def slot_values(doc_forms: DataFrame, forms: dict[str, list[str]]) -> DataFrame:
    """A-04: corpus, doc_id, value, n for a small dimension value -> forms."""
    value = F.create_map(*(F.lit(x) for v, fs in forms.items() for f in fs for x in (f, v)))
    return doc_forms.withColumn("value", F.try_element_at(value, F.col("form"))).where("value is not null").groupBy("corpus", "doc_id", "value").agg(F.sum("n").alias("n"))


def slot_distribution(values: DataFrame) -> DataFrame:
    """A-04, A-13: corpus, value, n, total, p with Wilson's interval."""
    by = values.groupBy("corpus", "value").agg(F.sum("n").alias("n"))
    out = by.withColumn("total", F.sum("n").over(Window.partitionBy("corpus")))
    low, high = wilson(F.col("n"), F.col("total"))
    return out.withColumns({"p": F.col("n") / F.col("total"), "low": low, "high": high})


def pooled(distribution: DataFrame, usable_from: int = 200) -> DataFrame:
    """A-15: p over all corpora, ranges over corpora with enough tokens; without such the interval is (0, 1) and the range null."""
    usable = F.col("total") >= usable_from
    out = distribution.groupBy("value").agg(F.sum("n").alias("n"), F.coalesce(F.min(F.when(usable, F.col("low"))), F.lit(0.0)).alias("low"), F.coalesce(F.max(F.when(usable, F.col("high"))), F.lit(1.0)).alias("high"), F.min(F.when(usable, F.col("p"))).alias("least_p"), F.max(F.when(usable, F.col("p"))).alias("most_p"), F.count_if(usable).alias("n_usable"))
    total = distribution.agg(F.sum("n").alias("all_n"))
    return out.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("all_n")).drop("all_n")  # one row


def suffix_inventory(types: DataFrame, rules: list[tuple[str, str]], exceptions: list[str]) -> DataFrame:
    """J-18, J-16, G-11: the first rule (suffix, value) in order that a form ends with, without listed exceptions."""
    rule = F.when(F.lit(False), F.lit(""))
    label = F.when(F.lit(False), F.lit(""))
    for suffix, value in rules:
        rule, label = rule.when(F.col("form").endswith(suffix), suffix), label.when(F.col("form").endswith(suffix), value)
    return types.withColumns({"rule": rule, "value": label}).where(F.col("rule").isNotNull() & ~F.col("form").isin(exceptions))
