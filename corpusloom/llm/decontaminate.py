"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names (capitalised words inside a sentence) and units become typed placeholders; what is left of a text is its template. Windows of
`WINDOW` template words are hash-joined with those of the benchmark. Windows that match on one diagonal (place in the document minus place in
the item) must fill the item's slots consistently: an item value stands for one value of the document throughout, or
nearly all are the item's own. An item leaks into a document
where at least `COVERAGE` of its windows are found on consistent diagonals, verbatim or with other parameters.

The benchmark's windows are broadcast, behind a Bloom filter, while there are at most `BROADCAST_WINDOWS` of them (counted first) and
shuffled otherwise. A template of
fewer than `LITERALS` plain words says too little: such windows of the benchmark are bare and match word for word and value for value only. Where it is more, an item's coverage is
that of its other windows alone, so that other parameters don't count against it. Items shorter than a window are one window.

Edge cases: null and empty texts match nothing; null items and items without words are never found; repeated items are found together;
rows are known by doc_id and a hash of the text, so that repeated rows have equal results, rows of one doc_id with other texts their own, and
rows without doc_id are looked at like all others; very long texts are one row at a time; empty tables give empty results or none contaminated;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, written

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: A diagonal that fills this share of its slots with the item's own values counts, whatever the rest.
VERBATIM = 0.75
BROADCAST_WINDOWS = 1_000_000
#: Of the filter that documents' windows pass before the join.
MOST_BITS = 1 << 22
UNITS = ("mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds degree degrees mph kmh").split()
#: A placeholder is this mark and a letter for its type; the value follows it in the token.
MARK = "\u0001"


def tokens(text: Column) -> Column:
    """Lower-cased words; those that are slots begin with MARK and #, n or u."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu}\p{Ll})", f"{MARK}n")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])\p{N}[\p{N}.,]*(?<![.,])", f"{MARK}#$0")
    t = F.regexp_replace(t, rf"({MARK}#[\p{{N}}.,]*\p{{N}}) ?(?=(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", f"$1 {MARK}u")
    return F.filter(F.split(F.lower(t), rf"[^{MARK}#\p{{L}}\p{{M}}\p{{N}}.,]+|[.,]+(?!\p{{N}})|(?<!\p{{N}})[.,]+"), lambda w: w != "")


def template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith(MARK), w.substr(1, 2)).otherwise(w))


def _windows(hashes: Column, widths: list[int]) -> Column:
    """array<struct<width, pos, hash>> of every `width` template words, for each width."""

    def of(width: int) -> Column:
        n = F.size(hashes) - (width - 1)
        every = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(width).alias("width"), i.alias("pos"), F.xxhash64(F.slice(hashes, i, width)).alias("hash")))
        return F.when(n > 0, every).otherwise(F.array().cast("array<struct<width:int,pos:int,hash:bigint>>"))

    return of(widths[0]) if len(widths) == 1 else F.concat(*map(of, widths))


def _once(x: Column) -> Column:
    """The same column, computed once a row: filters that are inferred from explode() would be pushed below it and compute it again."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def _exploded(df: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """A row for each window of each row; `df` has `hashes`."""
    return df.select(*keys, F.explode(_windows(F.col("hashes"), widths)).alias("w")).select(*keys, "w.*")


def _bit(h: Column, shift: int, bits: int) -> tuple[Column, Column]:
    place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """A Bloom filter over a column `hash`, as a constant array of longs."""
    at = hashes.select(F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in (_bit(F.col("hash"), k, bits) for k in (0, 22))))).alias("x")).select("x.*").distinct()
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in at.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).collect():  # bits / 64 rows at most
        out[r.w] = r.m
    return F.lit(out)


def _maybe(bitmap: Column, h: Column, bits: int) -> Column:
    ok = [F.getbit(F.get(bitmap, w.cast("int")), b) == 1 for w, b in (_bit(h, k, bits) for k in (0, 22))]
    return ok[0] & ok[1]


def _hashes() -> Column:
    return F.transform(template(F.col("tokens")), lambda w: F.xxhash64(w))


def _exact() -> Column:
    """Hashes of words and values as they stand, whatever type of slot they are; apart from those of templates."""
    return F.transform("tokens", lambda w: F.xxhash64(F.when(w.startswith(MARK), w.substr(F.lit(3), F.length(w))).otherwise(w), F.lit("exact")))


def row_key(docs: DataFrame) -> Column:
    """What a row of `docs` is known by."""
    return F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_key"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc (row_key of a document), item_id, coverage, reparameterised for each benchmark item that leaks into a document."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", tokens(F.col("text")).alias("tokens"))
    items = items.groupBy("tokens").agg(F.array_sort(F.collect_set("item_id")).alias("items")).where(F.size("tokens") > 0).withColumn("item", F.element_at("items", 1))
    items = written(items.withColumn("hashes", _hashes()), "benchmark-items", 8)
    short = [r.n for r in items.where(F.size("tokens") < window).select(F.size("tokens").alias("n")).distinct().collect()]  # at most window - 1 lengths
    with_exact = items.withColumn("exact", _exact())
    sides = []
    for kind in ("hashes", "exact"):
        each = with_exact.select("item", "tokens", F.col(kind).alias("hashes"), F.lit(kind == "exact").alias("bare"))
        sides.append(_exploded(each.where(F.size("tokens") >= window), ["item", "tokens", "bare"], [window]))
        sides += [_exploded(each.where(F.size("tokens") == w), ["item", "tokens", "bare"], [w]) for w in short]
    own = sides[0]
    for side in sides[1:]:
        own = own.union(side)
    plain = F.size(F.filter(F.slice("tokens", F.col("pos"), F.col("width")), lambda t: ~t.startswith(MARK)))
    own = written(own.where(F.col("bare") == (plain < F.least(F.lit(LITERALS), F.col("width")))).select("item", "bare", "width", F.col("pos").alias("item_pos"), "hash"), "benchmark-windows", 8)
    n_windows = own.groupBy("item").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(~F.col("bare")).alias("n_templates"))
    bare = [r.width for r in own.where("bare").select("width").distinct().collect()]  # at most `window` widths

    n_own = own.count()
    mine = docs.select(row_key(docs).alias("doc"), _once(tokens(F.col("text"))).alias("tokens")).select("doc", "tokens", _once(_hashes()).alias("hashes"), *([_once(_exact()).alias("exact")] if bare else []))
    windows = _windows(F.col("hashes"), [window, *short])
    if bare:
        windows = F.concat(windows, _windows(F.col("exact"), bare))
    found_in = F.slice("tokens", F.col("pos"), F.col("width")).alias("doc_tokens")
    if n_own <= BROADCAST_WINDOWS:  # windows that the benchmark can't have are left out before they are rows, so that the tokens go along with those that stay
        bits = min(max(1 << 16, 1 << (32 * n_own).bit_length()), MOST_BITS)
        bitmap = _bitmap(own, bits)
        near = mine.select("doc", "tokens", _once(F.filter(windows, lambda w: _maybe(bitmap, w["hash"], bits))).alias("near")).select("doc", "tokens", F.explode("near").alias("w")).select("doc", "tokens", "w.*")
        matches = near.join(F.broadcast(own), ["width", "hash"]).select("doc", "item", "bare", "width", "pos", "item_pos", found_in)
    else:
        near = mine.select("doc", F.explode(windows).alias("w")).select("doc", "w.*").join(own, ["width", "hash"]).select("doc", "item", "bare", "width", "pos", "item_pos")
        matches = near.join(mine.select("doc", "tokens"), "doc").select("doc", "item", "bare", "width", "pos", "item_pos", found_in)
    matches = written(matches.distinct(), "leak-windows")

    item_tokens = items.select("item", F.col("tokens").alias("item_tokens"))
    item_slots = F.exists("item_tokens", lambda t: t.startswith(MARK))
    with_slots = matches.where("not bare").join(item_tokens.where(item_slots), "item")
    pairs = F.arrays_zip(F.slice("item_tokens", F.col("item_pos"), F.col("width")).alias("i"), F.col("doc_tokens").alias("d"))
    filled = with_slots.select("doc", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), F.explode(F.filter(pairs, lambda p: p["i"].startswith(MARK))).alias("p"))
    slots = filled.groupBy("doc", "item", "diagonal", "p.i").agg(F.min("p.d").alias("low"), F.max("p.d").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.d") == F.col("p.i")).alias("same"))
    slots = slots.groupBy("doc", "item", "diagonal").agg((F.bool_and(F.col("low") == F.col("high")) | (F.sum("same") >= F.sum("n") * VERBATIM)).alias("consistent"), F.bool_or(F.col("low") != F.col("i")).alias("changed"))

    found = matches.withColumn("diagonal", F.col("pos") - F.col("item_pos")).join(slots, ["doc", "item", "diagonal"], "left").where(F.col("bare") | F.coalesce("consistent", F.lit(True)))
    templates = F.count_distinct(F.when(~F.col("bare"), F.col("item_pos")))
    found = found.groupBy("doc", "item").agg(F.countDistinct("item_pos").alias("hit"), templates.alias("hit_templates"), F.bool_or(~F.col("bare") & F.coalesce("changed", F.lit(False))).alias("reparameterised")).join(n_windows, "item")
    found = found.withColumn("coverage", F.greatest(F.col("hit") / F.col("n_windows"), F.try_divide("hit_templates", "n_templates"))).where(F.col("coverage") >= coverage)
    return found.join(items.select("item", "items"), "item").select("doc", F.explode("items").alias("item_id"), "coverage", "reparameterised")


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id of every document with contaminated, item_ids and the largest coverage."""
    leaks = find_leaks(docs, benchmark).groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.bool_or("reparameterised").alias("reparameterised"))
    return docs.select(row_key(docs).alias("doc")).join(leaks, "doc", "left").select(
        "doc.doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document, with the benchmark items that leak into it."""
    return marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents into which no benchmark item leaks; each row is judged by its own text, with a doc_id or without."""
    leaks = find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc").distinct()
    return docs.join(leaks, row_key(docs) == leaks["doc"], "left_anti").select(*docs.columns)
