"""

A scored record has system, slot, condition, item, template, gold (null where there is none), emitted, outcome and the flags that follow from it.
NULL says undefined, never False: `correct` is null without gold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The outcomes of a judgement.
OUTCOMES = ["CORRECT", "WRONG", "COMMITTED", "UNDECIDABLE", "AVOIDANT_DROP", "AVOIDANT_NEUTRAL", "AVOIDANT_NEG", "UNPARSED"]
COMMITTED = ["CORRECT", "WRONG", "COMMITTED", "UNDECIDABLE"]
AVOIDANT = ["AVOIDANT_DROP", "AVOIDANT_NEUTRAL", "AVOIDANT_NEG"]
CELL = ["system", "slot", "condition"]
FLOOR_N, FLOOR_SHARE = 30, 0.30


def share(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n)


def cells(scored: DataFrame, keys: list[str] | None = None, panel_compat: bool = False) -> DataFrame:
    """A-05, A-06, A-39, P-07: counts of outcomes, three accuracies, coverage, floors with their reason. Accuracies are null without gold, but
    for `panel_compat`, where a cell with enough committed records and no gold has 0."""
    keys = keys or CELL
    o = F.col("outcome")
    n = F.count(F.lit(1))
    out = scored.groupBy(*keys).agg(
        n.alias("n"), F.countDistinct("template").alias("n_templates"), *(F.count_if(o == x).alias(x.lower()) for x in OUTCOMES), F.count_if(o.isin(COMMITTED)).alias("n_committed"),
        F.count_if(o.isin(AVOIDANT)).alias("n_avoidant"), F.count("gold").alias("n_gold"),
    )
    c, floor = F.col("n_committed"), (F.col("n_committed") < FLOOR_N)
    low = F.col("n_committed") < F.col("n") * FLOOR_SHARE
    has_gold = F.lit(True) if panel_compat else F.col("n_gold") > 0
    reason = F.when(~has_gold, "no_gold").when(floor, "too_few").when(low, "low_share")
    return out.withColumns({
        "acc_strict": F.when(has_gold, share(F.col("correct"), F.col("n"))),
        "acc_parsed": F.when(has_gold, share(F.col("correct"), F.col("n") - F.col("unparsed"))),
        "acc_committed": F.when(reason.isNull(), share(F.col("correct"), c)),
        "committed_rate": share(c, F.col("n")),
        "coverage": share(F.col("n") - F.col("unparsed"), F.col("n")),
        "floor_reason": reason,
    })


def unbalanced(cell_table: DataFrame) -> DataFrame:
    """A-06: cells whose outcomes don't add up to n; there are none."""
    return cell_table.where(sum((F.col(x.lower()) for x in OUTCOMES), F.lit(0)) != F.col("n"))


def modal_value(scored: DataFrame, keys: list[str]) -> DataFrame:
    """A-05, A-20: the emitted value of most records and its share; ties go by value."""
    by = scored.where("emitted is not null").groupBy(*keys, "emitted").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    ranked = by.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "emitted"))).withColumn("total", F.sum("n").over(w))
    return ranked.where("r = 1").select(*keys, F.col("emitted").alias("modal"), "n", (F.col("n") / F.col("total")).alias("modal_share"))


def unanimous(modal: DataFrame, keys: list[str]) -> DataFrame:
    """A-20: whether all systems have one modal value."""
    return modal.groupBy(*keys).agg(F.countDistinct("modal").alias("n_values"), F.count(F.lit(1)).alias("n_systems"), F.min("modal").alias("least_modal")).withColumn("unanimous", F.col("n_values") == 1)


def missing_cells(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J-13: combinations of the keys' values that have no record. Dimensions are small; their product is the grid."""
    keys = keys or CELL
    grid = None
    for k in keys:
        values = scored.select(k).distinct()
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))
    return grid.join(scored.select(*keys).distinct(), keys, "left_anti")


def canonical_prompts(scored: DataFrame, canonical: DataFrame) -> DataFrame:
    """P-06: records of the prompt that is canonical for their condition, or of the prompt `nmt`."""
    return scored.join(F.broadcast(canonical.withColumnRenamed("prompt", "_canonical")), "condition", "left").where((F.col("prompt") == "nmt") | (F.col("prompt") == F.col("_canonical"))).drop("_canonical")


def paired(a: DataFrame, b: DataFrame, keys: list[str], flag: str = "is_correct") -> DataFrame:
    """J-08, U-05: discordant counts of two conditions over the same items: b (first right, second wrong) and c."""
    x = a.groupBy("system", *keys).agg(F.max(flag).alias("x"))
    y = b.groupBy("system", *keys).agg(F.max(flag).alias("y"))
    return x.join(y, ["system", *keys]).groupBy("system").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))


def gradient(cell_table: DataFrame, order: list[str]) -> DataFrame:
    """A-06, U-04's point estimate: accuracy by condition and the drop from the first to the last of `order`."""
    wide = cell_table.groupBy("system", "slot").pivot("condition", order).agg(F.first("acc_strict"))
    return wide.withColumn("drop", F.col(order[0]) - F.col(order[-1]))


def prompt_robustness(records: DataFrame) -> DataFrame:
    """J-09, A-17: items that every prompt has, accuracy of each prompt on them, and the range."""
    n = records.select("prompt").distinct().count()
    common = records.groupBy("item").agg(F.countDistinct("prompt").alias("k")).where(F.col("k") == n).select("item")
    by = records.join(common, "item", "left_semi").groupBy("prompt").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row for each prompt
    return by.withColumn("range", F.max("acc").over(w) - F.min("acc").over(w))


def prompt_ranges(records: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """A-17 by cell: how far prompts' strict accuracies lie apart on the items that all prompts of the cell have. Cells of one prompt or of fewer common
    items have no row; the range is null where fewer than two prompts pass the floors."""
    n = records.groupBy(*keys).agg(F.countDistinct("prompt").alias("_n")).where("_n > 1")
    common = records.groupBy(*keys, "item").agg(F.countDistinct("prompt").alias("_k")).join(n, keys).where("_k = _n").select(*keys, "item")
    enough = common.groupBy(*keys).count().where(F.col("count") >= least)
    by = cells(records.join(common, [*keys, "item"], "left_semi").join(enough, keys, "left_semi"), [*keys, "prompt"])
    acc = F.when(F.col("floor_reason").isNull(), F.col("acc_strict"))
    return by.groupBy(*keys).agg(F.when(F.count(acc) > 1, F.max(acc) - F.min(acc)).alias("range"))


def directed_ratio(observed: DataFrame, prior: DataFrame) -> DataFrame:
    """A-19: observed share over prior at the pooled, low and high end; d_low uses the prior's high end."""
    j = observed.join(prior, "value")
    return j.withColumns({
        "d": F.try_divide(F.col("p_observed"), F.col("p")), "d_low": F.try_divide(F.col("p_observed"), F.col("high")), "d_high": F.try_divide(F.col("p_observed"), F.col("low")),
        "sign_flips": (F.col("p_observed") > F.col("low")) & (F.col("p_observed") < F.col("high")),
    })


def length_leak(lengths: DataFrame, keys: list[str], length: str, times: float = 2.5) -> DataFrame:
    """A-21: share of records longer than `times` the upper median. The median is a histogram's: a group costs its distinct lengths."""
    counts = lengths.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_c", F.sum("_n").over(w.orderBy(length).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(w))
    median = run.where(F.col("_c") > F.floor(F.col("_t") / 2)).groupBy(*keys).agg(F.min(length).alias("median"))
    return counts.join(median, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.sum("_n").alias("n"), F.sum(F.when(F.col(length) > times * F.col("median"), F.col("_n")).otherwise(0)).alias("n_long"))


def wording_delta(cell_table: DataFrame, prompts: tuple[str, str], keys: list[str]) -> DataFrame:
    """A-18: accuracy under two wordings side by side."""
    wide = cell_table.groupBy(*keys).pivot("prompt", list(prompts)).agg(F.first("acc_strict"))
    return wide.withColumn("delta", F.col(prompts[1]) - F.col(prompts[0]))


def integrity(records: DataFrame, key: list[str], expected: DataFrame, required: list[str]) -> DataFrame:
    """A-30: by file, rows, duplicates of the key, rows without a required field, and what was expected."""
    per_key = records.groupBy("file", *key).agg(F.count(F.lit(1)).alias("_n"), F.sum(sum((F.col(c).isNull().cast("int") for c in required), F.lit(0)).cast("boolean").cast("int")).alias("_missing"))
    by = per_key.groupBy("file").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") - 1).alias("n_duplicates"), F.sum("_missing").alias("n_missing"))
    return by.join(expected, "file", "full").select("file", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), "n_expected", F.coalesce(F.col("n") == F.col("n_expected"), F.lit(False)).alias("complete"))


def licence_overlap(files: DataFrame, restricted: DataFrame, attested: DataFrame, warn: int = 8, fail: int = 25) -> DataFrame:
    """A-31, J-14: distinct restricted forms in each file that the free corpus does not attest."""
    forms = files.join(restricted.join(attested, "form", "left_anti"), "form", "left_semi").groupBy("file").agg(F.countDistinct("form").alias("n_forms"))
    out = files.select("file").distinct().join(forms, "file", "left").select("file", F.coalesce("n_forms", F.lit(0)).alias("n_forms"))
    return out.withColumn("verdict", F.when(F.col("n_forms") > fail, "FAIL").when(F.col("n_forms") > warn, "WARN").otherwise("OK"))


def audit(rows: DataFrame, key: str, text: Column, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """P-14, A-29: findings (key, code, level) of rows whose text a rule's pattern finds; all rules in one pass."""
    found = F.array(*(F.when(text.rlike(pattern), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, (level, pattern) in rules.items()))
    return rows.select(key, F.explode(F.array_compact(found)).alias("f")).select(key, "f.code", "f.level")
