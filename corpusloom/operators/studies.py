"""

Model outputs (token ids, logits, curves, draws) come as tables; everything here is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of which less is better.
DESCENDING = ("metricx24xl", "metricx24xlqe", "metricx23large")
TINY = 1e-6


def oriented(metric: Column, score: Column, descending: tuple[str, ...] = DESCENDING) -> Column:
    """M-03: scores of which more is better, turned once."""
    return F.when(metric.isin(*descending), -score).otherwise(score)


def divergence(a: Column, b: Column) -> Column:
    """N-06: (index, contained): the first place where two sequences of token ids differ; the shorter's length where it begins the longer; null for equal ones."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))
    first = F.array_position(F.transform(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])), F.lit(True)).cast("int") - 1
    differs = F.size(a) != F.size(b)
    return F.struct(F.when(first >= 0, first).when(differs, n).alias("index"), ((first < 0) & differs).alias("contained"))


def screened(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """U-11, N-06: divergence, place of the decision, tokens a word, tokens after the divergence, and why a pair of variants can't be used. `a` and
    `b` are arrays of ids; a_words and b_words their numbers of words."""
    d = pairs.withColumn("_d", divergence(F.col(a), F.col(b))).withColumns({"divergence_index": F.col("_d.index"), "contained": F.col("_d.contained")})
    index = F.col("divergence_index")
    reason = F.when(F.col("contained"), "prefix_containment").when(index.isNull(), "variants_tokenize_identically")
    for side in (a, b):
        d = d.withColumns({f"{side}_fertility": F.size(side) / F.greatest(F.lit(1), F.col(f"{side}_words")), f"{side}_suffix": F.when(index.isNotNull(), F.size(side) - index).otherwise(0)})
    return d.withColumns({"decision_position": F.when(index > 0, index - 1).otherwise(-1), "excluded": reason}).drop("_d")


def contrast_pairs(members: DataFrame, keys: list[str], gold: str, order: str) -> DataFrame:
    """W-10: of each set the two members that are least by (gold, order); sets of one member, or whose two agree in gold, are none. Two rounds of
    partial aggregation: a set's size doesn't matter."""
    row = F.struct(gold, order)
    first = members.groupBy(*keys).agg(F.min(row).alias("pos"))
    rest = members.join(first, keys).where(row != F.col("pos"))
    second = rest.groupBy(*keys).agg(F.min("pos").alias("pos"), F.min(row).alias("neg"))
    return second.where(F.col("pos")[gold] != F.col("neg")[gold])


def trimmed(pairs: DataFrame, cell: list[str], offset: str, key: str, most: int) -> DataFrame:
    """W-09: at most `most` pairs of each cell, those of offsets 0 and 1 before all others, then by key."""
    w = Window.partitionBy(*cell).orderBy(F.least(F.col(offset), F.lit(2)), key)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def restored(patched: Column, base: Column, target: Column) -> Column:
    """U-10: the share of an effect that a patch restores; null where there is next to none."""
    return F.when(F.abs(target - base) >= TINY, (patched - base) / (target - base))


def lens_curves(rows: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """A-44: by layer, mean and median of `value` over the run's own `final`; finals next to 0 are left out, and cells of fewer runs."""
    norm = F.when(F.abs("final") > TINY, F.col("value") / F.col("final"))
    out = rows.groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("mean"), F.percentile(norm, 0.5).alias("median"), F.avg("value").alias("raw_mean"))
    return out.where(F.col("n") >= least)


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.ln(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))) + top
    return F.transform(x, lambda v: v - total)


def fidelity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A-33: two backends' logits of the same items: share of equal first choices, mean and largest divergence, largest error of a logit, and Pearson's r of
    the difference of the first two logits."""
    p, q = log_softmax(F.col(a)), log_softmax(F.col(b))
    kl = F.aggregate(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    error = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    first = lambda c: F.element_at(c, 1) - F.element_at(c, 2)
    each = rows.select(kl.alias("kl"), error.alias("error"), (top(a) == top(b)).cast("int").alias("agree"), first(a).alias("x"), first(b).alias("y"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg("agree").alias("agreement"), F.avg("kl").alias("mean_kl"), F.max("kl").alias("max_kl"), F.max("error").alias("max_error"), F.corr("x", "y").alias("r"))


def first_divergent_layer(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """A-45: the first layer whose largest difference, relative to the largest value, is above the tolerance; null where none is."""
    relative = F.col("difference") / F.greatest(F.col("largest"), F.lit(1e-12))
    return rows.groupBy(*keys).agg(F.min(F.when(relative > tolerance, F.col("layer"))).alias("layer"), F.count(F.lit(1)).alias("n_layers"))


def matched_wins(pairs: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """A-32, M-03: win rates of metrics on exactly the records that a judge covered; ties count half."""
    rows = pairs.join(judged.select(*keys).distinct(), keys, "left_semi").where(F.col("good").isNotNull() & F.col("bad").isNotNull())
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), ((F.count_if(F.col("good") > F.col("bad")) + 0.5 * F.count_if(F.col("good") == F.col("bad"))) / F.count(F.lit(1))).alias("rate"))


def calibrated(deltas: DataFrame, fits: DataFrame) -> DataFrame:
    """U-06: deltas (metric, delta in native units) as agreement with people, by a table of sigmoids (metric, factor to the fitted scale, top, slope, shift):
    accuracy, what 75 per cent need, and whether the delta is at the sigmoid's ceiling. Metrics without a fit stay, as not available."""
    x = F.abs("delta") * F.col("factor")
    accuracy = F.col("top") / (1 + F.exp(-F.col("slope") * (x - F.col("shift"))))
    need = F.col("shift") - F.ln(F.col("top") / 0.75 - 1) / F.col("slope")
    return deltas.join(fits, "metric", "left").select("metric", "delta", F.col("factor").isNotNull().alias("available"), x.alias("fitted"), accuracy.alias("accuracy"), (x / need).alias("ratio_75"), (accuracy >= F.col("top") * 0.999).alias("saturated"))


def localisation_call(good_n: Column, good_hit: Column, bad_n: Column, bad_hit: Column, control_n: Column, control_hit: Column, share: Column) -> Column:
    """G-17: the rule that was set before: flags everywhere, no errors scored, no control, control not found, spans too wide, found less than the control, found."""
    return (
        F.when((good_n > 0) & (bad_n > 0) & (good_hit >= bad_hit), "indiscriminate_flagging").when(F.coalesce(bad_n, F.lit(0)) == 0, "not_evaluable").when(F.coalesce(control_n, F.lit(0)) == 0, "inconclusive")
        .when(control_hit < 0.20, "inconclusive_for_tamil").when(F.coalesce(share, F.lit(0.0)) > 0.5, "detects_but_does_not_localise").when(bad_hit < control_hit, "phenomenon_specific_failure").otherwise("no_failure")
    )


def falsified(b: Column, c: Column, p_mcnemar: Column, p_chance: Column, distance: Column, same_direction: Column, c0_p: Column, explicit_p: Column, sensitive: Column, suppressed: Column) -> dict[str, Column]:
    """G-18: three criteria, the capability precondition under both wordings of C0, robustness to prompts, and whether all of them hold where the
    drop isn't suppressed. What isn't known is null: preconditions must be known to hold, sensitivity and suppression to be there."""
    first, second = (b > c) & (p_mcnemar < 0.01), p_chance >= 0.05
    third = F.coalesce(same_direction & (distance < 0.15), F.lit(False))
    able, explicit = c0_p < 0.05, explicit_p < 0.05
    all_but_c0 = first & second & third & ~F.coalesce(sensitive, F.lit(False)) & suppressed.isNull()
    return {
        "criterion_1": first, "criterion_2": second, "criterion_3": third, "c0_ok": able, "c0_ok_explicit": explicit, "prompt_robustness_ok": ~sensitive, "suppressed": suppressed,
        "default_is_active": all_but_c0 & F.coalesce(able, F.lit(False)), "default_is_active_with_corrected_c0": all_but_c0 & F.coalesce(explicit, F.lit(False)),
    }


def ordered_by_intervals(intervals: DataFrame, name: str) -> DataFrame:
    """G-19: pairs of names by disjoint intervals: which is lower, or that the intervals overlap. `intervals` is a small table of results."""
    x, y = (intervals.select(F.col(name).alias(side), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high")) for side in ("x", "y"))
    return x.join(y, F.col("x") < F.col("y")).select("x", "y", F.when(F.col("x_high") < F.col("y_low"), "below").when(F.col("y_high") < F.col("x_low"), "above").otherwise("overlap").alias("verdict"))


def onset_test(draws: DataFrame, floor: float) -> DataFrame:
    """G-20: draws (draw, a, b) of two onsets, paired by their index: mean difference, its interval, the one-sided share of draws that fail, and the verdict."""
    d = F.col("a") - F.col("b")
    out = draws.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), F.percentile(d, 0.025).alias("low"), F.percentile(d, 0.975).alias("high"), F.avg((d <= 0).cast("int")).alias("p"))
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    return out.withColumn("verdict", F.when((F.col("delta") >= floor) & clear, "DISSOCIATION DETECTED").otherwise("NO DETECTABLE DISSOCIATION"))


def areas(scores: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """U-07, A-42: area under the curve by ranks, ties at half, from the counts of each distinct score."""
    counts = scores.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("_below", F.coalesce(below, F.lit(0)))
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return ranked.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.try_divide(won, F.sum("_p") * F.sum("_n")).alias("auc"))


def excess(areas_by_probe: DataFrame, keys: list[str], probe: str, controls: list[str]) -> DataFrame:
    """A-42: what a probe's area is above the better of its controls."""
    best = F.max(F.when(F.col("probe").isin(controls), F.col("auc")))
    own = F.max(F.when(F.col("probe") == probe, F.col("auc")))
    return areas_by_probe.groupBy(*keys).agg(own.alias("auc"), best.alias("control"), (own - best).alias("excess"))


def permuted_labels(rows: DataFrame, group: list[str], key: str, label: str, draw: int) -> DataFrame:
    """A-42's null: labels dealt anew within each group, by hash."""
    w = lambda order: F.row_number().over(Window.partitionBy(*group).orderBy(order, key))
    ranked = rows.withColumn("_at", w(F.col(key)))
    dealt = rows.select(*group, key, F.col(label).alias("_label")).withColumn("_at", w(F.xxhash64(F.col(key), F.lit(draw)))).select(*group, "_at", F.col("_label").alias("permuted"))
    return ranked.join(dealt, [*group, "_at"]).drop("_at")


def grouped_folds(rows: DataFrame, group: Column, folds: int) -> DataFrame:
    """U-08: the fold of each row, by its group."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))


def probe_scores(rows: DataFrame, features: str, label: str, folds: int, ridge: float = 1.0) -> DataFrame:
    """U-08: rows (with fold) scored by a logistic probe with an L2 penalty, fitted on the other folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = rows.withColumns({"_x": array_to_vector(features), "_y": F.col(label).cast("double")})
    out = None
    for k in range(folds):
        model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=ridge, elasticNetParam=0.0, probabilityCol="_p").fit(made.where(F.col("fold") != k))
        one = model.transform(made.where(F.col("fold") == k)).withColumn("score", F.element_at(vector_to_array("_p"), 2)).select(*rows.columns, "score")
        out = one if out is None else out.unionByName(one)
    return out


def paired_difference(draw_weights: DataFrame, keys: list[str]) -> DataFrame:
    """U-04: rows (keys, draw, weight, x_k, x_n, y_k, y_n by cluster) as the interval of the difference of two shares over the same clusters in each draw."""
    by = draw_weights.groupBy(*keys, "draw").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("x_k", "x_n", "y_k", "y_n")))
    d = F.try_divide(F.col("x_k").cast("double"), "x_n") - F.try_divide(F.col("y_k").cast("double"), "y_n")
    return by.withColumn("_d", d).groupBy(*keys).agg(F.avg("_d").alias("mean"), F.percentile("_d", 0.025).alias("low"), F.percentile("_d", 0.975).alias("high"))


def gate_summary(cells: DataFrame, most: float = 0.25) -> DataFrame:
    """A-23: cells (system, drop, acc_committed) whose drop passes the gate: how many, and their accuracies."""
    ok = F.col("drop") <= most
    acc = F.when(ok, F.col("acc_committed"))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(ok).alias("n_passing"), F.min(acc).alias("least"), F.max(acc).alias("most"), F.avg(acc).alias("mean"))


def headlines(cells: DataFrame, where: Column, sentence: str, *values: str) -> DataFrame:
    """A-36: a sentence for each cell that a rule picks."""
    return cells.where(where).select(F.format_string(sentence, *(F.col(v) for v in values)).alias("sentence"))


def missing_from(rendered: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A-37: what a report should have and has not."""
    return wanted.select(key).distinct().join(rendered.select(key).distinct(), key, "left_anti")


def registered_before(plans: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """A-43: whether the last registration precedes the first result."""
    p, r = plans.groupBy(*keys).agg(F.max("at").alias("registered")), results.groupBy(*keys).agg(F.min("at").alias("first_result"))
    return p.join(r, keys, "full").withColumn("precedes", F.coalesce(F.col("registered") < F.col("first_result"), F.lit(False)))
