"""Queries of scored records and metric studies, with their SQL. Events stand for scored records: see `SCORED`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import metric as M
from corpusloom.operators import panel as P
from corpusloom.operators import resample as R
from corpusloom.plans.corpus import read

#: Outcomes by event type and key: the same table in both languages.
_OUTCOME = {"click": "CORRECT", "view": "WRONG", "signup": "AVOIDANT_DROP", "purchase": "CORRECT", "error": "UNPARSED"}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """N-04, N-05: events as scored records."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.when((k % 17 == 0) & (F.col("event_type") == "view"), "UNDECIDABLE")
    for kind, name in _OUTCOME.items():
        outcome = outcome.when(F.col("event_type") == kind, name)
    condition = F.concat(F.lit("C"), (F.dayofmonth("ts") % 4).cast("string"))
    return e.select(
        "event_id", "user_id", "value", k.alias("k"), F.concat(F.lit("s"), (F.col("user_id") % 13).cast("string")).alias("system"), F.concat(F.lit("slot"), (k % 5).cast("string")).alias("slot"), condition.alias("condition"), (F.col("user_id") * 100 + k).alias("item"),
        k.alias("template"), F.when(condition != "C3", k % 2).alias("gold"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("emitted"), outcome.alias("outcome"), F.col("event_type").isin("click", "purchase").alias("is_correct"),
    )


SCORED = "scored AS (SELECT event_id, user_id, value, CAST(props->>'$.k' AS INT) AS k, 's' || (user_id % 13) AS system, 'slot' || (CAST(props->>'$.k' AS INT) % 5) AS slot, 'C' || (day(ts) % 4) AS condition, user_id * 100 + CAST(props->>'$.k' AS INT) AS item, CAST(props->>'$.k' AS INT) AS template, CASE WHEN day(ts) % 4 <> 3 THEN CAST(props->>'$.k' AS INT) % 2 END AS gold, CASE WHEN event_type <> 'error' THEN event_type END AS emitted, CASE WHEN CAST(props->>'$.k' AS INT) % 17 = 0 AND event_type = 'view' THEN 'UNDECIDABLE' WHEN event_type IN ('click', 'purchase') THEN 'CORRECT' WHEN event_type = 'view' THEN 'WRONG' WHEN event_type = 'signup' THEN 'AVOIDANT_DROP' WHEN event_type = 'error' THEN 'UNPARSED' END AS outcome, event_type IN ('click', 'purchase') AS is_correct FROM events)"
_HAS = "n_gold > 0"
CELLS = SCORED + ", c AS (SELECT system, slot, condition, count(*) AS n, count(DISTINCT template) AS n_templates, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower()}" for o in P.OUTCOMES) + ", count(*) FILTER (outcome IN ('CORRECT', 'WRONG', 'COMMITTED', 'UNDECIDABLE')) AS n_committed, count(*) FILTER (starts_with(outcome, 'AVOIDANT')) AS n_avoidant, count(gold) AS n_gold FROM scored GROUP BY ALL), cell AS (SELECT *, CASE WHEN n_gold > 0 THEN correct / n END AS acc_strict, CASE WHEN n_gold > 0 THEN correct / nullif(n - unparsed, 0) END AS acc_parsed, CASE WHEN n_gold > 0 AND n_committed >= 30 AND n_committed >= n * 0.30 THEN correct / n_committed END AS acc_committed, n_committed / n AS committed_rate, (n - unparsed) / n AS coverage, CASE WHEN n_gold = 0 THEN 'no_gold' WHEN n_committed < 30 THEN 'too_few' WHEN n_committed < n * 0.30 THEN 'low_share' END AS floor_reason FROM c)"


def props_json_extract(spark, d):  # type: ignore[no-untyped-def]
    """N-04, N-05."""
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


def panel_cells(spark, d):  # type: ignore[no-untyped-def]
    """A-05, A-06, A-39, P-07."""
    return P.cells(scored(spark, d))


def panel_balance(spark, d):  # type: ignore[no-untyped-def]
    """A-06's assertion: the number of cells and of those whose outcomes don't add up."""
    c = P.cells(scored(spark, d))
    return c.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(sum((F.col(x.lower()) for x in P.OUTCOMES), F.lit(0)) != F.col("n")).alias("n_unbalanced"))


def panel_missing_cells(spark, d):  # type: ignore[no-untyped-def]
    """J-13: system, template and condition without a record."""
    return P.missing_cells(scored(spark, d), ["system", "template", "condition"])


def gradient_drop(spark, d):  # type: ignore[no-untyped-def]
    """A-06, U-04's point estimate."""
    return P.gradient(P.cells(scored(spark, d)), ["C0", "C1", "C2"])


def mcnemar_pairs(spark, d):  # type: ignore[no-untyped-def]
    """J-08, U-05: discordant pairs of two conditions."""
    s = scored(spark, d)
    return P.paired(s.where("condition = 'C1'"), s.where("condition = 'C2'"), ["item"])


def mcnemar_exact(spark, d):  # type: ignore[no-untyped-def]
    """U-05: exact p-values of mcnemar_pairs, and Holm's adjustment (W-08)."""
    p = mcnemar_pairs(spark, d).withColumn("p", S.binomial_two_sided(F.least("b", "c"), F.col("b") + F.col("c"))).withColumn("family", F.lit("all"))
    return S.holm(p, ["family"], "p", tie=["system"]).drop("family")


def binomial_vs_chance(spark, d):  # type: ignore[no-untyped-def]
    """U-05: one-sided against a quarter. These p-values are dyadic: ties of the last place go up, whatever sums them."""
    c = P.cells(scored(spark, d), ["system", "slot"])
    return c.select("system", "slot", "correct", "n", S.binomial_sf(F.col("correct"), F.col("n"), F.lit(0.25)).alias("p")).withColumn("p", F.round(F.col("p") + 1e-12, 6))


def holm_adjust(spark, d):  # type: ignore[no-untyped-def]
    """W-08 with given p-values: the share of each customer segment and nation, as families."""
    c = read(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / 2000.0)
    return S.holm(c, ["c_mktsegment"], "p", 0.3, ["c_nationkey"]).select("c_mktsegment", "c_nationkey", "n", "rejected", F.round("p_holm", 6).alias("p_holm"))


def prompt_robustness(spark, d):  # type: ignore[no-untyped-def]
    """J-09, A-17: order priorities as prompts, customers as items."""
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("prompt"), F.col("o_custkey").alias("item"), (F.col("o_orderstatus") == "F").alias("is_correct"))
    return P.prompt_robustness(o).select("prompt", "n", F.round("acc", 6).alias("acc"), F.round("range", 6).alias("range"))


def modal_value_by_system(spark, d):  # type: ignore[no-untyped-def]
    """A-20."""
    return P.modal_value(scored(spark, d), ["system", "slot"])


def modal_unanimity(spark, d):  # type: ignore[no-untyped-def]
    """A-20."""
    return P.unanimous(P.modal_value(scored(spark, d), ["system", "slot"]), ["slot"])


def dfr_range(spark, d):  # type: ignore[no-untyped-def]
    """A-19: emitted shares of each slot against shares of all, with ends a tenth below and above."""
    s = scored(spark, d).where("emitted is not null")
    obs = s.groupBy("slot", F.col("emitted").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = s.groupBy("slot").agg(F.count(F.lit(1)).alias("t"))
    obs = obs.join(total, "slot").select("slot", "value", (F.col("n") / F.col("t")).alias("p_observed"))
    all_ = s.agg(F.count(F.lit(1)).alias("t"))
    prior = s.groupBy(F.col("emitted").alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(all_)).select("value", (F.col("n") / F.col("t")).alias("p"), (F.col("n") / F.col("t") * 0.9).alias("low"), (F.col("n") / F.col("t") * 1.1).alias("high"))
    r = lambda c: F.round(c, 6).alias(c)
    return P.directed_ratio(obs, prior).select("slot", "value", r("d"), r("d_low"), r("d_high"), "sign_flips")


def length_leak_detector(spark, d):  # type: ignore[no-untyped-def]
    """A-21."""
    c = read(spark, d, "conversations").select("role", F.length("text").alias("len"))
    return P.length_leak(c, ["role"], "len").select("role", F.col("median").cast("long").alias("median"), "n", "n_long", (F.col("n_long") / F.col("n") > 0.1).alias("leaks"))


def answer_locus_drop(spark, d):  # type: ignore[no-untyped-def]
    """A-22, T-20: share of turns with a target word, first against later turns."""
    c = read(spark, d, "conversations").where("role = 'assistant'").select((F.col("turn") <= 1).alias("early"), X.surface_hit(F.lower("text"), F.array(F.lit("tion"), F.lit("ing"))).alias("hit"))
    w = c.agg(F.avg(F.when(F.col("early"), F.col("hit").cast("int"))).alias("first"), F.avg(F.when(~F.col("early"), F.col("hit").cast("int"))).alias("later"))
    return w.select(F.round("first", 6).alias("first"), F.round("later", 6).alias("later"), (F.col("first") - F.col("later") > 0.25).alias("flagged"))


def wording_delta(spark, d):  # type: ignore[no-untyped-def]
    """A-18."""
    s = scored(spark, d).withColumn("prompt", F.when(F.col("k") < 50, "p1").otherwise("p2"))
    return P.wording_delta(P.cells(s, ["system", "prompt"]), ("p1", "p2"), ["system"])


def raw_integrity(spark, d):  # type: ignore[no-untyped-def]
    """A-30: conversations as files."""
    c = read(spark, d, "conversations").withColumn("file", F.col("conv_id") % 10)
    expected = c.groupBy("file").agg(F.count(F.lit(1)).alias("n_expected")).where("file < 9")
    return P.integrity(c, ["conv_id", "turn"], expected, ["role", "text"])


def restricted_overlap_gate(spark, d):  # type: ignore[no-untyped-def]
    """A-31, J-14: words of the benchmark that French documents don't have, in each corpus."""
    docs = read(spark, d, "documents")
    words = lambda df: df.select(F.explode(X.tokens(F.col("text"), X.LATIN)).alias("form")).distinct()
    files = docs.where("lang <> 'fr'").select(F.col("source").alias("file"), F.explode(X.tokens(F.col("text"), X.LATIN)).alias("form"))
    return P.licence_overlap(files, words(read(spark, d, "benchmark")), words(docs.where("lang = 'fr'")))


_RULES = {"SHOUTING": ("FAIL", r"[A-Z]{6,}!!"), "SYMBOLS": ("FAIL", r"[$&%#]{3}"), "LICENCE": ("WARN", "(?i)licensed under"), "TABLE": ("WARN", r" \| ")}


def audit_findings(spark, d):  # type: ignore[no-untyped-def]
    """P-14, A-29, N-14: findings by code and level."""
    return P.audit(read(spark, d, "documents"), "doc_id", F.col("text"), _RULES).groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def html_to_text(spark, d):  # type: ignore[no-untyped-def]
    """T-18."""
    return read(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


def clean_ops_histogram(spark, d):  # type: ignore[no-untyped-def]
    """T-19: how often each step changes an answer. Answers get a label, a quote or a tail, by turn."""
    c = read(spark, d, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Translation: "), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('"'), F.col("text"), F.lit('" (abc)'))).otherwise(F.concat("text", F.lit("\n\nNote: more")))
    return c.select(F.explode(X.clean(raw, X.LATIN)[1]).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def onset_crossing(spark, d):  # type: ignore[no-untyped-def]
    """W-07: from which day of the month on a user group's cumulative share of clicks stays at a fifth."""
    e = read(spark, d, "events").select((F.col("user_id") % 20).alias("curve"), F.dayofmonth("ts").cast("double").alias("depth"), (F.col("event_type") == "click").cast("int").alias("hit"))
    by = e.groupBy("curve", "depth").agg(F.avg("hit").alias("value"))
    return S.onset(by, ["curve"], "depth", "value", 0.15).select("curve", F.round("onset", 6).alias("onset"))


def first_n_per_stratum(spark, d):  # type: ignore[no-untyped-def]
    """W-06."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    return read(spark, d, "documents").select("doc_id", "lang", "source", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


def _pairs(spark, d):  # type: ignore[no-untyped-def]
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("arm"), F.concat(F.lit("slot"), (F.col("l_suppkey") % 5).cast("string")).alias("slot"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("system"), F.col("l_partkey").alias("item"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("good"), (F.col("l_extendedprice") * 0.95).alias("bad"), (F.col("l_quantity") * 100).alias("empty"))


PAIRS = "pairs AS (SELECT l_returnflag AS arm, 'slot' || (l_suppkey % 5) AS slot, 's' || (l_suppkey % 3) AS system, l_partkey AS item, l_extendedprice * (1 - l_discount) AS good, l_extendedprice * 0.95::DOUBLE AS bad, l_quantity * 100 AS empty FROM lineitem)"


def metric_direction(spark, d):  # type: ignore[no-untyped-def]
    """A-10."""
    return _pairs(spark, d).groupBy("slot", "system").agg(*M.direction())


def metric_sign_test(spark, d):  # type: ignore[no-untyped-def]
    """A-10, U-05: the exact sign test over parts."""
    p = _pairs(spark, d).groupBy("item").agg(*M.direction())
    return p.select("item", "win", "loss", S.binomial_two_sided(F.col("win"), F.col("win") + F.col("loss")).alias("p"))


def metric_magnitude(spark, d):  # type: ignore[no-untyped-def]
    """A-11."""
    m = _pairs(spark, d).groupBy("arm", "slot").agg(*M.magnitude(F.col("good") - F.col("bad")))
    return m.select("arm", "slot", *(F.round(c, 4).alias(c) for c in ("mean", "median", "q25", "q75", "frac_nonpositive")))


def metric_groupings(spark, d):  # type: ignore[no-untyped-def]
    """A-07."""
    return M.grouped(_pairs(spark, d), [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("good") - F.col("bad")), 4).alias("mean")])


def z_floor(spark, d):  # type: ignore[no-untyped-def]
    """A-12, P-15, P-16."""
    z = M.z_floor(_pairs(spark, d), ["arm", "slot"], 1.0)
    return z.select("arm", "slot", "n_used", "n_dropped", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


def splice_decomposition(spark, d):  # type: ignore[no-untyped-def]
    """A-08, A-09, J-10."""
    s = M.splice_decomposition(_pairs(spark, d).withColumn("diff", F.col("good") - F.col("bad")), "A", "R")
    return s.select("slot", "n_items", *(F.round(c, 4).alias(c) for c in ("dc", "dn", "s", "b")))


def variant_dedup_ids(spark, d):  # type: ignore[no-untyped-def]
    """N-07, A-34: segments of two variants of each benchmark item, numbered densely."""
    b = read(spark, d, "benchmark").select("item_id", F.create_map(F.lit("good"), F.col("text"), F.lit("bad"), F.concat(F.lit("x"), F.col("text"))).alias("variants"))
    long = M.long_variants(b, ["item_id"])
    return long.join(M.segment_ids(long, ["text"]), "text").select("item_id", "variant", "line")


def positional_score_join(spark, d):  # type: ignore[no-untyped-def]
    """J-06, N-08, S-10: all components of vectors as a metric's scores, joined by line; three lines are the variants of an item, set side by side."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("metric"), F.col("embedding").alias("scores"))
    lines = v.agg(F.max(F.size("scores")).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("line"))
    index = lines.select("line", F.floor(F.col("line") / 3).alias("item"), F.element_at(F.array(F.lit("good"), F.lit("bad"), F.lit("empty")), F.col("line") % 3 + 1).alias("variant"))
    w = M.wide_variants(M.positional(index, v), ["metric", "item"], ["good", "bad", "empty"])
    return w.select("metric", "item", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("good", "bad", "empty")))


def heldout_reference(spark, d):  # type: ignore[no-untyped-def]
    """J-07: every turn of every conversation."""
    r = read(spark, d, "conversations").select((F.col("conv_id") % 40).alias("item"), "conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("good"))
    return M.held_out_reference(r).select("conv_id", "turn", "reference")


heldout_reference_all_turns = heldout_reference


def span_localisation(spark, d):  # type: ignore[no-untyped-def]
    """J-17, A-24: a document's first full stop, with three letters on either side, as gold, and the space of its first comma as the prediction."""
    t = read(spark, d, "documents").select("lang", F.instr("text", ".").alias("at"), F.instr("text", ",").alias("comma"), F.length("text").alias("len"))
    rows = t.where("at > 0").select("lang", (F.col("at") - 3).alias("start"), (F.col("at") + 3).alias("end"), F.when(F.col("comma") > 0, F.array(F.struct((F.col("comma") - 4).alias("start"), (F.col("comma") + 4).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    out = M.localisation(rows, ["lang"])
    return out.select("lang", "n", "n_flagged", "n_hit", "n_iou", "tp", "fp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def chrf_sentence(spark, d):  # type: ignore[no-untyped-def]
    """U-09: each turn against the turn before it."""
    c = read(spark, d, "conversations")
    a = c.select("conv_id", "turn", "text").join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return a.select("conv_id", "turn", F.round(M.chrf("text", "before"), 6).alias("chrf"))


def mean_interval(spark, d):  # type: ignore[no-untyped-def]
    """U-02: mean value by event type, users as clusters."""
    return R.mean_interval(read(spark, d, "events"), ["event_type"], "user_id", "value", 500)


def token_spans(spark, d):  # type: ignore[no-untyped-def]
    """T-07, T-23: numbers of bare words and their characters in benchmark items."""
    return read(spark, d, "benchmark").select("item_id", X.token_spans(F.col("text")).alias("s")).select("item_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (
    props_json_extract, panel_cells, panel_balance, panel_missing_cells, gradient_drop, mcnemar_pairs, mcnemar_exact, binomial_vs_chance, holm_adjust, prompt_robustness, modal_value_by_system, modal_unanimity, dfr_range, length_leak_detector, answer_locus_drop,
    wording_delta, raw_integrity, restricted_overlap_gate, audit_findings, html_to_text, clean_ops_histogram, onset_crossing, first_n_per_stratum, metric_direction, metric_sign_test, metric_magnitude, metric_groupings, z_floor, splice_decomposition,
    variant_dedup_ids, positional_score_join, heldout_reference, span_localisation, chrf_sentence, mean_interval, token_spans,
)}

_MODAL = SCORED + ", m AS (SELECT system, slot, emitted, count(*) AS n FROM scored WHERE emitted IS NOT NULL GROUP BY ALL), modal AS (SELECT system, slot, emitted AS modal, n, n / sum(n) OVER (PARTITION BY system, slot) AS modal_share, row_number() OVER (PARTITION BY system, slot ORDER BY n DESC, emitted) AS r FROM m)"
ORACLES = {
    "props_json_extract": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, coalesce(props->>'$.absent', 'none') AS absent FROM events",
    "panel_cells": f"WITH {CELLS} SELECT * FROM cell",
    "panel_balance": f"WITH {CELLS} SELECT count(*) AS n_cells, count(*) FILTER ({' + '.join(o.lower() for o in P.OUTCOMES)} <> n) AS n_unbalanced FROM cell",
    "panel_missing_cells": f"WITH {SCORED} SELECT * FROM (SELECT DISTINCT system FROM scored) CROSS JOIN (SELECT DISTINCT template FROM scored) CROSS JOIN (SELECT DISTINCT condition FROM scored) ANTI JOIN scored USING (system, template, condition)",
    "gradient_drop": f"WITH {CELLS}, w AS (SELECT system, slot, any_value(acc_strict) FILTER (condition = 'C0') AS \"C0\", any_value(acc_strict) FILTER (condition = 'C1') AS \"C1\", any_value(acc_strict) FILTER (condition = 'C2') AS \"C2\" FROM cell GROUP BY ALL) SELECT *, \"C0\" - \"C2\" AS \"drop\" FROM w",
    "mcnemar_pairs": f"WITH {SCORED}, x AS (SELECT system, item, bool_or(is_correct) AS x FROM scored WHERE condition = 'C1' GROUP BY ALL), y AS (SELECT system, item, bool_or(is_correct) AS y FROM scored WHERE condition = 'C2' GROUP BY ALL) SELECT system, count(*) AS n_pairs, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM x JOIN y USING (system, item) GROUP BY system",
    "holm_adjust": "WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) / 2000.0::DOUBLE AS p FROM customer GROUP BY ALL), r AS (SELECT *, (count(*) OVER (PARTITION BY c_mktsegment) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_nationkey) + 1) * p AS s FROM c) SELECT c_mktsegment, c_nationkey, n, bool_and(s <= 0.3) OVER w AS rejected, round(least(1.0, max(s) OVER w), 6) AS p_holm FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY p, c_nationkey ROWS UNBOUNDED PRECEDING)",
    "prompt_robustness": "WITH o AS (SELECT o_orderpriority AS prompt, o_custkey AS item, o_orderstatus = 'F' AS ok FROM orders), k AS (SELECT item FROM o GROUP BY item HAVING count(DISTINCT prompt) = (SELECT count(DISTINCT prompt) FROM o)), a AS (SELECT prompt, count(*) AS n, avg(ok::INT) AS acc FROM o SEMI JOIN k USING (item) GROUP BY prompt) SELECT prompt, n, round(acc, 6) AS acc, round(max(acc) OVER () - min(acc) OVER (), 6) AS range FROM a",
    "modal_value_by_system": f"WITH {_MODAL} SELECT system, slot, modal, n, modal_share FROM modal WHERE r = 1",
    "modal_unanimity": f"WITH {_MODAL} SELECT slot, count(DISTINCT modal) AS n_values, count(*) AS n_systems, min(modal) AS least_modal, count(DISTINCT modal) = 1 AS unanimous FROM modal WHERE r = 1 GROUP BY slot",
    "dfr_range": f"WITH {SCORED}, s AS (SELECT * FROM scored WHERE emitted IS NOT NULL), oc AS (SELECT slot, emitted AS value, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT slot, value, n / sum(n) OVER (PARTITION BY slot) AS po FROM oc), p AS (SELECT value, sum(n) / (SELECT sum(n) FROM oc) AS p FROM oc GROUP BY value) SELECT slot, value, round(po / p, 6) AS d, round(po / (p * 1.1::DOUBLE), 6) AS d_low, round(po / (p * 0.9::DOUBLE), 6) AS d_high, po > p * 0.9::DOUBLE AND po < p * 1.1::DOUBLE AS sign_flips FROM o JOIN p USING (value)",
    "length_leak_detector": "WITH c AS (SELECT role, length(text) AS l FROM conversations), m AS (SELECT role, list_sort(list(l))[count(*) // 2 + 1] AS median FROM c GROUP BY role) SELECT role, median, count(*) AS n, count(*) FILTER (l > 2.5 * median) AS n_long, count(*) FILTER (l > 2.5 * median) / count(*) > 0.1 AS leaks FROM c JOIN m USING (role) GROUP BY role, median",
    "answer_locus_drop": "WITH c AS (SELECT turn <= 1 AS early, (contains(lower(text), 'tion') OR contains(lower(text), 'ing'))::INT AS hit FROM conversations WHERE role = 'assistant'), w AS (SELECT avg(hit) FILTER (early) AS f, avg(hit) FILTER (NOT early) AS l FROM c) SELECT round(f, 6) AS first, round(l, 6) AS later, f - l > 0.25 AS flagged FROM w",
    "wording_delta": f"WITH {SCORED}, c AS (SELECT system, CASE WHEN k < 50 THEN 'p1' ELSE 'p2' END AS prompt, CASE WHEN count(gold) > 0 THEN count(*) FILTER (outcome = 'CORRECT') / count(*) END AS a FROM scored GROUP BY ALL), w AS (SELECT system, any_value(a) FILTER (prompt = 'p1') AS p1, any_value(a) FILTER (prompt = 'p2') AS p2 FROM c GROUP BY system) SELECT *, p2 - p1 AS delta FROM w",
    "raw_integrity": "WITH k AS (SELECT conv_id % 10 AS file, conv_id, turn, count(*) AS n, count(*) FILTER (role IS NULL OR text IS NULL) AS m FROM conversations GROUP BY ALL), b AS (SELECT file, sum(n) AS n, sum(n - 1) AS d, sum(m) AS m FROM k GROUP BY file), e AS (SELECT file, n_expected FROM (SELECT conv_id % 10 AS file, count(*) AS n_expected FROM conversations GROUP BY conv_id % 10) WHERE file < 9) SELECT file, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(d, 0) AS BIGINT) AS n_duplicates, CAST(coalesce(m, 0) AS BIGINT) AS n_missing, n_expected, coalesce(n = n_expected, FALSE) AS complete FROM b FULL JOIN e USING (file)",
    "restricted_overlap_gate": r"WITH w AS (SELECT source, lang, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS form FROM documents), r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS form FROM benchmark), f AS (SELECT form FROM r ANTI JOIN (SELECT form FROM w WHERE lang = 'fr') USING (form)), k AS (SELECT source AS file, count(DISTINCT form) FILTER (form IN (SELECT form FROM f)) AS n_forms FROM w WHERE lang <> 'fr' GROUP BY source) SELECT file, n_forms, CASE WHEN n_forms > 25 THEN 'FAIL' WHEN n_forms > 8 THEN 'WARN' ELSE 'OK' END AS verdict FROM k",
    "audit_findings": "SELECT code, level, count(*) AS n, min(doc_id) AS first_doc FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, '{lv}' AS level, doc_id FROM documents WHERE regexp_matches(text, '{p}')" for c, (lv, p) in _RULES.items()) + ") GROUP BY ALL",
    "html_to_text": r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS t FROM pages) SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM s""",
    "onset_crossing": "WITH b AS (SELECT user_id % 20 AS curve, CAST(day(ts) AS DOUBLE) AS depth, avg((event_type = 'click')::INT) AS v FROM events GROUP BY ALL), s AS (SELECT *, lag(v) OVER w AS lv, lag(depth) OVER w AS ld, max(depth) FILTER (v < 0.15) OVER (PARTITION BY curve) AS below FROM b WINDOW w AS (PARTITION BY curve ORDER BY depth)), a AS (SELECT curve, arg_min(CASE WHEN lv IS NULL OR lv >= 0.15 THEN depth ELSE ld + (0.15 - lv) / (v - lv) * (depth - ld) END, depth) AS onset FROM s WHERE below IS NULL OR depth > below GROUP BY curve) SELECT curve, round(coalesce(onset, 1.0), 6) AS onset FROM (SELECT DISTINCT curve FROM b) LEFT JOIN a USING (curve)",
    "first_n_per_stratum": "SELECT doc_id, lang, source, r FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "metric_direction": f"WITH {PAIRS} SELECT slot, system, count(*) FILTER (good > bad) AS win, count(*) FILTER (good = bad) AS tie, count(*) FILTER (good < bad) AS loss, (count(*) FILTER (good > bad) + 0.5 * count(*) FILTER (good = bad)) / count(*) AS rate FROM pairs GROUP BY ALL",
    "metric_magnitude": f"WITH {PAIRS} SELECT arm, slot, round(avg(good - bad), 4) AS mean, round(quantile_cont(good - bad, 0.5), 4) AS median, round(quantile_cont(good - bad, 0.25), 4) AS q25, round(quantile_cont(good - bad, 0.75), 4) AS q75, round(avg((good - bad <= 0)::INT), 4) AS frac_nonpositive FROM pairs GROUP BY ALL",
    "metric_groupings": f"WITH {PAIRS} SELECT CASE WHEN grouping(arm) = 1 THEN 'ALL' ELSE arm END AS arm, CASE WHEN grouping(slot) = 1 THEN 'ALL' ELSE slot END AS slot, CASE WHEN grouping(system) = 1 THEN 'ALL' ELSE system END AS system, count(*) AS n, round(avg(good - bad), 4) AS mean FROM pairs GROUP BY GROUPING SETS ((), (arm), (arm, slot), (arm, slot, system), (slot))",
    "z_floor": f"WITH {PAIRS}, z AS (SELECT arm, slot, abs(good - empty) >= 1.0 AS used, CASE WHEN abs(good - empty) >= 1.0 THEN (good - bad) / (good - empty) END AS z FROM pairs) SELECT arm, slot, count(*) FILTER (used) AS n_used, count(*) FILTER (NOT used) AS n_dropped, CASE WHEN count(*) FILTER (used) >= 20 THEN round(avg(z), 4) END AS mean, CASE WHEN count(*) FILTER (used) >= 20 THEN round(quantile_cont(z, 0.5), 4) END AS median FROM z GROUP BY ALL",
    "splice_decomposition": f"WITH {PAIRS}, i AS (SELECT slot, item, avg(good - bad) FILTER (arm = 'A') AS dc, avg(good - bad) FILTER (arm = 'R') AS dn FROM pairs GROUP BY ALL HAVING dc IS NOT NULL AND dn IS NOT NULL), g AS (SELECT CASE WHEN grouping(slot) = 1 THEN 'ALL' ELSE slot END AS slot, count(*) AS n_items, avg(dc) AS dc, avg(dn) AS dn FROM i GROUP BY ROLLUP (slot)) SELECT slot, n_items, round(dc, 4) AS dc, round(dn, 4) AS dn, CASE WHEN n_items >= 20 THEN round((dc + dn) / 2, 4) END AS s, CASE WHEN n_items >= 20 THEN round((dc - dn) / 2, 4) END AS b FROM g",
    "variant_dedup_ids": "WITH l AS (SELECT item_id, 'good' AS variant, text FROM benchmark UNION ALL SELECT item_id, 'bad', 'x' || text FROM benchmark), k AS (SELECT text, row_number() OVER (ORDER BY encode(text)) - 1 AS line FROM (SELECT DISTINCT text FROM l)) SELECT item_id, variant, line FROM l JOIN k USING (text)",
    "positional_score_join": "WITH e AS (SELECT vec_id AS metric, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS line FROM embeddings) SELECT metric, line // 3 AS item, round(max(x) FILTER (line % 3 = 0), 6) AS good, round(max(x) FILTER (line % 3 = 1), 6) AS bad, round(max(x) FILTER (line % 3 = 2), 6) AS empty FROM e GROUP BY ALL",
    "binomial_vs_chance": "WITH " + SCORED + ", c AS (SELECT system, slot, count(*) FILTER (outcome = 'CORRECT') AS correct, count(*) AS n FROM scored GROUP BY ALL) SELECT system, slot, correct, n, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75))) FROM (SELECT unnest(range(correct, n + 1)) AS i)) + 1e-12, 6) AS p FROM c",
    "heldout_reference": "WITH r AS (SELECT conv_id % 40 AS item, conv_id, turn, md5(text) AS good FROM conversations), l AS (SELECT item, list_sort(list(DISTINCT good))[1:2] AS least FROM r GROUP BY item) SELECT conv_id, turn, list_filter(least, lambda t: t <> good)[1] AS reference FROM r JOIN l USING (item)",
    "span_localisation": "WITH t AS (SELECT lang, instr(text, '.') - 3 AS s, instr(text, '.') + 3 AS e, instr(text, ',') AS c FROM documents WHERE instr(text, '.') > 0), o AS (SELECT lang, c > 0 AS f, CASE WHEN c > 0 THEN greatest(0, least(e, c + 4) - greatest(s, c - 4)) ELSE 0 END AS ov FROM t), g AS (SELECT lang, count(*) AS n, count(*) FILTER (f) AS n_flagged, count(*) FILTER (ov >= 1) AS n_hit, count(*) FILTER (f AND ov / (14.0 - ov) >= 0.5) AS n_iou FROM o GROUP BY lang) SELECT lang, n, n_flagged, n_hit, n_iou, n_hit AS tp, n_flagged - n_hit AS fp, round(n_hit / nullif(n_flagged, 0), 6) AS precision, round(n_hit / n, 6) AS recall, round(2 * (n_hit / nullif(n_flagged, 0)) * (n_hit / n) / nullif(n_hit / nullif(n_flagged, 0) + n_hit / n, 0), 6) AS f1 FROM g",
}
