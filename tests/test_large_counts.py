"""Counts and tables of a size that sf0.001 has not."""

import datetime as dt
import tracemalloc
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import index as I
from corpusloom.operators import resample as R
from corpusloom.plans import studies


def tail(k, n, p=Fraction(1, 4)):
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def test_binomial_tails_of_many_trials(spark):
    cases = [(0, 0), (0, 7), (3, 7), (7, 7), (300, 1_500), (400, 1_500), (1_500, 1_500)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", S.binomial_sf(F.col("k"), F.col("n"), F.lit(0.25)).alias("p")).collect()
    assert len(got) == len(cases) and all(abs(r.p - tail(r.k, r.n)) <= 1e-11 * tail(r.k, r.n) for r in got)


def events(spark, folder, rows):
    """Rows (user, day, hour, type, k), and the value if it isn't 1."""
    made = [(i, dt.datetime(2024, 1, day, hour), user, kind, *(value or [1.0]), f'{{"k": {k}}}') for i, (user, day, hour, kind, k, *value) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_two_sided_tails_of_many_trials(spark):
    """Before, whole numbers of n bits were summed n / 2 times. P(X = n / 2) is known to six places by Stirling."""
    n = 4_000_000
    cases = [(n // 2, n), (n // 2 - 1, n), (3, 7), (700, 1_440)]
    got = {(r.k, r.n): r.p for r in spark.createDataFrame(cases, "k long, n long").select("k", "n", S.binomial_two_sided(F.col("k"), F.col("n")).alias("p")).collect()}
    middle = (2 / (np.pi * n)) ** 0.5 * (1 - 1 / (4 * n))
    assert got[n // 2, n] == 1.0 and abs(got[n // 2 - 1, n] - (1 - middle)) < 1e-9
    assert all(abs(got[c] - 2 * tail(c[1] - c[0], c[1], Fraction(1, 2))) < 1e-12 for c in cases[2:])


def test_falsification_of_many_pairs(spark, tmp_path):
    right = {1: range(800), 2: range(740, 1_500), 4: range(1_200), 3: range(700)}  # day: the items that are right in its condition
    events(spark, tmp_path, [(13 * i, day, 0, "click" if i in those else "view", 5) for day, those in right.items() for i in range(1_500)])
    r = studies.falsification(spark, str(tmp_path)).first()
    half = Fraction(1, 2)
    assert (r.b, r.c, r.p_mcnemar, r.p_chance, r.c0_ok) == (740, 700, round(2 * tail(740, 1_440, half), 6), round(tail(760, 1_500, half), 6), True)


def test_falsification_of_slots_with_suppression_and_prompts(spark, tmp_path):
    """Slot 0 has an active default; slot 1 has too few records; in slot 2 a second prompt (value 3) gets all of C1 wrong and all of C0 right."""
    right = {1: 1.0, 2: 0.5, 4: 1.0, 3: 0.0}  # day: the share that is right in its condition
    rows = [(13 * i, day, 0, "click" if i < share * n else "view", k) for k, n in ((5, 60), (6, 10), (7, 60)) for day, share in right.items() for i in range(n)]
    rows += [(13 * i, day, 0, kind, 7, 3.0) for day, kind in ((1, "view"), (4, "click")) for i in range(60)]
    events(spark, tmp_path, rows)
    got = {r.slot: (r.b, r.c, r.tv, r.suppressed, r.prompt_robustness_ok, r.c0_ok, r.c0_ok_explicit, r.default_is_active, r.default_is_active_with_corrected_c0) for r in studies.falsification(spark, str(tmp_path)).collect()}
    assert got == {
        "slot0": (30, 0, 0.0, None, None, True, None, True, False), "slot1": (5, 0, 0.0, "C1 too_few; C2 too_few", None, True, None, False, False), "slot2": (30, 0, 0.0, None, False, True, True, False, False),
    }


def test_every_kth_row_where_one_reading_has_less_to_shuffle(spark):
    """Parts that are merged by their bytes differ between the rows and their keys alone."""
    rows = 20_000
    df = spark.range(rows).repartition(7).select("id", F.concat(*(F.sha2(F.concat("id", F.lit(i)), 256) for i in range(6))).alias("text"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(before, ("16", "512k", "false"), strict=True):
            spark.conf.set(k, v)
        assert sorted(r.id for r in I.systematic_sample(df, "id", 7).collect()) == list(range(0, rows, 7))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_every_kth_row_of_keys_with_nulls_and_of_texts(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(f"k{i:03}",) for i in range(40)], "key string").repartition(3)
    got = [r.key for r in I.systematic_sample(df, "key", 6).collect()]
    assert sorted(k for k in got if k) == [f"k{i:03}" for i in range(0, 40, 6)] and got.count(None) == 1


def with_peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_draws_of_cluster_means_do_not_stand_in_memory_at_once(spark):
    n, draws = 40_000, 200
    s = np.random.default_rng(3).normal(size=n)
    got, peak = with_peak(lambda: R.cluster_mean(s, np.ones(n), draws, 1))
    whole = s[np.random.default_rng(1).integers(0, n, (draws, n))].mean(axis=1)
    assert np.allclose(got, [s.mean(), *np.quantile(whole, [0.025, 0.975])], rtol=1e-9, atol=0) and peak < 64


def test_draws_of_a_count_matrix_do_not_stand_in_memory_at_once():
    n, draws = 40_000, 300
    counts = np.random.default_rng(3).integers(1, 5, (n, 2))
    (p, low, high, _), peak = with_peak(lambda: R.bootstrap_matrix(counts, draws, 1))
    sums = (np.random.default_rng(1).poisson(1, (draws, n)) @ counts)[:, 0]
    share = sums / (np.random.default_rng(1).poisson(1, (draws, n)) @ counts).sum(axis=1)
    assert np.allclose([low[0], high[0]], np.quantile(share, [0.025, 0.975]), rtol=1e-5) and peak < 64


def test_script_ratios_of_odd_texts_are_counted_once(spark):
    texts = ["", None, " \t\n", "ab c1", "a\u200bé\u00ad!", "\U0001d44e🙂\ufeff", "x" * 9_000_000, "நீ a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: (r.ratio, r.share, r.in_script) for r in df.select("i", *X.script_measures(F.col("text"), X.LATIN)).collect()}
    assert got == {0: (0.0, 0.0, False), 1: (None, None, None), 2: (0.0, 0.0, False), 3: (0.75, 0.75, False), 4: (2 / 3, 2 / 5, False), 5: (0.5, 1 / 3, False), 6: (1.0, 1.0, True), 7: (2 / 3, 2 / 3, False)}
    plan = df.select(*X.script_measures(F.col("text"), X.LATIN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_forms_are_counted_off_texts_as_by_documents(spark):
    rows = [("a", 1, "The cat, the\u200b dog"), ("a", 1, "THE end"), ("a", 2, "l'été 9x the"), ("b", 1, "the the"), ("b", None, "the"), ("b", None, "the cat"), (None, 3, "dog"), (None, 4, "dog dog"), ("c", 5, None), ("c", 6, ""), ("c", 7, " ... ")]
    docs = spark.createDataFrame(rows, "corpus string, doc_id long, text string").repartition(3)
    got = I.counted_forms(docs, X.LATIN)
    want = I.form_types(I.document_forms(docs.select("corpus", "doc_id", X.tokens(F.col("text"), X.LATIN).alias("tokens"))))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.corpus: (r.n, r.df) for r in got.where("form = 'the'").collect()} == {"a": (4, 2), "b": (4, 2)}
