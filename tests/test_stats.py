import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import metric as M
from corpusloom.operators import panel as P
from corpusloom.operators import resample as R


def test_direction_and_sign_test(spark):
    df = spark.createDataFrame(list(zip([1.0, 1.0, 1.0, 0.0], [0.0, 1.0, 2.0, 0.0], strict=True)), "good double, bad double")
    r = df.agg(*M.direction()).first()
    assert (r.win, r.tie, r.loss, r.rate) == (1, 2, 1, 0.5)
    assert spark.createDataFrame([(1, 2)], "k int, n int").select(S.binomial_two_sided("k", "n").alias("p")).first().p == 1.0


def test_magnitude(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, 1.0), (1, 0.0)], "good int, bad double")
    r = df.agg(*M.magnitude(F.col("good") - F.col("bad"))).first()
    assert (r["mean"], r.frac_nonpositive) == (0.25, 0.5)


def test_floor_drops_tiny_denominators(spark):
    df = spark.createDataFrame([("c", 1.0, 0.9, 0.0), ("c", 1.0, 0.9, 1.0), ("c", 1.0, 0.9, 0.9999)], "k string, good double, bad double, empty double")
    r = M.z_floor(df, ["k"], least=1).first()
    assert (r.n_used, r.n_dropped) == (1, 2) and math.isclose(r["mean"], 0.1)


def test_wilson_of_nothing(spark):
    low, high = S.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == (0.0, 1.0)


def test_holm_stops_and_is_monotone(spark):
    df = spark.createDataFrame([("f", "a", 0.001), ("f", "b", 0.03), ("f", "c", 0.9), ("f", "d", float("nan"))], "fam string, name string, p double")
    rows = {r.name: r for r in S.holm(df, ["fam"], "p").collect()}
    assert rows["a"].rejected and not rows["c"].rejected and "d" not in rows
    assert rows["a"].p_holm <= rows["b"].p_holm <= rows["c"].p_holm


def test_onset(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0), ("x", 0.5, 0.4), ("x", 1.0, 0.8), ("y", 0.0, 0.9), ("y", 1.0, 0.1)], "k string, d double, v double")
    r = {r.k: r.onset for r in S.onset(df, ["k"], "d", "v", 0.6).collect()}
    assert math.isclose(r["x"], 0.75) and r["y"] == 1.0


def test_bootstrap_of_two_clusters(spark):
    df = spark.createDataFrame([("g", "A", 0.0)] * 50 + [("g", "B", 1.0)] * 50, "k string, c string, v double")
    r = R.mean_interval(df, ["k"], "c", "v").first()
    assert (r["mean"], r.low, r.high) == (0.5, 0.0, 1.0)


def test_clumped_counts_have_wider_intervals():
    spread = np.tile([[1, 1]], (100, 1))
    clumped = np.zeros((100, 2))
    clumped[:4] = [[25, 0], [0, 25], [25, 0], [0, 25]]
    _, lo, hi, deff = R.bootstrap_matrix(clumped, 500, 1)
    _, lo2, hi2, deff2 = R.bootstrap_matrix(spread, 500, 1)
    assert hi[0] - lo[0] > 5 * (hi2[0] - lo2[0]) and deff[0] > 5 > deff2[0]
    assert np.isnan(R.bootstrap_matrix(np.zeros((3, 2)), 10, 1)[0]).all()


def test_auc_with_ties():
    assert R.auc(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])) == 0.875


def test_cells_without_gold_have_no_accuracy(spark):
    rows = [("s", "x", "C3", 1, None, "COMMITTED")] * 40 + [("s", "x", "C0", 1, 1, "CORRECT")] * 40
    cells = {r.condition: r for r in P.cells(spark.createDataFrame(rows, "system string, slot string, condition string, template int, gold int, outcome string")).collect()}
    assert cells["C3"].acc_committed is None and cells["C3"].floor_reason == "no_gold" and cells["C0"].acc_committed == 1.0


def test_chrf_of_equal_texts(spark):
    df = spark.createDataFrame([("abc def", "abc def"), ("abc", "xyz")], "a string, b string")
    assert [round(r.x, 6) for r in df.select(M.chrf("a", "b").alias("x")).collect()] == [100.0, 0.0]
