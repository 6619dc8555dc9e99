"""Metric studies that take whole tables, against plain Python on small fixtures."""

import hashlib
from math import comb

from corpusloom.plans import evaluation


def test_sign_test_of_every_item(spark, tmp_path):
    wins = {7: (5, 1), 40: (3, 3), 41: (8, 0), 90_000: (2, 7)}  # item: wins, losses
    rows = [("A", 1, item, 100.0, 0.0 if k < w else 0.5, 1.0) for item, (w, l) in wins.items() for k in range(w + l)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_partkey long, l_extendedprice double, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["item"]: (r.win, r.loss, round(r.p, 9)) for r in evaluation.metric_sign_test(spark, str(tmp_path)).collect()}
    assert got == {i: (w, l, round(min(1.0, 2 * sum(comb(w + l, k) for k in range(min(w, l) + 1)) / 2 ** (w + l)), 9)) for i, (w, l) in wins.items()}


def test_references_of_all_turns(spark, tmp_path):
    rows = [(c, t, "user", f"text {(c * 7 + t) % 5}") for c in (1, 2, 41, 42, 81) for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {(c, t): min((digest(y) for d, _, _, y in rows if d % 40 == c % 40 and y != x), default=None) for c, t, _, x in rows}
    assert {(r.conv_id, r.turn): r.reference for r in evaluation.heldout_reference_all_turns(spark, str(tmp_path)).collect()} == want
