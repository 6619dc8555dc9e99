"""The similarity join on dense neighbourhoods, where rounds of leaders settle most pairs, against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import jaccard


def _copies(seed: int) -> list[tuple[int, str]]:
    r, rows = random.Random(seed), []
    for _ in range(4):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for _ in range(30):
            words = list(base)
            for _ in range(r.randrange(5)):
                words[r.randrange(60)] = f"x{r.randrange(50)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def _brute_force(rows: list[tuple[int, str]], width: int, percent: int) -> dict[int, int]:
    sets = [set(zip(*[t.split()[i:] for i in range(width)], strict=False)) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_leaders_lose_no_link(spark, monkeypatch, width, percent):
    for name, value in (("SMALL", 4), ("MORE_LEADERS", 2), ("BLOCK", 64), ("FREQUENT_FROM", 6), ("IN_CHUNK", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = _copies(1)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == _brute_force(rows, width, percent)


@pytest.mark.parametrize("seed", [2, 3])
def test_of_each_group_one_row_stays(spark, monkeypatch, seed):
    for name, value in (("SMALL", 4), ("MORE_LEADERS", 2), ("BLOCK", 64), ("FREQUENT_FROM", 6), ("IN_CHUNK", 2), ("LARGE", 1)):
        monkeypatch.setattr(jaccard, name, value)
    texts = [t for _, t in _copies(seed)]
    ids = [None if i % 9 == 0 else i // 2 * 2 for i in range(len(texts))]  # some without an id, some of one id
    rows = [(i, t, "x", k % 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [*rows[3:6], (5, texts[7], "x", 1), (None, texts[7], "x", 0), (7, "", "x", 0), (7, "", "x", 0), (None, None, "x", 0)]
    group = _brute_force([(k, r[1] or "") for k, r in enumerate(rows)], 5, 80)
    want = []
    for g in sorted({group[k] for k, r in enumerate(rows) if r[1]}):
        want.append(min((r[0] is None, r[0] or 0) for k, r in enumerate(rows) if r[1] and group[k] == g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, text_hash int")
    got = jaccard.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.text) == sorted(want)
    assert sorted((r.doc_id, r.text) for r in got if not r.text and r.doc_id) == [(7, ""), (7, "")] and any(r.text is None for r in got)


def test_rows_of_one_id_are_one_node(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join([*words, "end"])), (5, " ".join(reversed(words))), (9, " ".join(reversed(words))), (9, None), (4, ""), (None, " ".join(words))]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id) == [(1, 1), (4, 4), (5, 1), (5, 1), (9, 1), (9, 1)]
    assert jaccard.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_are_counted_across_chunks(spark):
    """Each text is a chunk of its own: what 40 of them share is frequent all the same, where prefixes can begin with it."""
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{base} x{i}") for i in range(40)], "doc_id long, text string").repartition(40, "doc_id")
    (shared,) = jaccard.shingle_sets([base.encode()], 3)
    low = shared[shared < np.uint64(2**64 // 10)]
    assert len(low) > 5 and np.isin(low, jaccard.frequent_shingles(docs, 3, 90)).all()


def test_pairs_that_sketches_turn_down_are_no_rows(spark):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (60, 66, 70, 100, 130, 140) for _ in range(10)]
    sets.append(sets[3][1:])
    s, n = [jaccard.sketch(x) for x in sets], np.array([len(x) for x in sets])
    near = jaccard._apart(s, s) * 190 <= (n[:, None] + n[None, :]) * 10
    assert near.tolist() == [[jaccard.possible(a, len(x), b, len(y), 90) for b, y in zip(s, sets, strict=True)] for a, x in zip(s, sets, strict=True)]
    rows = [(k, 7, len(x), 0) for k, x in enumerate(sets)]
    dense = spark.createDataFrame(rows, "group_id long, element long, n int, pos int").withColumn("stretch", jaccard._stretch(90))
    labelled = spark.createDataFrame([(k, len(x), k, 1, k) for k, x in enumerate(sets)], "class long, n long, group_id long, members long, component long")
    sketches = spark.createDataFrame([(k, len(x), bytearray(y)) for k, (x, y) in enumerate(zip(sets, s, strict=True))], "class long, n long, sketch binary")
    assert [tuple(x) for x in jaccard._across(dense, labelled, sketches, 90).collect()] == [(3, 60)]
