"""Spherical-cap filters against all pairs: every unit size, and the share of links that are found."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.llm import cap_filters


def _vectors(seed: int, n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[: n // 4] + 0.2 * rng.normal(size=(n // 4, dim))
    dense = base[0] + 0.12 * rng.normal(size=(n // 4, dim))  # a cluster in which most pairs link
    return np.concatenate([base, near, dense, base[:5]]).astype(np.float32)


@pytest.mark.parametrize(("kind", "few", "block"), [("float", 48, 512), ("double", 3, 16)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, kind, few, block):
    monkeypatch.setattr(cap_filters, "FEW", few)
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    x = _vectors(5, 160, 24)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(None, x[0].tolist(), ""), (900, [], ""), (901, None, ""), (902, [1.0, None], "")]
    got = cap_filters.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, filter string")).collect()
    assert len(got) == len(rows) and sorted((r.vec_id or 0, r.n_links) for r in got if r.vec_id is None or r.vec_id >= 900) == [(0, 0), (900, 0), (901, 0), (902, 0)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None and r.vec_id < 900}
    assert all(links[i] <= hit[i].sum() for i in range(len(x)))  # none that is below the threshold
    assert sum(links.values()) >= 0.95 * hit.sum()
    label = {r.vec_id: r.component_id for r in got}
    assert all(hit[i].any() or label[i] == i for i in range(len(x))) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_more_lengths_than_codes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "LENGTHS", 2)
    with pytest.raises(ValueError, match="lengths"):
        cap_filters.near_duplicates(spark.createDataFrame([(k, [1.0] * k) for k in (1, 2, 3)], "vec_id long, embedding array<double>"))
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
