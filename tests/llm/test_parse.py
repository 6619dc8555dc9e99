"""Relative Lempel-Ziv parsing: factors with source, place and length, against all pairs of windows by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import common, substring


def _texts(seed: int) -> list[str]:
    r = random.Random(seed)
    texts: list[list[str]] = []
    for _ in range(40):
        words = [r.choice("abcd") if r.random() < 0.5 else f"u{r.randrange(10**6)}" for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            if texts:
                source = r.choice(texts)
                lo = r.randrange(len(source) + 1)
                at = r.randrange(len(words) + 1)
                words[at:at] = source[lo : lo + r.randrange(25)]
        texts.append(words)
    return [" ".join(t) for t in texts]


def _kept(rows: list[tuple[int, str]], window: int) -> list[str]:
    lists = [(i, t.split()) for i, t in rows]
    out = []
    for i, w in lists:
        earlier = {tuple(v[k : k + window]) for j, v in lists if j < i for k in range(len(v) - window + 1)}
        gone = {k + x for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in earlier for x in range(window)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 2)])
def test_spans_cover_what_brute_force_finds(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substring, "HOT_FROM", hot)
    monkeypatch.setattr(substring, "BLOCK", 5)
    rows = [(k // 2 if k % 5 == 0 else k, t) for k, t in enumerate(_texts(seed))]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, rlz_id string, rlz_spans int")
    got = substring.deduplicated(docs, 7, 2)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in got.collect()) == sorted(zip([i for i, _ in rows], _kept(rows, 7), strict=True))


def test_factors_stand_in_their_sources(spark):
    rows = list(enumerate(_texts(3)))
    words = {i: t.split() for i, t in rows}
    found = substring.factors(spark.createDataFrame(rows, "doc_id long, text string"), 7, 2).collect()
    assert found
    for r in found:
        part, source = words[r.doc_id][r.start : r.end], words[r.source]
        assert len(part) >= 7 and r.source < r.doc_id
        assert any(source[k : k + len(part)] == part for k in range(len(source)))


def _block(seed: int, window: int) -> tuple[substring.Block, list[np.ndarray], np.ndarray]:
    r = np.random.default_rng(seed)
    base = r.integers(0, 4, 400, dtype=np.uint64)
    runs = [base[a : a + int(r.integers(window, 3 * window))] for a in r.integers(0, 330, 60).tolist()]
    runs = [x for k, x in enumerate(runs) if not any(np.array_equal(x, y) for y in runs[:k])]
    first = np.array([int(x) for x in r.integers(0, 20, len(runs))])
    return substring.Block(runs, first, np.zeros(len(runs), dtype=np.int64), window), runs, first


@pytest.mark.parametrize("bits", [64, 3])
def test_factors_are_the_longest_and_words_decide(monkeypatch, bits):
    whole = common.rolling
    monkeypatch.setattr(substring, "rolling", lambda x, n: whole(x, n) >> np.uint64(64 - bits))  # few bits: most windows share a hash
    window = 8
    block, runs, first = _block(5, window)
    run, start, size, source, _ = block.parse()
    for k, words in enumerate(runs):
        windows = [words[p : p + window].tobytes() for p in range(len(words) - window + 1)]

        def longest(p: int, k: int = k, words: np.ndarray = words) -> int:
            best = 0
            for j, other in enumerate(runs):
                if first[j] < first[k]:
                    for q in range(len(other) - window + 1):
                        n = 0
                        while p + n < len(words) and q + n < len(other) and words[p + n] == other[q + n]:
                            n += 1
                        best = max(best, n - window + 1)
            return best

        p, want = 0, []
        while p < len(windows):
            n = longest(p)
            if n > 0:
                want.append((p, n))
            p += max(n, 1)
        mine = run == k
        assert sorted(zip(start[mine].tolist(), size[mine].tolist(), strict=True)) == want
        assert (source[mine] < first[k]).all()
