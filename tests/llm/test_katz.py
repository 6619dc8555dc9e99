"""The trigram model against the textbook's recursion over dictionaries, and the sums of its probabilities."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import katz

E = "</end>"


class Katz:
    """P by recursion, from the counts of the learned texts."""

    def __init__(self, texts: list[list[str]]):
        self.c = [Counter(), Counter(), Counter()]
        self.context = [Counter(), Counter(), Counter()]
        for t in texts:
            seq = [E, E, *t, E]
            for i in range(2, len(seq)):
                for k in range(3):
                    self.c[k][tuple(seq[i - k : i + 1])] += 1
                    self.context[k][tuple(seq[i - k : i])] += 1
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.d = [None, *(katz.discounts([float(sum(x == r for x in c.values())) for r in range(1, katz.DISCOUNTED + 2)]) for c in self.c[1:])]
        self.after: dict = {}
        for k in (1, 2):
            for g in self.c[k]:
                self.after.setdefault(g[:-1], []).append(g[-1])

    def left(self, k: int, c: int) -> float:
        return c - katz.ALWAYS if c > katz.DISCOUNTED else self.d[k][c - 1] * c

    def p(self, *g: str) -> float:
        k = len(g) - 1
        if not k:
            return (self.c[0][g] + 1) / (self.n + self.v + 1)
        total = self.context[k][g[:-1]]
        if not total:
            return self.p(*g[1:])
        if self.c[k][g]:
            return self.left(k, self.c[k][g]) / total
        seen = self.after[g[:-1]]
        freed = 1 - sum(self.left(k, self.c[k][(*g[:-1], w)]) / total for w in seen)
        return freed / (1 - sum(self.p(*g[1:-1], w) for w in seen)) * self.p(*g[1:])


def _rows(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = [f"w{min(int(r.expovariate(0.15)), 60)}" for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(120)]
    texts += ["The cat  sat\ton the mat"] * 6 + ["", None, "the the the the the", "é Ü ü é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5]), (7, ""), (None, texts[1]), (None, None)]
    return rows


@pytest.mark.parametrize(("seed", "tokens", "heavy", "cell"), [(1, 1_000_000, 10**9, 10**6), (2, 17, 10**9, 40), (3, 50, 25, 300)])
def test_scores_are_those_of_the_recursion(spark, monkeypatch, seed, tokens, heavy, cell):
    for name, value in (("TOKENS", tokens), ("HEAVY_FROM", heavy), ("CELL_BYTES", cell), ("CHUNK", 900)):
        monkeypatch.setattr(katz, name, value)
    rows = _rows(seed)
    lower = lambda t: [w for w in __import__("re").split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    held_out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    model = Katz([lower(t) for i, t in rows if not held_out(i)])
    want = []
    for i, t in rows:
        seq = [E, E, *lower(t), E]
        grams = [seq[k - 2 : k + 1] for k in range(2, len(seq))]
        score, base = sum(math.log10(model.p(*g)) for g in grams), sum(math.log10(model.p(g[-1])) for g in grams)
        want.append((-1 if i is None else i, len(grams), sum(model.c[0][(g[-1],)] > 0 for g in grams), model.n, round(base, 6), round(score, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("row", __import__("pyspark").sql.functions.lit("clash"))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.scores(docs).collect()]
    assert sorted(x[:4] for x in got) == sorted(x[:4] for x in want)
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 2e-6 and abs(x[5] - y[5]) < 2e-6, (x, y)
    every = [g[0] for g in model.c[0]] + ["unknown"]
    for context in ((E, E), (E, "the"), ("the", "cat"), ("w1", "w0"), ("nothing", "w0"), ("nothing", "such")):
        assert abs(sum(model.p(*context, w) for w in every) - 1) < 1e-9


def test_without_rows_and_without_training(spark):
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = katz.scores(spark.createDataFrame([(alone, "a b a")], "doc_id long, text string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.score, got.base_score) == (4, 0, 0, 0.0, 0.0)


def test_discounts_leave_something_to_every_count():
    for n in ([0.0] * 6, [5.0, 0, 0, 0, 0, 0], [100.0, 40, 20, 12, 8, 6], [1.0, 9, 1, 1, 1, 50]):
        d = katz.discounts(n)
        assert len(d) == 5 and np.all(d > 0) and np.all(d * np.arange(1, 6) <= np.arange(1, 6) - katz.ALWAYS + 1e-12)


def test_messages_stay_large_as_the_table_grows():
    """Each chunk sends to each cell: at 6 GB of parquet (about 11 GB of text) a message is to hold several KB of the chunk's text."""
    assert katz.CHUNK / katz.cells_of(11_000_000_000, 600) > 5_000
    assert [katz.cells_of(n, 12) for n in (0, 999, 5_000, 1_000_000)] == [1, 1, 5, 12]
