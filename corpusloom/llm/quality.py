"""Quality classifier: histogram gradient-boosted trees over document statistics.

`statistics` turns texts into a matrix of counts and shares (byte classes, word lengths, repetition), vectorised over chunks of texts. The
trees are grown on the driver from a bounded sample of labelled rows (`MAX_TRAINING_ROWS`, chosen by hash of doc_id), on quantile bins of each
statistic, and flattened into arrays (feature, threshold, left, right, value); scoring walks all rows of a chunk down all trees by numpy.

Edge cases: a null text scores as an empty one; very long texts are measured whole, one at a time; without labelled rows (empty tables too) every
score is 0.5, with one class it is near that class; labels of one doc_id that contradict one another count as the lower; of several rows of one doc_id
the one with the least hash of its text is learned from; repeated rows get equal scores; a null doc_id is scored, never learned from, and has a
null held_out; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_chunks, words_of

MAX_TRAINING_ROWS = 20_000
KEEP_AT = 0.7

_CLASSES = ["other", "letter_lower", "letter_upper", "digit", "space", "newline", "full_stop", "comma", "exclamation", "symbol", "pipe", "bracket", "quote", "non_ascii"]
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 1, 2, 3, 13
for _chars, _k in ((b" \t\r\v\f", 4), (b"\n", 5), (b".", 6), (b",;:", 7), (b"!?", 8), (b"*#$%&@^~=+_/\\", 9), (b"|", 10), (b"()[]{}<>", 11), (b"\"'`", 12)):
    _CLASS[list(_chars)] = _k
STATISTICS = [*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "mean_word", "share_short", "share_long", "share_capital", "share_odd_end", "distinct_words", "top_word", "repeats_last", "words_a_line"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text, each computed over the whole text."""
    n, classes = len(texts), len(_CLASSES)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    counts = np.bincount(np.repeat(np.arange(n) * classes, lengths) + _CLASS[joined], minlength=n * classes).reshape(n, classes).astype(float)
    hashes, starts, ends, first = words_of(texts)
    words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    size = ends - starts
    with_newlines = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    head, tail = _CLASS[with_newlines[starts]], _CLASS[with_newlines[ends - 1]]
    share = lambda flags: np.bincount(doc[flags], minlength=n) / np.maximum(words, 1)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(order)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][at], runs)
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    return np.column_stack([
        counts / np.maximum(lengths, 1)[:, None], np.log1p(lengths), np.log1p(words), np.bincount(doc, size, minlength=n) / np.maximum(words, 1),
        share(size <= 3), share(size >= 14), share(head == 2), share((tail == 9) | (tail == 8)), np.bincount(doc[order][at], minlength=n) / np.maximum(words, 1),
        top / np.maximum(words, 1), share(again), words / (counts[:, 5] + 1),
    ])


@dataclass
class BoostedTrees:
    """Binary trees in flat arrays; a leaf points to itself. score() is the logistic of base + sum of leaf values."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> BoostedTrees:
    """Histogram gradient boosting under the logistic loss."""
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))

    def node(value: float = 0.0) -> int:
        k = len(flat["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", value)):
            flat[name].append(v)
        return k

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(node())
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for k, rows in level:
                    best = (1e-6, 0, 0)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    if d < depth and len(rows) >= 2 * least:
                        for f, e in enumerate(edges):
                            if not len(e):
                                continue
                            b = binned[rows, f]
                            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                            gain[(nl < least) | (len(rows) - nl < least)] = 0
                            c = int(gain.argmax())
                            if gain[c] > best[0]:
                                best = (float(gain[c]), f, c)
                    if best[0] > 1e-6:
                        _, f, c = best
                        goes = binned[rows, f] <= c
                        flat["feature"][k], flat["threshold"][k], flat["left"][k], flat["right"][k] = f, float(edges[f][c]), node(), node()
                        below += [(flat["left"][k], rows[goes]), (flat["right"][k], rows[~goes])]
                    else:
                        flat["value"][k] = float(-rate * gs / (hs + ridge))
                        margin[rows] += flat["value"][k]
                level = below
    arrays = {k: np.array(v, dtype=float if k in ("threshold", "value") else np.int64) for k, v in flat.items()}
    if not roots:
        roots, arrays = [0], {k: np.zeros(1, dtype=float if k in ("threshold", "value") else np.int64) for k in flat}
    return BoostedTrees(base, np.array(roots), depth=depth, **arrays)


def training_fold(doc_id: Column, modulus: int, held_out: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """Up to `rows` labelled documents (doc_id, text, y) of the training fold, by hash of doc_id. Only ids of the sample, at most `rows`, are broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & training_fold(F.col("doc_id"), modulus, held_out))
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> BoostedTrees:
    sample = labelled_sample(docs, labels, "quality", 4, 2, rows)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, ys, keys, texts in text_chunks(batches, ("doc_id", "y", "key")):
            measured = pa.array(list(statistics([t or b"" for t in texts])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(keys, pa.int64()), measured], ["doc_id", "y", "key", "x"])

    got = sample.withColumn("key", F.xxhash64("text")).mapInArrow(measure, "doc_id long, y int, key long, x array<double>").toPandas()
    got = got.sort_values(["doc_id", "key"]).drop_duplicates("doc_id")
    return grow(np.array(got.x.tolist(), dtype=float).reshape(len(got), len(STATISTICS)), got.y.to_numpy(dtype=float))


def score(docs: DataFrame, model: BoostedTrees, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, score of each whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(statistics([t or b"" for t in texts])))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (~training_fold(F.col("doc_id"), 4, 2)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the others keep their columns. Rows are scored where they are, without a join."""
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            scores = [model.score(statistics([t or b"" for t in texts])) for (texts,) in text_chunks([b], ())]
            yield b.filter(pa.array(np.concatenate(scores) >= KEEP_AT)) if scores else b

    return docs.mapInArrow(run, docs.schema)
