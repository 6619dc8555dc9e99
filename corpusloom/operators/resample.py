"""Resampling over clusters: in Column form with hashed weights, in numpy where draws must be a generator's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import hash_uniform, poisson_weight


def hash_bootstrap(successes: DataFrame, totals: DataFrame, draws: int = 200) -> DataFrame:
    """U-01 in Column form: corpus, mean_p, low, high of sum(k) / sum(n) over clusters (doc_id) with Poisson(1) weights. Zero clusters never count.

    Each cluster's weighted sums for all draws are partial aggregates: a group's size does not matter.
    """
    rows = totals.join(successes, ["corpus", "doc_id"], "left").fillna(0, ["k"])
    rows = rows.select("corpus", "doc_id", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    w = poisson_weight(hash_uniform(F.col("corpus"), F.col("doc_id").cast("string"), F.col("b").cast("string")))
    by = rows.groupBy("corpus", "b").agg(F.try_divide(F.sum(w * F.col("k")).cast("double"), F.sum(w * F.col("n"))).alias("p"))
    return by.groupBy("corpus").agg(F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.percentile("p", 0.025), 6).alias("low"), F.round(F.percentile("p", 0.975), 6).alias("high"))


def _pieces(draws: int, clusters: int, cells: int = 2_000_000) -> list[int]:
    """Numbers of draws that are made at once: a generator gives the same numbers in pieces as in one matrix, which would grow with draws x clusters."""
    size = max(1, cells // max(1, clusters))
    return [min(size, draws - low) for low in range(0, draws, size)]


def bootstrap_matrix(counts: np.ndarray, n_boot: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """U-01: p, low, high and design effect of each column's share, clusters being rows. Multinomial weights up to 2,000 rows, Poisson(1) beyond."""
    counts = counts[counts.sum(axis=1) > 0].astype(np.float32)
    if not len(counts):
        n = counts.shape[1]
        return np.full(n, np.nan), np.zeros(n), np.ones(n), np.full(n, np.nan)
    rng = np.random.default_rng(seed)
    total = counts.sum()
    p = counts.sum(axis=0) / total
    draws = []
    for size in _pieces(n_boot, len(counts)):
        w = rng.multinomial(len(counts), np.full(len(counts), 1 / len(counts)), size) if len(counts) <= 2000 else rng.poisson(1, (size, len(counts)))
        sums = w.astype(np.float32) @ counts
        draws.append(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9))
    d = np.concatenate(draws)
    iid = p * (1 - p) / total
    return p, np.quantile(d, 0.025, axis=0), np.quantile(d, 0.975, axis=0), np.divide(d.var(axis=0, ddof=1), iid, out=np.full(len(p), np.nan), where=iid > 0)


def numpy_bootstrap(values: DataFrame, n_boot: int = 1000, seed: int = 20260807) -> DataFrame:
    """U-01, A-35 by corpus: one row for each value. A group's rows are counts by document; the matrix holds documents with any."""
    schema = "corpus string, value string, p double, low double, high double, deff double"

    def run(key, pdf):  # type: ignore[no-untyped-def]
        import pandas as pd

        m = pdf.pivot_table(index="doc_id", columns="value", values="n", aggfunc="sum", fill_value=0)
        p, low, high, deff = bootstrap_matrix(m.to_numpy(), n_boot, seed)
        return pd.DataFrame({"corpus": key[0], "value": list(m.columns), "p": p.astype(float), "low": low.astype(float), "high": high.astype(float), "deff": deff.astype(float)})

    return values.groupBy("corpus").applyInPandas(run, schema)


def cluster_mean(s: np.ndarray, n: np.ndarray, n_boot: int, seed: int) -> tuple[float, float, float]:
    """U-02: mean, low and high from clusters' sums and numbers of values, by draws of cluster indexes."""
    mean = s.sum() / n.sum() if n.sum() else float("nan")
    if len(s) < 2 or not n.sum():
        return mean, mean, mean
    rng, draws = np.random.default_rng(seed), []
    for size in _pieces(n_boot, len(s)):
        at = rng.integers(0, len(s), (size, len(s)))
        draws.append(s[at].sum(axis=1) / np.maximum(n[at].sum(axis=1), 1))
    return mean, *np.quantile(np.concatenate(draws), [0.025, 0.975])


def mean_interval(df: DataFrame, keys: list[str], cluster: str, value: str, n_boot: int = 2000, seed: int = 1) -> DataFrame:
    """U-02: mean with a cluster bootstrap's interval; (mean, mean) for one cluster."""
    sums = df.groupBy(*keys, cluster).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_n"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", mean double, low double, high double"

    def run(key, pdf):  # type: ignore[no-untyped-def]
        import pandas as pd

        s, n = pdf.sort_values(cluster)[["_s", "_n"]].to_numpy().T
        return pd.DataFrame([[*key, *cluster_mean(s, n, n_boot, seed)]], columns=[*keys, "mean", "low", "high"])

    return sums.groupBy(*keys).applyInPandas(run, schema)


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    """U-07: by rank sums, ties at half."""
    _, which, n = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[which]
    pos = labels.sum()
    neg = len(labels) - pos
    return float((rank[labels > 0].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")
