"""Statistics as Column expressions, and the few that need numpy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """A-13: (0, 1) where n is 0."""
    p = F.try_divide(k.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def total_variation(p: Column, q: Column) -> Column:
    """A-14, an aggregate over the union of the keys."""
    return 0.5 * F.sum(F.abs(p - q))


def jensen_shannon(p: Column, q: Column) -> Column:
    """A-14, base 2."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return F.sum(0.5 * part(p) + 0.5 * part(q))


def _stirling_error(n: int) -> float:
    """ln n! less Stirling's formula."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n / n) / n / n) / n / n) / n / n) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x, as a series where the terms would cancel."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    total, term, j = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        j += 2
        if total + term / j == total:
            return total
        total += term / j


def _binomial_pmf(k: int, n: int, p: float) -> float:
    """By Loader's saddle-point expansion, to a double's precision at every n."""
    if k in (0, n):
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log(p)))
    x = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(x) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for k > n p: terms fall, and are summed until all that are left can't change a double: some multiples of sqrt(n)."""
    total = term = _binomial_pmf(k, n, p)
    odds, at, step = p / (1 - p), k, 64
    while term and at < n:
        i = np.arange(at, min(n, at + step), dtype=float)
        ratios = (n - i) / (i + 1) * odds
        terms = term * np.cumprod(ratios)
        total, term, at, step = total + float(terms.sum()), float(terms[-1]), at + len(i), min(65_536, 4 * step)
        if term * ratios[-1] < total * 1e-18 * (1 - ratios[-1]):
            break
    return total


@lru_cache(65_536)
def upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial distribution. Time grows with sqrt(n), numbers stay doubles."""
    if k <= 0 or k > n or not 0 < p < 1:
        return float(k <= 0 or (k <= n and p >= 1))
    return min(1.0, _upper_tail(k, n, p)) if k > n * p else 1 - _upper_tail(n - k + 1, n, 1 - p)


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(k, n):  # type: ignore[no-untyped-def]
    """U-05: exact, p = 1/2; 1 where n is 0. Also McNemar's exact test, with n = b + c."""
    import pandas as pd

    def one(k: int, n: int) -> float:
        k = min(k, n - k)
        return 1.0 if 2 * k + 1 >= n else min(1.0, 2 * upper_tail(n - k, n, 0.5))

    return pd.Series([one(int(a), int(b)) for a, b in zip(k, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def binomial_sf(k, n, p):  # type: ignore[no-untyped-def]
    """U-05: P(X >= k)."""
    import pandas as pd

    return pd.Series([upper_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


def holm(df: DataFrame, family: list[str], p: str, alpha: float = 0.05, tie: list[str] | None = None) -> DataFrame:
    """W-08: `rejected` (step-down, stops at the first failure) and `p_holm` (adjusted, monotone). NaN and null p-values take no part."""
    valid = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy(*family)
    ordered = w.orderBy(p, *(tie or []))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ranked = valid.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(ordered))
    ranked = ranked.withColumn("_scaled", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("rejected", F.min(F.col("_scaled") <= alpha).over(so_far)).withColumn("p_holm", F.least(F.lit(1.0), F.max("_scaled").over(so_far))).drop("_m", "_r", "_scaled")


def onset(df: DataFrame, keys: list[str], depth: str, value: str, threshold: float) -> DataFrame:
    """W-07: the depth from which a curve stays at or over the threshold, by linear interpolation; 1.0 if it never does."""
    w = Window.partitionBy(*keys).orderBy(depth)
    step = df.withColumns({"_last": F.lag(value).over(w), "_before": F.lag(depth).over(w), "_below": F.max(F.when(F.col(value) < threshold, F.col(depth))).over(Window.partitionBy(*keys))})
    after = step.where(F.col("_below").isNull() | (F.col(depth) > F.col("_below")))
    at = F.when(F.col("_last").isNull() | (F.col("_last") >= threshold), F.col(depth)).otherwise(F.col("_before") + (threshold - F.col("_last")) / (F.col(value) - F.col("_last")) * (F.col(depth) - F.col("_before")))
    found = after.groupBy(*keys).agg(F.min_by(at, depth).alias("onset"))
    return df.select(*keys).distinct().join(found, keys, "left").withColumn("onset", F.coalesce("onset", F.lit(1.0)))


def hash_uniform(*parts: Column) -> Column:
    """A uniform number of text, alike in every engine: 32 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


#: The distribution function of Poisson(1) at 0 to 7.
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_weight(u: Column) -> Column:
    out = F.when(u < POISSON_1[0], 0)
    for k, c in enumerate(POISSON_1[1:], 1):
        out = out.when(u < c, k)
    return out.otherwise(8)


def poisson_weight_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(POISSON_1)) + " ELSE 8 END"


def percentile_by_index(values: Column, q: float) -> Column:
    """U-03: the sorted value at int(q * n), as an aggregate's result of collect_list."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(q) * F.size(ordered)).cast("int")) + 1)


def upper_median(values: Column) -> Column:
    """A-21: the sorted value at n // 2."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
