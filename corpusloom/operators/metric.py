
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import iou, overlap


def long_variants(records: DataFrame, keys: list[str], variants: str = "variants") -> DataFrame:
    """N-07."""
    return records.select(*keys, F.explode(variants).alias("variant", "text"))


def segment_ids(long: DataFrame, columns: list[str]) -> DataFrame:
    """A-34, K-08: a dense id for each distinct segment, in the segments' order. Ranks in ranges of the order, then the ranges' offsets: no single task."""
    parts = long.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*columns))).join(F.broadcast(sizes), "_part")
    return ranked.select(*columns, (F.col("_before") + F.col("_r") - 1).cast("long").alias("line"))


def positional(index: DataFrame, payloads: DataFrame) -> DataFrame:
    """J-06, S-10: scores joined by line number, never by text."""
    return index.join(payloads.select("metric", F.posexplode("scores").alias("line", "score")), "line")


def wide_variants(long: DataFrame, keys: list[str], variants: list[str]) -> DataFrame:
    """N-08."""
    return long.groupBy(*keys).pivot("variant", variants).agg(F.first("score"))


LEVELS = [[], ["arm"], ["arm", "slot"], ["arm", "slot", "system"], ["slot"]]


def grouped(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """A-07: one pass over all five levels; what a level doesn't name is ALL."""
    dims = ["arm", "slot", "system"]
    out = df.groupingSets([[F.col(c) for c in level] for level in LEVELS], *dims).agg(*aggregates, F.grouping_id(*dims).alias("_g"))
    return out.withColumns({c: F.when(F.col("_g").bitwiseAND(F.lit(1 << 2 - i)) > 0, "ALL").otherwise(F.col(c)) for i, c in enumerate(dims)}).drop("_g")


def direction() -> list[Column]:
    """A-10: wins, ties, losses of good over bad; ties count half."""
    win, tie, loss = F.col("good") > F.col("bad"), F.col("good") == F.col("bad"), F.col("good") < F.col("bad")
    n = F.count_if(win) + F.count_if(tie) + F.count_if(loss)
    return [F.count_if(win).alias("win"), F.count_if(tie).alias("tie"), F.count_if(loss).alias("loss"), F.try_divide(F.count_if(win) + 0.5 * F.count_if(tie), n).alias("rate")]


def magnitude(diff: Column) -> list[Column]:
    """A-11."""
    q = lambda p, name: F.percentile(diff, p).alias(name)
    return [F.avg(diff).alias("mean"), q(0.5, "median"), q(0.25, "q25"), q(0.75, "q75"), F.avg((diff <= 0).cast("int")).alias("frac_nonpositive")]


def z_floor(df: DataFrame, keys: list[str], epsilon: float = 1e-3, least: int = 20) -> DataFrame:
    """A-12, P-15, P-16: (good - bad) / (good - empty) where the denominator is not tiny; small cells are null."""
    den = F.col("good") - F.col("empty")
    used = F.abs(den) >= epsilon
    z = F.when(used, F.try_divide(F.col("good") - F.col("bad"), den))
    out = df.groupBy(*keys).agg(F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_dropped"), F.avg(z).alias("mean"), F.percentile(z, 0.5).alias("median"))
    return out.withColumns({c: F.when(F.col("n_used") >= least, F.col(c)) for c in ("mean", "median")})


def splice_decomposition(df: DataFrame, controlled: str, natural: str, least: int = 20) -> DataFrame:
    """A-08, A-09, J-10: on items of both arms, signal s = (dc + dn) / 2 and bias b = (dc - dn) / 2, of means of item means; by slot and ALL."""
    items = df.groupBy("slot", "item").agg(F.avg(F.when(F.col("arm") == controlled, F.col("diff"))).alias("dc"), F.avg(F.when(F.col("arm") == natural, F.col("diff"))).alias("dn")).where("dc is not null and dn is not null")
    out = items.rollup("slot").agg(F.count(F.lit(1)).alias("n_items"), F.avg("dc").alias("dc"), F.avg("dn").alias("dn"), F.grouping("slot").alias("_g"))
    out = out.withColumn("slot", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("slot"))).drop("_g")
    ok = F.col("n_items") >= least
    return out.withColumns({"s": F.when(ok, (F.col("dc") + F.col("dn")) / 2), "b": F.when(ok, (F.col("dc") - F.col("dn")) / 2)})


def held_out_reference(records: DataFrame) -> DataFrame:
    """J-07: another system's text of the same item, the first in order that differs from one's own. The two least texts of an item suffice."""
    texts = records.select("item", "good").distinct().groupBy("item").agg(F.slice(F.array_sort(F.collect_set("good")), 1, 2).alias("_least"))
    return records.join(texts, "item").withColumn("reference", F.try_element_at(F.filter("_least", lambda t: t != F.col("good")), F.lit(1))).drop("_least")


def localisation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """J-17, A-24: gold span (start, end) against predicted spans, inside each row: any prediction, a hit of a character, an IoU of a half, precision and recall."""
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: iou(F.col("start"), F.col("end"), s["start"], s["end"]))), F.lit(0.0))
    hits = F.size(F.filter("spans", lambda s: overlap(F.col("start"), F.col("end"), s["start"], s["end"]) >= 1))
    n = F.size("spans")
    by = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 0).alias("n_flagged"), F.count_if(hits > 0).alias("n_hit"), F.count_if(best >= 0.5).alias("n_iou"), F.sum(hits).alias("tp"), F.sum(n - hits).alias("fp"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("n_hit"), F.col("n"))
    return by.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall)})


@F.pandas_udf(T.DoubleType())
def chrf(hypothesis, reference):  # type: ignore[no-untyped-def]
    """U-09: chrF2 of a sentence, characters of orders 1 to 6 without white space, orders that neither text has left out."""
    from collections import Counter

    import pandas as pd

    def one(h: str, r: str) -> float:
        h, r = "".join(h.split()), "".join(r.split())
        ps, rs = [], []
        for n in range(1, 7):
            a, b = Counter(h[i : i + n] for i in range(len(h) - n + 1)), Counter(r[i : i + n] for i in range(len(r) - n + 1))
            if a and b:
                common = sum((a & b).values())
                ps.append(common / sum(a.values()))
                rs.append(common / sum(b.values()))
        if not ps:
            return 0.0
        p, q = sum(ps) / len(ps), sum(rs) / len(rs)
        return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0

    return pd.Series([one(a or "", b or "") for a, b in zip(hypothesis, reference, strict=True)])
