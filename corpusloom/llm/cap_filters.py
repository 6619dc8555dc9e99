"""Embedding near-duplicates by spherical-cap filters.

Vectors are rotated at random and cut into blocks; each block has a random code, and a filter direction is one word of each code. A vector is
list-decoded to all directions whose inner product with it exceeds a threshold (and its best few in any case). The number of directions grows
with the number of vectors, so that a filter keeps holding a few unrelated vectors. The filters of a vector grow with it too: as many as random
pairs at exactly the threshold need to share one with `RECALL`, found by trial on the very codes that are used. Vectors of one filter are compared exactly, in double
precision. Equal vectors are one class from the start. A filter with more than `BLOCK` vectors is cut into blocks whose pairs are separate units of
work, so that a task holds two blocks at most. A pair counts in the first filter that both vectors share; a unit gives each vector's number of
links and a spanning forest, never its pairs.

Edge cases: null vectors, null or non-finite components, zero vectors and null vec_ids link with nothing; vectors of different lengths never
link; repeated rows count as vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, written
from corpusloom.llm.graph import components

THRESHOLD = 0.95
#: Different lengths that the vectors of a table may have: each needs codes of its own, and a row at the driver.
LENGTHS = 10_000
#: Filters that a random vector exceeds on average, and those it gets at least; both grow alike where RECALL asks for more.
FILTERS, LEAST_FILTERS = 16, 8
#: Share of trial pairs at the threshold that a filter has to hold; from MOST_FILTERS on, wider filters make up for it.
RECALL, TRIALS, MOST_FILTERS = 0.985, 2_000, 256
#: Unrelated vectors that a filter holds on average.
IN_FILTER = 6
BLOCK = 512
#: Vectors of a filter that is compared together with others.
FEW = 48


def _tail(dim: int, p: float) -> float:
    """The inner product with a unit direction that a random unit vector exceeds with probability p."""
    u = np.linspace(0, 1, 200_001)
    density = (1 - u**2) ** ((dim - 3) / 2) if dim >= 3 else np.ones_like(u)
    above = np.cumsum(density[::-1])[::-1]
    return float(u[np.searchsorted(-above, -2 * p * above[0])])


class CapFilters:
    def __init__(self, dim: int, vectors: int, seed: int = 7, filters: int = FILTERS, in_filter: int = IN_FILTER):
        rng = np.random.default_rng([seed, dim])
        directions = max(4096, filters * vectors // in_filter)
        self.blocks = max(1, min(dim // 8 or 1, 2 if directions <= 2048**2 else 3 if directions <= 2048**3 else 4))
        self.words = math.ceil(directions ** (1 / self.blocks))
        self.cut = np.array_split(np.arange(dim), self.blocks)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(len(at) / dim) for at in self.cut for c in (rng.normal(size=(self.words, len(at))),)]
        self.least = _tail(dim, min(0.5, filters / self.words**self.blocks))
        self.at_least = min(LEAST_FILTERS * filters // FILTERS, self.words**self.blocks)
        self.salt = dim * 0x9E3779B1
        self.step = max(1, min(256, (1 << 22) // self.words))  # vectors to decode at once

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector its filters' numbers, ascending."""
        y = x @ self.rotation
        scores = [y[:, at] @ code.T for at, code in zip(self.cut, self.codes, strict=True)]
        top = [s.max(axis=1) for s in scores]
        out = []
        for k in range(len(x)):
            bound = self.least
            while True:
                ids, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
                for j, s in enumerate(scores):
                    rest = sum(t[k] for t in top[j + 1 :])
                    at = np.flatnonzero(s[k] >= bound - rest - sums.max()) if len(sums) else np.empty(0, dtype=np.int64)
                    total = sums[:, None] + s[k][at][None, :]
                    a, b = np.nonzero(total >= bound - rest)
                    ids, sums = ids[a] * self.words + at[b], total[a, b]
                if len(ids) >= self.at_least:
                    break
                bound -= 0.02
            if bound < self.least:
                ids = ids[np.argsort(-sums, kind="stable")[: self.at_least]]
            out.append(np.sort(ids) * 8191 + self.salt)
        return out


def recall(filters: CapFilters, dim: int, threshold: float, trials: int = TRIALS, seed: int = 11) -> float:
    """The share of random pairs at exactly cosine `threshold` that share a filter."""
    rng = np.random.default_rng([seed, dim])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, trials, dim)))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    found = 0
    for lo in range(0, trials, filters.step):
        pairs = zip(filters.decode(a[lo : lo + filters.step]), filters.decode(b[lo : lo + filters.step]), strict=True)
        found += sum(bool(len(np.intersect1d(x, y))) for x, y in pairs)
    return found / trials


def fitted(dim: int, vectors: int, threshold: float) -> dict[str, int]:
    """The filters that RECALL needs at the threshold: arguments of CapFilters."""
    filters, in_filter = FILTERS, IN_FILTER
    if dim < 2 or vectors < 2 or not -1 < threshold < 1:
        return {}
    while (share := recall(CapFilters(dim, vectors, filters=filters, in_filter=in_filter), dim, threshold)) < RECALL:
        if filters < MOST_FILTERS:
            filters = min(MOST_FILTERS, math.ceil(filters * min(4.0, max(1.1, math.log(1 - RECALL) / math.log(1 - max(share, 0.01))))))
        elif in_filter < vectors:
            in_filter *= 2
        else:
            break  # a filter is half of all directions
    return {"filters": filters, "in_filter": in_filter}


def unit(embeddings: np.ndarray) -> np.ndarray:
    x = np.asarray(embeddings, dtype=np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared(a: list[np.ndarray], b: list[np.ndarray], below: int) -> np.ndarray:
    """Whether two vectors share a filter under `below`."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa[fa < below], fb)
    mark = []
    for lists, flat in ((a, fa), (b, fb)):
        m = np.zeros((len(lists), len(both)), dtype=np.float32)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.searchsorted(both, flat)
        ok = np.flatnonzero((at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat)) if len(both) else np.empty(0, dtype=np.int64)
        m[row[ok], at[ok]] = 1
        mark.append(m)
    return mark[0] @ mark[1].T > 0


class _Rows:
    """Rows of sorted batches as arrays: the unit (filter, i, j), the vector's part, class, weight, components and filters."""

    def __init__(self, batch):  # noqa: ANN001
        self.filter, self.i, self.j, self.part, self.id, self.weight = (batch.column(k).to_numpy() for k in range(6))
        self.x, self.at = _flat(batch.column(6))
        self.filters, self.filters_at = _flat(batch.column(7))

    def own(self, k: int) -> np.ndarray:
        return self.filters[self.filters_at[k] : self.filters_at[k + 1]]

    def units(self) -> list[tuple[int, int]]:
        new = np.r_[True, (self.filter[1:] != self.filter[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])]
        at = np.append(np.flatnonzero(new), len(self.filter))
        return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of one length."""
        d = self.at[rows[0] + 1] - self.at[rows[0]]
        return unit(self.x[self.at[rows][:, None] + np.arange(d)[None, :]])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Values of an Arrow list column without nulls, and where each row's begin."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _small(rows: _Rows, units: list[tuple[int, int]], threshold: float) -> list[tuple[int, int, int]]:
    """(class, links, other class) for either side of each link that counts in one of these units, which are whole filters of one size and dimension."""
    lo, m = np.array([u[0] for u in units]), units[0][1] - units[0][0]
    x = rows.matrix((lo[:, None] + np.arange(m)[None, :]).ravel()).reshape(len(lo), m, -1)
    k, a, b = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= threshold, 1))
    out = []
    for f, p, q in zip(rows.filter[lo[k]].tolist(), (lo[k] + a).tolist(), (lo[k] + b).tolist(), strict=True):
        fp, fq = rows.own(p), rows.own(q)
        if not np.isin(fp[: np.searchsorted(fp, f)], fq, assume_unique=True).any():  # the first filter that they share
            out += [(int(rows.id[p]), int(rows.weight[q]), int(rows.id[q])), (int(rows.id[q]), int(rows.weight[p]), int(rows.id[p]))]
    return out


def _compare(rows: _Rows, lo: int, hi: int, threshold: float) -> list[tuple[int, int, int]]:
    """(class, links to vectors of other classes that count here, least class of its part here) for each class with a link."""
    f, i, j = int(rows.filter[lo]), int(rows.i[lo]), int(rows.j[lo])
    x = rows.matrix(np.arange(lo, hi))
    ids, weight, side = rows.id[lo:hi], rows.weight[lo:hi], rows.part[lo:hi]
    a = np.flatnonzero(side == i)
    b = a if i == j else np.flatnonzero(side == j)
    if not len(a) or not len(b):
        return []
    hit = x[a] @ x[b].T >= threshold
    if i == j:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return []
    filters = [rows.own(k) for k in range(lo, hi)]
    new = hit & ~_shared([filters[k] for k in a], [filters[k] for k in b], f)
    links = np.zeros(hi - lo, dtype=np.int64)
    links[a] += new @ weight[b]
    if i != j:
        links[b] += new.T @ weight[a]
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(hit, label[b][None, :], big).min(axis=1))
        label[b] = np.minimum(label[b], np.where(hit, label[a][:, None], big).min(axis=0))
        if (label == before).all():
            break
    linked = np.zeros(hi - lo, dtype=bool)
    linked[a] |= hit.any(axis=1)
    linked[b] |= hit.any(axis=0)
    return [(int(ids[k]), int(links[k]), int(label[k])) for k in np.flatnonzero(linked)]


def _linked(rows: _Rows, threshold: float) -> list[tuple[int, int, int]]:
    """What all units of some rows give; whole filters of a few vectors are multiplied together, those of one size at a time."""
    out: list[tuple[int, int, int]] = []
    few: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for lo, hi in rows.units():
        if hi - lo > FEW or rows.i[lo] != rows.j[lo]:
            out += _compare(rows, lo, hi, threshold)
        elif hi - lo > 1:
            few.setdefault((hi - lo, int(rows.at[lo + 1] - rows.at[lo])), []).append((lo, hi))
    for (m, d), units in few.items():
        step = max(1, (1 << 19) // (m * max(m, d)))
        for k in range(0, len(units), step):
            out += _small(rows, units[k : k + step], threshold)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding)."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    kept = e if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else e.cast("array<double>")  # as short as they came
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    kind = rows.schema["embedding"].dataType.simpleString()
    good = rows.where("fine").drop("fine").withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind[6:-1])))  # -0.0 is 0.0
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    sizes = {r.d: r.n for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS + 1).collect()}
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    fits = {d: fitted(d, n, threshold) for d, n in sizes.items()}

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: dict[int, CapFilters] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_096):
                b = batch.slice(lo, 4_096)
                x, at = _flat(b.column(2))
                lengths = np.diff(at)
                for d in np.unique(lengths).tolist():
                    some = np.flatnonzero(lengths == d)
                    f = made.setdefault(d, CapFilters(d, sizes[d], **fits[d]))
                    for k in range(0, len(some), f.step):
                        part = some[k : k + f.step]
                        found = f.decode(unit(x[at[part][:, None] + np.arange(d)[None, :]]))
                        ends = np.concatenate([[0], np.cumsum([len(v) for v in found])]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(part)) for c in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["class", "weight", "embedding", "filters"])

    decoded = written(classes.select("class", "weight", "embedding").mapInArrow(decode, f"class long, weight long, embedding {kind}, filters array<long>"), "vector-filters")
    held = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().where(F.col("count") > 1).withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    # units are made of numbers alone; vectors are fetched by class and travel once, to where they are compared
    placed = decoded.select(F.explode("filters").alias("filter"), "class").join(held, "filter").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("filter", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class").join(decoded, "class").select("filter", "i", "j", "part", "class", "weight", "embedding", "filters")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_048):
                part = batch.slice(lo, 2_048)
                held = part if held is None else pa.concat_batches([held, part])
                last = _Rows(held).units()[-1][0]  # this unit may go on
                if last:
                    if found := _linked(_Rows(held.slice(0, last)), threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["class", "links", "label"])
                    held = held.slice(last)
        if held is not None and (found := _linked(_Rows(held), threshold)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["class", "links", "label"])

    found = written(placed.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j").mapInArrow(compare, "class long, links long, label long"), "vector-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select("class", "label"), "class", "label").withColumnRenamed("node", "class")
    known = classes.join(links, "class", "left").join(parts, "class", "left")
    known = known.select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = good.join(known, "embedding").select("vec_id", "n_links", "component_id").unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: links and components of all vectors by cosine >= 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links,
  least(m.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = m.vec_id), m.vec_id)) AS component_id,
  m.vec_id = least(m.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = m.vec_id), m.vec_id)) AS kept
FROM embeddings m
"""
