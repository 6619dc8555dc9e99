"""N-gram Jaccard join by grouped prefixes.

A document is its set of 64-bit hashes of word shingles. Two sets with a Jaccard similarity of t share one of their first
n - ceil(t * n) + 1 elements in any order that holds for all sets; the order here is by hash, with elements that many documents have at the
end. Documents with equal sets are one class; classes of equal size and prefix are one group, and groups that share a prefix element are
candidates where sizes and places in the prefixes allow the similarity (exactly: a pair passes at its first common element). Group pairs are
expanded to members. Each class carries a sketch, one bit for each of n or more buckets: whether the bucket holds an odd number of its
elements. Sketches of two sets differ in at most as many bits as the sets have elements of their own, so that a pair whose sketches differ in
too many is none; the others are verified on the whole sets.

Only what connects matters for component_id, so dense neighbourhoods aren't verified pair by pair: of an element that more than `SMALL` groups
share, and of a large group, members are first verified against a few leaders; a round follows against the groups with the most links, and at
last all that still lie in different components are compared by their sketches, in blocks, and verified. No link between components is lost, and
pairs inside one are never listed. These rounds are joins on (element, stretch of sizes), whose larger side Spark may cut wherever it is skewed; the postings of
frequent elements are salted, so that no task holds those of one element.

Which elements count as frequent changes the order alone, never the result: a first pass counts the shingles that prefixes can begin with (and of
others those that come up often in a chunk of input) and keeps the `FREQUENT` most frequent ones, a bounded table that is broadcast.

Edge cases: null texts and texts without words have empty sets and link with nothing; texts shorter than a shingle are one shingle; very long
texts are one set, held by one worker at a time; rows of one doc_id are one node, with the links of all their texts; rows without doc_id are
their own component (null); an empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, released, rolling, table, text_chunks, words_of, written
from corpusloom.llm.graph import components

#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 90
SHINGLE = 3
FREQUENT = 200_000
#: A frequent shingle is one from so many documents on. Those of the least hashes, this many times a prefix's share of a set, are counted exactly;
#: others in chunks where at least IN_CHUNK documents have them.
IN_CHUNK, FREQUENT_FROM, COUNTED = 3, 33, 1.5
#: Groups that share an element and are compared all with all, and parts that the postings of a frequent element are dealt to.
SMALL, SALTS = 32, 64
#: Leaders of a stretch of sizes in the first and in the second round; pairs that are made at a time; pairs that one set is compared in.
LEADERS, MORE_LEADERS, BLOCK, CHUNK = 2, 8, 1 << 17, 128
#: Groups of more members send their leads alone in the first round.
LARGE = 8
BROADCAST_IDS = 1_000_000
#: Bytes of text that are made into sets at a time.
BYTES = 1_000_000


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, first = words_of(texts, lower=True)
    rolled = rolling(hashes, width)
    ends = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    return [np.unique(rolled[a : b - width + 1]) if b - a >= width else rolling(hashes[a:b], b - a) if b > a else rolled[:0] for a, b in ends]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def in_order(elements: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set in the order of prefixes, frequent elements at the end, and the number of the others."""
    at = np.minimum(np.searchsorted(frequent, elements), max(len(frequent) - 1, 0))
    often = frequent[at] == elements if len(frequent) else np.zeros(len(elements), dtype=bool)
    return np.concatenate([elements[~often], elements[often]]), int((~often).sum())


def sketch(elements: np.ndarray) -> bytes:
    """A bit for each of 64 * 2**k >= n buckets: whether an odd number of the elements falls into it."""
    bits = max(64, 1 << max(len(elements) - 1, 0).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """Whether sets of these sketches and sizes may be similar enough. The larger sketch is folded to the buckets of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    apart = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    return apart * (100 + percent) <= (n_a + n_b) * (100 - percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def frequent_shingles(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """At most FREQUENT hashes, sorted. What prefixes begin with has small hashes, and is counted whole at every size of the table."""
    below = np.uint64(min(2**64 - 1, int(2**64 * COUNTED * (100 - percent) / 100)))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (texts,) in text_chunks(batches, (), limit=4_000_000):
            part, n = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_sets([t or b"" for t in texts], width)]), return_counts=True)
            n[(n < IN_CHUNK) & (part > below)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(_signed(part[n > 0])), pa.array(n[n > 0].astype(np.int32))], ["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    return np.sort(counted.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))


def signatures(docs: DataFrame, frequent: np.ndarray, width: int, percent: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys` (long columns), n (set size), digest (of the set), group (digest of size and prefix), prefix (bytes: the number of elements that
    aren't frequent, elements), sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    digest_of = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    names = [*keys, "n", "digest", "group", "prefix", "sketch"]

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for *own, texts in text_chunks(batches, keys, limit=BYTES):
            rows = []
            for s in shingle_sets([t or b"" for t in texts], width):
                ordered, rare = in_order(s, shared.value)
                prefix = np.array([rare], dtype=np.uint64).tobytes() + ordered[: prefix_size(len(s), percent) if len(s) else 0].tobytes()
                rows.append((len(s), digest_of(s.tobytes()), digest_of(len(s).to_bytes(8, "little") + prefix), prefix, sketch(s)))
            n, *binary = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in own), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in binary)], names)

    return docs.select(*keys, "text").mapInArrow(sign, ", ".join(f"{c} {'long' if c in (*keys, 'n') else 'binary'}" for c in names))


def _postings(prefixes: DataFrame) -> DataFrame:
    """group_id, n, pos, element, salt for each element of each prefix; salt is 0 for elements that aren't frequent."""
    names = ["group_id", "n", "pos", "element", "salt"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [np.frombuffer(x, dtype=np.int64) for x in part.column(2).to_pylist()]
                size = [len(x) - 1 for x in found]
                group = np.repeat(part.column(0).to_numpy(), size)
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
                often = pos >= np.repeat([int(x[0]) for x in found], size)
                salt = np.where(often, 1 + group % SALTS, 0).astype(np.int32)
                n = np.repeat(part.column(1).to_numpy(), size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, n, pos, np.concatenate([x[1:] for x in found]), salt)], names)

    return prefixes.select("group_id", "n", "prefix").mapInArrow(run, "group_id long, n int, pos int, element long, salt int")


def _fits(n_a: np.ndarray, pos_a: np.ndarray, n_b: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets, whose first common element stands at pos, can be similar enough."""
    return (100 + percent) * np.minimum(n_a - pos_a, n_b - pos_b) >= percent * (n_a + n_b)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """kind 0: a pair (a, b) of the few groups that share an element. kind 1: a posting of any other element, as (a, element, n, pos)."""
    names = ["kind", "a", "b", "n", "pos"]

    def told(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, pos: np.ndarray | None = None):  # noqa: ANN202
        import pyarrow as pa

        zero = np.zeros(len(a), dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (zero + np.int32(kind), a, b, zero if n is None else n, zero if pos is None else pos)], names)

    def of_elements(rows: list[np.ndarray]) -> Iterator:
        element, salt, who, n, pos = rows
        at = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        m = np.diff(np.append(at, len(element)))
        dense = (m > SMALL) | (salt[at] > 0)
        out = np.repeat(dense, m)
        if out.any():
            yield told(1, who[out], element[out], n[out], pos[out])
        for k in np.unique(m[~dense & (m > 1)]).tolist():  # all elements that k groups share at a time
            heads, (i, j) = at[~dense & (m == k)], np.triu_indices(k, 1)
            step = max(1, BLOCK // len(i))
            for lo in range(0, len(heads), step):
                a, b = ((heads[lo : lo + step, None] + x[None, :]).ravel() for x in (i, j))
                ok = _fits(n[a].astype(np.int64), pos[a], n[b].astype(np.int64), pos[b], percent)
                a, b = who[a[ok]], who[b[ok]]
                if len(a):
                    yield told(0, np.minimum(a, b), np.maximum(a, b))

    def run(batches: Iterator) -> Iterator:
        held: list[np.ndarray] | None = None
        for b in batches:
            rows = [b.column(i).to_numpy() for i in range(5)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))  # the last element may go on
            if rows[1][-1] > 0 and cut == 0:
                cut = len(rows[0])  # a salted one goes through as it comes
            held = [x[cut:] for x in rows]
            if cut:
                yield from of_elements([x[:cut] for x in rows])
        if held is not None and len(held[0]):
            yield from of_elements(held)
        released()

    dealt = postings.select("element", "salt", "group_id", "n", "pos").repartition("element", "salt").sortWithinPartitions("element", "salt")
    return dealt.mapInArrow(run, "kind int, a long, b long, n int, pos int")


def _allows(percent: int) -> Column:
    """`_fits` for columns x_n, x_pos, y_n, y_pos."""
    most = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")).cast("long")
    return (100 + percent) * most >= percent * (F.col("x_n") + F.col("y_n")).cast("long")


def _stretch(percent: int) -> Column:
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(min(percent, 99) / 100))).cast("int")


def _sides(df: DataFrame, side: str, near: tuple[int, ...] = ()) -> DataFrame:
    """Columns with a side's mark; `near`: a row for each stretch of sizes that far from its own. All similar sizes are in (-1, 0, 1)."""
    if near:
        df = df.withColumn("stretch", F.explode(F.array(*(F.col("stretch") + k for k in near))))
    return df.select(*(c if c in ("element", "stretch") else F.col(c).alias(f"{side}_{c}") for c in df.columns))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _with_leaders(dense: DataFrame, leaders: int, near: tuple[int, ...], apart: Column, percent: int) -> DataFrame:
    """Pairs of groups: each posting of a dense element (with `score`) with the leaders of its element that have about its size."""
    bucket = F.pmod(F.xxhash64("group_id"), F.lit(leaders))
    best = F.max(F.struct("score", *(c for c in dense.columns if c not in ("score", "element", "stretch"))))
    heads = dense.groupBy("element", "stretch", bucket.alias("bucket")).agg(best.alias("r")).select("element", "stretch", "r.*").drop("score")
    found = _sides(dense.drop("score"), "x").join(_sides(heads, "y", near), ["element", "stretch"])
    return found.where((F.col("x_group_id") != F.col("y_group_id")) & apart & _allows(percent)).select(*_pair("x_group_id", "y_group_id")).distinct()


def _sketched(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, sketches as rows of words) for each length."""
    size = np.array([len(x) for x in sketches])
    found = [(np.flatnonzero(size == k), k) for k in np.unique(size).tolist()]
    return [(at, np.frombuffer(b"".join(sketches[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), k // 8)) for at, k in found]


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits each of x differs from each of y, where the larger of two sketches is folded as in `possible`."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    of_x, of_y = _sketched(x), _sketched(y)
    for at, a in of_x:
        for to, b in of_y:
            width = min(a.shape[1], b.shape[1])
            left, right = _folded(a, width), _folded(b, width)
            step = max(1, BLOCK * 4 // (len(left) * width))
            for lo in range(0, len(right), step):
                out[np.ix_(at, to[lo : lo + step])] = np.bitwise_count(left[:, None, :] ^ right[None, lo : lo + step, :]).sum(axis=2, dtype=np.int64)
    return out


def _across(dense: DataFrame, labelled: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that share a dense element or a group, lie in different components, and may be similar by sizes, places and
    sketches: of each element, all that is outside its largest component with all that is not of its own. About `CHUNK` rows from outside are a
    block, which one task holds while the element's other rows pass by, so that pairs that sketches turn down are compared, but never rows."""
    own = labelled.where("members > 1").select(F.col("group_id").alias("element"), _stretch(percent).alias("stretch"), "class", "component", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    rows = dense.join(labelled.select("group_id", "class", "component"), "group_id").select(*own.columns).unionByName(own)
    rows = written(rows.join(sketches.select("class", "sketch"), "class"), "shingle-dense")
    sizes = rows.groupBy("element", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("element").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    rows = rows.join(largest, "element").withColumn("inside", F.col("component") == F.col("main")).drop("main")
    outside = rows.where("not inside").withColumn("stretch", F.explode(F.array(*(F.col("stretch") + k for k in (-1, 0, 1)))))
    parts = outside.groupBy("element", "stretch").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    part = {"x": F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    names = ["element", "stretch", "part", "side", "class", "component", "n", "pos", "inside", "sketch"]
    x, y = (df.join(parts, ["element", "stretch"]).withColumn("part", part[side]).withColumn("side", F.lit(int(side == "y"))).select(names) for side, df in (("x", outside), ("y", rows)))

    def pairs(x: list, y: list):  # noqa: ANN202
        import pyarrow as pa

        (c, k, n, p), (d, m, o, q), inside = ([v[:, None] for v in x[:4]], [v[None, :] for v in y[:4]], y[4][None, :])
        ok = (k != m) & (inside | (c < d)) & _fits(n, p, o, q, percent)
        ok[ok] = (_apart(x[5], y[5]) * (100 + percent) <= (n + o) * (100 - percent))[ok] if ok.any() else False
        i, j = np.nonzero(ok)
        a, b = x[0][i], y[0][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def compare(batches: Iterator) -> Iterator:
        key, block = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                b = batch.slice(lo, 1_000)
                keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])
                values = [*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64 if i < 8 else bool) for i in range(4, 9)), b.column(9).to_pylist()]
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    run = [v[s:e] for v in values]
                    if (now := tuple(keys[:3, s].tolist())) != key:
                        key, block = now, []
                    if keys[3, s]:
                        if block and (found := pairs(block, run)).num_rows:
                            yield found
                    else:  # a block may come in two batches
                        block = [*(np.concatenate(v) for v in zip(block[:5], run[:5], strict=True)), block[5] + run[5]] if block else run
        released()

    return x.unionByName(y).repartition("element", "stretch", "part").sortWithinPartitions("element", "stretch", "part", "side").mapInArrow(compare, "a long, b long").distinct()


def _expanded(pairs: DataFrame, members: DataFrame, keep: Column) -> DataFrame:
    """Pairs of classes of group pairs; `members` has group_id, class and what `keep` asks for (as x_* and y_*)."""
    x, y = (members.select(*(F.col(c).alias(f"{side}_{c}") for c in members.columns)) for side in ("x", "y"))
    found = pairs.join(x, F.col("a") == F.col("x_group_id")).join(y, F.col("b") == F.col("y_group_id"))
    return found.where(keep & (F.col("x_class") != F.col("y_class"))).select(*_pair("x_class", "y_class")).distinct()


def _checked(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The class pairs (a, b) that their sketches allow."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                n_a, n_b, s_a, s_b = (part.column(k).to_pylist() for k in (2, 3, 4, 5))
                ok = pa.array([possible(x, n, y, m, percent) for n, m, x, y in zip(n_a, n_b, s_a, s_b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    x, y = (sketches.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class and elements (the whole set, as bytes) of the classes in `pairs`, made from the text of one document of each. While these are at
    most BROADCAST_IDS (counted), their ids are broadcast, so that texts stay where they are; beyond, both sides are shuffled."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = written(classes.join(asked, "class", "left_semi").select("class", "digest", F.col("rep").alias("doc_id")), "shingle-ids")
    ids = wanted.select("doc_id").distinct()
    side = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids.hint("merge")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for own, texts in text_chunks(batches, limit=BYTES):
            sets = [s.tobytes() for s in shingle_sets([t or b"" for t in texts], width)]
            digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "elements"])

    made = docs.join(side, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, elements binary")
    return made.dropDuplicates(["doc_id", "digest"]).join(wanted, ["doc_id", "digest"]).select("class", "elements")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The class pairs (a, b) that are similar. The set of a goes once to each `CHUNK` of its pairs, that of b with the pair."""
    counts = pairs.groupBy("a").count().withColumn("parts", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    right = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(sets.withColumnRenamed("class", "b"), "b")
    left = counts.join(sets.withColumnRenamed("class", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "elements")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, own = None, None
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                part_of = batch.slice(lo, 64)
                for a, part, b, elements in zip(*(part_of.column(i).to_pylist() for i in range(4)), strict=True):
                    mine = np.frombuffer(elements, dtype=np.uint64)
                    if b is None:
                        key, own = (a, part), mine
                    elif key == (a, part) and own is not None and similar(own, mine, percent):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        released()

    rows = left.unionByName(right.select("a", "part", "b", "elements"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(compare, "a long, b long")


def class_components(docs: DataFrame, signed: DataFrame, width: int, percent: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """class, digest, rep (least doc_id), component (a class, least of those that links lead to) for each distinct set of documents with a
    doc_id. `docs` has long doc_id and string text, `signed` their signatures. `more` makes further links from (class, digest)."""
    full = signed.where("n > 0 and doc_id is not null")
    whole = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("group").alias("group"), F.first("sketch").alias("sketch"))
    classes = written(whole.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")  # written, so that the numbers stay
    groups = classes.groupBy("group").agg(F.min("class").alias("group_id"), F.count(F.lit(1)).alias("members"))
    members = written(classes.select("class", "n", "group", "digest", "rep").join(groups, "group"), "shingle-groups")
    # sets of fewer than 9 elements have no similar ones but equal ones at 0.9, and so on
    least = -(-percent // (100 - percent)) if percent < 100 else 2**62
    heads = members.where((F.col("class") == F.col("group_id")) & (F.col("n") >= least)).select(F.col("rep").alias("doc_id"), "digest", "group_id")
    prefixes = full.select("doc_id", "digest", "n", "prefix").join(heads, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    first = written(_candidates(_postings(prefixes), percent), "shingle-candidates")
    dense = first.where("kind = 1").select(F.col("a").alias("group_id"), F.col("b").alias("element"), "n", "pos").withColumn("stretch", _stretch(percent))
    members, sketches = members.drop("group", "digest", "rep"), classes.select("class", "n", "sketch")

    def linked(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """What is left of class pairs by their sketches, and the links among them."""
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        fresh = written(_checked(fresh, sketches, percent), "shingle-pairs")
        return fresh, written(_verified(fresh, _sets(docs, fresh, classes, width), percent), "shingle-links")

    inside = members.where("members > 1").select(F.col("group_id").alias("a"), F.col("group_id").alias("b")).distinct()
    started = _with_leaders(dense.withColumn("score", F.xxhash64("group_id", F.lit(1))), LEADERS, (0, 1), F.lit(True), percent)
    pairs = first.where("kind = 0").select("a", "b").distinct().unionByName(started)
    few = (F.col("x_members") <= LARGE) & (F.col("y_members") <= LARGE)
    lead = (F.col("x_class") == F.col("x_group_id")) & (F.col("y_class") == F.col("y_group_id"))
    to_lead = (F.col("a") == F.col("b")) & (F.col("x_class") == F.col("x_group_id"))
    tried, links = linked(_expanded(pairs.unionByName(inside), members.drop("n"), few | lead | to_lead), None)
    if more is not None:
        links = links.unionByName(more(classes))
    parts = _parts(links)
    for leaders in (MORE_LEADERS, 0):  # between components alone: the groups with the most links, then all that is left
        labelled = members.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
        keep = F.col("x_component") != F.col("y_component")
        if leaders:
            degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").count()
            whole = labelled.join(degree, "class", "left").groupBy("group_id").agg(F.min("component").alias("label"), (F.min("component") != F.max("component")).cast("int").alias("mixed"), F.coalesce(F.max("count"), F.lit(0)).alias("score"))
            apart = (F.col("x_label") != F.col("y_label")) | (F.col("x_mixed") > 0) | (F.col("y_mixed") > 0)
            open_ = _expanded(_with_leaders(dense.join(whole, "group_id"), leaders, (-1, 0, 1), apart, percent), labelled.select("group_id", "class", "component"), lead & keep)
        else:
            open_ = _across(dense, labelled, sketches, percent)
            if members.where(F.col("members") > LARGE).limit(1).count():  # of large groups, pairs of the first round went by their leads alone
                many = labelled.where("members > 1").select(F.col("group_id").alias("g")).distinct()
                small = first.where("kind = 0").select("a", "b").join(many, (F.col("a") == F.col("g")) | (F.col("b") == F.col("g")), "left_semi").distinct()
                open_ = open_.unionByName(_expanded(small, labelled.select("group_id", "class", "component"), keep)).distinct()
        found, fresh = linked(open_, tried)
        if fresh.limit(1).count():
            tried, links = tried.unionByName(found), links.unionByName(fresh)
            parts = _parts(links)
    return classes.select("class", "digest", "rep").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _parts(links: DataFrame) -> DataFrame:
    return written(components(links, "a", "b").select(F.col("node").alias("class"), "component"), "shingle-parts")


def similar_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, frequent_shingles(docs, width, percent), width, percent), "shingle-signatures")
    own = signed.where("n > 0 and doc_id is not null").select("doc_id", "digest")
    twice = written(own.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("doc_id"), "shingle-twice", 1)

    def of_one_id(classes: DataFrame) -> DataFrame:
        """Links between the classes that rows of one doc_id are in."""
        named = own.join(twice, "doc_id", "left_semi").join(classes.select("class", "digest"), "digest").select("doc_id", "class")
        return named.join(named.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("class != a").select("a", F.col("class").alias("b")).distinct()

    repeated = twice.limit(1).count() > 0
    found = written(class_components(docs, signed, width, percent, of_one_id if repeated else None), "shingle-components")
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = found.join(least, "component").select("digest", "component_id")
    empty = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = signed.where("n > 0 and doc_id is not null").join(ids, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    if repeated:  # an empty text of an id that has other texts is of their component
        known = full.join(twice.unionByName(empty.select("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c"))
        empty = empty.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return full.unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: doc_id, n_shingles, component_id of every document."""
    return similar_components(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one row, that of the smallest
    doc_id, then of the smallest hash of the text; rows without doc_id come last and yield to any with one. Of rows that agree in doc_id and
    text one stays. Rows without words are no copies of one another and stay."""
    id_, text = docs["doc_id"], docs["text"].cast("string")
    rows = docs.select(id_.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    keys = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("doc_id").isNull().cast("long").alias("without"), "text_hash", "text")
    width, percent = 5, 80
    signed = written(signatures(keys, frequent_shingles(keys, width, percent), width, percent, ("id_", "without", "text_hash")), "shingle-signatures")
    # class_components finds one document of a class by doc_id (and set): rows without one are found by the hash of their text
    found_by = signed.withColumn("doc_id", F.when(F.col("without") > 0, F.col("text_hash")).otherwise(F.col("id_")))
    by_text = written(class_components(rows.select(F.coalesce("doc_id", "text_hash").alias("doc_id"), "text"), found_by, width, percent).select("digest", "component"), "shingle-components")
    mine = F.struct("without", "id_", "text_hash")
    full = signed.where("n > 0").join(by_text, "digest").select("component", mine.alias("own"))
    best = full.groupBy("component").agg(F.min("own").alias("best"))
    gone = written(full.join(best, "component").where("own != best").select("own.*").distinct(), "shingle-losers")
    again = written(signed.where("n > 0").groupBy("without", "id_", "text_hash").count().where("count > 1").drop("count").join(gone, ["without", "id_", "text_hash"], "left_anti"), "shingle-repeats")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df.hint("merge")

    def matches(df: DataFrame, side: DataFrame) -> Column:
        return (F.coalesce(df["doc_id"].cast("long"), F.lit(0)) == side["id_"]) & (df["doc_id"].isNull().cast("long") == side["without"]) & (F.xxhash64(df["text"].cast("string")) == side["text_hash"])

    lost = small(gone)
    kept = docs.join(lost, matches(docs, lost), "left_anti")
    if again.limit(1).count():
        twice = small(again)
        name = free_name(docs, "text_hash")
        once = kept.join(twice, matches(kept, twice), "left_semi").withColumn(name, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", name]).drop(name)
        kept = kept.join(twice, matches(kept, twice), "left_anti").unionByName(once)
    return kept.select(*docs.columns)
