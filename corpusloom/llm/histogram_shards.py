"""Sharding by histogram sort, in DataFrame operations only.

Rows get a 192-bit sort key: the 64-bit hash of the text, that of a tie column (doc_id), and a number that is written once with the row, so that
any run of equal keys can be divided; the number tells apart only rows that are alike in both, so that the result doesn't hang on how the input was
dealt. The splitters between shards are found by counting exact bytes below candidate boundaries, all partitions at once: a round counts bytes in the
buckets of the next key digits, but only where a splitter still lies inside, until each splitter is within the tolerance, beside a group that stays
whole, or at a single row. After that the rows are exchanged once. What reaches the driver in a round is bounded by (shards - 1) * 2**digit_bits rows.

Law `bytes`: shard sizes differ by about the tolerance (a share of the ideal shard), by the one row on a splitter, or by a group of equal texts that
holds at most `WHOLE` of the ideal shard: such a group is never divided. Larger groups are, as one may hold more than a shard. Slots follow the leading
bits of the first two key words, then the whole key, at every size; the prefixes that hold over 1/64 of all rows are only numbered in smaller parts.

Edge cases: null texts count 8 bytes and hash as empty ones; very long texts weigh what they weigh; an empty table gives an empty result; repeated
rows are rows of their own; rows without doc_id are one value of the tie; columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, table, written

SHARDS = 24
#: Share of the ideal shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005
#: Share of the ideal shard up to which a group of equal keys stays whole.
WHOLE = 0.05
#: Bits of a key word that a round resolves, and of the second word that part rows for their slots.
DIGITS, SECOND = (12, 13, 13, 13, 13), 8
WORDS = 3


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _digit(word: Column, taken: int, bits: int) -> Column:
    """`bits` bits of a signed word after its first `taken`, in the order of the signed values."""
    ordered = word.bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return F.shiftrightunsigned(ordered, 64 - taken - bits).bitwiseAND(F.lit(2**bits - 1).cast("long"))


def _prefix(word: Column, taken: int) -> Column:
    ordered = word.bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return F.shiftrightunsigned(ordered, 64 - taken)


def _bound(key: int) -> tuple[int, ...]:
    """The words of a key (an integer of 64 * WORDS bits) as signed values; those of the last key where it is past the end."""
    key = min(key, 2 ** (64 * WORDS) - 1)
    return tuple((key >> 64 * (WORDS - 1 - w)) % 2**64 - 2**63 for w in range(WORDS))


def splitters(keyed: DataFrame, words: list[str], size: str, shards: int, tolerance: float, whole: float = WHOLE) -> list[tuple[int, ...]]:
    """Keys of the first row of each shard but the first. Fewer where there are too few rows."""
    total = keyed.agg(F.sum(size)).first()[0] or 0
    ideal = total / shards
    open_ = {k: (k * ideal, 0, 0) for k in range(1, shards)} if total else {}  # target, bytes below the prefix, the prefix of the whole key
    found: dict[int, int] = {}
    for w, word in enumerate(words):
        for i, bits in enumerate(DIGITS):
            if not open_:
                break
            taken = sum(DIGITS[:i])
            prefixes = {p for _, _, p in open_.values()}
            # of a prefix: the words before this one, which are fixed, and the bits of this one
            at = F.struct(*(F.col(c) for c in words[:w]), (_prefix(F.col(word), taken) if taken else F.lit(0).cast("long")).alias("p"))
            split = lambda p, w=w, taken=taken: (*((p >> taken + 64 * (w - 1 - j)) % 2**64 - 2**63 for j in range(w)), p % 2**taken)
            wanted = {split(p): p for p in prefixes}
            rows = keyed
            if w or taken:
                rows = rows.where(at.isin([F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(key, [*words[:w], "p"], strict=True))) for key in wanted]))
            counted = rows.groupBy(at.alias("at"), _digit(F.col(word), taken, bits).alias("d")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
            buckets: dict[int, list] = {}
            for r in counted.collect():
                buckets.setdefault(wanted[tuple(r["at"])], []).append((r.d, r.bytes, r.n))
            left = 64 * (WORDS - w) - taken - bits
            for k, (target, below, p) in list(open_.items()):
                for d, held, n in sorted(buckets[p]):
                    if below + held > target or abs(below + held - target) <= tolerance * ideal:
                        break
                    below += held
                near, far, p = abs(target - below), abs(below + held - target), p << bits | d
                group = w == 0 and taken + bits == 64 and held <= whole * ideal
                if min(near, far) <= tolerance * ideal or n == 1 or group:
                    found[k] = (p if near <= far else p + 1) << left
                    del open_[k]
                else:
                    open_[k] = (target, below, p)
    for k, (_, _, p) in open_.items():
        found[k] = p
    return [_bound(found[k]) for k in sorted(found)]


def histogram_shards(rows: DataFrame, key: str, size: str, shards: int = SHARDS, tolerance: float = TOLERANCE, tie: str | None = None, whole: float = WHOLE) -> DataFrame:
    """`rows` with columns shard (int) and slot (long, gapless from 0 in each shard). `key` and `size` name long columns, `tie` any column."""
    k1, k2, k3, bytes_, p1, p2, g1, g2, part, n, before, row = (free_name(rows, f"hs_{c}") for c in ("k1", "k2", "k3", "bytes", "p1", "p2", "g1", "g2", "part", "n", "before", "row"))
    tied = F.xxhash64(F.col(tie)) if tie else F.lit(0).cast("long")
    keyed = written(rows.withColumns({k1: F.coalesce(F.col(key), F.lit(0)).cast("long"), k2: tied, k3: F.monotonically_increasing_id(), bytes_: F.coalesce(F.col(size), F.lit(0)).cast("long")}), "histogram-sort")
    words = [k1, k2, k3]
    bounds = splitters(keyed, words, bytes_, shards, tolerance, whole)

    def from_on(bound: tuple[int, ...]) -> Column:
        out = F.col(words[-1]) >= bound[-1]
        for w, b in list(zip(words, bound, strict=True))[-2::-1]:
            out = (F.col(w) > b) | ((F.col(w) == b) & out)
        return out

    shard = reduce(lambda x, b: x + F.when(from_on(b), 1).otherwise(0), bounds, F.lit(0)).cast("int")
    first, second = _prefix(F.col(k1), DIGITS[0]), _prefix(F.col(k2), SECOND)
    counts = keyed.groupBy(first.alias("p"), second.alias("q")).count()
    everything = keyed.count()
    heavy = [(r.p, r.q) for r in counts.where(F.col("count") * 64 > everything).collect()]  # fewer than 64
    is_heavy = F.struct(first.alias("p"), second.alias("q")).isin([F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for p, q in heavy]) if heavy else F.lit(False)
    only = lambda c: F.when(is_heavy, c).otherwise(F.lit(0).cast("long"))
    # the parts of a heavy prefix are its distinct keys, and for rows alike the partitions that they came from: the order is that of the others
    dealt = keyed.withColumns({"shard": shard, p1: first, p2: second, g1: only(F.col(k1)), g2: only(F.col(k2)), part: only(F.shiftright(F.col(k3), 33))})
    run = ["shard", p1, p2, g1, g2, part]
    earlier = Window.partitionBy("shard").orderBy(*run[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*run).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    placed = dealt.withColumn(row, F.row_number().over(Window.partitionBy(*run).orderBy(k1, k2, k3)))
    return placed.join(offsets, run).withColumn("slot", (F.col(before) + F.col(row) - 1).cast("long")).select(*rows.columns, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards 0 to 23 under the law `bytes`."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", document_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")
    )
    return histogram_shards(docs, "text_hash", "size", tie="doc_id").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
