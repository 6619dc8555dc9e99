"""Shared ground of the training-data operators: tables in the shared folder and vectorised word hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000
BLOCK_BYTES = 1_000_000


#: Arrow batches are small on either side of the workers' pipes: a worker's memory then follows what it works on.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCHES in a session that has larger ones; a query's last step runs when its caller asks for rows, so that this can't be undone here."""
    for name, value in BATCHES.items():
        if int(re.sub(r"\D", "", spark.conf.get(name)) or 0) > int(value):
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset: a temporary one in local mode, an error on a cluster,
    whose executors would not see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark's own setting while a table is written: its shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, partitions: int | None = None) -> DataFrame:
    """Cuts lineage: writes `df` to the shared folder (removed when the driver ends, or by `dropped`) and reads it back. What was shuffled for
    it is freed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    small_batches(spark)
    before = spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true")
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, where nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or where the table has such a column, that with marks behind it until it has none."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_cells(spark: SparkSession) -> int:
    """Hash cells that packed exchanges are dealt to: they follow the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- words and hashes over byte buffers -------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= BLOCK_BYTES + BLOCK_BYTES // 4:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a sum counts for every bit of the hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` consecutive values (mod 2**64, order counts)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:-width]) * _power(_BASE_INVERSE, n) + np.uint64(width))


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20, 0x09-0x0D) of UTF-8 texts: 64-bit hashes, starts and ends in the texts joined by a newline, and
    the first word's index of each text with the number of words as last entry. Texts are hashed in blocks, as the sums take 8 bytes a byte."""
    blocks, size = [[0, 0]], 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            blocks.append([k, k])
            size = 0
        size += len(t)
        blocks[-1][1] = k + 1
    if len(blocks) > 1:
        parts = [words_of(texts[lo:hi], lower) for lo, hi in blocks]
        chars = np.cumsum([0] + [sum(map(len, texts[lo:hi])) + hi - lo for lo, hi in blocks])
        words = np.cumsum([0] + [len(p[0]) for p in parts])
        first = [p[3][:-1] + w for p, w in zip(parts, words, strict=False)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + c for p, c in zip(parts, chars, strict=False)]), np.concatenate([p[2] + c for p, c in zip(parts, chars, strict=False)]), np.append(np.concatenate(first), words[-1])
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _SPACE[joined]
    edge = space[1:] != space[:-1]
    at = np.flatnonzero(edge) + 1
    starts, ends = at[0::2], at[1::2]
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * _power(_BASE, len(joined)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_BASE_INVERSE, len(joined))[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)]) + 1
    return hashes, starts - 1, ends - 1, np.searchsorted(starts, bounds)


def text_chunks(batches: Iterable, columns: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[list, ...]]:
    """Arrow batches as chunks of about `limit` bytes: lists of the named columns, then the texts as bytes (null as None)."""
    import pyarrow as pa

    held: list[list] = [[] for _ in (*columns, text)]
    size = 0
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in (*columns, text)]
        for part, n in _slices(batch, at[-1], limit):
            for column, k in zip(held, at, strict=True):
                values = part.column(k)
                column += (values.cast(pa.binary()) if k == at[-1] else values).to_pylist()
            size += n
            if size >= limit:
                yield tuple(held)
                held, size = [[] for _ in held], 0
    if held[0]:
        yield tuple(held)
    released()


def released() -> None:
    """Gives memory that is free back to the system: a worker goes on to other tasks, and its heap would stay at its largest."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _slices(batch, at: int, limit: int) -> Iterator[tuple]:  # noqa: ANN001
    """(slice of an Arrow batch, bytes of its texts): up to the row that fills `limit`, so that a batch is never held as Python objects at once."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = min(int(np.searchsorted(ends, before + limit)) + 1, batch.num_rows)
        yield batch.slice(lo, hi - lo), int(ends[hi - 1]) - before
        lo, before = hi, int(ends[hi - 1])
