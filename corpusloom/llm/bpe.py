"""Byte-level BPE encoding and decoding by padded numpy matrices.

Texts are cut where a single space stands between two characters that are not white space: the pre-token pattern always begins a match at such
a space, so that each cut piece splits alike wherever it stands. Distinct pieces of a chunk that a bounded cache does not hold are split by the
pattern, bucketed by length and merged together: a row of a bucket's matrix is a pre-token, padded; in every round each row merges its leftmost
pair of minimum rank (found by a hashed pair table), the matrix is compacted, and rows without a pair leave. Pre-tokens of over
`LONG_BYTES` bytes go by a heap, which costs n log n where a row would cost n rounds.

Edge cases: null and empty texts have no tokens; bytes that are not UTF-8 count as U+FFFD; special tokens' strings are ordinary text; very long
texts are encoded whole, one at a time; repeated rows, and rows without doc_id, are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import released, small_batches, table, text_chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG_BYTES = 128
#: Bytes of text that are encoded at a time.
CHUNK = 1_000_000
#: Pieces that a worker keeps with their tokens, while a task runs.
CACHED = 120_000
#: White space as Unicode defines it (Python's own class has four control characters more).
_WS = r"\t-\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
_RUN = re.compile(f"[{_WS}][{_WS}]")
_MARKS = frozenset(".,;:!?|-")
_NONE = np.int64(1 << 40)


class PairTable:
    """left id << 32 | right id -> rank of the joined token, in open addressing with linear probes."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(8, int(2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int64)
        key = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        rank = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slot = self._slot(key)
        while len(key):  # each free slot goes to one of those that want it; the others step on
            free = self.keys[slot] == -1
            chosen, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[chosen], self.ranks[chosen] = key[won], rank[won]
            rest = np.ones(len(key), dtype=bool)
            rest[won] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE where there is no such pair or a side is padding (-1)."""
        shape = left.shape
        key = (left.ravel() << 32) | np.maximum(right.ravel(), 0)
        out = np.full(key.shape, _NONE, dtype=np.int64)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Bpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.ids = {i: i for i in self.tokens}  # one object for each id
        self.comma = {i: f",{i}" for i in self.tokens}
        self.pairs = {self.ranks[t[:i]] << 32 | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.table = PairTable(self.pairs)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pattern = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
        self.pattern = regex.compile(pattern)
        self._spaced: dict[object, dict[str, object]] = {}

    def _matrix(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words whose lengths are of one bucket."""
        width = max(map(len, words))
        ids = np.full((len(words), width), -1, dtype=np.int64)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids[np.arange(width)[None, :] < length[:, None]] = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        out: list[list[int]] = [[] for _ in words]
        who = np.arange(len(words))
        rank = self.table.look_up(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), dtype=np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), _NONE)
            done = best == _NONE
            if done.any():
                left = ids[done]
                kept = left >= 0
                flat, end = list(map(self.ids.__getitem__, left[kept].tolist())), np.cumsum(kept.sum(axis=1)).tolist()
                for k, lo, hi in zip(who[done].tolist(), [0, *end], end, strict=False):
                    out[k] = flat[lo:hi]
            ids, rank, who, at, best = ids[~done], rank[~done], who[~done], at[~done], best[~done]
            if not len(who):
                break
            rows = np.arange(len(who))
            ids[rows, at] = best
            n = ids.shape[1] - 1  # every row loses one place
            take = np.arange(n)[None, :] + (np.arange(n)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            if n < 2:
                rank = rank[:, :0]
                continue
            take = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] > at[:, None])
            rank = np.take_along_axis(rank, take, axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < n - 1)
                rank[rows[ok], side[ok]] = self.table.look_up(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])
        return out

    def _heap(self, word: bytes) -> list[int]:
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (q := self.pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of pre-tokens."""
        out: list[list[int]] = [[] for _ in words]
        buckets: dict[int, list[int]] = {}
        for k, (w, whole) in enumerate(zip(words, map(self.ranks.get, words), strict=True)):
            if whole is not None:
                out[k] = [whole]
            elif len(w) > LONG_BYTES:
                out[k] = self._heap(w)
            elif w:
                buckets.setdefault((len(w) + 3) // 4, []).append(k)
        for at in buckets.values():
            for lo in range(0, len(at), 20_000):
                for k, ids in zip(at[lo : lo + 20_000], self._matrix([words[k] for k in at[lo : lo + 20_000]]), strict=True):
                    out[k] = ids
        return out

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Token ids of texts, each split by the pattern; every distinct pre-token is merged once."""
        split = [self.pre_tokens(p) for p in pieces]
        distinct = list(set(chain.from_iterable(split)))
        ids = dict(zip(distinct, self.encode_words([w.encode() for w in distinct]), strict=True))
        return [tuple(ids[s[0]]) if len(s) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, s))) for s in split]

    def pre_tokens(self, piece: str) -> list[str] | tuple[str, ...]:
        """What the pattern finds; runs of letters, with a mark after them or not, are seen without it."""
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isalpha():
            return (piece,)
        if bare[-1:] in _MARKS and bare[:-1].isalpha():
            return (piece[:-1], bare[-1])
        return self.pattern.findall(piece)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; all but the first have lost the space that they begin with."""
        return _CUT.split(text) if _RUN.search(text) else text.split(" ")

    def encode_texts(self, texts: list[str], make: Callable = tuple) -> list[list]:
        """For each text, make(token ids) of its pieces in order. What `make` gives for pieces after a space is cached."""
        cut = [self.cut(t) if t else [] for t in texts]
        cache = self._spaced.setdefault(make, {})
        new = list({w for c in cut for w in c[1:]} - cache.keys())
        cache.update(zip(new, map(make, self.encode_pieces([f" {w}" for w in new])), strict=True))
        heads = map(make, self.encode_pieces([c[0] for c in cut if c]))
        out = [[next(heads), *map(cache.__getitem__, c[1:])] if c else [] for c in cut]
        if len(cache) > CACHED:  # what came first stays: it is what comes often
            for w in new:
                del cache[w]
        return out

    def decode(self, ids: tuple[int, ...] | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


    def written(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        """The number of ids, each id after a comma, and the bytes they decode to."""
        return len(ids), "".join(map(self.comma.__getitem__, ids)), b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


@contextlib.contextmanager
def _task(coder: Bpe) -> Iterator[Bpe]:
    """A task's time with the coder: without collections, which would only walk millions of small tuples that make no cycles; at the end the worker,
    which may go on to other work, forgets the pieces."""
    gc.disable()
    try:
        yield coder
    finally:
        coder._spaced.clear()
        gc.enable()
        released()


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _strings(texts: list[bytes | None]) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(bpe(path, pattern)) as coder:
            for doc_ids, texts in text_chunks(batches, limit=CHUNK):
                ids = [[i for piece in t for i in piece] for t in coder.encode_texts(_strings(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of encode()'s rows."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [bpe(path, pattern).decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: digests of the ids of every whole text and of the bytes they decode to."""
    path, pattern = _default()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(bpe(path, pattern)) as coder:
            for doc_ids, texts in text_chunks(batches, limit=CHUNK):
                rows = []
                for pieces in coder.encode_texts(_strings(texts), coder.written):
                    n, ids, back = zip(*pieces, strict=True) if pieces else ((), (), ())
                    rows.append((sum(n), hashlib.sha256("".join(ids)[1:].encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()))
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, n_tokens and ids of each document; a null text has none. Rows stay rows, with a doc_id or without."""
    small_batches(spark)
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
