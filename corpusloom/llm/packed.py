"""Packed exchange: numpy arrays cross a shuffle as one compressed binary for each chunk of input and hash cell."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator

import numpy as np

from corpusloom.llm.common import released


_own = threading.local()


def _zstd() -> tuple:
    """This thread's compressor and decompressor: to make them takes longer than a small message."""
    if not hasattr(_own, "both"):
        import zstandard

        _own.both = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _own.both


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary. Integers of 4 and 8 bytes go by the weight of their bytes: the high bytes of small values compress to nothing."""
    head = np.array([len(arrays), *(v for a in arrays for v in (np.dtype(a.dtype).num, len(a)))], dtype=np.int64)
    return _zstd()[0].compress(head.tobytes() + b"".join(_planes(a).tobytes() for a in arrays))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = _zstd()[1].decompress(payload)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for num, length in head.reshape(n, 2).tolist():
        kind = _KINDS[num]
        flat = np.frombuffer(raw, dtype=np.uint8, count=length * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, length).T).view(kind).ravel() if _wide(kind) else flat.view(kind))
        at += length * kind.itemsize
    return out


_KINDS = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.int16, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}


def _wide(kind: np.dtype) -> bool:
    return kind.kind in "iu" and kind.itemsize >= 4


def _planes(a: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T) if _wide(a.dtype) and len(a) else a


def narrow(x: np.ndarray) -> np.ndarray:
    """Values from 0 on in the fewest bytes that hold them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def by_cell(cells: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, places in `cells`) for each cell that occurs."""
    order = np.argsort(cells.astype(np.uint16) if n <= 1 << 16 else cells, kind="stable")
    ends = np.searchsorted(cells[order], np.arange(n + 1))
    for c in np.flatnonzero(np.diff(ends)).tolist():
        yield c, order[ends[c] : ends[c + 1]]


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run of each element, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - offsets(lengths)[:-1][run]


def keyed_rows(batches: Iterable, keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches that are sorted by their first `keys` columns; binaries are read a few rows at a time."""
    key, rows = None, []
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns), strict=True):
                if row[:keys] != key:
                    if rows:
                        yield key, rows  # type: ignore[misc]
                    key, rows = row[:keys], []
                rows.append(row)
    if rows:
        yield key, rows  # type: ignore[misc]
    rows = []
    released()
