"""Vectorised text primitives on Arrow string columns.

All of them work on the UTF-8 bytes of a whole chunk of rows at once; nothing loops over characters in Python.
A null text is an empty one here; operators that must tell the two apart filter before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of the rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 8 << 20
U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]

#: ASCII white space, as DuckDB's and Java's ``[ \t\n\x0B\f\r]`` have it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters and digits; every byte of a non-ASCII character counts as a letter.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Neither word nor white space.
PUNCT = ~(SPACE | WORD)


def lean(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives freed memory back to the system after each batch that isn't small: Python workers outlive their tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for b in batches:
                seen += b.nbytes
                yield b

        for b in run(counted()):
            seen += b.nbytes
            yield b
            del b
            if seen > BATCH_BYTES // 4:
                seen = 0
                release()
        release()

    return go


def batched(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with Arrow batches of at most ``BATCH_BYTES``.

    Batches are bounded by rows and bytes of the session; its default of 64 MB, doubled while it is written and held on both
    sides of the pipe by each core, is more than an executor has to spare. The plan reads the setting when it runs, so it is
    made in the session, and only where the session has none of its own: a value that was set by hand, larger or not, stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(lean(run), schema)


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, an integer, those whose value is not alone; one row is held, however many are alike."""
    held: pa.RecordBatch | None = None
    like = False  # the held row is as the one before it
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        a = np.asarray(b.column(0))
        same = np.zeros(len(a) + 1, bool)
        same[0], same[1:-1] = like, a[1:] == a[:-1]
        held, like = b.slice(len(b) - 1), bool(same[-2])
        yield b.slice(0, len(b) - 1).filter(pa.array((same[1:] | same[:-1])[:-1]))
    if held is not None and like:
        yield held


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 16) * 9 // 8
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(m, b, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, n + 1 offsets into the bytes) for runs of rows of about ``limit`` bytes; a longer row is alone."""
    first = 0
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(arr):
            continue
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        _, at, data = arr.buffers()
        offs = np.frombuffer(at, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield first + i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
        first += len(arr)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never spans two rows."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    full = offs[:-1][np.diff(offs) > 0]
    start[full] = mask[full]
    last = offs[1:][np.diff(offs) > 0] - 1
    end[last] = mask[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def by_row(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n + 1 bounds: the runs of row i are those from bounds[i] to bounds[i + 1]."""
    return np.searchsorted(starts, offs)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each run."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run, from one prefix sum of a polynomial hash."""
    pw, inv = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * inv[starts] ^ (ends - starts).astype(U64))


def hash_rows(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of the sequence of item hashes of each row."""
    pw, inv = powers(len(items) + 1)
    pre = np.zeros(len(items) + 1, U64)
    np.cumsum(items * pw[: len(items)], out=pre[1:])
    a, b = bounds[:-1], bounds[1:]
    return mix((pre[b] - pre[a]) * inv[a] ^ (b - a).astype(U64))


def ngrams(items: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of the n items from each position on; the last n - 1 positions have none."""
    if len(items) < n:
        return np.zeros(0, U64)
    m = len(items) - n + 1
    out = items[:m].copy()
    for k in range(1, n):
        out *= _BASE
        out += items[k : k + m]
    return mix(out)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """The positions from which n items lie within one row."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.flatnonzero(np.arange(len(end)) + n <= end)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def both_cases(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[
    tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
]:
    """``chunks`` with the bytes and offsets of the same rows in lower case."""
    for first, data, offs in chunks(column, limit):
        arr = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(data))
        ((_, low, low_offs),) = chunks(lower(arr), 1 << 62)
        yield first, data, offs, low, low_offs


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the runs of bytes of a kind."""
    s, e = runs(kind[data], offs)
    return s, e, by_row(s, offs)
