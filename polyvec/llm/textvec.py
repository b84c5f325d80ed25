"""Vectorised text kernels on Arrow string arrays (numpy only, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_POW = np.power(U64(0x9E3779B97F4A7C15 | 1), np.arange(256, dtype=U64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets starting at 0; a null counts as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column, prefixes: tuple[int, ...] = ()) -> tuple:
    """(64-bit hash of each lower-cased word, its document's position, byte at which it starts).

    A word is a run of letters and digits; every other ASCII sign separates. A Han, kana or
    Hangul sign opens a word of its own, as those scripts have no blanks. For each length in
    prefixes one more array: the hash of the word's first so many bytes, 0 for words no longer.
    """
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, offsets = utf8(lower)
    none = np.zeros(0, np.int64)
    empty = (none.astype(U64), none, none, *(none.astype(U64) for _ in prefixes))
    if not len(data):
        return empty
    inside = _WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | ((data[1:] >= 0xE3) & (data[1:] <= 0xED))
    edges = offsets[:-1][offsets[:-1] < len(data)]
    opens[edges] = inside[edges]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    starts = np.flatnonzero(opens[at])
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    weighted = (data[at].astype(U64) + U64(1)) * _POW[place & 255]
    salt = U64(0xC2B2AE3D27D4EB4F)
    h = mix64(np.add.reduceat(weighted, starts) ^ (lengths.astype(U64) * salt))
    first = at[starts]
    more = []
    if prefixes:
        total = np.concatenate((np.zeros(1, U64), np.cumsum(weighted)))
        for k in prefixes:
            tag = mix64(np.array([k], U64))
            long = lengths > k
            part = total[np.minimum(starts + k, len(at))] - total[starts]
            more.append(np.where(long, mix64(part ^ tag), U64(0)))
    return (h, np.searchsorted(offsets, first, side="right") - 1, first, *more)


def _release() -> None:
    """Gives memory that is free back to the system: a worker lives on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps its free memory


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000):
    """The batch in consecutive pieces of about most_bytes of text (one text at least), so that
    the working memory of a kernel doesn't depend on the batch size or on text lengths."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    _release()


def resident(name: str, make):
    """An object that a Python worker keeps between tasks (models, caches): made at first use."""
    import sys
    import types

    keep = sys.modules.setdefault("_polyvec_resident", types.ModuleType("_polyvec_resident")).__dict__
    if name not in keep:
        keep[name] = make()
    return keep[name]
