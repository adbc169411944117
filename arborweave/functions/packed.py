"""Vectorised k-mer arithmetic on Arrow string columns (numpy, no per-letter Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of the polynomial hash


def letters_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    letters = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return letters[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts or lists of a column have at most `most` letters or items together, or one row: what is made of a slice is of bounded size however many rows a batch has."""
    values = batch.column(column)
    size = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_codes(letters: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value for each window of k letters; exact (5 bits a letter) for letters A-Z and k <= 12.

    Longer windows get a polynomial hash. Length len(letters) - k + 1, or 0.
    """
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    exact = k <= 12
    step = np.uint64(32) if exact else _ODD
    have, width, power = (letters & np.uint8(31) if exact else letters).astype(np.uint64), 1, np.array([step])  # an array wraps silently
    out, done = None, 0
    todo = k
    while todo:
        if todo & 1:
            out = have[:n] if out is None else out[:n] * power + have[done : done + n]
            done += width
        todo >>= 1
        if todo:
            have = have[:-width] * power + have[width:] if len(have) > width else have[:0]
            power = power * power
            width *= 2
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    if len(values) < w:
        return values[:0]
    have, width = values, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = w - width
    return np.minimum(have[: len(values) - w + 1], have[rest : rest + len(values) - w + 1])


def inside(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over the window starts 0..total-k: the window lies within one row."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    ends = offsets[1:-1]
    for back in range(1, k):
        at = ends - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... lengths[i] of them, for all i in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def strings(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The substrings of an ASCII buffer as an Arrow string column."""
    data = letters[spread(starts, lengths)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
