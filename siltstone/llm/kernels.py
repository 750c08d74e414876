"""Vector kernels on byte buffers: gram hashes and sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``data[i : i + k]`` (uint8), by doubling: log2(k) passes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length = _BYTE[data], 1
    out, done = None, 0
    while True:
        if k & length:
            if out is None:
                out, done = power, length
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * _U(pow(_BASE, length, 1 << 64)) + power[done : done + m]
                done += length
        if length * 2 > k:
            return mix64(out[:n])
        power = power[:-length] * _U(pow(_BASE, length, 1 << 64)) + power[length:]
        length *= 2


def first_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For every window ``values[i : i + w]`` the index of its first least value."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at, size = values, np.arange(len(values), dtype=np.int32), 1

    def join(step: int, m: int):
        later = least[step : step + m] < least[:m]
        return np.where(later, least[step : step + m], least[:m]), np.where(later, at[step : step + m], at[:m])

    while size * 2 <= w:
        least, at = join(size, len(least) - size)
        size *= 2
    if size < w:
        least, at = join(w - size, n)
    return at[:n].astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and each row's start (one more than rows); null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


def portions(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column (a longer row is one alone), so that work arrays stay small."""
    _, starts = flat_bytes(batch[column])
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop
