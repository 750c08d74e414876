"""Content-defined chunking by a gear hash with normalised cut masks (FastCDC).

Written from the published description: a rolling sum of table entries, shifted
by one bit a byte; no cut before ``least`` bytes; a stricter mask up to the
average size and a looser one behind it; a forced cut at ``most``. The gear
table is made from splitmix64, so cuts agree between runs and machines but not
with other implementations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.functions.addresses import SPLITMIX


def _gear() -> list[int]:
    out, state = [], 0
    for _ in range(256):
        state = (state + SPLITMIX[0]) % (1 << 64)
        z = (state ^ (state >> 30)) * SPLITMIX[1] % (1 << 64)
        z = (z ^ (z >> 27)) * SPLITMIX[2] % (1 << 64)
        out.append(z ^ (z >> 31))
    return out


_GEAR = np.array(_gear(), np.uint64)


def gear_sums(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: what 64 shifts leave of the entries before it, by doubling."""
    out, span = _GEAR[data], 1
    while span < 64:
        before = np.zeros_like(out)
        before[span:] = out[:-span] << np.uint64(span)
        out = out + before
        span *= 2
    return out


def cuts(data: bytes, average: int, least: int, most: int) -> list[int]:
    """Where chunks end."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    bits = max(1, average.bit_length() - 1)
    mask = lambda n: np.uint64(((1 << n) - 1) << (64 - n))
    sums = gear_sums(raw)
    strict, loose = np.flatnonzero((sums & mask(bits + 2)) == 0), np.flatnonzero((sums & mask(bits - 2 or 1)) == 0)
    out, start = [], 0
    while len(raw) - start > least:
        middle, end = min(start + average, len(raw)), min(start + most, len(raw))
        i = np.searchsorted(strict, start + least)
        if i < len(strict) and strict[i] < middle:
            cut = int(strict[i]) + 1
        else:
            i = np.searchsorted(loose, max(middle, start + least))
            cut = int(loose[i]) + 1 if i < len(loose) and loose[i] < end else end
        out.append(cut)
        start = cut
    if start < len(raw):
        out.append(len(raw))
    return out


def chunked(blobs: DataFrame, average: int = 1024, least: int = 256, most: int = 4096) -> DataFrame:
    """ino, bytes to (ino, ordinal, logical_offset, payload); no shuffle, a blob at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ino, ordinal, offset, payload = [], [], [], []
            for i, raw in zip(b["ino"].to_pylist(), b["bytes"].to_pylist(), strict=True):
                start = 0
                for n, stop in enumerate(cuts(raw or b"", average, least, most)):
                    ino.append(i)
                    ordinal.append(n)
                    offset.append(start)
                    payload.append(raw[start:stop])
                    start = stop
            yield pa.RecordBatch.from_pydict(
                {
                    "ino": pa.array(ino, pa.int64()),
                    "ordinal": pa.array(ordinal, pa.int64()),
                    "logical_offset": pa.array(offset, pa.int64()),
                    "payload": pa.array(payload, pa.binary()),
                }
            )

    return blobs.select("ino", "bytes").mapInArrow(run, "ino long, ordinal long, logical_offset long, payload binary")
