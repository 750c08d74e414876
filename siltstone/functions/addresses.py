"""Content addresses, checksums, routing and size arithmetic, all as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def address(payload: Column) -> Column:
    """The content address of bytes: lower-case hex SHA-256."""
    return F.sha2(payload, 256)


def verified(payload: Column, expected: Column) -> Column:
    return address(payload) == expected


def keyed_address(key: Column, payload: Column) -> Column:
    """An address that only holders of the epoch's key can compute."""
    return F.sha2(F.concat(key, payload), 256)


def header_checksum(header: Column) -> Column:
    """CRC-32, the IEEE polynomial."""
    return F.crc32(header)


def hex_digit(address_: Column, place: int) -> Column:
    """The value of one hex digit of an address; places count from 1."""
    return F.instr(F.lit(HEX), F.substring(address_, place, 1)).cast("int") - 1


def cache_bucket(address_: Column, buckets: int = 64) -> Column:
    """First byte of the hash modulo the number of buckets."""
    return (hex_digit(address_, 1) * 16 + hex_digit(address_, 2)) % buckets


def padded_len(size: Column) -> Column:
    """Padme: ``e`` = floor(log2 size), ``s`` = floor(log2 e) + 1; round up to a multiple of 2 ** (e - s)."""
    top = lambda c: F.length(F.bin(c)).cast("int") - 1
    e = top(size)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(e - (top(e.cast("long")) + 1), F.lit(0)))
    return F.when(size < 2, size).otherwise(F.floor((size + step - 1) / step).cast("long") * step)


def align_up(value: Column, unit: int) -> Column:
    return F.floor((value + (unit - 1)) / unit).cast("long") * unit


def zone_size(device_bytes: Column) -> Column:
    """The power of two at or above a 65536th of the device, between 1 and 16 MiB."""
    wanted = F.greatest(F.ceil(device_bytes / 65536), F.lit(1))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(wanted - 1)).cast("int"))
    return F.least(F.greatest(power, F.lit(1 << 20)), F.lit(16 << 20))


def shard_bytes(logical: Column, k: int, page: int = 4096) -> Column:
    """Bytes of each of k shards: an equal share, in whole pages."""
    return align_up(F.ceil(logical / k), page)


def uuid_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def uuid_bytes(text: Column) -> Column:
    """32 hex digits, dashes ignored."""
    return F.unhex(F.replace(text, F.lit("-")))


def slice_of(payload: Column, offset: Column, length: Column) -> Column:
    """Bytes from an offset, fewer at the end, none behind it."""
    return F.substring(payload, offset + 1, length)


#: Increment and multipliers of the splitmix64 finaliser.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shard_for_inode(ino: Column, shards: int) -> Column:
    """splitmix64 finaliser modulo the number of shards (vectorised: SQL's 64-bit products raise on overflow)."""

    @F.pandas_udf("long")
    def route(values: pd.Series) -> pd.Series:
        z = values.to_numpy().astype(np.uint64) + np.uint64(SPLITMIX[0])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX[2])
        return pd.Series(((z ^ (z >> np.uint64(31))) % np.uint64(shards)).astype(np.int64))

    return route(ino)


def staging_name(prefix: str, name: Column, root: Column) -> Column:
    return F.concat(F.lit(prefix), name, F.lit("/"), root)
