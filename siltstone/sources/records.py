"""Segments as files of records: writing, scanning past damage, verified reads.

Layout: a header page, then records. A record is ``header length`` (4 bytes,
little endian), the header as JSON, its CRC-32 (4 bytes) and the payload. A
scan that meets bytes it can't parse looks for the next record's magic and
reports the range it skipped; a segment is scanned in one task, segments in
parallel.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of this format.
MAGIC, PAGE, FOOTER = "SLT1", 4096, b"SLTEND\0\0"
_START = b'{"magic": "SLT1"'


def encode_record(content_hash: str, kind: str, codec: str, payload: bytes, size: int) -> bytes:
    header = json.dumps(
        {"magic": MAGIC, "hash": content_hash, "kind": kind, "codec": codec, "stored": len(payload), "size": size}
    ).encode()
    return struct.pack("<I", len(header)) + header + struct.pack("<I", zlib.crc32(header)) + payload


def parse_header(raw: bytes, at: int) -> tuple[dict, int, int] | None:
    """Header, where its payload starts and ends; None for anything malformed."""
    if at + 8 > len(raw):
        return None
    (n,) = struct.unpack_from("<I", raw, at)
    stop = at + 4 + n
    if not 0 < n <= 4096 or stop + 4 > len(raw) or not raw.startswith(_START, at + 4):
        return None
    header = raw[at + 4 : stop]
    if zlib.crc32(header) != struct.unpack_from("<I", raw, stop)[0]:
        return None
    parsed = json.loads(header)
    end = stop + 4 + parsed["stored"]
    return (parsed, stop + 4, end) if end <= len(raw) else None


def scan(raw: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """(kind, start, stop, header) in order: record, damaged, footer or eof."""
    at = PAGE
    while at < len(raw):
        if raw.startswith(FOOTER, at):
            yield "footer", at, at + len(FOOTER), None
            return
        found = parse_header(raw, at)
        if found:
            header, _, end = found
            yield "record", at, end, header
            at = end
            continue
        nearest = raw.find(_START, at + 5)
        footer = raw.find(FOOTER, at + 1)
        after = min((p for p in (nearest - 4 if nearest > 0 else -1, footer) if p > at), default=len(raw))
        yield "damaged", at, after, None
        at = after
    yield "eof", len(raw), len(raw), None


SEGMENT_ROWS = "segment_id long, kind string, start long, stop long, content_hash string, codec string, ok boolean"


def scan_segments(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """segment_id, raw to one row an event of the scan; ``ok`` says whether the payload has its address (null: not read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segment, raw in zip(b["segment_id"].to_pylist(), b["raw"].to_pylist(), strict=True):
                for kind, start, stop, header in scan(raw):
                    ok = None
                    if header and payloads:
                        ok = hashlib.sha256(raw[stop - header["stored"] : stop]).hexdigest() == header["hash"]
                    rows.append((segment, kind, start, stop, header and header["hash"], header and header["codec"], ok))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            names = ["segment_id", "kind", "start", "stop", "content_hash", "codec", "ok"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return segments.select("segment_id", "raw").mapInArrow(run, SEGMENT_ROWS)


READ = "segment_id long, start long, content_hash string, codec string, stored long, ok boolean, raw binary"


def read_records(segments: DataFrame, places: DataFrame) -> DataFrame:
    """One record for each place (segment_id, start), read on its own: its header, its stored bytes (``raw``) and whether they verify.

    ``raw`` is what is copied forward without unpacking. A place where
    no record begins gives a row without a hash that is not ok.
    """
    wanted = places.select("segment_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segment, start, raw in zip(b["segment_id"].to_pylist(), b["start"].to_pylist(), b["raw"].to_pylist(), strict=True):
                found = parse_header(raw, start)
                if found is None:
                    rows.append((segment, start, None, None, None, False, None))
                    continue
                header, begin, end = found
                stored = raw[begin:end]
                ok = hashlib.sha256(stored).hexdigest() == header["hash"]
                rows.append((segment, start, header["hash"], header["codec"], len(stored), ok, stored))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            names = ["segment_id", "start", "content_hash", "codec", "stored", "ok", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return segments.join(wanted, "segment_id").select("segment_id", "start", "raw").mapInArrow(run, READ)


def headers(segments: DataFrame) -> DataFrame:
    """segment_id, place, start, content_hash: record by record by their headers alone, payloads are stepped over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segment, whole in zip(b["segment_id"].to_pylist(), b["raw"], strict=True):
                raw, at, place = memoryview(whole.as_buffer()), PAGE, 0
                while at < len(raw) and (step := header_step(raw, at)) is not None:
                    rows.append((segment, place, at, step[0]))
                    at, place = step[1], place + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["segment_id", "place", "start", "content_hash"])

    return segments.select("segment_id", "raw").mapInArrow(run, "segment_id long, place long, start long, content_hash string")


def header_step(raw: memoryview, at: int) -> tuple[str, int] | None:
    """A record's hash and where the next one begins, from its header's bytes; None where no record begins."""
    if at + 8 > len(raw):
        return None
    (n,) = struct.unpack_from("<I", raw, at)
    stop = at + 4 + n
    if not 0 < n <= 4096 or stop + 4 > len(raw):
        return None
    header = bytes(raw[at + 4 : stop])
    if not header.startswith(_START) or zlib.crc32(header) != struct.unpack_from("<I", raw, stop)[0]:
        return None
    parsed = json.loads(header)
    return parsed["hash"], stop + 4 + parsed["stored"]


def write_segments(chunks: DataFrame) -> DataFrame:
    """segment_id, seq, content_hash, payload to segment_id, raw: a header page, records in order and the footer."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        parts = [b"SLTSEG".ljust(PAGE, b"\0")]
        for h, p in zip(t["content_hash"].to_pylist(), t["payload"].to_pylist(), strict=True):
            parts.append(encode_record(h, "RawChunk", "none", p, len(p)))
        return pa.table({"segment_id": t["segment_id"][:1], "raw": pa.array([b"".join([*parts, FOOTER])], pa.binary())})

    rows = chunks.select("segment_id", "seq", "content_hash", "payload")
    return rows.groupBy("segment_id").applyInArrow(run, "segment_id long, raw binary")


COPIED = "segment_id long, raw binary, records array<struct<content_hash:string,offset:long,len:long>>"
_COPIED_ARROW = pa.schema([("segment_id", pa.int64()), ("raw", pa.binary()), ("records", pa.list_(pa.struct([("content_hash", pa.string()), ("offset", pa.int64()), ("len", pa.int64())])))])


def copied(segments: DataFrame) -> DataFrame:
    """segment_id, raw, wanted (hashes; null: all) to segments of the wanted records alone, byte for byte, and where these are; without any, raw is null.

    A segment that is damaged, or of which a wanted record doesn't verify, has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, raw, wanted in zip(b["segment_id"].to_pylist(), b["raw"].to_pylist(), b["wanted"].to_pylist(), strict=True):
                events, own = list(scan(raw)), None if wanted is None else set(wanted)
                keep = [(start, stop, h) for kind, start, stop, h in events if kind == "record" and (own is None or h["hash"] in own)]
                sound = all(hashlib.sha256(raw[stop - h["stored"] : stop]).hexdigest() == h["hash"] for _, stop, h in keep)
                if sound and all(kind != "damaged" for kind, *_ in events):
                    own, at = [], PAGE
                    for start, stop, h in keep:
                        own.append({"content_hash": h["hash"], "offset": at, "len": stop - start})
                        at += stop - start
                    whole = b"".join([raw[:PAGE], *(raw[start:stop] for start, stop, _ in keep), FOOTER]) if keep else None
                    yield pa.RecordBatch.from_pylist([{"segment_id": segment, "raw": whole, "records": own}], schema=_COPIED_ARROW)

    return segments.select("segment_id", "raw", "wanted").mapInArrow(run, COPIED)


def with_damage(segments: DataFrame, at: int, length: int) -> DataFrame:
    """The segments with some bytes overwritten, for tests of the scan."""
    raw = F.col("raw")
    spoilt = F.concat(F.substring(raw, 1, at), F.unhex(F.repeat(F.lit("ff"), F.lit(length))), F.substring(raw, at + length + 1, 1 << 30))
    return segments.withColumn("raw", F.when(F.octet_length("raw") > at + length, spoilt).otherwise(raw))
