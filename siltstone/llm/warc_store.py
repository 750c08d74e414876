r"""A content-addressed archive of web records.

Payload bytes are stored once, in a table of their own, under their SHA-256;
record headers are kept exactly as written, in a second table, with the
digest that leads to the payload. Original records are put together again by
a join on the digest, after every payload read has been hashed and compared
with its address.

WARC 1.1 rules that are followed: ``response`` records own their payload;
a ``revisit`` names the record whose payload is identical in
``WARC-Refers-To`` and carries no block of its own. Payloads shorter than
``least_bytes`` are always ``response`` (their bytes are still stored once).

Shuffles: the scan's digests are summed up to (digest, smallest id) in the
map tasks before they move, so a payload that a third of all pages share
costs one row a task; what is joined by digest is unique on one side and has
its own exchange on either, so such a digest's pages are split over tasks. The payload table is written from an aggregate whose
partial step keeps one copy a task and digest. Large payloads travel
compressed (zlib).

Defined results: null html is an empty payload; null ids sort after all
others; of rows that repeat an id with the same payload the record names tie
and every row is written; an empty table gives an empty archive; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import fresh_path, mapped, written

#: The names and the profile that WARC 1.1 prescribes.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    payloads: str
    headers: str


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, payload to digest, n_bytes, packed; one row a digest and batch."""
    for b in batches:
        seen: dict[str, tuple[int, bytes]] = {}
        for digest, payload in zip(b["digest"].to_pylist(), b["payload"].to_pylist(), strict=True):
            if digest not in seen:
                seen[digest] = (len(payload), zlib.compress(payload, 6))
        yield pa.RecordBatch.from_pydict(
            {
                "digest": list(seen),
                "n_bytes": pa.array([n for n, _ in seen.values()], pa.int64()),
                "packed": pa.array([p for _, p in seen.values()], pa.binary()),
            }
        )


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpack and verify: a payload whose hash isn't its address ends the job. Rows that follow each other with one digest share the work."""
    last: tuple[str, int, bytes, bytes] | None = None
    for b in batches:
        whole = []
        for digest, n, packed in zip(*(b[c].to_pylist() for c in ("digest", "n_bytes", "packed")), strict=True):
            if last is None or last[:3] != (digest, n, packed):
                payload = zlib.decompress(packed)
                if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload stored under {digest} is damaged")
                last = digest, n, packed, payload
            whole.append(last[3])
        columns = {"page_id": b["page_id"], "header": b["header"], "payload": pa.array(whole, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns)


def write_archive(pages: DataFrame, least_bytes: int = 100) -> Archive:
    """page_id, url, html to the two tables of an archive in the shared folder."""
    spark = pages.sparkSession
    scan = pages.select(
        "page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    archive = Archive(fresh_path(spark, "warc-payloads"), fresh_path(spark, "warc-headers"))

    packed = mapped(scan.select("digest", "payload"), _packed, "digest string, n_bytes long, packed binary")
    (
        packed.groupBy("digest")
        .agg(F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed"))  # equal under one digest
        .write.option("compression", "none")
        .parquet(archive.payloads)
    )

    slim = scan.select("page_id", "url", "digest", F.octet_length("payload").alias("n_bytes"))
    # a table of its own, so that the join has exchanges on both sides and a digest that many pages have can be split
    first = written(slim.groupBy("digest").agg(F.min("page_id").alias("first_id")), "warc-first")
    told = slim.join(first, "digest")
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    headers = told.withColumn("kind", kind).select(
        "page_id",
        "digest",
        F.encode(
            F.concat(
                F.lit(f"{VERSION}\r\n"),
                line("WARC-Type", F.col("kind")),
                line("WARC-Record-ID", urn(F.col("page_id"))),
                line("WARC-Target-URI", F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", "")),
                line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                F.when(
                    revisit,
                    F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE))),
                ).otherwise(""),
                line("Content-Type", F.lit("text/html; charset=utf-8")),
                line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
                F.lit("\r\n"),
            ),
            "utf-8",
        ).alias("header"),
    )
    headers.write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, header (exact bytes) and payload (the full one, also of revisits), joined again and verified."""
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads)
    joined = headers.join(payloads, "digest").select("page_id", "header", "digest", "n_bytes", "packed")
    return mapped(joined, _restored, "page_id long, header binary, payload binary")


def record_bytes(header: Column, payload: Column) -> Column:
    """The original record: header, the block it carries (none for a revisit) and the closing line ends."""
    is_revisit = F.decode(header, "utf-8").contains("\r\nWARC-Type: revisit\r\n")
    block = F.when(is_revisit, F.lit(b"")).otherwise(payload)
    return F.concat(header, block, F.lit(b"\r\n\r\n"))


def header_field(name: str, header: str = "header") -> Column:
    """One field of the exact header bytes; null where it is absent."""
    text = F.decode(F.col(header), "utf-8")
    found = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(text.contains(f"\r\n{name}: "), found)
