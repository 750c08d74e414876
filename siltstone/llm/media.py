r"""Media columns: content-addressed payloads in tar shards.

A table holds no media bytes, only where they are: the digest of the stored
form, its shard, offset and length. Shards are plain (ustar) tar files of
about ``shard_bytes``, members named by their digest, so any tar tool reads
them and a range read of ``length`` bytes at ``offset`` gives one medium.

* :func:`store` writes shards from the tasks that hold the rows and returns
  the index. No payload is shuffled, and each is stored once over all tasks: a
  first pass writes digests and row numbers only, of equal digests the row with
  the least number stores the payload, and each task reads the list of its own
  rows that don't. (So rows must come in the same order and partitions when
  they are computed twice, as those of files and written tables do; a payload
  that nobody stored ends the job.) A shard's name is the digest of its bytes
  and it appears by a rename, so a task that runs again after a lost executor
  leaves the same or a stray file, never a broken one.
* :func:`places` has one row a stored payload; :func:`with_header` fills
  metadata columns by reading only the first bytes of each medium and
  :func:`with_media` reads and verifies the whole, once a payload.
* :func:`placed` joins what is known of the payloads to all rows.

The codec here is an 8-bit grey PNG, :data:`WIDTH` samples a row: lossless,
deflated, and its first 33 bytes tell its size. Payloads are padded with
bytes 255 to a positive multiple of :data:`WIDTH`.

The work folder's scheme has to be one that pyarrow opens (file, hdfs, s3,
gs, abfs); a task's memory is bounded by one shard and one batch.

Defined results: null bytes are an empty payload (one row of padding); equal
payloads have equal values throughout; repeated rows each get an index row;
an empty table writes no shard; other columns pass through, but for ones named
like those that are added, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import fresh_path, mapped, parts_for, written

#: Samples in a row of the image.
WIDTH = 576
#: The PNG signature, and how many bytes signature and IHDR chunk take.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33

INDEX = (
    ("n_bytes", "long", pa.int64()),
    ("digest", "string", pa.string()),
    ("shard", "string", pa.string()),
    ("offset", "long", pa.int64()),
    ("length", "long", pa.int64()),
)


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (max(1, -(-len(payload) // WIDTH)) * WIDTH - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes) -> bytes:
    """Samples, a multiple of WIDTH, to an 8-bit grey PNG without row filters."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    if zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("the PNG header is damaged")
    return struct.unpack(">IIB", first[16:25])


def decode_png(stored: bytes) -> bytes:
    """What :func:`encode_png` was given; every chunk's checksum is verified."""
    width, height, bits = png_header(stored)
    at, data = len(SIGNATURE), b""
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if bits != 8 or rows[:, 0].any():
        raise ValueError("not a PNG of this writer")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Size, mean and a 64-bit average hash (of 64 column bands) of the picture."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    bands = grid.sum(axis=0, dtype=np.int64).reshape(64, -1).sum(axis=1)
    bits = bands * 64 > bands.sum()
    code = int("".join("1" if b else "0" for b in bits), 2)
    return f"{WIDTH}x{len(grid)};mean={int(bands.sum()) // len(samples)};ahash={code:016x}"


class ShardWriter:
    """Collects tar members and writes a shard whenever enough are there."""

    def __init__(self, folder: str, shard_bytes: int) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.shard_bytes = shard_bytes
        self.files.create_dir(self.folder, recursive=True)
        self._clear()

    def _clear(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0
        self.at: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, stored: bytes) -> None:
        """At most once a shard."""
        if digest in self.at:
            return
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(stored)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.at[digest] = (self.size + len(head), len(stored))
        body = stored + b"\0" * (-len(stored) % tarfile.BLOCKSIZE)
        self.parts += [head, body]
        self.size += len(head) + len(body)

    @property
    def full(self) -> bool:
        return self.size >= self.shard_bytes

    def close(self) -> tuple[str, dict[str, tuple[int, int]]]:
        """Writes the shard; its name and where each digest is."""
        whole = b"".join(self.parts) + b"\0" * (2 * tarfile.BLOCKSIZE)
        name = f"{hashlib.sha256(whole).hexdigest()[:40]}.tar"
        passing = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(passing) as out:
            out.write(whole)
        self.files.move(passing, f"{self.folder}/{name}")
        at = self.at
        self._clear()
        return name, at


def _own_names(rows: DataFrame, payload: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with the payload as bytes, its digest (``content``), the row's number and the other columns but those the index has."""
    keep = [c for c in rows.columns if c != payload and c not in ("content", *(n for n, _, _ in INDEX))]
    raw = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    given = rows.select(F.monotonically_increasing_id().alias("at"), raw.alias("raw"), *(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(keep)))
    return given.withColumn("content", F.sha2("raw", 256)), keep


def _elsewhere(given: DataFrame) -> str:
    """Writes, by partition of the rows, the numbers of those whose payload another row stores; the folder."""
    spark = given.sparkSession
    slim = written(given.select("content", "at"), "media-contents")
    # a table of its own, so that a content that a third of all rows have can be split in the join
    first = written(slim.groupBy("content").agg(F.min("at").alias("first")), "media-first")
    folder = fresh_path(spark, "media-elsewhere")
    others = slim.join(first, "content").where("at <> first").select("at", F.shiftright("at", 33).alias("part"))
    others.write.partitionBy("part").parquet(folder)
    return folder


def _numbers(files: fs.FileSystem, folder: str, part: int) -> set[int]:
    at = f"{folder}/part={part}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return set()
    listed = files.get_file_info(fs.FileSelector(at))
    out: set[int] = set()
    for f in listed:
        if f.path.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                out.update(pq.read_table(source, columns=["at"])["at"].to_pylist())
    return out


def store(rows: DataFrame, payload: str, folder: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """Writes the column ``payload`` (binary or string) to shards, each payload once.

    Returns ``rows`` without it, with the digest of the payload itself
    (``content``) and the index columns behind; digest and place are null
    where another row stores the payload: :func:`places` has them by content.
    """
    given, keep = _own_names(rows, payload)
    others = _elsewhere(given)
    kept = [f"own{i}" for i in range(len(keep))]
    nullable = [T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in INDEX]
    fields = [T.StructField(own, rows.schema[c].dataType) for own, c in zip(kept, keep, strict=True)]
    schema = T.StructType([*fields, T.StructField("content", T.StringType()), *nullable])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder, shard_bytes)
        files, others_at = fs.FileSystem.from_uri(others)
        skip: set[int] | None = None
        waiting: list[tuple[pa.RecordBatch, list[str | None], list[int]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            name, at = writer.close() if writer.at else (None, {})
            for part, digests, sizes in waiting:
                placed = [at.get(d, (None, None)) for d in digests]
                more = [
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([name if p[0] is not None else None for p in placed], pa.string()),
                    pa.array([p[0] for p in placed], pa.int64()),
                    pa.array([p[1] for p in placed], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(n for n, _, _ in INDEX)])
            waiting.clear()

        for b in batches:
            digests, sizes, start = [], [], 0
            for i, (at, raw) in enumerate(zip(b["at"].to_pylist(), b["raw"].to_pylist(), strict=True)):
                if skip is None:
                    skip = _numbers(files, others_at, at >> 33)
                digest = None
                if at not in skip:
                    stored = encode_png(padded(raw))
                    digest = hashlib.sha256(stored).hexdigest()
                    writer.add(digest, stored)
                digests.append(digest)
                sizes.append(len(raw))
                if writer.full or i == b.num_rows - 1:
                    waiting.append((b.slice(start, i + 1 - start).select([*kept, "content"]), digests, sizes))
                    digests, sizes, start = [], [], i + 1
                    if writer.full:
                        yield from flush()
        yield from flush()

    out = mapped(given, run, schema)
    return out.select(*(F.col(own).alias(c) for own, c in zip(kept, keep, strict=True)), "content", *(n for n, _, _ in INDEX))


def places(index: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """One row a stored payload: content, digest, shard, offset, length; dealt by shard into parts of about ``part_bytes``."""
    stored = index.where(F.col("shard").isNotNull()).select("content", "digest", "shard", "offset", "length")
    total = stored.agg(F.sum("length")).first()[0] or 0
    return stored.repartition(parts_for(total, part_bytes), "shard")


def placed(index: DataFrame, found: DataFrame) -> DataFrame:
    """``index`` with what is known of each payload (:func:`places` and what was added to it); a payload without a place ends the job."""
    rest = [c for c in found.columns if c != "content"]
    known = found.select("content", *rest)
    missing = F.raise_error(F.concat(F.lit("no task stored the payload "), F.col("content")))
    joined = index.drop(*rest).join(known, "content", "left")
    return joined.withColumn("shard", F.coalesce(F.col("shard"), missing.cast("string")))


class RangeReader:
    """Range reads in shards; the last few shards stay open."""

    def __init__(self, folder: str, most_open: int = 8) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.most_open = most_open
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= self.most_open:
                self.open.pop(next(iter(self.open))).close()
            self.open[shard] = self.files.open_input_file(f"{self.folder}/{shard}")
        got = self.open[shard].read_at(length, offset)
        if len(got) != length:
            raise ValueError(f"{shard} ends before {offset + length}")
        return got


def with_header(index: DataFrame, folder: str) -> DataFrame:
    """Metadata columns width, height, bits: reads HEADER_BYTES bytes of each medium, no payload."""
    more = [T.StructField(n, T.IntegerType()) for n in ("width", "height", "bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for b in batches:
            places = zip(b["shard"].to_pylist(), b["offset"].to_pylist(), strict=True)
            found = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in places]
            columns = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "width", "height", "bits"])

    index = index.drop("width", "height", "bits")
    return mapped(index, run, T.StructType([*index.schema, *more]))


def with_media(index: DataFrame, folder: str) -> DataFrame:
    """Reads every medium whole, verifies its digest and adds what its samples say."""
    added = (
        ("payload_bytes", T.LongType(), pa.int64()),
        ("payload_sha256", T.StringType(), pa.string()),
        ("tail_crc32", T.LongType(), pa.int64()),
        ("feature", T.StringType(), pa.string()),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for b in batches:
            found = []
            for digest, *place in zip(*(b[c].to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                stored = reader.read(*place)
                if hashlib.sha256(stored).hexdigest() != digest:
                    raise ValueError(f"the medium stored under {digest} is damaged")
                samples = decode_png(stored)
                found.append(
                    (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), feature_of(samples))
                )
            columns = [pa.array([f[i] for f in found], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(n for n, _, _ in added)])

    index = index.drop(*(n for n, _, _ in added))
    return mapped(index, run, T.StructType([*index.schema, *(T.StructField(n, t) for n, t, _ in added)]))


def shard_folder(spark) -> str:
    return fresh_path(spark, "media-shards")
