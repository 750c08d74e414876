"""The model's tables, derived from Parquet inputs without writing anything.

blob      a document's bytes, its inode and directory
chunk_ref fixed blocks of blobs, with their content addresses
location  where the first copy of each chunk lies: shard, segment, offset
replica   copies of chunks on devices, some lacking, damaged or divergent
delta     a per-shard change log with epochs, from the events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.addresses import address, hex_digit

BLOCK, SEGMENT_CAP, HEADER_BYTES, SHARDS, DEVICES, INLINE = 256, 65536, 64, 16, 3, 512
#: Segment ids of a shard and blocks of a file: so many, that no two owners' numbers meet (64 PiB a shard, 16 GiB a file).
SEGMENTS_A_SHARD, BLOCKS_A_FILE = 1 << 40, 1 << 26
#: Running sums go by ranges of so many files and then over the ranges' sums.
FILES_A_RANGE = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, dir, lang, bytes."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ino"),
        F.col("source").alias("dir"),
        "lang",
        F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8").alias("bytes"),
    )


def fixed_blocks(blob: DataFrame, size: int = BLOCK) -> DataFrame:
    """``blob`` with its bytes cut into blocks: ordinal, logical_offset, payload. Narrow: no shuffle."""
    offsets = F.when(F.octet_length("bytes") > 0, F.sequence(F.lit(0), F.octet_length("bytes") - 1, F.lit(size)))
    return blob.select(*[c for c in blob.columns if c != "bytes"], "bytes", F.explode(offsets).alias("o")).select(
        *[c for c in blob.columns if c != "bytes"],
        F.floor(F.col("o") / size).alias("ordinal"),
        F.col("o").cast("long").alias("logical_offset"),
        F.substring(F.col("bytes"), F.col("o") + 1, F.lit(size)).alias("payload"),
    )


def addressed(blocks: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Blocks with content_hash and len; the payload leaves the plan unless it is asked for."""
    out = blocks.withColumn("content_hash", address(F.col("payload"))).withColumn(
        "len", F.octet_length("payload").cast("long")
    )
    return out if keep_payload else out.drop("payload")


def chunk_refs(spark: SparkSession, sf_dir: str, keep_payload: bool = False) -> DataFrame:
    return addressed(fixed_blocks(blobs(spark, sf_dir)), keep_payload)


def sequence_number(ino: Column, ordinal: Column) -> Column:
    """The order in which blocks were written."""
    return ino * BLOCKS_A_FILE + ordinal


def sums_before(rows: DataFrame, owner: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the owner's earlier rows, in two levels: within buckets, which are ranges of the order, and over buckets."""
    totals = rows.groupBy(owner, bucket).agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(owner).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(owner, bucket, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = F.sum(value).over(Window.partitionBy(owner, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn(name, within).join(base, [owner, bucket]).withColumn(name, F.col(name) + F.col("base")).drop("base")


def locations(refs: DataFrame, *more: Column) -> DataFrame:
    """content_hash, len, seq, shard, record_len, segment_id, offset: first copies, appended to their shard's segments.

    The running sum goes by shard and range of files. ``more`` are further aggregates over a hash's references, which then need
    no pass of their own.
    """
    first = refs.groupBy("content_hash").agg(
        F.min("len").alias("len"), F.min(sequence_number(F.col("ino"), F.col("ordinal"))).alias("seq"), *more
    )
    carried = [c for c in first.columns if c not in ("content_hash", "len", "seq")]
    placed = (
        first.withColumn("shard", hex_digit(F.col("content_hash"), 1))
        .withColumn("record_len", F.col("len") + HEADER_BYTES)
        .withColumn("range", F.floor(F.col("seq") / (BLOCKS_A_FILE * FILES_A_RANGE)))
    )
    placed = sums_before(placed, "shard", "range", ["seq"], "record_len", "at")
    return placed.select(
        "content_hash",
        "len",
        "seq",
        "shard",
        "record_len",
        (F.col("shard") * F.lit(SEGMENTS_A_SHARD) + F.floor(F.col("at") / SEGMENT_CAP)).alias("segment_id"),
        (F.col("at") % SEGMENT_CAP).alias("offset"),
        *carried,
    )


def replicas(location: DataFrame, devices: int = DEVICES) -> DataFrame:
    """Copies on every device but those that a hash's second digit names; the third spoils, the fourth tells another codec."""
    vdevs = F.explode(F.sequence(F.lit(0), F.lit(devices - 1))).alias("vdev_id")
    return (
        location.select("*", vdevs)
        .where(hex_digit(F.col("content_hash"), 2) != F.col("vdev_id"))
        .withColumn("good", hex_digit(F.col("content_hash"), 3) != F.col("vdev_id") + 4)
        .withColumn("codec", F.when(hex_digit(F.col("content_hash"), 4) == F.col("vdev_id") + 8, "zstd").otherwise("none"))
    )


def delta_log(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """shard_id, ino, new_object_hash, epoch, segment_id, event_id: the events as commits of their shard, 256 a segment."""
    rows = read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("ino"), F.pmod("user_id", F.lit(shards)).cast("int").alias("shard_id"), "props"
    )
    rows = rows.withColumns({"day": F.to_date("ts"), "one": F.lit(1).cast("long")})
    return (
        sums_before(rows, "shard_id", "day", ["ts", "event_id"], "one", "before")
        .withColumn("epoch", F.col("before") + 1)
        .select(
            "shard_id",
            "ino",
            F.sha2(F.coalesce("props", F.lit("")).cast("binary"), 256).alias("new_object_hash"),
            "epoch",
            F.floor((F.col("epoch") - 1) / 256).alias("segment_id"),
            "event_id",
        )
    )


#: The same tables as DuckDB common table expressions, by name and in order.
SQL = {
    "blob": "SELECT doc_id AS ino, source AS dir, lang, encode(coalesce(text, '')) AS bytes FROM documents",
    "chunk_ref": """SELECT ino, dir, lang, o // 256 AS ordinal, o AS logical_offset, payload, sha256(payload) AS content_hash, octet_length(payload) AS len
  FROM (SELECT ino, dir, lang, o, bytes[o + 1 : o + 256] AS payload FROM (SELECT *, unnest(range(0, octet_length(bytes), 256)) AS o FROM blob))""",
    "location": """SELECT content_hash, len, seq, shard, record_len, shard * 1099511627776 + pos // 65536 AS segment_id, pos % 65536 AS "offset"
  FROM (SELECT *, CAST(sum(record_len) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) - record_len AS pos
    FROM (SELECT *, instr('0123456789abcdef', substr(content_hash, 1, 1)) - 1 AS shard, len + 64 AS record_len
      FROM (SELECT content_hash, min(len) AS len, min(ino * 67108864 + ordinal) AS seq FROM chunk_ref GROUP BY content_hash)))""",
    "replica": """SELECT *, instr('0123456789abcdef', substr(content_hash, 3, 1)) - 1 <> vdev_id + 4 AS good,
    CASE WHEN instr('0123456789abcdef', substr(content_hash, 4, 1)) - 1 = vdev_id + 8 THEN 'zstd' ELSE 'none' END AS codec
  FROM (SELECT *, unnest(range(0, 3)) AS vdev_id FROM location) WHERE instr('0123456789abcdef', substr(content_hash, 2, 1)) - 1 <> vdev_id""",
    "delta": """SELECT shard_id, ino, sha256(coalesce(props, '')) AS new_object_hash, epoch, (epoch - 1) // 256 AS segment_id, event_id
  FROM (SELECT *, user_id AS ino, user_id % 16 AS shard_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS epoch FROM events)""",
}
_NEEDS = {"blob": (), "chunk_ref": ("blob",), "location": ("chunk_ref",), "replica": ("location",), "delta": ()}


def with_tables(query: str, *names: str) -> str:
    """DuckDB SQL: the tables that a query needs, in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    query = query.strip()
    head = "WITH " + ("RECURSIVE " if query.startswith("RECURSIVE") else "")
    query = query.removeprefix("RECURSIVE").lstrip()
    tables = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"{head}{tables}{',' + chr(10) + query[1:] if query.startswith(',') else chr(10) + query}"
