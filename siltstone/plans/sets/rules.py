"""More integrity rules, each with damage planted by a rule that SQL can say as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.operators import integrity as I
from siltstone.operators import stripes
from siltstone.plans.catalogue import query
from siltstone.plans.sets.devices import vdevs
from siltstone.sources import slots
from siltstone.sources import tables as T

sql = T.with_tables


@query("SELECT DISTINCT 'SizeMismatch' AS rule, CAST(event_id AS VARCHAR) AS key, octet_length(encode(event_type)) || '<>' || (octet_length(encode(event_type)) + 1) AS detail, 'error' AS severity FROM events WHERE event_id % 4 = 0")
def fsck_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: links whose declared size isn't their target's; every fourth declares a byte too much."""
    links = T.read(spark, sf_dir, "events").select("event_id", F.octet_length(F.encode("event_type", "utf-8")).cast("long").alias("n"))
    told = links.withColumn("size", F.col("n") + (F.col("event_id") % 4 == 0).cast("long"))
    return I.report([I.where(told, "SizeMismatch", F.col("n") != F.col("size"), "event_id", F.concat_ws("<>", "n", "size"))])


_SHIFTED = ", c AS (SELECT ino, ordinal, len, logical_offset - CASE WHEN ordinal = 2 AND ino % 3 = 0 THEN 16 ELSE 0 END AS o FROM chunk_ref)"


@query(sql(f"{_SHIFTED}, w AS (SELECT *, lag(o + len) OVER (PARTITION BY ino ORDER BY ordinal) AS stop FROM c) SELECT DISTINCT 'UnsortedOrOverlappingChunkList' AS rule, CAST(ino AS VARCHAR) AS key, stop || '>' || o AS detail, 'error' AS severity FROM w WHERE stop > o", "chunk_ref"))
def fsck_chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every third file the third chunk begins 16 bytes too early."""
    early = F.when((F.col("ordinal") == 2) & (F.col("ino") % 3 == 0), 16).otherwise(0)
    size = F.octet_length("payload").cast("long")
    parts = T.fixed_blocks(T.blobs(spark, sf_dir)).select("ino", "ordinal", (F.col("logical_offset") - early).alias("logical_offset"), size.alias("len"))
    return I.report([I.overlapping(parts, "ino")])


@query("WITH w AS (SELECT c_nationkey, c_mktsegment, lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS before FROM customer) SELECT DISTINCT 'UnsortedOrDuplicateDirEntries' AS rule, CAST(c_nationkey AS VARCHAR) AS key, c_mktsegment AS detail, 'error' AS severity FROM w WHERE before >= c_mktsegment")
def fsck_dir_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a nation's customers as names of a directory that should rise."""
    return I.report([I.rising(T.read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment", "UnsortedOrDuplicateDirEntries")])


@query("SELECT 'UnreadableObject' AS rule, CAST(event_id AS VARCHAR) AS key, CAST(octet_length(encode(coalesce(props, '{}'))) + 1 AS VARCHAR) AS detail, 'error' AS severity FROM events WHERE event_id % 5 = 0")
def fsck_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects that don't decode; every fifth begins with a bracket too many."""
    body = F.concat(F.when(F.col("event_id") % 5 == 0, "{").otherwise(""), F.coalesce("props", F.lit("{}")))
    rows = T.read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    broken = F.from_json("body", "map<string,string>").isNull()
    return I.report([I.where(rows, "UnreadableObject", broken, "event_id", F.octet_length("body"))])


_SLOTS = "s AS (SELECT s_suppkey AS pool, unnest(range(0, 16)) AS generation, 3 + s_suppkey % 4 AS version FROM supplier), v AS (SELECT *, pool % 4 <> 0 AND (pool + generation) % 3 <> 0 AS ok FROM s)"


@query(f"""WITH {_SLOTS}, n AS (SELECT pool, max(generation) AS generation, any_value(version) AS version FROM v WHERE ok GROUP BY pool)
SELECT 'NoValidSuperblock' AS rule, CAST(pool AS VARCHAR) AS key, '16' AS detail, 'error' AS severity FROM v GROUP BY pool HAVING NOT bool_or(ok)
UNION ALL SELECT CASE WHEN version < 4 THEN 'LegacyFormatVersion' ELSE 'UnsupportedFormatVersion' END, CAST(pool AS VARCHAR), CAST(version AS VARCHAR), 'error' FROM n WHERE version NOT BETWEEN 4 AND 5""")
def fsck_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools all of whose slots fail their checksum, and newest slots of a version that can't be read."""
    ring = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("generation"))
    ring = ring.withColumn("version", 3 + F.col("pool") % 4)
    body = F.encode(F.concat_ws(":", "pool", "generation", "version"), "utf-8")
    spoilt = (F.col("pool") % 4 == 0) | ((F.col("pool") + F.col("generation")) % 3 == 0)
    stored = ring.withColumn("body", body).withColumn("checksum", A.header_checksum(body) + spoilt.cast("long"))
    valid = A.header_checksum(F.col("body")) == F.col("checksum")
    newest = slots.newest_valid(stored, "pool", valid)
    return I.report([I.without_valid(stored, "pool", valid), I.versions(newest, "pool", "version", 4, 5)])


_LABELS = """m AS (SELECT s_nationkey AS pool, s_suppkey, 'dev' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS path,
  md5(CASE WHEN s_suppkey % 6 = 5 THEN 'other' ELSE CAST(s_nationkey AS VARCHAR) END) AS pool_uuid, s_suppkey // 2 AS vdev_id, 3 + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS vdev_count, s_suppkey % 3 AS generation FROM supplier),
f AS (SELECT *, pool_uuid <> first_value(pool_uuid) OVER (PARTITION BY pool ORDER BY path) AS is_foreign FROM m)"""


@query(f"""WITH {_LABELS} SELECT path, CASE WHEN is_foreign THEN 'foreign' WHEN count(*) OVER (PARTITION BY pool, is_foreign, vdev_id) > 1 THEN 'duplicate'
  WHEN vdev_count <> max(vdev_count) OVER (PARTITION BY pool, is_foreign) THEN 'count' WHEN generation < max(generation) OVER (PARTITION BY pool, is_foreign) THEN 'behind' END AS finding FROM f""")
def fsck_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of other pools, of one slot twice, of another count, or behind; each is planted."""
    key = F.col("s_suppkey")
    labels = T.read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pool"),
        F.concat(F.lit("dev"), F.lpad(key.cast("string"), 12, "0")).alias("path"),
        F.md5(F.when(key % 6 == 5, F.lit("other")).otherwise(F.col("s_nationkey").cast("string"))).alias("pool_uuid"),
        F.floor(key / 2).alias("vdev_id"),
        (3 + (key % 7 == 0).cast("int")).alias("vdev_count"),
        (key % 3).alias("generation"),
    )
    return slots.membership(labels, slots.foreign(position="path")).select("path", "finding")


_PRESENT = """, live AS (SELECT DISTINCT content_hash FROM chunk_ref WHERE lang IS DISTINCT FROM 'es'), lost AS (SELECT DISTINCT content_hash FROM chunk_ref WHERE lang = 'es' AND ino % 2 = 0),
want AS (SELECT content_hash FROM live UNION SELECT content_hash FROM lost), loose AS (SELECT content_hash FROM want WHERE content_hash NOT LIKE '3%')"""


@query(sql(f"{_PRESENT} SELECT 'ReplicaMissing' AS rule, content_hash AS key, CAST(v AS VARCHAR) AS detail, 'error' AS severity FROM (SELECT content_hash, unnest(range(0, 3)) AS v FROM loose) WHERE (content_hash, v) NOT IN (SELECT content_hash, vdev_id FROM replica)", "replica"))
def fsck_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that are missing of live data, and of what couldn't be resolved; shard 3 is striped and counts as present."""
    refs = T.chunk_refs(spark, sf_dir).withColumns({"live": F.expr("lang IS DISTINCT FROM 'es'"), "unsure": F.expr("lang = 'es' AND ino % 2 = 0")})
    index = T.locations(refs, F.max("live").alias("live"), F.max("unsure").alias("unsure"))
    wanted = I.counted(index.where("live"), index.where("unsure"))
    return I.report([I.lacking(wanted, T.replicas(index), index.where("shard = 3"), vdevs(spark))])


_STRIPED = """, seg AS (SELECT segment_id, CAST(sum(record_len) AS BIGINT) AS logical FROM location GROUP BY segment_id),
sh AS (SELECT segment_id, i, ((((logical + 1) // 2) + 4095) // 4096) * 4096 AS shard_size, (segment_id + i) % 11 AS r FROM (SELECT *, unnest(range(0, 3)) AS i FROM seg))"""


@query(sql(f"{_STRIPED} SELECT 'StripeShardCorrupt' AS rule, CAST(segment_id AS VARCHAR) AS key, i || '/' || ['header', 'index', 'placement', 'length', 'hash'][CAST(r AS INTEGER) + 1] AS detail, 'error' AS severity FROM sh WHERE r < 5", "location"))
def fsck_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with a bad header, index, place, length or hash; the remainder by 11 says which is planted."""
    own = T.locations(T.chunk_refs(spark, sf_dir)).groupBy("segment_id").agg(F.sum("record_len").alias("logical"))
    rows = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shard_index")).withColumn("r", (F.col("segment_id") + F.col("shard_index")) % 11)
    size = A.shard_bytes(F.col("logical"), 2).cast("long")
    digest = F.sha2(F.encode(F.concat_ws(":", "segment_id", "shard_index"), "utf-8"), 256)
    off = lambda k: (F.col("r") == k).cast("int")
    shards = rows.select(
        "segment_id",
        "shard_index",
        (F.col("r") != 0).alias("header_ok"),
        (F.col("shard_index") + off(1)).alias("told_index"),
        F.col("shard_index").alias("vdev_id"),
        (F.col("shard_index") + off(2)).alias("told_vdev"),
        size.alias("shard_size"),
        (size - off(3)).alias("n_bytes"),
        digest.alias("shard_hash"),
        F.when(F.col("r") == 4, F.reverse(digest)).otherwise(digest).alias("found_hash"),
    )
    return I.report([I.shard_faults(shards)])


@query(sql("SELECT 'StripeInconsistent' AS rule, CAST(ino AS VARCHAR) AS key, CASE WHEN ino % 5 = 0 THEN 'parity shard 2 does not match the data shards' ELSE 'shard 1 disagrees with its siblings' END AS detail, 'error' AS severity FROM blob WHERE octet_length(bytes) > 0 AND ino % 5 < 2", "blob"))
def fsck_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob striped at 2 + 1; some parities are of other bytes, under a hash of their own, and some descriptors differ."""
    body = T.blobs(spark, sf_dir).select(F.col("ino").alias("segment_id"), F.col("bytes").alias("body")).where("octet_length(body) > 0")
    shards = stripes.encoded(body, 2, 1)
    flip = (F.col("segment_id") % 5 == 0) & (F.col("shard_index") == 2)
    first = F.when(F.hex(F.substring("bytes", 1, 1)) == "00", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    spoilt = F.when(flip, F.concat(first, F.substring("bytes", 2, 1 << 30))).otherwise(F.col("bytes"))
    other = (F.col("segment_id") % 5 == 1) & (F.col("shard_index") == 1)
    shards = shards.withColumn("bytes", spoilt).withColumn("shard_hash", F.sha2("bytes", 256)).withColumn("logical_len", F.col("logical_len") + other.cast("long"))
    return I.report([stripes.inconsistent(shards, 2, 1)])


_RINGS = """k AS (SELECT s_nationkey AS pool, 'dev' || s_suppkey AS path, s_suppkey % 5 <> 4 AS present, s_suppkey % 7 <> 3 AS sum_ok,
  CASE WHEN s_suppkey % 6 = 5 THEN -1 ELSE s_nationkey END AS ring_pool, s_suppkey % 3 AS generation FROM supplier),
n AS (SELECT *, max(CASE WHEN present AND sum_ok AND ring_pool = pool THEN generation END) OVER (PARTITION BY pool) AS newest FROM k),
r AS (SELECT *, CASE WHEN NOT present THEN 'KeyringMissing' WHEN NOT sum_ok THEN 'KeyringDamaged' WHEN ring_pool <> pool THEN 'KeyringForeign' WHEN generation < newest THEN 'KeyringStale' END AS rule FROM n)"""


@query(f"WITH {_RINGS} SELECT rule, path AS key, CAST(pool AS VARCHAR) AS detail, CASE WHEN rule = 'KeyringDamaged' THEN 'error' ELSE 'warning' END AS severity FROM r WHERE rule IS NOT NULL")
def fsck_keyrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyring copies that are missing, damaged, another pool's or behind."""
    key = F.col("s_suppkey")
    copies = T.read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pool"),
        F.concat(F.lit("dev"), key.cast("string")).alias("path"),
        (key % 5 != 4).alias("present"),
        (key % 7 != 3).alias("sum_ok"),
        F.when(key % 6 == 5, -1).otherwise(F.col("s_nationkey")).alias("ring_pool"),
        (key % 3).alias("generation"),
    )
    return I.report([I.keyrings(copies)])
