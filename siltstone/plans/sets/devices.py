"""Copies on devices, stripes, slots, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.operators import replicas, stripes
from siltstone.plans.catalogue import query
from siltstone.sources import slots
from siltstone.sources import tables as T

sql = T.with_tables


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.replicas(T.locations(T.chunk_refs(spark, sf_dir)))


def vdevs(spark: SparkSession) -> DataFrame:
    return spark.range(T.DEVICES).select(F.col("id").cast("int").alias("vdev_id"))


@query(sql("SELECT content_hash, v AS vdev_id FROM (SELECT content_hash, unnest(range(0, 3)) AS v FROM location) WHERE (content_hash, v) NOT IN (SELECT content_hash, vdev_id FROM replica)", "replica"))
def resilver_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device lacks."""
    held = copies(spark, sf_dir)
    return replicas.missing_on(held.select("content_hash").distinct(), held, vdevs(spark)).select("content_hash", "vdev_id")


@query(sql("SELECT b.content_hash, b.vdev_id, min(g.vdev_id) AS source FROM replica b LEFT JOIN replica g ON g.content_hash = b.content_hash AND g.good WHERE NOT b.good GROUP BY ALL", "replica"))
def heal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each damaged copy is healed from."""
    return replicas.heal_sources(copies(spark, sf_dir)).select("content_hash", "vdev_id", "source")


@query(sql('SELECT content_hash, min(vdev_id) AS vdev_id FROM replica WHERE good GROUP BY content_hash', "replica"))
def failover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device each hash is read from, the first that verifies."""
    held = copies(spark, sf_dir)
    return replicas.first_good(held.select("content_hash", "vdev_id", "good"), F.col("good")).select("content_hash", "vdev_id")


@query(
    sql(
        """
, ref AS (SELECT content_hash, arg_min(codec, vdev_id) AS reference FROM replica WHERE good GROUP BY content_hash),
wanted AS (SELECT content_hash, v AS vdev_id FROM (SELECT content_hash, unnest(range(0, 3)) AS v FROM location))
SELECT w.content_hash, w.vdev_id, CASE WHEN r.content_hash IS NULL THEN 'missing' WHEN NOT r.good THEN 'corrupt' ELSE 'divergent' END AS finding
FROM wanted w LEFT JOIN replica r ON r.content_hash = w.content_hash AND r.vdev_id = w.vdev_id LEFT JOIN ref ON ref.content_hash = w.content_hash
WHERE r.content_hash IS NULL OR NOT r.good OR ref.reference IS DISTINCT FROM r.codec""",
        "replica",
    )
)
def replica_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, damaged and divergent copies."""
    return replicas.compared(copies(spark, sf_dir), vdevs(spark), "codec").select("content_hash", "vdev_id", "finding")


@query(sql("SELECT content_hash, CASE WHEN content_hash LIKE '0%' THEN 'missing' ELSE 'mismatch' END AS finding FROM location WHERE content_hash LIKE '0%' OR content_hash LIKE 'a%'", "location"))
def verify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index against a walk that lost shard 0 and finds shard 10 elsewhere."""
    index = T.locations(T.chunk_refs(spark, sf_dir)).select("content_hash", "segment_id", "offset", "shard")
    walk = index.where("shard <> 0").withColumn("offset", F.col("offset") + (F.col("shard") == 10).cast("int"))
    return replicas.index_faults(index, walk, ["content_hash"], ["segment_id", "offset"])


@query(sql("SELECT content_hash FROM replica GROUP BY content_hash HAVING count(DISTINCT vdev_id) = 3", "replica"))
def on_all_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that every device holds."""
    return replicas.on_all(copies(spark, sf_dir), T.DEVICES)


@query(
    sql(
        """
, s AS (SELECT b.content_hash, b.vdev_id, min(g.vdev_id) AS source FROM replica b LEFT JOIN replica g ON g.content_hash = b.content_hash AND g.good WHERE NOT b.good GROUP BY ALL)
SELECT r.vdev_id, count(*) AS records, count(*) FILTER (NOT good) AS corrupt, coalesce(any_value(h), 0) AS healed, coalesce(any_value(u), 0) AS unrecoverable
FROM replica r LEFT JOIN (SELECT vdev_id, count(*) FILTER (source IS NOT NULL) AS h, count(*) FILTER (source IS NULL) AS u FROM s GROUP BY vdev_id) x USING (vdev_id) GROUP BY r.vdev_id""",
        "replica",
    )
)
def scrub_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verify-and-heal pass by device."""
    return replicas.scrubbed(copies(spark, sf_dir))


_SIZES = "SELECT ino, CAST(octet_length(bytes) AS BIGINT) AS n FROM blob"


@query(sql(f"SELECT ino, ((((n + 3) // 4) + 4095) // 4096) * 4096 AS shard_size, least(n // greatest(((((n + 3) // 4) + 4095) // 4096) * 4096, 1), 3) AS last_shard FROM ({_SIZES})", "blob"))
def stripe_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard sizes at k = 4 and the shard that the last byte falls in."""
    n = F.octet_length("bytes").cast("long")
    sized = T.blobs(spark, sf_dir).select("ino", n.alias("n"), A.shard_bytes(n, 4).cast("long").alias("shard_size"))
    last = F.least(F.floor(F.col("n") / F.greatest("shard_size", F.lit(1))), F.lit(3).cast("long"))
    return sized.select("ino", "shard_size", last.alias("last_shard"))


@query("SELECT o_orderkey AS device, least(greatest(CASE WHEN w <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(w - 1)) END, 1048576), 16777216) AS zone_size FROM (SELECT o_orderkey, greatest(CAST(ceil(CAST(o_orderkey * 100000000 AS DOUBLE) / 65536) AS BIGINT), 1) AS w FROM orders)")
def zone_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone sizes of devices of many sizes."""
    orders = T.read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("device"), A.zone_size(F.col("o_orderkey") * 100_000_000).alias("zone_size"))


_DISTRIBUTED = """
, seg AS (SELECT segment_id, CAST(sum(record_len) AS BIGINT) AS logical FROM location GROUP BY segment_id),
sh AS (SELECT segment_id, logical, i, ((((logical + 1) // 2) + 4095) // 4096) * 4096 AS shard_size,
  CASE WHEN segment_id % 7 = i THEN 'missing' WHEN segment_id % 5 = i THEN 'unreadable' ELSE 'good' END AS state FROM (SELECT *, unnest(range(0, 3)) AS i FROM seg))"""


def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripes of k = 2, m = 1 over the segments; some shards are gone, some unreadable."""
    own = T.locations(T.chunk_refs(spark, sf_dir)).groupBy("segment_id").agg(F.sum("record_len").alias("logical"))
    rows = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    state = F.when(F.col("segment_id") % 7 == F.col("i"), "missing").when(F.col("segment_id") % 5 == F.col("i"), "unreadable").otherwise("good")
    return rows.withColumn("shard_size", A.shard_bytes(F.col("logical"), 2).cast("long")).withColumn("state", state)


@query(
    sql(
        f"""{_DISTRIBUTED}, p AS (SELECT segment_id, max(logical) AS logical, sum(CASE WHEN state <> 'missing' THEN shard_size ELSE 0 END) AS held,
  count(*) FILTER (state = 'missing') AS mi, count(*) FILTER (state = 'unreadable') AS un, count(*) FILTER (state = 'good') AS good FROM sh GROUP BY segment_id)
SELECT count(*) AS stripes, CAST(sum(logical) AS BIGINT) AS logical_bytes, CAST(sum(held) AS BIGINT) AS shard_bytes, CAST(sum(logical) * 3 AS BIGINT) AS mirrored_bytes,
  CAST(greatest(sum(logical) * 3 - sum(held), 0) AS BIGINT) AS saved_bytes, CAST(sum(mi) AS BIGINT) AS missing, CAST(sum(un) AS BIGINT) AS unreadable, count(*) FILTER (good < 2) AS unrecoverable FROM p""",
        "location",
    )
)
def stripe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What striping saves and what is damaged."""
    return stripes.status(shard_states(spark, sf_dir), 2, 3)


@query(sql(f"{_DISTRIBUTED} SELECT segment_id, i AS shard_index, i AS vdev_id FROM sh WHERE state = 'missing'", "location"))
def stripe_shards_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that a descriptor names and nobody has."""
    states = shard_states(spark, sf_dir)
    descriptors = states.select("segment_id").distinct().withColumn("devices", F.array(*[F.lit(i) for i in range(3)]))
    present = states.where("state <> 'missing'").select("segment_id", F.col("i").alias("shard_index"))
    return stripes.missing_shards(descriptors, present).select("segment_id", "shard_index", "vdev_id")


@query(sql("SELECT ino AS segment_id, CAST(3 AS INTEGER) AS good, true AS ok, CAST(octet_length(bytes) AS BIGINT) AS body_bytes FROM blob WHERE octet_length(bytes) > 0", "blob"))
def stripe_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob striped at 3 + 2, its first and last shard lost, and rebuilt."""
    bodies = T.blobs(spark, sf_dir).select(F.col("ino").alias("segment_id"), F.col("bytes").alias("body")).where("octet_length(body) > 0")
    shards = stripes.encoded(bodies, 3, 2).where("shard_index NOT IN (0, 4)")
    return stripes.reconstructed(shards, 3, 2)


@query("SELECT s_suppkey AS pool, max(slot) AS generation FROM (SELECT s_suppkey, unnest(range(0, 16)) AS slot FROM supplier) WHERE (s_suppkey + slot) % 3 <> 0 GROUP BY s_suppkey")
def superblock_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 16 slots the newest valid one; slots whose checksum fails are passed over."""
    ring = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("generation"))
    body = F.encode(F.concat_ws(":", "pool", "generation"), "utf-8")
    stored = ring.withColumn("body", body).withColumn("checksum", A.header_checksum(body) + ((F.col("pool") + F.col("generation")) % 3 == 0).cast("long"))
    valid = A.header_checksum(F.col("body")) == F.col("checksum")
    return slots.newest_valid(stored, "pool", valid).select("pool", "generation")


_MEMBERS = "SELECT s_nationkey AS pool, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 + (CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS vdev_id, 3 AS vdev_count, CAST(s_suppkey % 2 AS BIGINT) AS generation, 'dev' || s_suppkey AS path, s_acctbal < 0 AS faulted, s_suppkey % 2 AS lag, CAST(1000000 * (s_suppkey % 9 + 1) AS BIGINT) AS total, CAST(1000 * (s_suppkey % 9 + 1) AS BIGINT) AS free FROM supplier"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as devices of their nation's pool; every fifth claims the slot of its neighbour."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    size = F.col("s_suppkey") % 9 + 1
    return T.read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pool"),
        (place + (F.col("s_suppkey") % 5 == 0).cast("int")).cast("int").alias("vdev_id"),
        F.lit(3).alias("vdev_count"),
        (F.col("s_suppkey") % 2).alias("generation"),
        F.concat(F.lit("dev"), F.col("s_suppkey").cast("string")).alias("path"),
        (F.col("s_acctbal") < 0).alias("faulted"),
        (F.col("s_suppkey") % 2).alias("lag"),
        (size * 1_000_000).alias("total"),
        (size * 1_000).alias("free"),
    )


@query(f"""WITH m AS ({_MEMBERS}), p AS (SELECT pool, max(vdev_count) AS count, list_sort(list(DISTINCT vdev_id)) AS members FROM m GROUP BY pool)
SELECT pool, count, array_to_string(members, ',') AS members, array_to_string(list_filter([0, 1, 2], lambda x: NOT list_contains(members, x)), ',') AS missing FROM p""")
def discover_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools among candidate devices and their missing slots."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return slots.discovered(members(spark, sf_dir)).select("pool", "count", text("members"), text("missing"))


@query(f"""WITH m AS ({_MEMBERS})
SELECT path, CASE WHEN count(*) OVER (PARTITION BY pool, vdev_id) > 1 THEN 'duplicate' WHEN generation < max(generation) OVER (PARTITION BY pool) THEN 'behind' END AS finding FROM m""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that can't be trusted."""
    labelled = members(spark, sf_dir).withColumns({"pool_uuid": F.md5(F.col("pool").cast("string")), "position": F.col("path")})
    return slots.membership(labelled, slots.foreign()).select("path", "finding")


@query(f"""WITH m AS ({_MEMBERS}), s AS (SELECT pool, unnest(range(0, 3)) AS v FROM (SELECT DISTINCT pool FROM m))
SELECT s.pool, s.v AS vdev_id, CASE WHEN m.path IS NULL THEN 'absent' WHEN faulted THEN 'faulted' WHEN lag > 0 THEN 'catching-up' ELSE 'online' END AS health FROM s LEFT JOIN m ON m.pool = s.pool AND m.vdev_id = s.v""")
def vdev_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of every slot."""
    return slots.slot_health(members(spark, sf_dir), F.max("vdev_count"))


@query(f"WITH m AS ({_MEMBERS}) SELECT pool, min(total) AS total, min(free) AS free FROM m GROUP BY pool")
def statfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity of mirrored pools."""
    return slots.capacity(members(spark, sf_dir))
