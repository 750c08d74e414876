"""Changes of the index and of small tables: upserts, conditional deletes and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import store
from siltstone.plans.catalogue import query
from siltstone.plans.sets.devices import copies
from siltstone.sources import tables as T

sql = T.with_tables

#: Fixed value: the pseudo-device under which stripes are indexed.
STRIPED = 65535


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir).select("content_hash", "vdev_id", "segment_id", "offset", "len")


@query(sql('SELECT content_hash, vdev_id, CASE WHEN shard < 8 THEN segment_id + 500000 ELSE segment_id END AS segment_id FROM replica', "replica"))
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the first eight shards put again at new places; the newer version wins."""
    old = copies(spark, sf_dir).select("content_hash", "vdev_id", "segment_id", "shard", F.lit(1).alias("version"))
    new = old.where("shard < 8").withColumn("segment_id", F.col("segment_id") + 500_000).withColumn("version", F.lit(2))
    return store.upserted(old, new, ["content_hash", "vdev_id"]).select("content_hash", "vdev_id", "segment_id")


@query(sql('SELECT content_hash, vdev_id, segment_id, "offset", len FROM replica WHERE segment_id % 1099511627776 <> 0', "replica"))
def forget_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, K8: the first segment of every shard is gone; what pointed there is forgotten."""
    index = index_of(spark, sf_dir)
    gone = index.where("segment_id % 1099511627776 = 0").select("segment_id").distinct()
    return store.forgotten(index, gone)


@query(
    sql(
        f"""SELECT content_hash, vdev_id, segment_id, "offset", len FROM replica WHERE segment_id % 1099511627776 <> 0
UNION ALL SELECT content_hash, {STRIPED}, segment_id, min("offset"), min(len) FROM replica WHERE segment_id % 1099511627776 = 0 GROUP BY content_hash, segment_id""",
        "replica",
    )
)
def restripe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the first segment of every shard moved from mirrors to a stripe."""
    index = index_of(spark, sf_dir)
    cold = index.where("segment_id % 1099511627776 = 0").select("segment_id").distinct()
    return store.restriped(index, cold, STRIPED)


@query(sql("SELECT content_hash, min(CASE WHEN lang = 'en' THEN 'kept' ELSE 'put' END) AS how FROM chunk_ref GROUP BY content_hash", "chunk_ref"))
def put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects put only where their hash isn't known yet."""
    refs = T.chunk_refs(spark, sf_dir)
    distinct = lambda cond, how: refs.where(cond).select("content_hash").distinct().withColumn("how", F.lit(how))
    return store.absent_only(distinct("lang = 'en'", "kept"), distinct("lang <> 'en' OR lang IS NULL", "put"), ["content_hash"])


@query("SELECT s_suppkey AS device FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND s_acctbal >= 0")
def blank_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices without any record of another pool and without a claim on them."""
    used = T.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_suppkey").alias("device"))
    devices = T.read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("device"))
    return devices.join(used.distinct(), "device", "left_anti")


@query("SELECT DISTINCT o_custkey AS ino FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def orphaned_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of inodes that no longer live."""
    pinned = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("ino")).distinct()
    live = T.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ino"))
    return pinned.join(live, "ino", "left_anti")


@query("SELECT n_nationkey AS name, CASE WHEN n_regionkey = 1 THEN 'new' || n_nationkey ELSE 'root' || n_regionkey END AS root FROM nation")
def replace_snapshot_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, V8: entries replaced only where name and root are still the expected ones."""
    nations = T.read(spark, sf_dir, "nation")
    entries = nations.select(F.col("n_nationkey").alias("name"), F.concat(F.lit("root"), F.col("n_regionkey").cast("string")).alias("root"))
    changes = nations.select(
        F.col("n_nationkey").alias("name"), F.lit("root1").alias("expected"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("new")
    )
    return store.replaced_if(entries, changes, ["name"], "expected", "root")


@query(sql("SELECT segment_id, count(*) AS records FROM location WHERE shard = 3 GROUP BY segment_id", "location"))
def owner_shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that one shard owns, found by the header alone (the filter goes below the hash's payload)."""
    return T.locations(T.chunk_refs(spark, sf_dir)).where("shard = 3").groupBy("segment_id").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT s_nationkey AS pool, CASE WHEN max(s_suppkey) % 2 = 0 THEN 'index' ELSE 'rescan' END AS source FROM supplier GROUP BY s_nationkey")
def mount_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool's index is trusted if its generation is the newest commit's, else everything is scanned."""
    suppliers = T.read(spark, sf_dir, "supplier")
    commits = suppliers.groupBy(F.col("s_nationkey").alias("pool")).agg(F.max("s_suppkey").alias("generation"))
    index = suppliers.where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("pool")).agg(F.max("s_suppkey").alias("indexed"))
    trusted = F.coalesce(F.col("generation") == F.col("indexed"), F.lit(False))
    return commits.join(index, "pool", "left").select("pool", F.when(trusted, "index").otherwise("rescan").alias("source"))
