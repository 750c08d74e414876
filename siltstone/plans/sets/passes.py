"""Maintenance passes and attribute changes, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import attributes
from siltstone.plans import maintenance
from siltstone.plans.catalogue import query
from siltstone.plans.sets.devices import copies, vdevs
from siltstone.plans.sets.layout import live_hashes
from siltstone.sources import tables as T

sql = T.with_tables

_SWEPT = """
, live AS (SELECT DISTINCT content_hash FROM chunk_ref WHERE lang IS DISTINCT FROM 'es'),
seg AS (SELECT segment_id, min(shard) AS shard, sum(record_len) + 4160 AS total, coalesce(sum(record_len) FILTER (content_hash IN (SELECT content_hash FROM live)), 0) AS alive FROM location GROUP BY segment_id),
cand AS (SELECT segment_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY segment_id DESC) AS age FROM seg) WHERE age > 1 AND alive < 0.95 * total),
aft AS (SELECT * FROM location WHERE segment_id NOT IN (SELECT segment_id FROM cand) OR content_hash IN (SELECT content_hash FROM live))"""


def _collected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live, location, _ = live_hashes(spark, sf_dir)
    records = location.select("content_hash", "shard", "record_len", "segment_id", "offset")
    return records, maintenance.collect_garbage(records, live, live.limit(0), 0.95, 1, T.SEGMENT_CAP)


@query(sql(f"{_SWEPT} SELECT shard, count(*) AS records, CAST(sum(record_len) AS BIGINT) AS n_bytes FROM aft GROUP BY shard", "location"))
def gc_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mark-sweep-repack pass leaves in each shard."""
    after = _collected(spark, sf_dir)[1]
    return after.groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.sum("record_len").alias("n_bytes"))


@query(sql("SELECT vdev_id, count(*) AS records, count(*) FILTER (good) AS good FROM (SELECT v AS vdev_id, true AS good FROM (SELECT DISTINCT content_hash FROM replica WHERE good), (SELECT unnest(range(0, 3)) AS v) UNION ALL SELECT vdev_id, good FROM replica WHERE content_hash NOT IN (SELECT content_hash FROM replica WHERE good)) GROUP BY vdev_id", "replica"))
def converge_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device after a scrub and a resilver."""
    after = maintenance.converge(copies(spark, sf_dir), vdevs(spark))
    return after.groupBy("vdev_id").agg(F.count(F.lit(1)).alias("records"), F.count_if("good").alias("good"))


@query(sql("SELECT v AS vdev_id, count(*) AS records, CAST(sum(record_len) AS BIGINT) AS n_bytes FROM (SELECT content_hash, min(record_len) AS record_len FROM replica WHERE good GROUP BY content_hash) s, (SELECT unnest(range(0, 3)) AS v) WHERE (s.content_hash, v) NOT IN (SELECT content_hash, vdev_id FROM replica WHERE good) GROUP BY v", "replica"))
def converge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that pass writes to each device."""
    return maintenance.written_by(copies(spark, sf_dir), vdevs(spark))


@query(sql("SELECT ino, sha256(string_agg(sha256(encode('key-2') || payload), '' ORDER BY ordinal)) AS list_hash, count(*) AS converted, 0 AS \"left\" FROM chunk_ref GROUP BY ino", "chunk_ref"))
def rekey_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's chunk list under the second epoch's addresses."""
    from siltstone.plans.sets.history import rekey_memo

    return maintenance.rekeyed(T.chunk_refs(spark, sf_dir), rekey_memo(spark, sf_dir))


@query("SELECT c_custkey AS ino, CASE WHEN c_nationkey % 2 = 0 THEN ((33188 & ~4095) | 384) ELSE 33188 END AS mode, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey ELSE 0 END AS uid, CASE WHEN c_nationkey % 2 = 0 OR c_nationkey % 3 = 0 THEN 9 ELSE 1 END AS ctime FROM customer")
def set_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: modes and owners changed for some inodes; ctime moves with them."""
    customers = T.read(spark, sf_dir, "customer")
    zero = F.lit(0)
    inodes = customers.select(
        F.col("c_custkey").alias("ino"), F.lit(33188).cast("long").alias("mode"), zero.alias("uid"), zero.alias("gid"), zero.alias("mtime"), F.lit(1).alias("ctime")
    )
    nation = F.col("c_nationkey")
    changes = customers.where((nation % 2 == 0) | (nation % 3 == 0)).select(
        F.col("c_custkey").alias("ino"),
        F.when(nation % 2 == 0, 384).cast("long").alias("new_mode"),
        F.when(nation % 3 == 0, nation).alias("new_uid"),
        F.lit(None).cast("int").alias("new_gid"),
        F.lit(None).cast("int").alias("new_mtime"),
    )
    return attributes.changed(inodes, changes, F.lit(9)).select("ino", "mode", "uid", "ctime")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' AND k THEN 'exists' WHEN event_type = 'click' AND NOT k THEN 'missing' ELSE 'ok' END AS outcome FROM (SELECT event_type, list_contains(json_keys(props), event_type) OR event_id % 4 = 0 AS k FROM events WHERE props IS NOT NULL)) GROUP BY outcome")
def set_xattrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes set with create and replace flags; events' properties are what is there."""
    events = T.read(spark, sf_dir, "events").where("props IS NOT NULL")
    own = F.from_json("props", "map<string,string>")
    marked = F.when((F.col("event_id") % 4 == 0) & ~F.map_contains_key(own, F.col("event_type")), F.map_concat(own, F.create_map("event_type", F.lit("x")))).otherwise(own)
    current = events.select(F.col("event_id").alias("ino"), marked.alias("xattrs"))
    flag = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "replace")
    sets = events.select(F.col("event_id").alias("ino"), F.col("event_type").alias("name"), F.lit("v").alias("value"), flag.alias("flag"))
    return attributes.set_outcomes(current, sets).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.s_suppkey AS asked, n_nationkey AS found FROM supplier s LEFT JOIN nation ON n_nationkey = s_nationkey AND substr(n_name, 1, 1) = substr(s_name, 1, 1)")
def lookup_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child by parent and name, null where there is none."""
    asked = T.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.substring("s_name", 1, 1).alias("name"))
    entries = T.read(spark, sf_dir, "nation").select("n_nationkey", F.substring("n_name", 1, 1).alias("name"), F.col("n_nationkey").alias("found"))
    return asked.join(entries, ["n_nationkey", "name"], "left").select(F.col("s_suppkey").alias("asked"), "found")


@query("SELECT vdev_id, '{\"vdev\":' || vdev_id || ',\"records\":' || n || '}' AS message FROM (SELECT s_nationkey AS vdev_id, count(*) AS n FROM supplier GROUP BY s_nationkey)")
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status report as JSON messages."""
    per = T.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("vdev_id")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("vdev_id", F.to_json(F.struct(F.col("vdev_id").alias("vdev"), F.col("n").alias("records"))).alias("message"))
