"""Shapes and descriptors, client attributes, streams of old epochs, dirty marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import modes
from siltstone.operators import delta, stripes
from siltstone.plans.catalogue import query
from siltstone.plans.sets.history import epoch_records
from siltstone.sources import tables as T

sql = T.with_tables


@query("SELECT p_partkey AS pool, k, m, (k = 0 AND m = 0) OR (k >= 2 AND m >= 1 AND k + m <= 255) AS valid FROM (SELECT p_partkey, p_size % 5 * (p_partkey % 60) AS k, p_partkey % 7 * (p_size % 3) AS m FROM part)")
def stripe_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripe policies that a pool may be given."""
    k = F.col("p_size") % 5 * (F.col("p_partkey") % 60)
    m = F.col("p_partkey") % 7 * (F.col("p_size") % 3)
    shapes = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pool"), k.alias("k"), m.alias("m"))
    return shapes.withColumn("valid", stripes.is_valid_shape(F.col("k"), F.col("m")))


@query("""WITH d AS (SELECT o_orderkey AS segment_id, CAST(o_custkey % 5 AS BIGINT) AS k, CAST(o_orderkey % 3 AS BIGINT) AS m, 1 + o_custkey % 7 AS devices,
  CASE o_orderkey % 11 WHEN 0 THEN 0 WHEN 1 THEN 4294967296 ELSE CAST(o_custkey AS BIGINT) * 64 END AS size, CAST(o_orderkey AS BIGINT) * 8 AS logical, CAST(o_custkey % 6 AS BIGINT) - 1 AS i FROM orders)
SELECT segment_id, coalesce(k >= 2 AND m >= 1 AND devices = k + m AND i >= 0 AND i < k + m AND size > 0 AND size <= 4294967295 AND logical <= size * k, false) AS sane FROM d""")
def descriptor_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors as they come off a damaged disk, and which of them can be acted on."""
    key, customer = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    size = F.when(key % 11 == 0, 0).when(key % 11 == 1, 1 << 32).otherwise(customer * 64)
    devices = F.sequence(F.lit(1), (1 + customer % 7).cast("int"))
    sane = stripes.is_sane(customer % 5, key % 3, devices, size, key * 8, customer % 6 - 1)
    return T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), sane.alias("sane"))


@query("""WITH f AS (SELECT o_orderkey AS ino, 32768 + 384 + o_orderkey % 64 AS mode, CAST(o_custkey AS BIGINT) * 37 AS size, CAST(o_orderkey AS BIGINT) * 1000 - 500000 AS seconds FROM orders)
SELECT ino, mode & 4095 AS perm, (size + 511) // 512 AS blocks, (size + 511) // 512 * 512 AS used, greatest(seconds, 0) AS net_seconds FROM f""")
def client_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions, space and times of inodes as clients see them."""
    key, size = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long") * 37
    seen = modes.client_attributes(F.lit(32768 + 384) + key % 64, size, key * 1000 - 500000)
    return T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), *[c.alias(name) for name, c in seen.items()])


@query(sql("""SELECT stream, count(*) AS segments, count(*) FILTER (old) AS old FROM (
SELECT stream, shard, segment_id, bool_or(old) AS old FROM (
  SELECT CASE WHEN shard < 12 THEN 'data' ELSE 'meta' END AS stream, 0 AS shard, segment_id, segment_id % 4 = 0 AS old FROM location
  UNION ALL SELECT 'delta', shard_id, segment_id, epoch % 300 = 0 FROM delta
  UNION ALL SELECT 'stripes', 0, segment_id, segment_id % 3 = 0 OR segment_id % 4 = 0 FROM location WHERE shard < 12 AND segment_id % 2 = 0
) GROUP BY stream, shard, segment_id) GROUP BY stream""", "location", "delta"))
def stream_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of an old epoch in all four streams; every third striped segment can't be read, and counts as old."""
    segment = lambda shard: F.struct(shard.cast("int").alias("shard"), F.col("segment_id").cast("long").alias("id"))
    held = epoch_records(spark, sf_dir)
    log = T.delta_log(spark, sf_dir).withColumn("of", F.when(F.col("epoch") % 300 == 0, 1).otherwise(2))
    none, target = F.lit(0), 2
    body = F.when(F.col("segment_id") % 3 != 0, F.col("epoch"))  # null where too few shards are left
    striped = held.where((F.col("stream") == "data") & (F.col("segment_id") % 2 == 0))
    rows = (
        held.select("stream", segment(none).alias("segment_id"), F.col("epoch").cast("int").alias("epoch"))
        .unionByName(log.select(F.lit("delta").alias("stream"), segment(F.col("shard_id")).alias("segment_id"), F.col("of").cast("int").alias("epoch")))
        .unionByName(striped.select(F.lit("stripes").alias("stream"), segment(none).alias("segment_id"), body.cast("int").alias("epoch")))
    )
    return delta.census(rows, target)


@query("""WITH a AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS generation FROM orders),
b AS (SELECT generation, min(generation) FILTER (generation % 3 <> 0) OVER (ORDER BY generation ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS upto FROM a)
SELECT upto AS generation, count(DISTINCT o_custkey) AS rewritten FROM orders JOIN b ON year(o_orderdate) * 12 + month(o_orderdate) = b.generation GROUP BY upto""")
def dirty_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V8: inodes that each monthly checkpoint rewrites; every third fails and gives its marks to the next."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    marks = T.read(spark, sf_dir, "orders").select(month.alias("generation"), F.col("o_custkey").alias("ino"))
    attempts = marks.select("generation").distinct().withColumn("published", F.col("generation") % 3 != 0)
    return delta.drained(marks, attempts).groupBy(F.col("by").alias("generation")).agg(F.count(F.lit(1)).alias("rewritten"))
