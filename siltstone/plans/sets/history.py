"""Versions, snapshots, the change log, key epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.functions import modes
from siltstone.operators import delta
from siltstone.plans.catalogue import query
from siltstone.sources import tables as T

sql = T.with_tables


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects of monthly versions: an order is there from its month on."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", month.alias("month"))


_GEN = "gen AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


@query(f"WITH {_GEN}, v AS (SELECT month, count(*) AS added FROM gen GROUP BY month) SELECT month AS version, CAST(sum(added) OVER (ORDER BY month) AS BIGINT) AS objects FROM v")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: how many objects a reader of each version sees."""
    added = generations(spark, sf_dir).groupBy(F.col("month").alias("version")).agg(F.count(F.lit(1)).alias("added"))
    seen = F.sum("added").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0))  # one row a month
    return added.select("version", seen.alias("objects"))


@query(sql("SELECT dir AS snapshot, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS n_bytes FROM (SELECT content_hash, min(dir) AS dir, min(len) AS len FROM chunk_ref GROUP BY content_hash HAVING count(DISTINCT dir) = 1) GROUP BY dir", "chunk_ref"))
def snapshot_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: what deleting each snapshot (a directory's root) would free."""
    per = T.chunk_refs(spark, sf_dir).groupBy("content_hash", "dir").agg(F.min("len").alias("len"))
    alone = per.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("dir").alias("snapshot"), F.min("len").alias("len"))
    return alone.where("n = 1").groupBy("snapshot").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("n_bytes"))


@query("SELECT root, count(*) AS names FROM (SELECT sha256(source) AS root, source AS name FROM documents UNION SELECT sha256(lang), lang FROM documents) GROUP BY root")
def live_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of the current tree and of every snapshot."""
    docs = T.read(spark, sf_dir, "documents")
    named = lambda c: docs.select(F.sha2(F.col(c), 256).alias("root"), F.col(c).alias("name"))
    return named("source").unionByName(named("lang")).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("names"))


@query("""WITH e AS (SELECT source AS name, sha256(source) AS root FROM documents GROUP BY source), s AS (SELECT '.staging/' || name || '/' || CASE WHEN name LIKE '%1' THEN 'gone' ELSE root END AS staged, name, root FROM e)
SELECT staged FROM s WHERE staged <> '.staging/' || name || '/' || root""")
def orphaned_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged entries whose snapshot has another root by now."""
    entries = T.read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().withColumn("root", F.sha2("name", 256))
    old = F.when(F.col("name").endswith("1"), "gone").otherwise(F.col("root"))
    staged = entries.select(A.staging_name(".staging/", F.col("name"), old).alias("staged"))
    current = entries.select(A.staging_name(".staging/", F.col("name"), F.col("root")).alias("staged"))
    return staged.join(current, "staged", "left_anti")


@query(sql("SELECT shard_id, ino, new_object_hash, epoch, segment_id FROM delta", "delta"))
def delta_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a commit of its shard, epochs without gaps."""
    return T.delta_log(spark, sf_dir).drop("event_id")


_MARKS = ", wm AS (SELECT shard_id, max(epoch) // 2 AS watermark FROM delta GROUP BY shard_id)"


def watermarks(log: DataFrame) -> DataFrame:
    """Half of each shard's epochs were checkpointed."""
    return log.groupBy("shard_id").agg(F.floor(F.max("epoch") / 2).alias("watermark"))


@query(sql(f"{_MARKS} SELECT shard_id, ino, arg_max(new_object_hash, epoch) AS new_object_hash, max(epoch) AS epoch FROM delta JOIN wm USING (shard_id) WHERE epoch > watermark GROUP BY shard_id, ino", "delta"))
def delta_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that replay above the watermarks leads to."""
    log = T.delta_log(spark, sf_dir)
    return delta.replayed(log, watermarks(log))


@query(sql(f"{_MARKS} SELECT shard_id, segment_id FROM delta JOIN wm USING (shard_id) GROUP BY shard_id, segment_id HAVING max(epoch) <= any_value(watermark) AND min(event_id) % 11 <> 0", "delta"))
def delta_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log segments that can go; one whose first event is unreadable (a multiple of 11) stays."""
    log = T.delta_log(spark, sf_dir)
    first = F.min("event_id").over(Window.partitionBy("shard_id", "segment_id"))
    marked = log.withColumn("readable", ~((F.col("event_id") == first) & (F.col("event_id") % 11 == 0)))
    return delta.truncatable(marked, watermarks(log))


@query(sql("SELECT shard_id, segment_id, epoch AS \"offset\" FROM delta", "delta"))
def delta_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as two devices hold them, each replayed once."""
    log = T.delta_log(spark, sf_dir).select("shard_id", "segment_id", F.col("epoch").alias("offset"))
    return delta.once(log.unionByName(log))


@query(sql("SELECT shard_id, segment_id AS generation, watermark, lag(watermark) OVER (PARTITION BY shard_id ORDER BY segment_id) AS through FROM (SELECT shard_id, segment_id, max(epoch) AS watermark FROM delta GROUP BY shard_id, segment_id)", "delta"))
def watermark_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published watermarks, and the older one that truncation goes through."""
    published = T.delta_log(spark, sf_dir).groupBy("shard_id", F.col("segment_id").alias("generation")).agg(F.max("epoch").alias("watermark"))
    return delta.previous_watermarks(published)


@query(sql("SELECT shard, coalesce(min(segment_id) FILTER (state = 'open'), max(segment_id) + 1) AS upto FROM (SELECT shard, segment_id, CASE WHEN segment_id = max(segment_id) OVER (PARTITION BY shard) AND shard % 2 = 0 THEN 'open' ELSE 'sealed' END AS state FROM (SELECT DISTINCT shard, segment_id FROM location)) GROUP BY shard", "location"))
def dedup_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an incremental scan of each shard may go; even shards have an open segment."""
    own = T.locations(T.chunk_refs(spark, sf_dir)).select("shard", "segment_id").distinct()
    last = F.col("segment_id") == F.max("segment_id").over(Window.partitionBy("shard"))
    return delta.scan_cursor(own.withColumn("state", F.when(last & (F.col("shard") % 2 == 0), "open").otherwise("sealed")))


_FLAGS = ", r AS (SELECT content_hash, segment_id, CASE WHEN shard < 12 THEN 'data' ELSE 'meta' END AS stream, (32768 + CASE WHEN segment_id % 4 = 0 THEN 1 ELSE 2 END) & 32767 AS epoch FROM location)"


def epoch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with flags: all sealed, every fourth segment still under key epoch 1."""
    flags = F.lit(modes.SEALED) + F.when(F.col("segment_id") % 4 == 0, 1).otherwise(2)
    rows = T.locations(T.chunk_refs(spark, sf_dir)).withColumn("flags", flags)
    stream = F.when(F.col("shard") < 12, "data").otherwise("meta")
    return rows.where(modes.is_sealed(F.col("flags"))).select("content_hash", "segment_id", stream.alias("stream"), modes.epoch_of(F.col("flags")).alias("epoch"))


@query(sql(f"{_FLAGS} SELECT stream, count(*) AS segments, count(*) FILTER (old) AS old FROM (SELECT stream, segment_id, bool_or(epoch <> 2) AS old FROM r GROUP BY stream, segment_id) GROUP BY stream", "location"))
def epoch_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that hold records of an old key epoch."""
    return delta.census(epoch_records(spark, sf_dir), 2)


@query(sql(f"{_FLAGS} SELECT content_hash FROM r WHERE epoch <> 2 AND content_hash IN (SELECT content_hash FROM chunk_ref WHERE lang IS DISTINCT FROM 'es')", "location"))
def unconverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable chunks that a re-key still has to rewrite."""
    reachable = T.chunk_refs(spark, sf_dir).where("lang IS DISTINCT FROM 'es'").select("content_hash").distinct()
    return delta.unconverted(reachable, epoch_records(spark, sf_dir), 2)


@query(sql("SELECT ino, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY ino ORDER BY ordinal) AS k FROM chunk_ref WHERE ordinal >= 1 AND ordinal % 2 = 0) WHERE k <= 256", "chunk_ref"))
def rekey_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's next 256 chunks of the old epoch from its resume point (a batch is the feature)."""
    chunks = T.chunk_refs(spark, sf_dir).withColumn("epoch", F.col("ordinal") % 2 + 1).withColumn("resume", F.lit(1))
    return delta.next_batch(chunks, 2).select("ino", "ordinal")


@query(sql("SELECT content_hash AS old, sha256(encode('key-2') || any_value(payload)) AS new FROM chunk_ref GROUP BY content_hash", "chunk_ref"))
def rekey_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old to new address of every distinct chunk, computed once each."""
    chunks = T.chunk_refs(spark, sf_dir, keep_payload=True).select("content_hash", A.keyed_address(F.lit(b"key-2"), F.col("payload")).alias("new"))
    return chunks.groupBy(F.col("content_hash").alias("old")).agg(F.min("new").alias("new"))
