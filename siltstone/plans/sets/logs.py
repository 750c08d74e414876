"""Operation logs and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import namespace
from siltstone.plans.catalogue import query
from siltstone.sources import tables as T
from siltstone.sources import work
from siltstone.streaming import streams

sql = T.with_tables


def _path(n: int) -> Column:
    """A name in a tree of three levels, two or three names each, drawn from the event's number."""
    drawn = F.col("event_id") * n
    digit = lambda by, of: F.pmod(F.floor(drawn / by), F.lit(of)).cast("string")
    top, middle, low = F.concat(F.lit("/n"), digit(3, 2)), F.concat(F.lit("/m"), digit(6, 3)), F.concat(F.lit("/k"), digit(18, 2))
    depth = F.pmod(drawn, F.lit(3))
    return F.when(depth == 0, top).when(depth == 1, F.concat(top, middle)).otherwise(F.concat(top, middle, low))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations of their user's tree: names, offsets and lengths from the event."""
    ops = F.array(*[F.lit(o) for o in ("write", "mkdir", "write", "rename", "link", "truncate", "fallocate", "unlink", "rmdir", "symlink", "write")])
    return T.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"),
        F.row_number().over(_by_user()).alias("seq"),
        F.element_at(ops, (F.pmod(F.col("event_id") * 7, F.size(ops)) + 1).cast("int")).alias("op"),
        _path(5).alias("path"),
        _path(7).alias("target"),
        (F.col("event_id") * 37 % 8192).alias("offset"),
        (F.col("event_id") * 13 % 4096).alias("len"),
        F.encode(F.coalesce("props", F.lit("")), "utf-8").alias("data"),
        F.element_at(F.array(F.lit("allocate"), F.lit("punch"), F.lit("zero")), (F.col("event_id") % 3 + 1).cast("int")).alias("mode"),
        (F.col("event_id") % 2 == 0).alias("keep_size"),
    )


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query()
def namespace_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees that the operation logs lead to."""
    return namespace.replayed(operation_log(spark, sf_dir))


@query()
def namespace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M8: operations by what became of them."""
    return namespace.outcomes(operation_log(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _written(rows: DataFrame, folder: str, key: str, order: str) -> str:
    """A log as files, as many as its size asks for; what has one key is in one file and in order."""
    rows.repartition(key).sortWithinPartitions(order).write.parquet(folder)
    return folder


@query(sql("SELECT shard_id, ino, max(epoch) AS epoch, arg_max(new_object_hash, epoch) AS new_object_hash FROM delta GROUP BY shard_id, ino", "delta"))
def delta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state, kept up by a stream over the log's files."""
    folder, log = work.fresh(spark, "streams"), T.delta_log(spark, sf_dir).select("shard_id", "ino", "epoch", "new_object_hash")
    stream = streams.source(spark, _written(log, f"{folder}/log", "shard_id", "epoch"), log)
    return streams.latest_now(stream, folder, ["shard_id", "ino"], "epoch")


@query(sql("SELECT shard_id, event_id, epoch FROM delta", "delta"))
def commit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs handed out by a counter that is state of each shard."""
    folder = work.fresh(spark, "streams")
    ops = T.read(spark, sf_dir, "events").select("event_id", "ts", F.pmod("user_id", F.lit(T.SHARDS)).cast("int").alias("shard_id"))
    stream = streams.committed(streams.source(spark, _written(ops, f"{folder}/log", "shard_id", "ts"), ops))
    return streams.available_now(stream, folder)


@query("SELECT DISTINCT sha256(coalesce(props, '')) AS content_hash FROM events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes the first time they come, over a stream."""
    folder = work.fresh(spark, "streams")
    rows = T.read(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.coalesce("props", F.lit("")).cast("binary"), 256).alias("content_hash")
    )
    stream = streams.first_seen(streams.source(spark, _written(rows, f"{folder}/log", "content_hash", "ts"), rows), "ts", "3650 days")
    return streams.available_now(stream.select("content_hash"), folder)


@query("""WITH e AS (SELECT user_id % 16 AS shard_id, ts FROM events), m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY shard_id ORDER BY ts) + INTERVAL 30 SECOND THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY shard_id ORDER BY ts) AS g FROM m)
SELECT CAST(shard_id AS INTEGER) AS shard_id, CAST(epoch_us(min(ts)) AS BIGINT) AS opened, CAST(epoch_us(max(ts)) + 30000000 AS BIGINT) AS sealed, count(*) AS records FROM g GROUP BY shard_id, g""")
def idle_seal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of 30 seconds by shard, over a stream."""
    folder = work.fresh(spark, "streams")
    rows = T.read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(T.SHARDS)).cast("int").alias("shard_id"), F.col("ts").cast("timestamp").alias("ts"))
    # a last record, of no shard, moves the watermark past all others, so that their segments are sealed
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 7300 DAYS")).alias("ts")).select(F.lit(-1).alias("shard_id"), "ts")
    end.write.mode("append").parquet(_written(rows, f"{folder}/log", "shard_id", "ts"))
    found = streams.idle_seals(streams.source(spark, f"{folder}/log", rows), "ts", "30 seconds", "3650 days")
    out = streams.available_now(found, folder).where("shard_id >= 0")
    return out.select("shard_id", F.unix_micros("opened").alias("opened"), F.unix_micros("sealed").alias("sealed"), "records")


@query(
    """
WITH w AS (SELECT user_id AS ino, event_id AS seq, (event_id % 7) * 8 AS "offset", 8 AS len FROM events),
b AS (SELECT *, CASE WHEN "offset" = lag("offset" + len) OVER (PARTITION BY ino ORDER BY seq) THEN 0 ELSE 1 END AS begins FROM w)
SELECT ino, seq, CAST(sum(begins) OVER (PARTITION BY ino ORDER BY seq) AS BIGINT) AS session FROM b
"""
)
def append_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append sessions with the expected offset as state."""
    folder, offset = work.fresh(spark, "streams"), (F.col("event_id") % 7) * 8
    writes = T.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("ino"), F.col("event_id").alias("seq"), offset.alias("offset"), F.lit(8).cast("long").alias("len")
    )
    stream = streams.append_sessions(streams.source(spark, _written(writes, f"{folder}/log", "ino", "seq"), writes))
    return streams.available_now(stream, folder)
