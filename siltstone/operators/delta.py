"""The change log: commits with epochs, replay above a watermark, truncation, key epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def committed(ops: DataFrame, order: list[str]) -> DataFrame:
    """``ops`` (shard_id, ...) with epoch: one more with every commit of the shard."""
    w = Window.partitionBy("shard_id").orderBy(*order)
    return ops.withColumn("epoch", F.row_number().over(w).cast("long"))


def replayed(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """ino, new_object_hash, epoch: the latest entry of each inode above its shard's watermark.

    Entries that replicas of a log repeat fall together under ``max_by``.
    """
    above = log.join(watermarks, "shard_id").where(F.col("epoch") > F.col("watermark"))
    return above.groupBy("shard_id", "ino").agg(F.max_by("new_object_hash", "epoch").alias("new_object_hash"), F.max("epoch").alias("epoch"))


def truncatable(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """shard_id, segment_id of log segments in which all entries are covered and readable."""
    per = log.groupBy("shard_id", "segment_id").agg(F.max("epoch").alias("last"), F.bool_and("readable").alias("readable"))
    return per.join(watermarks, "shard_id").where((F.col("last") <= F.col("watermark")) & F.col("readable")).select("shard_id", "segment_id")


def once(entries: DataFrame) -> DataFrame:
    """Entries that several devices hold, one row for each place in the log."""
    return entries.dropDuplicates(["shard_id", "segment_id", "offset"])


def previous_watermarks(published: DataFrame) -> DataFrame:
    """shard_id, generation, watermark and the one before it: truncation goes through the older."""
    w = Window.partitionBy("shard_id").orderBy("generation")
    return published.withColumn("through", F.lag("watermark").over(w))


def scan_cursor(segments: DataFrame) -> DataFrame:
    """shard, upto: an incremental scan never passes the lowest open segment."""
    return segments.groupBy("shard").agg(
        F.coalesce(F.min(F.when(F.col("state") == "open", F.col("segment_id"))), F.max("segment_id") + 1).alias("upto")
    )


def census(records: DataFrame, target: int) -> DataFrame:
    """stream, segments, old: segments that hold a record of another epoch; a null epoch can't be read and is another."""
    per = records.groupBy("stream", "segment_id").agg(F.bool_or(~F.col("epoch").eqNullSafe(target)).alias("old"))
    return per.groupBy("stream").agg(F.count(F.lit(1)).alias("segments"), F.count_if("old").alias("old"))


def published_by(attempts: DataFrame) -> DataFrame:
    """generation, by: the first attempt from this one on that publishes, null while there is none (one row an attempt)."""
    later = Window.orderBy("generation").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return attempts.select("generation", F.min(F.when(F.col("published"), F.col("generation"))).over(later).alias("by"))


def drained(marks: DataFrame, attempts: DataFrame) -> DataFrame:
    """by, ino: the inodes that each published checkpoint rewrites, null for those still dirty.

    A mark (generation, ino) goes to the checkpoint that drains it. One that
    fails gives its marks back, so they go to the next that publishes. A mark
    is set before its write commits: repeats and marks without a write only
    rewrite the same inode.
    """
    return marks.join(published_by(attempts), "generation", "left").select("by", "ino").distinct()


def unconverted(reachable: DataFrame, records: DataFrame, target: int) -> DataFrame:
    """content_hash of reachable records that are still sealed under another epoch."""
    return records.where(F.col("epoch") != target).select("content_hash").distinct().join(reachable, "content_hash", "left_semi")


def next_batch(chunks: DataFrame, target: int, size: int = 256) -> DataFrame:
    """Each file's first ``size`` chunks of an old epoch, from its resume point on."""
    w = Window.partitionBy("ino").orderBy("ordinal")
    old = chunks.where((F.col("epoch") != target) & (F.col("ordinal") >= F.col("resume")))
    return old.withColumn("k", F.row_number().over(w)).where(F.col("k") <= size).drop("k")
