"""Maintenance passes: each takes the tables and gives the tables after it; running one twice changes nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import reach, replicas, stripes
from siltstone.sources import records
from siltstone.sources.tables import sums_before
from siltstone.sources.work import small_batches, written

#: A range of the running sum over copied records has 2 to this power segments.
RANGE_BITS = 12


def collect_garbage(records: DataFrame, live: DataFrame, pinned: DataFrame, below: float, newest: int, cap: int) -> DataFrame:
    """content_hash, shard, record_len, segment_id, offset after a mark-sweep-repack pass.

    What live or pinned records sparse segments have is copied forward into
    new segments behind each shard's last one; those segments then go.
    """
    totals = records.groupBy("segment_id").agg(F.min("shard").alias("shard"), (F.sum("record_len") + 4160).alias("total_bytes"))
    candidates = reach.sweep_candidates(totals, reach.live_bytes(live, records), below, newest).select("segment_id")
    # written, as the running sum reads it twice: by ranges of segments, and over the ranges' sums
    kept = written(reach.repack_keep(records, candidates, live, pinned), "repack-kept")
    last = records.groupBy("shard").agg(F.max("segment_id").alias("last"))
    ranged = kept.withColumn("range", F.shiftright("segment_id", RANGE_BITS))
    moved = sums_before(ranged, "shard", "range", ["segment_id", "offset"], "record_len", "at").join(last, "shard")
    columns = ["content_hash", "shard", "record_len", "segment_id", "offset"]
    moved = moved.withColumn("segment_id", F.col("last") + 1 + F.floor(F.col("at") / cap)).withColumn("offset", F.col("at") % cap)
    staying = records.join(candidates, "segment_id", "left_anti")
    return staying.select(*columns).unionByName(moved.select(*columns))


def converge(copies: DataFrame, devices: DataFrame) -> DataFrame:
    """content_hash, vdev_id, good after a scrub and a resilver: every hash with one good copy has one on every device.

    Copies of hashes without any good one stay as they are.
    """
    sound = copies.where("good").select("content_hash").distinct()
    healed = replicas.on_every_device(sound, devices).withColumn("good", F.lit(True))
    lost = copies.join(sound, "content_hash", "left_anti").select("content_hash", "vdev_id", "good")
    return healed.unionByName(lost)


def written_by(copies: DataFrame, devices: DataFrame) -> DataFrame:
    """vdev_id, records, bytes that :func:`converge` has to write to each device."""
    sound = replicas.first_good(copies.select("content_hash", "vdev_id", "good", "record_len"), F.col("good"))
    lacking = replicas.missing_on(sound, copies.where("good"), devices)
    return (
        lacking.join(sound.select("content_hash", "record_len"), "content_hash")
        .groupBy("vdev_id")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("record_len").alias("n_bytes"))
    )


def unstripe(shards: DataFrame, index: DataFrame, actions: DataFrame, live: DataFrame, online: Column, k: int, m: int, renamed: Column) -> DataFrame:
    """The index (content_hash, vdev_id, segment_id, offset, len) after the ``actions`` of :func:`recovery.stripe_upkeep`.

    Bodies of stripes to repack or to turn back are put together from any ``k`` shards that verify. Of the former the
    live records are copied, by hash, so that a lack in the index loses none; of the latter all. They go as they are
    into a segment ``renamed``, mirrored on the devices ``online``. A stripe goes when it is dropped or copied; one
    that can't be read stays as it is.
    """
    moving = actions.where("action IN ('repack', 'unstripe')")
    small_batches(shards.sparkSession)
    # written, as the bodies are read for their hashes and for their records, the copies for the index and for what goes
    bodies = written(stripes.bodies(shards.join(moving, "segment_id", "left_semi"), k, m), "unstripe-bodies")
    alive = records.headers(bodies).join(live.select("content_hash").distinct(), "content_hash", "left_semi")
    alive = alive.groupBy("segment_id").agg(F.collect_set("content_hash").alias("alive"))
    wanted = F.when(F.col("action") == "repack", F.coalesce("alive", F.array().cast("array<string>"))).alias("wanted")
    chosen = bodies.join(moving, "segment_id").join(alive, "segment_id", "left").select("segment_id", "raw", wanted)
    copies = written(records.copied(chosen), "unstripe-segments")
    entries = copies.select(renamed.alias("segment_id"), F.explode("records").alias("r")).select("segment_id", "r.*")
    gone = copies.select("segment_id").unionByName(actions.where("action = 'drop'").select("segment_id"))
    staying = index.join(gone, "segment_id", "left_anti")
    columns = ["content_hash", "vdev_id", "segment_id", "offset", "len"]
    return staying.select(*columns).unionByName(entries.withColumn("vdev_id", F.explode(online)).select(*columns))


def rekeyed(refs: DataFrame, memo: DataFrame) -> DataFrame:
    """Chunk lists under the new addresses: ino, list_hash, converted, left; lists are addressed bottom-up."""
    met = refs.join(memo.withColumnRenamed("old", "content_hash"), "content_hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("new", "content_hash").alias("h"))))["h"]
    return met.groupBy("ino").agg(
        F.sha2(F.concat_ws("", parts), 256).alias("list_hash"),
        F.count("new").alias("converted"),
        F.count_if(F.col("new").isNull()).alias("left"),
    )
