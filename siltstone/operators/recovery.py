"""From what devices hold back to one state: shard superblocks, replay over a base, index rebuild, stripe upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def furthest(superblocks: DataFrame, valid: Column) -> DataFrame:
    """shard_id, epoch, vdev_id: of each shard's valid copies the one that is furthest along (then the least device)."""
    best = F.min(F.struct((-F.col("epoch")).alias("back"), "vdev_id")).alias("t")
    return superblocks.where(valid).groupBy("shard_id").agg(best).select("shard_id", (-F.col("t.back")).alias("epoch"), "t.vdev_id")


def readable_prefix(log: DataFrame) -> DataFrame:
    """Entries of a log segment before its first torn one; what follows in that segment is lost."""
    torn = F.min(F.when(~F.col("readable"), F.col("epoch"))).over(Window.partitionBy("shard_id", "segment_id"))
    return log.withColumn("torn", torn).where(F.col("torn").isNull() | (F.col("epoch") < F.col("torn"))).drop("torn")


def recovered(base: DataFrame, log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """shard_id, ino, new_object_hash, epoch: the base state and, over it, the newest readable entry above each shard's watermark.

    A shard without a watermark is replayed from the start.
    """
    known = readable_prefix(log).join(watermarks.select("shard_id", F.col("epoch").alias("mark")), "shard_id", "left")
    above = known.where(F.col("epoch") > F.coalesce("mark", F.lit(0)))
    columns = ["shard_id", "ino", "new_object_hash", "epoch"]
    every = base.select(*columns).unionByName(above.select(*columns))
    top = F.max_by(F.struct("new_object_hash", "epoch"), "epoch").alias("t")
    return every.groupBy("shard_id", "ino").agg(top).select("shard_id", "ino", "t.new_object_hash", "t.epoch")


def rebuilt_index(copies: DataFrame, stripes: DataFrame) -> DataFrame:
    """content_hash, vdev_id, segment_id, offset of every copy that a device's scan met, and of a stripe's bodies where no device has the hash.

    A device that holds a hash twice keeps the place that comes last; the stripe's device number is -1.
    """
    place = F.max(F.struct("segment_id", "offset")).alias("p")
    own = copies.groupBy("content_hash", "vdev_id").agg(place).select("content_hash", "vdev_id", "p.segment_id", "p.offset")
    loose = stripes.join(own.select("content_hash").distinct(), "content_hash", "left_anti").groupBy("content_hash").agg(place)
    return own.unionByName(loose.select("content_hash", F.lit(-1).alias("vdev_id"), "p.segment_id", "p.offset"))


def removed_where_still(index: DataFrame, told: DataFrame) -> DataFrame:
    """The index without the entries (content_hash, vdev_id) of ``told`` that still point into the segment named there."""
    return index.join(told.select("content_hash", "vdev_id", "segment_id"), ["content_hash", "vdev_id", "segment_id"], "left_anti")


def stripe_upkeep(stripes: DataFrame, least_live: float, leaving: Column) -> DataFrame:
    """segment_id, action of (segment_id, total_bytes, live_bytes, devices): drop, repack, unstripe or keep.

    A dead stripe is dropped; one that is mostly dead is repacked; of the others those that name a device that
    leaves are turned back into mirrored segments.
    """
    live = F.coalesce("live_bytes", F.lit(0))
    action = (
        F.when(live == 0, "drop")
        .when(live < least_live * F.col("total_bytes"), "repack")
        .when(F.exists("devices", lambda d: d == leaving), "unstripe")
        .otherwise("keep")
    )
    return stripes.select("segment_id", action.alias("action"))


def device_states(events: DataFrame, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """pool, vdev_id, state, refused: events (pool, vdev_id, at, event) applied in order; one that a state doesn't know is refused.

    Histories of devices are short (attach, detach, online, offline, promote), so one is folded in a row.
    """
    table = F.create_map(*[F.lit(x) for (state, event), to in moves.items() for x in (f"{state}>{event}", to)])
    told = events.groupBy("pool", "vdev_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("e"))

    def step(held: Column, e: Column) -> Column:
        to = F.try_element_at(table, F.concat(held["state"], F.lit(">"), e["event"]))
        return F.struct(F.coalesce(to, held["state"]).alias("state"), (held["refused"] + to.isNull().cast("long")).alias("refused"))

    nothing = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("refused"))
    done = told.withColumn("t", F.aggregate("e", nothing, step))
    return done.select("pool", "vdev_id", "t.state", "t.refused")


def created_pool(devices: DataFrame) -> DataFrame:
    """pool, vdev_id, vdev_count, generation, root_ino, root_uid, next_ino of new pools (pool, path, uid, blank): all devices have to be blank.

    Devices are numbered by path; the root directory belongs to who creates the pool (the least uid).
    """
    pool = Window.partitionBy("pool")
    sized = devices.select(
        "pool",
        (F.row_number().over(pool.orderBy("path")) - 1).alias("vdev_id"),
        F.count(F.lit(1)).over(pool).alias("vdev_count"),
        F.min("uid").over(pool).alias("root_uid"),
        F.bool_and("blank").over(pool).alias("all_blank"),
    )
    one = F.lit(1).cast("long")
    return sized.where("all_blank").select("pool", "vdev_id", "vdev_count", one.alias("generation"), one.alias("root_ino"), "root_uid", (one + 1).alias("next_ino"))
