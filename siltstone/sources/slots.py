"""Commit slots, labels, members: which copy of a small record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_valid(slots: DataFrame, owner: str, valid: Column, generation: str = "generation") -> DataFrame:
    """Each owner's valid slot with the highest generation."""
    rest = [c for c in slots.columns if c != owner]
    top = F.max_by(F.struct(*rest), F.col(generation)).alias("t")
    return slots.where(valid).groupBy(owner).agg(top).select(owner, *[f"t.{c}" for c in rest])


def conflicting(copies: DataFrame, owner: str, body: str, generation: str = "generation") -> DataFrame:
    """owner, generation with more than one body: two different records claim to be the same commit."""
    return copies.groupBy(owner, generation).agg(F.count_distinct(body).alias("bodies")).where("bodies > 1")


def discovered(candidates: DataFrame) -> DataFrame:
    """pool, count, members, missing of candidate devices (pool, vdev_id, vdev_count, path); a path counts once."""
    once = candidates.dropDuplicates(["path"])
    pools = once.groupBy("pool").agg(F.max("vdev_count").alias("count"), F.array_sort(F.collect_set("vdev_id")).alias("members"))
    slots = F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))
    return pools.withColumn("missing", F.array_except(slots, F.transform("members", lambda m: m.cast("int"))))


def foreign(uuid: str = "pool_uuid", position: str = "position") -> Column:
    """Whether a member's label names another pool than the label of its pool's first member."""
    first = F.min_by(uuid, position).over(Window.partitionBy("pool"))
    return ~F.col(uuid).eqNullSafe(first)


def membership(members: DataFrame, foreign: Column | None = None) -> DataFrame:
    """members with ``finding``: foreign, duplicate slot, wrong count, or behind the newest generation; null when all is well.

    Nothing else that a foreign device says counts, for itself or for others.
    """
    members = members.withColumn("is_foreign", F.lit(False) if foreign is None else foreign)
    pool = Window.partitionBy("pool", "is_foreign")
    several = F.count(F.lit(1)).over(Window.partitionBy("pool", "is_foreign", "vdev_id")) > 1
    finding = (
        F.when(F.col("is_foreign"), "foreign")
        .when(several, "duplicate")
        .when(F.col("vdev_count") != F.max("vdev_count").over(pool), "count")
        .when(F.col("generation") < F.max("generation").over(pool), "behind")
    )
    return members.withColumn("finding", finding).drop("is_foreign")


def slot_health(members: DataFrame, count: Column) -> DataFrame:
    """pool, vdev_id, health of every slot 0..count-1: online, faulted, catching-up or absent."""
    slots = members.groupBy("pool").agg(count.alias("n")).select("pool", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("slot"))
    met = slots.join(members.withColumn("slot", F.col("vdev_id").cast("int")), ["pool", "slot"], "left")
    health = F.when(F.col("vdev_id").isNull(), "absent").when(F.col("faulted"), "faulted").when(F.col("lag") > 0, "catching-up").otherwise("online")
    return met.select("pool", F.col("slot").alias("vdev_id"), health.alias("health"))


def capacity(devices: DataFrame) -> DataFrame:
    """A mirrored pool is as large as its smallest device, and as free."""
    return devices.groupBy("pool").agg(F.min("total").alias("total"), F.min("free").alias("free"))
