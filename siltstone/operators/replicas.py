"""Devices and copies: what lacks, what is damaged, where to read and heal from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The most devices of a pool: as many as a shard index can tell.
MOST_DEVICES = 256


def on_every_device(hashes: DataFrame, devices: DataFrame) -> DataFrame:
    """content_hash, vdev_id: every device next to each hash; a pool of more than MOST_DEVICES is refused, none is left out.

    Devices count once, one without an id isn't one.
    """
    known = devices.select("vdev_id").where("vdev_id IS NOT NULL").distinct().limit(MOST_DEVICES + 1)
    ids = known.agg(F.collect_list("vdev_id").alias("ids"))
    many = F.raise_error(F.lit(f"more than {MOST_DEVICES} devices"))
    ids = ids.select(F.when(F.size("ids") <= MOST_DEVICES, F.col("ids")).otherwise(many).alias("ids"))
    one_row = F.broadcast(ids)  # of MOST_DEVICES ids at most
    return hashes.select("content_hash").crossJoin(one_row).select("content_hash", F.explode("ids").alias("vdev_id"))


def missing_on(hashes: DataFrame, copies: DataFrame, devices: DataFrame) -> DataFrame:
    """vdev_id, content_hash of hashes that a device lacks.

    The devices, a handful, are unrolled next to each hash; one anti-join finds what has no copy.
    """
    wanted = on_every_device(hashes, devices)
    return wanted.join(copies.select("content_hash", "vdev_id"), ["content_hash", "vdev_id"], "left_anti")


def first_good(copies: DataFrame, good: Column, order: str = "vdev_id") -> DataFrame:
    """content_hash with the first verified copy's columns; hashes without one don't appear."""
    rest = [c for c in copies.columns if c != "content_hash"]
    first = copies.where(good).groupBy("content_hash").agg(F.min_by(F.struct(*rest), F.col(order)).alias("t"))
    return first.select("content_hash", *[f"t.{c}" for c in rest])


def heal_sources(copies: DataFrame) -> DataFrame:
    """vdev_id, content_hash, source: for each damaged copy the first good device elsewhere, null if there is none."""
    bad = copies.where(~F.col("good")).select("content_hash", "vdev_id")
    good = copies.where("good").select("content_hash", F.col("vdev_id").alias("source"))
    return bad.join(good, "content_hash", "left").groupBy("content_hash", "vdev_id").agg(F.min("source").alias("source"))


def compared(copies: DataFrame, devices: DataFrame, header: str) -> DataFrame:
    """vdev_id, content_hash, finding: missing, corrupt, or divergent from the lowest good copy's header."""
    reference = first_good(copies.select("content_hash", "vdev_id", header, "good"), F.col("good")).select(
        "content_hash", F.col(header).alias("reference")
    )
    known = copies.select("content_hash").distinct()
    lacking = missing_on(known, copies, devices).withColumn("finding", F.lit("missing"))
    present = copies.join(reference, "content_hash", "left").select(
        "content_hash",
        "vdev_id",
        F.when(~F.col("good"), "corrupt").when(~F.col("reference").eqNullSafe(F.col(header)), "divergent").alias("finding"),
    )
    return lacking.unionByName(present.where("finding IS NOT NULL"))


def index_faults(index: DataFrame, walk: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Index entries that a fresh walk doesn't confirm: ``finding`` is missing or mismatch."""
    seen = walk.select(*keys, F.struct(*fields).alias("seen"))
    met = index.select(*keys, F.struct(*fields).alias("told")).join(seen, keys, "left")
    finding = F.when(F.col("seen").isNull(), "missing").when(F.col("seen") != F.col("told"), "mismatch")
    return met.select(*keys, finding.alias("finding")).where("finding IS NOT NULL")


def on_all(copies: DataFrame, devices: int) -> DataFrame:
    """Hashes that every device holds."""
    held = copies.groupBy("content_hash").agg(F.count_distinct("vdev_id").alias("n"))
    return held.where(F.col("n") == devices).select("content_hash")


def scrubbed(copies: DataFrame) -> DataFrame:
    """vdev_id, records, corrupt, healed, unrecoverable."""
    source = heal_sources(copies)
    per = source.groupBy("vdev_id").agg(
        F.count_if(F.col("source").isNotNull()).alias("healed"), F.count_if(F.col("source").isNull()).alias("unrecoverable")
    )
    seen = copies.groupBy("vdev_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("good")).alias("corrupt"))
    return seen.join(per, "vdev_id", "left").fillna(0, ["healed", "unrecoverable"])
