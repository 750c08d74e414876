"""Attributes of inodes: owner, mode and times, and extended attributes with their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.modes import merged_mode

#: Bytes of a name, of a value, and of all of an inode's attributes.
NAME_BYTES, VALUE_BYTES, TOTAL_BYTES = 255, 65536, 65536


def changed(inodes: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``inodes`` (ino, mode, uid, gid, mtime, ctime) after ``changes`` (ino and new_mode, new_uid, new_gid, new_mtime).

    What a change leaves null stays; the type bits of the mode stay; ctime moves for every inode that is named.
    """
    met = inodes.join(changes.withColumn("named", F.lit(True)), "ino", "left")
    return met.select(
        "ino",
        F.when(F.col("new_mode").isNotNull(), merged_mode(F.col("mode"), F.col("new_mode"))).otherwise(F.col("mode")).alias("mode"),
        *[F.coalesce(f"new_{c}", c).alias(c) for c in ("uid", "gid", "mtime")],
        F.when(F.col("named"), now).otherwise(F.col("ctime")).alias("ctime"),
    )


def set_outcomes(current: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (ino, name, value, flag) with outcome: ok, exists (create), missing (replace), or too long.

    ``current`` has ino and the map ``xattrs``, null where there are none.
    """
    met = sets.join(current, "ino", "left")
    there = F.coalesce(F.map_contains_key("xattrs", F.col("name")), F.lit(False))
    too_long = (F.octet_length("name") > NAME_BYTES) | (F.octet_length("value") > VALUE_BYTES)
    outcome = (
        F.when(too_long, "too long")
        .when((F.col("flag") == "create") & there, "exists")
        .when((F.col("flag") == "replace") & ~there, "missing")
        .otherwise("ok")
    )
    return met.select("ino", "name", "value", outcome.alias("outcome"))


def applied(current: DataFrame, sets: DataFrame) -> DataFrame:
    """ino, xattrs after the sets that are allowed: new values over old ones, null where none are left."""
    good = set_outcomes(current, sets).where("outcome = 'ok'")
    new = good.groupBy("ino").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("new"))
    met = current.join(new, "ino", "full_outer")
    old = F.coalesce("xattrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("new", k), F.lit(False)))
    merged = F.when(F.col("new").isNull(), F.col("xattrs")).otherwise(F.map_concat(kept, "new"))
    return met.select("ino", F.when(F.size(merged) > 0, merged).alias("xattrs"))
