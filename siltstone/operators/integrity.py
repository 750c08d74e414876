"""Integrity rules: each returns the rows that break it, as (rule, key, detail); a healthy input gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import replicas

#: The rules that only warn.
WARNINGS = ("KeyringMissing", "KeyringStale", "KeyringForeign")


def finding(rows: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def where(rows: DataFrame, rule: str, broken: Column, key: str, detail: Column) -> DataFrame:
    """A rule on single rows."""
    return finding(rows.where(broken), rule, F.col(key), detail)


def dangling(rows: DataFrame, targets: DataFrame, on: str, rule: str, key: str) -> DataFrame:
    """References that lead nowhere."""
    return finding(rows.join(targets.select(on).distinct(), on, "left_anti"), rule, F.col(key), F.col(on))


def mismatched(rows: DataFrame, targets: DataFrame, on: str, told: str, own: str, rule: str, key: str) -> DataFrame:
    """References to something of another kind."""
    met = rows.join(targets.select(on, own), on).where(~F.col(told).eqNullSafe(F.col(own)))
    return finding(met, rule, F.col(key), F.concat_ws("<>", told, own))


def rising(rows: DataFrame, owner: str, order: str, key: str, rule: str) -> DataFrame:
    """Keys of an owner that don't rise from one row to the next."""
    before = F.lag(key).over(Window.partitionBy(owner).orderBy(order))
    return finding(rows.withColumn("before", before).where(F.col("before") >= F.col(key)), rule, F.col(owner), F.col(key))


def unique(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return finding(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, F.col(key), F.col("n"))


def within(parts: DataFrame, owner: str, size: str, rule: str) -> DataFrame:
    """Chunk lists that are longer, or end later, than the size that their file declares; gaps are legal."""
    per = parts.groupBy(owner).agg(
        F.sum("len").alias("total"), F.max(F.col("logical_offset") + F.col("len")).alias("end"), F.max(size).alias("size")
    )
    return finding(per.where("total > size OR end > size"), rule, F.col(owner), F.concat_ws("/", "total", "end", "size"))


def overlapping(parts: DataFrame, owner: str, rule: str = "UnsortedOrOverlappingChunkList") -> DataFrame:
    """Entries of a chunk list, in list order, that begin before the one before them ends."""
    end = F.lag(F.col("logical_offset") + F.col("len")).over(Window.partitionBy(owner).orderBy("ordinal"))
    met = parts.withColumn("end", end).where(F.col("end") > F.col("logical_offset"))
    return finding(met, rule, F.col(owner), F.concat_ws(">", "end", "logical_offset"))


def without_valid(slots: DataFrame, owner: str, valid: Column) -> DataFrame:
    """Owners none of whose slots is valid: nothing else can be said of them."""
    per = slots.groupBy(owner).agg(F.bool_or(valid).alias("any"), F.count(F.lit(1)).alias("n"))
    return finding(per.where("NOT any"), "NoValidSuperblock", F.col(owner), F.col("n"))


def lacking(wanted: DataFrame, copies: DataFrame, striped: DataFrame, devices: DataFrame) -> DataFrame:
    """Hashes that a device lacks; one that a stripe holds is present on all of them. ``wanted`` says which count."""
    loose = wanted.select("content_hash").distinct().join(striped.select("content_hash").distinct(), "content_hash", "left_anti")
    pairs = replicas.on_every_device(loose, devices)
    missing = pairs.join(copies.select("content_hash", "vdev_id"), ["content_hash", "vdev_id"], "left_anti")
    return finding(missing, "ReplicaMissing", F.col("content_hash"), F.col("vdev_id"))


def counted(reachable: DataFrame, unresolved: DataFrame) -> DataFrame:
    """What presence is asked of: all that is reachable, and what could not be resolved (failing open: better one finding too many)."""
    return reachable.select("content_hash").unionByName(unresolved.select("content_hash")).distinct()


def shard_faults(shards: DataFrame) -> DataFrame:
    """Shards with something wrong, the first rule that they break: header, index, placement, length, hash."""
    why = (
        F.when(~F.col("header_ok"), "header")
        .when(F.col("told_index") != F.col("shard_index"), "index")
        .when(F.col("told_vdev") != F.col("vdev_id"), "placement")
        .when(F.col("n_bytes") != F.col("shard_size"), "length")
        .when(F.col("found_hash") != F.col("shard_hash"), "hash")
    )
    met = shards.withColumn("why", why).where("why IS NOT NULL")
    return finding(met, "StripeShardCorrupt", F.col("segment_id"), F.concat_ws("/", "shard_index", "why"))


def keyrings(copies: DataFrame) -> DataFrame:
    """Findings on the keyring copies of a pool's devices; a damaged or foreign one says nothing of the newest generation."""
    damaged = ~F.col("sum_ok")
    foreign = ~F.col("ring_pool").eqNullSafe(F.col("pool"))
    good = F.col("present") & F.col("sum_ok") & ~foreign
    newest = F.max(F.when(good, F.col("generation"))).over(Window.partitionBy("pool"))
    rule = (
        F.when(~F.col("present"), "KeyringMissing")
        .when(damaged, "KeyringDamaged")
        .when(foreign, "KeyringForeign")
        .when(F.col("generation") < newest, "KeyringStale")
    )
    met = copies.withColumn("rule", rule).where("rule IS NOT NULL")
    return met.select("rule", F.col("path").alias("key"), F.col("pool").cast("string").alias("detail"))


def versions(slots: DataFrame, key: str, version: str, oldest: int, newest: int) -> DataFrame:
    """Valid slots of a format that is too old to read, or newer than this code."""
    legacy = where(slots, "LegacyFormatVersion", F.col(version) < oldest, key, F.col(version))
    return legacy.unionByName(where(slots, "UnsupportedFormatVersion", F.col(version) > newest, key, F.col(version)))


def gaps(records: DataFrame, rule: str) -> DataFrame:
    """Stretches of a segment that no record covers."""
    end = F.lag(F.col("offset") + F.col("record_len")).over(Window.partitionBy("segment_id").orderBy("offset"))
    met = records.withColumn("end", end).where(F.col("end") < F.col("offset"))
    return finding(met, rule, F.col("segment_id"), F.concat_ws("..", "end", "offset"))


def report(findings: list[DataFrame]) -> DataFrame:
    """All findings with their severity, each once."""
    severity = F.when(F.col("rule").isin(*WARNINGS), "warning").otherwise("error")
    return reduce(DataFrame.unionByName, findings).distinct().withColumn("severity", severity)
