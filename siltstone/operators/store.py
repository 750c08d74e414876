"""Deduplicating store: what is new, what is shared, where duplicates converge, how segments fill."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(refs: DataFrame, *keys: str) -> DataFrame:
    """keys, content_hash, n, len: references summed up in the map tasks."""
    return refs.groupBy(*keys, "content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("len"))


def savings(refs: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """chunks, distinct_chunks, logical_bytes, stored_bytes: by a column, and over all.

    Both come from the references counted by group and hash, so the chunks are
    made and hashed once; sums take the place of distinct counts.
    """
    sums = (
        F.sum("n").alias("chunks"),
        F.count(F.lit(1)).alias("distinct_chunks"),
        F.sum(F.col("n") * F.col("len")).alias("logical_bytes"),
        F.sum("len").alias("stored_bytes"),
    )
    each = counted(refs, group)
    whole = each.groupBy("content_hash").agg(F.sum("n").alias("n"), F.min("len").alias("len"))
    return each.groupBy(group).agg(*sums), whole.agg(*sums)


def new_and_known(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct incoming chunks with ``hit``: whether the store has them."""
    index = known.select("content_hash").distinct().withColumn("in_store", F.lit(True))
    first = incoming.groupBy("content_hash").agg(F.min("len").alias("len"), F.count(F.lit(1)).alias("refs"))
    return first.join(index, "content_hash", "left").withColumn("hit", F.coalesce("in_store", F.lit(False))).drop("in_store")


def convergence(places: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """content_hash, canonical, loser: one row for every copy beside the canonical one on a device.

    ``places`` has vdev_id, content_hash, segment_id, offset. The place that the
    index names stays canonical if it is among the copies, else the lowest.
    """
    own = places.select("vdev_id", "content_hash", F.struct("segment_id", "offset").alias("place")).distinct()
    lowest = own.groupBy("vdev_id", "content_hash").agg(F.min("place").alias("lowest"), F.count(F.lit(1)).alias("n"))
    several = lowest.where("n > 1")
    if current is not None:
        named = current.select("vdev_id", "content_hash", F.struct("segment_id", "offset").alias("place")).join(
            own, ["vdev_id", "content_hash", "place"], "left_semi"
        )
        several = several.join(named.withColumnRenamed("place", "named"), ["vdev_id", "content_hash"], "left")
        several = several.withColumn("canonical", F.coalesce("named", "lowest"))
    else:
        several = several.withColumn("canonical", F.col("lowest"))
    return (
        own.join(several.select("vdev_id", "content_hash", "canonical"), ["vdev_id", "content_hash"])
        .where(F.col("place") != F.col("canonical"))
        .select("vdev_id", "content_hash", "canonical", F.col("place").alias("loser"))
    )


def shared(refs: DataFrame, group: str) -> DataFrame:
    """content_hash, groups, refs of chunks that more than one group uses."""
    per = refs.groupBy("content_hash", group).agg(F.count(F.lit(1)).alias("n"))
    both = per.groupBy("content_hash").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("refs"))
    return both.where("groups > 1")


def pins(changes: DataFrame) -> DataFrame:
    """content_hash, pins: references counted up and down, those that are still held."""
    return changes.groupBy("content_hash").agg(F.sum("delta").alias("pins")).where("pins > 0")


def is_zero(payload: Column) -> Column:
    """Whether bytes are all zero."""
    return ~F.hex(payload).rlike("[^0]")


def without_holes(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks of zeros, at least ``least`` bytes long, become holes: they are left out."""
    hole = (F.octet_length("payload") >= least) & is_zero(F.col("payload"))
    return blocks.where(~hole)


def sealed_segments(location: DataFrame) -> DataFrame:
    """segment_id, record_count, fingerprint (over the record hashes in order) and bytes."""
    hashes = F.array_sort(F.collect_list(F.struct("offset", "content_hash")))["content_hash"]
    return location.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum("record_len").alias("total_bytes"),
        F.sha2(F.concat_ws("", hashes), 256).alias("fingerprint"),
    )


def greedy_segments(records: DataFrame, cap: int) -> DataFrame:
    """shard, seq, record_len with roll: a record that would pass the cap opens a segment.

    Where a segment ends depends on all before it, so a shard is one task; its rows go by in order, batch by batch.
    """

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, used = None, 0, 0
        for b in batches:
            numbers, offsets = [], []
            for shard, n in zip(b["shard"].to_pylist(), b["record_len"].to_pylist(), strict=True):
                if shard != at:
                    at, number, used = shard, 0, 0
                if used and used + n > cap:
                    number, used = number + 1, 0
                numbers.append(number)
                offsets.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*b.schema.names, "segment_no", "offset"])

    ordered = records.select("shard", "seq", "record_len").repartition("shard").sortWithinPartitions("shard", "seq")
    return ordered.mapInArrow(roll, "shard int, seq long, record_len long, segment_no long, offset long")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New entries over old ones, by key; ``version`` decides, larger wins."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.col("version")).alias("top")
    return both.groupBy(*keys).agg(top).select(*keys, *[f"top.{c}" for c in rest])


def first_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union with a priority by place in the list; one row a key."""
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    rest = [c for c in union.columns if c != key]
    return union.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("priority", *[c for c in rest if c != "priority"])).alias("t")).select(key, *[f"t.{c}" for c in rest])


def page_after(index: DataFrame, after: tuple[str, int], size: int) -> DataFrame:
    """A page of the index in key order, strictly behind a key."""
    key = F.struct("content_hash", "vdev_id")
    edge = F.struct(F.lit(after[0]).alias("content_hash"), F.lit(after[1]).cast("int").alias("vdev_id"))
    return index.where(key > edge).orderBy("content_hash", "vdev_id").limit(size)


def preferred(index: DataFrame) -> DataFrame:
    """Each hash's place on the lowest device."""
    place = F.min_by(F.struct("vdev_id", "segment_id", "offset", "len"), F.col("vdev_id")).alias("p")
    return index.groupBy("content_hash").agg(place).select("content_hash", "p.*")


def running_within(rows: DataFrame, order: str, size: str, budget: int, width: int = 1 << 16) -> DataFrame:
    """Rows whose predecessors' sizes leave some of the budget (the one that spends the last of it included).

    Sums go by ranges of ``width`` numbers first; only one row a range is put in one order, and only the ranges that
    the budget reaches are looked into.
    """
    ranged = rows.withColumn("range", F.floor(F.col(order) / width))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranged.groupBy("range").agg(F.sum(size).alias("total")).select("range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = F.sum(size).over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    near = ranged.join(base.where(F.col("base") < budget), "range").withColumn("spent", F.col("base") + within)
    return near.where(F.col("spent") < budget).drop("range", "base", "spent")


def absent_only(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it doesn't have: what is there stays."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def forgotten(index: DataFrame, segments: DataFrame, holds: str = "segment_id") -> DataFrame:
    """The index without entries that still point into the given segments; entries that moved on stay."""
    return index.join(segments.select(holds), holds, "left_anti")


def restriped(index: DataFrame, segments: DataFrame, stripe_device: int) -> DataFrame:
    """Entries of striped segments, one a hash under the stripes' pseudo-device in place of the mirrored ones."""
    own = index.join(segments.select("segment_id"), "segment_id", "left_semi")
    striped = own.groupBy("content_hash", "segment_id").agg(F.min("offset").alias("offset"), F.min("len").alias("len"))
    moved = striped.withColumn("vdev_id", F.lit(stripe_device))
    return forgotten(index, segments).unionByName(moved.select(*index.columns))


def replaced_if(table: DataFrame, changes: DataFrame, keys: list[str], expected: str, column: str) -> DataFrame:
    """``column`` replaced by ``new`` where its present value is the ``expected`` one; a lost race changes nothing."""
    met = table.join(changes.select(*keys, F.col(expected).alias("wanted"), "new"), keys, "left")
    value = F.when(F.col(column).eqNullSafe(F.col("wanted")) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col(column))
    return met.select(*[value.alias(c) if c == column else F.col(c) for c in table.columns])
