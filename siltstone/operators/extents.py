"""Byte ranges: reads, holes, order checks, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(ranges: DataFrame, extents: DataFrame) -> DataFrame:
    """Range join on one key: extents (logical_offset, len) that meet [start, stop) of the same ino.

    The equality on ino makes it a hash or merge join; the inequalities filter its rows.
    """
    meets = (F.col("logical_offset") < F.col("stop")) & (F.col("logical_offset") + F.col("len") > F.col("start"))
    return ranges.join(extents, "ino").where(meets)


def read_ranges(ranges: DataFrame, extents: DataFrame) -> DataFrame:
    """ino, start, n_bytes, content: the bytes of each range from chunk payloads; holes inside the file are zeros.

    ``ranges`` has ino, start, stop, size (of the file; ranges end there).
    """
    clipped = ranges.withColumn("stop", F.least("stop", "size")).where("start < stop")
    parts = overlapping(clipped, extents)
    low, high = F.greatest("start", "logical_offset"), F.least(F.col("stop"), F.col("logical_offset") + F.col("len"))
    cut = parts.select(
        "ino",
        "start",
        "stop",
        low.alias("low"),
        high.alias("high"),
        F.hex(F.substring(F.col("payload"), (low - F.col("logical_offset") + 1).cast("int"), (high - low).cast("int"))).alias("h"),
    )
    before = F.lag("high").over(Window.partitionBy("ino", "start", "stop").orderBy("low"))
    gap = F.col("low") - F.coalesce(before, F.col("start"))
    filled = cut.withColumn("piece", F.concat(F.repeat(F.lit("00"), gap.cast("int")), F.col("h")))
    whole = filled.groupBy("ino", "start", "stop").agg(
        F.array_sort(F.collect_list(F.struct("low", "piece")))["piece"].alias("pieces"), F.max("high").alias("last")
    )
    found = clipped.join(whole, ["ino", "start", "stop"], "left")
    tail = F.col("stop") - F.coalesce("last", "start")
    content = F.unhex(F.concat(F.coalesce(F.concat_ws("", "pieces"), F.lit("")), F.repeat(F.lit("00"), tail.cast("int"))))
    return found.select("ino", "start", F.octet_length(content).cast("long").alias("n_bytes"), content.alias("content"))


def islands(extents: DataFrame, key: str, start: Column, stop: Column) -> DataFrame:
    """key, start, stop: maximal covered stretches of each key's intervals."""
    w = Window.partitionBy(key).orderBy("a", "b")
    own = extents.select(key, start.alias("a"), stop.alias("b"))
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int"))
    numbered = marked.withColumn("island", F.sum("new").over(w))  # equal intervals are peers and share the number
    return numbered.groupBy(key, "island").agg(F.min("a").alias("start"), F.max("b").alias("stop")).drop("island")


def seek(questions: DataFrame, stretches: DataFrame, key: str) -> DataFrame:
    """``questions`` (key, at, size) with next_data and next_hole.

    Data: the first covered byte at or behind ``at``; null when only a hole
    follows. Hole: the first uncovered byte there; the end of the file counts.
    Null for both at or behind the end.
    """
    met = questions.join(stretches.where("start < stop"), key, "left").where("stop > at OR stop IS NULL")
    within = questions.join(
        met.groupBy(key, "at").agg(
            F.min(F.greatest("start", "at")).alias("data"),
            F.max(F.when((F.col("start") <= F.col("at")) & (F.col("stop") > F.col("at")), F.col("stop"))).alias("covered_to"),
        ),
        [key, "at"],
        "left",
    )
    inside = F.col("at") < F.col("size")
    return within.select(
        key,
        "at",
        F.when(inside & (F.col("data") < F.col("size")), F.col("data")).alias("next_data"),
        F.when(inside, F.least(F.coalesce("covered_to", "at"), "size")).alias("next_hole"),
    )


def out_of_order(rows: DataFrame, owner: str, ordinal: str, key: str) -> DataFrame:
    """Adjacent pairs whose keys don't rise."""
    before = F.lag(key).over(Window.partitionBy(owner).orderBy(ordinal))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(key))


def overlaps(extents: DataFrame, owner: str) -> DataFrame:
    """Extents that begin before their predecessor ends."""
    before = F.lag(F.col("logical_offset") + F.col("len")).over(Window.partitionBy(owner).orderBy("ordinal"))
    return extents.withColumn("before", before).where(F.col("before") > F.col("logical_offset"))


def append_sessions(writes: DataFrame) -> DataFrame:
    """``writes`` (ino, seq, offset, len) with session: a write that doesn't continue at the last one's end starts a new one."""
    w = Window.partitionBy("ino").orderBy("seq")
    expected = F.lag(F.col("offset") + F.col("len")).over(w)
    begins = (expected.isNull() | (F.col("offset") != expected)).cast("long")
    return writes.withColumn("begins", begins).withColumn("session", F.sum("begins").over(w)).drop("begins")


def punch(extents: DataFrame, holes: DataFrame) -> DataFrame:
    """Extents (ino, start, stop) minus holes (ino, hole_start, hole_stop), at most one hole an ino: what is left of each."""
    cut = extents.join(holes, "ino", "left")
    left = cut.select("ino", "start", F.least(F.col("stop"), F.coalesce("hole_start", "stop")).alias("stop"))
    right = cut.where("hole_stop IS NOT NULL").select("ino", F.greatest("start", "hole_stop").alias("start"), "stop")
    return left.unionByName(right).where("start < stop")
