"""Reachability and reclaiming: marks, live bytes, candidates, what a repack keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.work import written


def marked(roots: DataFrame, refs: DataFrame, location: DataFrame) -> DataFrame:
    """content_hash of everything that the roots' inodes reach; nothing at all if a reference leads nowhere.

    Failing closed matters: a mark that misses something would let live data be reclaimed.
    """
    reached = refs.join(roots.select("ino").distinct(), "ino", "left_semi").select("content_hash").distinct()
    lost = reached.join(location.select("content_hash"), "content_hash", "left_anti")
    none_lost = lost.agg((F.count(F.lit(1)) == 0).alias("whole"))
    return reached.crossJoin(F.broadcast(none_lost)).where("whole").select("content_hash")  # one row on the other side


def live_bytes(live: DataFrame, location: DataFrame) -> DataFrame:
    """segment_id, live_bytes: of records whose hash is live."""
    kept = location.join(live, "content_hash", "left_semi")
    return kept.groupBy("segment_id").agg(F.sum("record_len").alias("live_bytes"))


def sweep_candidates(segments: DataFrame, live: DataFrame, below: float, newest: int, owner: str = "shard") -> DataFrame:
    """Sealed segments, the newest few of each owner left alone, whose live share is under a limit."""
    age = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("segment_id")))
    aged = segments.withColumn("age", age).where(F.col("age") > newest).drop("age")
    shared = aged.join(live, "segment_id", "left").withColumn("live_bytes", F.coalesce("live_bytes", F.lit(0)))
    return shared.where(F.col("live_bytes") < below * F.col("total_bytes"))


def may_reclaim(segments: DataFrame, sealed_at: DataFrame, published: Column, wait: int = 2) -> DataFrame:
    """Segments with ``ok``: sealed long enough ago, or not tracked at all."""
    known = segments.join(sealed_at, "segment_id", "left")
    return known.withColumn("ok", F.coalesce(published >= F.col("sealed_generation") + wait, F.lit(True)))


def repack_keep(records: DataFrame, candidates: DataFrame, live: DataFrame, pinned: DataFrame) -> DataFrame:
    """Records of candidate segments that a repack copies: live without a copy in a segment that stays, or pinned."""
    own = records.join(candidates.select("segment_id"), "segment_id", "left_semi")
    staying = records.join(candidates.select("segment_id"), "segment_id", "left_anti").select("content_hash").distinct()
    needed = own.join(live, "content_hash", "left_semi").join(staying, "content_hash", "left_anti")
    held = own.join(pinned.select("content_hash"), "content_hash", "left_semi")
    return needed.unionByName(held).distinct()


def tree_paths(edges: DataFrame, root: str) -> DataFrame:
    """node, path, depth from parent-child edges by breadth-first joins; a level is one join over the frontier, and is written.

    A node that comes again is on a cycle, which a tree may not have.
    """
    edges = edges.select("node", "parent", "name")
    level = edges.where(F.col("parent").isNull()).select("node", F.concat(F.lit(root), "name").alias("path"), F.lit(0).alias("depth"))
    out = level = written(level, "tree-level")
    depth = 0
    while not level.isEmpty():
        depth += 1
        below = edges.join(level.select(F.col("node").alias("parent"), "path"), "parent")
        level = written(below.select("node", F.concat("path", F.lit("/"), "name").alias("path"), F.lit(depth).alias("depth")), "tree-level")
        if not level.join(out, "node", "left_semi").isEmpty():
            raise ValueError("the tree has a cycle")
        out = out.unionByName(level)
    return out


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor: one row for each node above each node. Steps double, so a depth d takes log2(d) joins; each is written."""
    step = written(edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")).distinct(), "ancestors")
    known = step
    while True:
        up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"))
        further = step.join(up, "ancestor").select("node", F.col("above").alias("ancestor")).distinct()
        # of two steps of 2 ** k: what is known goes on by one more
        more = known.join(up, "ancestor").select("node", F.col("above").alias("ancestor"))
        grown = written(known.unionByName(more).distinct(), "ancestors")
        step = written(further, "ancestors")
        if step.isEmpty() or grown.count() == known.count():
            return grown
        known = grown
