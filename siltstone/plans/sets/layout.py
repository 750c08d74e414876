"""Extents, reachability, reclaiming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import extents, reach, store
from siltstone.plans.catalogue import query
from siltstone.sources import tables as T

sql = T.with_tables

#: What stays reachable in the queries below: every directory tree but the Spanish one, which was deleted; files without a language live.
LIVE = "lang IS DISTINCT FROM 'es'"


def live_hashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live hashes, locations and references. Liveness is summed up with the locations: one pass over the bytes."""
    refs = T.chunk_refs(spark, sf_dir).withColumn("reached", F.expr(LIVE))
    location = T.locations(refs, F.max("reached").alias("reached"))
    return location.where("reached").select("content_hash"), location.drop("reached"), refs.drop("reached")


@query(sql("SELECT ino, q AS start, least(q + 600, n) - q AS n_bytes, sha256(bytes[q + 1 : least(q + 600, n)]) AS content_hash FROM (SELECT ino, bytes, octet_length(bytes) AS n, octet_length(bytes) // 3 AS q FROM blob) WHERE q < n", "blob"))
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 bytes from a third of every file on, assembled from its chunks."""
    size = F.octet_length("bytes").cast("long")
    start = F.floor(size / 3)
    ranges = T.blobs(spark, sf_dir).select("ino", start.alias("start"), (start + 600).alias("stop"), size.alias("size"))
    got = extents.read_ranges(ranges, T.chunk_refs(spark, sf_dir, keep_payload=True))
    return got.select("ino", "start", "n_bytes", F.sha2("content", 256).alias("content_hash"))


_EVENT_EXTENTS = """
x AS (SELECT user_id, CAST(floor(value) AS BIGINT) * 64 AS a, CAST(floor(value) AS BIGINT) * 64 + 64 AS b FROM events WHERE value IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM m),
s AS (SELECT user_id, min(a) AS start, max(b) AS stop FROM i GROUP BY user_id, g)
"""


def event_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse files: each event covers a 64-byte block of its user's file, placed by its value."""
    at = F.floor("value") * 64
    return T.read(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", at.alias("a"), (at + 64).alias("b"))


@query(f"WITH {_EVENT_EXTENTS} SELECT user_id, start, stop FROM s")
def data_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of data in sparse files."""
    return extents.islands(event_extents(spark, sf_dir), "user_id", F.col("a"), F.col("b"))


@query(
    f"""WITH {_EVENT_EXTENTS},
f AS (SELECT user_id, max(stop) + 64 AS size FROM s GROUP BY user_id),
q AS (SELECT user_id, size, unnest([0, size // 2, size]) AS pos FROM f)
SELECT user_id, pos AS "at", CASE WHEN pos < size THEN min(CASE WHEN stop > pos THEN greatest(start, pos) END) END AS next_data,
  CASE WHEN pos < size THEN coalesce(max(CASE WHEN start <= pos AND stop > pos THEN stop END), pos) END AS next_hole
FROM q JOIN s USING (user_id) GROUP BY user_id, pos, size"""
)
def seek_data_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEEK_DATA and SEEK_HOLE at the start, the middle and the end of each sparse file."""
    stretches = extents.islands(event_extents(spark, sf_dir), "user_id", F.col("a"), F.col("b"))
    size = stretches.groupBy("user_id").agg((F.max("stop") + 64).alias("size"))
    places = F.array(F.lit(0).cast("long"), F.floor(F.col("size") / 2), F.col("size"))
    return extents.seek(size.select("user_id", "size", F.explode(places).alias("at")), stretches, "user_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before >= event_type")
def sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent keys of an owner that don't rise."""
    rows = T.read(spark, sf_dir, "events").withColumn("ordinal", F.struct("ts", "event_id"))
    return extents.out_of_order(rows, "user_id", "ordinal", "event_type").select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_partkey + 500) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) WHERE before > l_partkey")
def overlapping_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as extents at their part, 500 long; those that begin before the last one ends."""
    rows = T.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct("l_linenumber", "l_partkey").alias("ordinal"),
        F.col("l_partkey").alias("logical_offset"),
        F.lit(500).alias("len"),
    )
    return extents.overlaps(rows, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(
    """
WITH w AS (SELECT user_id AS ino, event_id AS seq, (event_id % 7) * 8 AS "offset", 8 AS len FROM events),
b AS (SELECT *, CASE WHEN "offset" = lag("offset" + len) OVER (PARTITION BY ino ORDER BY seq) THEN 0 ELSE 1 END AS begins FROM w)
SELECT ino, seq, CAST(sum(begins) OVER (PARTITION BY ino ORDER BY seq) AS BIGINT) AS session FROM b
"""
)
def append_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential-append sessions by offset continuity."""
    offset = (F.col("event_id") % 7) * 8
    writes = T.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("ino"), F.col("event_id").alias("seq"), offset.alias("offset"), F.lit(8).alias("len")
    )
    return extents.append_sessions(writes).select("ino", "seq", "session")


@query(sql("SELECT ino, start, stop FROM (SELECT ino, 0 AS start, n // 4 AS stop FROM s UNION ALL SELECT ino, n // 4 + 100, n FROM s) WHERE start < stop".replace("FROM s", "FROM (SELECT ino, octet_length(bytes) AS n FROM blob)"), "blob"))
def punch_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: 100 bytes punched out of every file a quarter in."""
    size = F.octet_length("bytes").cast("long")
    sized = T.blobs(spark, sf_dir).select("ino", size.alias("n"))
    whole = sized.select("ino", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    hole = F.floor(F.col("n") / 4)
    return extents.punch(whole, sized.select("ino", hole.alias("hole_start"), (hole + 100).alias("hole_stop")))


_MARK = f", live AS (SELECT DISTINCT content_hash FROM chunk_ref WHERE {LIVE})"


@query(sql(f"{_MARK} SELECT content_hash FROM live", "location"))
def mark_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that live files reach."""
    refs = T.chunk_refs(spark, sf_dir)
    roots = T.read(spark, sf_dir, "documents").where(LIVE).select(F.col("doc_id").alias("ino"))
    return reach.marked(roots, refs, T.locations(refs))


@query(sql(f"{_MARK} SELECT content_hash FROM live WHERE false", "location"))
def mark_fails_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks shard 0 leaves references that lead nowhere, so nothing is marked."""
    refs = T.chunk_refs(spark, sf_dir)
    roots = T.read(spark, sf_dir, "documents").where(LIVE).select(F.col("doc_id").alias("ino"))
    return reach.marked(roots, refs, T.locations(refs).where("shard <> 0"))


_LIVE_BYTES = _MARK + ", lb AS (SELECT segment_id, CAST(sum(record_len) AS BIGINT) AS live_bytes FROM location WHERE content_hash IN (SELECT content_hash FROM live) GROUP BY segment_id)"
_SEGMENTS = ", seg AS (SELECT segment_id, min(shard) AS shard, CAST(sum(record_len) AS BIGINT) + 4096 + 64 AS total_bytes FROM location GROUP BY segment_id)"


@query(sql(f"{_LIVE_BYTES} SELECT segment_id, live_bytes FROM lb", "location"))
def live_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live bytes of each segment."""
    live, location, _ = live_hashes(spark, sf_dir)
    return reach.live_bytes(live, location)


def segments(location: DataFrame) -> DataFrame:
    """segment_id, shard, total_bytes with the header page and the footer."""
    return location.groupBy("segment_id").agg(F.min("shard").alias("shard"), (F.sum("record_len") + 4096 + 64).alias("total_bytes"))


@query(
    sql(
        f"""{_LIVE_BYTES}{_SEGMENTS}
SELECT segment_id, total_bytes, coalesce(live_bytes, 0) AS live_bytes FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY segment_id DESC) AS age FROM seg) LEFT JOIN lb USING (segment_id)
WHERE age > 2 AND coalesce(live_bytes, 0) < 0.95 * total_bytes""",
        "location",
    )
)
def sweep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aged segments with less than 95 % live."""
    live, location, _ = live_hashes(spark, sf_dir)
    found = reach.sweep_candidates(segments(location), reach.live_bytes(live, location), 0.95, 2)
    return found.select("segment_id", "total_bytes", "live_bytes")


@query(
    sql(
        f"""{_SEGMENTS}, pub AS (SELECT max(segment_id % 1099511627776) AS g FROM seg)
SELECT segment_id, CASE WHEN shard = 15 THEN true ELSE (SELECT g FROM pub) >= segment_id % 1099511627776 + 2 END AS ok FROM seg""",
        "location",
    )
)
def may_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed generation is the place in the shard; shard 15 isn't tracked."""
    own = segments(T.locations(T.chunk_refs(spark, sf_dir)))
    generation = F.col("segment_id") % T.SEGMENTS_A_SHARD
    sealed = own.where("shard <> 15").select("segment_id", generation.alias("sealed_generation"))
    published = own.agg(F.max(generation).alias("published"))
    known = own.crossJoin(F.broadcast(published))  # one row
    return reach.may_reclaim(known, sealed, F.col("published")).select("segment_id", "ok")


_KEEP = f"""{_MARK}, copies AS (SELECT content_hash, ino AS segment_id FROM chunk_ref GROUP BY ALL),
cand AS (SELECT segment_id FROM copies GROUP BY segment_id HAVING count(*) < 8),
stay AS (SELECT content_hash FROM copies WHERE segment_id NOT IN (SELECT segment_id FROM cand))
SELECT segment_id, content_hash FROM copies WHERE segment_id IN (SELECT segment_id FROM cand)
  AND ((content_hash IN (SELECT content_hash FROM live) AND content_hash NOT IN (SELECT content_hash FROM stay)) OR substr(content_hash, 1, 1) = 'f')"""


@query(sql(_KEEP, "chunk_ref"))
def repack_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs as segments, small ones repacked; hashes that begin with f are pinned."""
    refs = T.chunk_refs(spark, sf_dir).withColumn("reached", F.expr(LIVE))
    # one aggregate over the references feeds all four inputs
    held = refs.groupBy("content_hash", F.col("ino").alias("segment_id")).agg(F.max("reached").alias("reached"))
    records, live = held.drop("reached"), held.where("reached").select("content_hash").distinct()
    small = held.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).where("n < 8")
    pinned = held.where("content_hash LIKE 'f%'").select("content_hash").distinct()
    return reach.repack_keep(records, small, live, pinned).select("segment_id", "content_hash")


@query(
    sql(
        f"""{_LIVE_BYTES}{_SEGMENTS}, ok AS (SELECT segment_id, total_bytes FROM seg JOIN lb USING (segment_id) WHERE live_bytes >= 0.5 * (total_bytes - 4160)),
r AS (SELECT *, sum(total_bytes) OVER (ORDER BY segment_id) - total_bytes AS spent FROM ok)
SELECT segment_id, total_bytes FROM r WHERE spent < 4194304""",
        "location",
    )
)
def stripe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold segments in order until the byte budget of a pass is spent (the budget is the feature)."""
    live, location, _ = live_hashes(spark, sf_dir)
    own = segments(location).join(reach.live_bytes(live, location), "segment_id")
    cold = own.where("live_bytes >= 0.5 * (total_bytes - 4160)")
    return store.running_within(cold, "segment_id", "total_bytes", 4 << 20).select("segment_id", "total_bytes")


_TREE = """
edges AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, name: regions, nations, suppliers and customers as a directory tree."""

    def level(name: str, mark: str, key: str, up_mark: str | None, up: str | None, label: str) -> DataFrame:
        parent = F.concat(F.lit(up_mark), F.col(up).cast("string")) if up else F.lit(None).cast("string")
        node = F.concat(F.lit(mark), F.col(key).cast("string"))
        return T.read(spark, sf_dir, name).select(node.alias("node"), parent.alias("parent"), F.col(label).alias("name"))

    out = level("region", "r", "r_regionkey", None, None, "r_name")
    out = out.unionByName(level("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"))
    out = out.unionByName(level("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name"))
    return out.unionByName(level("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"))


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT node, '/' || name AS path, 0 AS depth FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, p.path || '/' || e.name, p.depth + 1 FROM edges e JOIN p ON e.parent = p.node) SELECT node, path, depth FROM p")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every node."""
    return reach.tree_paths(tree(spark, sf_dir), "/")


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS ancestor FROM edges WHERE parent IS NOT NULL UNION ALL SELECT up.node, e.parent FROM up JOIN edges e ON e.node = up.ancestor WHERE e.parent IS NOT NULL) SELECT r.node AS target, count(*) AS refused FROM edges r JOIN up ON up.ancestor = r.node GROUP BY r.node")
def ancestor_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: for every directory the moves into its own subtree that a rename has to refuse."""
    closure = reach.ancestors(tree(spark, sf_dir))
    return closure.groupBy(F.col("ancestor").alias("target")).agg(F.count(F.lit(1)).alias("refused"))


@query(f"WITH {_TREE}, k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name) AS k FROM edges WHERE parent IS NOT NULL) SELECT parent, name, node FROM k WHERE k > 2 AND k <= 7")
def readdir_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every directory (a page is the feature)."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    inside = tree(spark, sf_dir).where("parent IS NOT NULL")
    return inside.withColumn("k", place).where("k > 2 AND k <= 7").select("parent", "name", "node")


@query("SELECT conv_id AS ino, count(*) AS nlink FROM conversations GROUP BY conv_id")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that point at each inode."""
    return T.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ino")).agg(F.count(F.lit(1)).alias("nlink"))
