"""Integrity rules over the tables, with damage planted where the tables are sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.functions import modes
from siltstone.operators import integrity as I
from siltstone.plans.catalogue import query
from siltstone.sources import records, slots
from siltstone.sources import tables as T

sql = T.with_tables


@query(sql("SELECT 'ContentHashMismatch' AS rule, CAST(ino AS VARCHAR) AS key, content_hash AS detail, 'error' AS severity FROM chunk_ref WHERE ordinal = 1", "chunk_ref"))
def fsck_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second chunk of every file has a flipped byte."""
    rows = T.chunk_refs(spark, sf_dir, keep_payload=True)
    spoilt = F.when(F.col("ordinal") == 1, F.concat(F.lit(b"\xff"), F.substring("payload", 2, 1 << 20))).otherwise(F.col("payload"))
    broken = ~A.verified(spoilt, F.col("content_hash"))
    return I.report([I.where(rows, "ContentHashMismatch", broken, "ino", F.col("content_hash"))])


@query(
    """
WITH f AS (
SELECT 'DanglingIno' AS rule, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION SELECT 'KindMismatch', CAST(o_orderkey AS VARCHAR), o_orderpriority || '<>' || c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE substr(o_orderpriority, 1, 1) <> substr(c_mktsegment, 1, 1)
UNION SELECT 'DuplicateVdev', CAST(s_nationkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
UNION SELECT 'SizeMismatch', CAST(doc_id AS VARCHAR), octet_length(encode(text)) || '<>' || n_chars FROM documents WHERE octet_length(encode(text)) <> n_chars
)
SELECT rule, key, detail, 'error' AS severity FROM f WHERE rule <> 'KindMismatch'
"""
)
def fsck_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers in debt dangle; sizes count characters where they should count bytes."""
    orders = T.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "ino")
    there = T.read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("ino"))
    docs = T.read(spark, sf_dir, "documents")
    size = F.octet_length(F.encode("text", "utf-8"))
    return I.report(
        [
            I.dangling(orders, there, "ino", "DanglingIno", "o_orderkey"),
            I.unique(T.read(spark, sf_dir, "supplier"), "s_nationkey", "DuplicateVdev"),
            I.where(docs, "SizeMismatch", size != F.col("n_chars"), "doc_id", F.concat_ws("<>", size.cast("string"), "n_chars")),
        ]
    )


@query("SELECT DISTINCT 'KindMismatch' AS rule, CAST(l_orderkey AS VARCHAR) AS key, l_linestatus || '<>' || o_orderstatus AS detail, 'error' AS severity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus <> o_orderstatus")
def fsck_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose status isn't their order's."""
    orders = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus")
    return I.report([I.mismatched(lines, orders, "l_orderkey", "l_linestatus", "o_orderstatus", "KindMismatch", "l_orderkey")])


@query(
    """
WITH l AS (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem)
SELECT DISTINCT 'UnsortedOrDuplicateInoMap' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS detail, 'error' AS severity FROM l WHERE before >= l_partkey
"""
)
def fsck_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order as a list that should rise."""
    lines = T.read(spark, sf_dir, "lineitem").withColumn("ordinal", F.struct("l_linenumber", "l_partkey"))
    return I.report([I.rising(lines, "l_orderkey", "ordinal", "l_partkey", "UnsortedOrDuplicateInoMap")])


@query(sql("SELECT 'SizeMismatch' AS rule, CAST(ino AS VARCHAR) AS key, total || '/' || total || '/' || size AS detail, 'error' AS severity FROM (SELECT ino, CAST(sum(len) AS BIGINT) AS total, CAST(sum(len) AS BIGINT) - ino % 2 AS size FROM chunk_ref GROUP BY ino) WHERE total > size", "chunk_ref"))
def fsck_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd files declare a byte less than their chunks have."""
    sized = T.blobs(spark, sf_dir).withColumn("size", F.octet_length("bytes").cast("long") - F.col("ino") % 2)
    return I.report([I.within(T.addressed(T.fixed_blocks(sized)), "ino", "size", "SizeMismatch")])


@query(sql("SELECT DISTINCT 'MissingObject' AS rule, CAST(ino AS VARCHAR) AS key, content_hash AS detail, 'error' AS severity FROM chunk_ref WHERE content_hash LIKE '0%'", "chunk_ref"))
def fsck_missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 0 was lost."""
    refs = T.chunk_refs(spark, sf_dir)
    return I.report([I.dangling(refs, T.locations(refs).where("shard <> 0"), "content_hash", "MissingObject", "ino")])


_LOST = ", kept AS (SELECT * FROM location WHERE content_hash NOT LIKE '_7%')"


@query(sql(f"{_LOST}, g AS (SELECT segment_id, \"offset\", lag(\"offset\" + record_len) OVER (PARTITION BY segment_id ORDER BY \"offset\") AS stop FROM kept) SELECT 'DamagedRegion' AS rule, CAST(segment_id AS VARCHAR) AS key, stop || '..' || \"offset\" AS detail, 'error' AS severity FROM g WHERE stop < \"offset\"", "location"))
def fsck_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose hash has a 7 in second place were overwritten."""
    kept = T.locations(T.chunk_refs(spark, sf_dir)).where("content_hash NOT LIKE '_7%'")
    return I.report([I.gaps(kept, "DamagedRegion")])


@query()
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs written as segments, overwritten in one place, scanned past the damage."""
    chunks = T.chunk_refs(spark, sf_dir, keep_payload=True).select(
        F.col("ino").alias("segment_id"), F.col("ordinal").alias("seq"), "content_hash", "payload"
    )
    segments = records.with_damage(records.write_segments(chunks), records.PAGE + 500, 64)
    rows = records.scan_segments(segments)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("n_bytes"), F.count_if(F.col("ok")).alias("ok"))


@query("SELECT user_id AS owner, event_type AS generation, count(DISTINCT props) AS bodies FROM events GROUP BY user_id, event_type HAVING count(DISTINCT props) > 1")
def conflicting_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that claim the same generation with another body."""
    rows = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("generation"), "props")
    return slots.conflicting(rows, "owner", "props")


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS secs, CAST(epoch_us(ts) % 1000000 * 1000 AS BIGINT) AS nanos FROM events")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """times as seconds and nanoseconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return T.read(spark, sf_dir, "events").select("event_id", F.floor(micros / 1_000_000).alias("secs"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("nanos"))


@query("SELECT l_orderkey, l_linenumber, ((33188 & ~4095) | ((l_partkey * 7) & 4095)) AS mode, CAST((l_partkey * 7) & 511 & ~18 AS BIGINT) AS created FROM lineitem")
def mode_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions replaced, the type kept; a new entry's mode without a default access list."""
    new = F.col("l_partkey") * 7
    none = F.lit(None).cast("array<struct<tag:string,perm:bigint>>")
    created = modes.created_mode(new.bitwiseAND(511), F.lit(18).cast("long"), none)
    return T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", modes.merged_mode(F.lit(33188).cast("long"), new).alias("mode"), created.alias("created"))


@query("SELECT p_partkey, (((p_size % 8) << 6) | ((CASE WHEN p_size % 2 = 0 THEN 5 ELSE 6 END) << 3) | 4) & 511 AS created FROM part")
def acl_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: a default access list limits what is created; the mask, where there is one, stands for the group."""
    entry = lambda tag, perm: F.struct(F.lit(tag).alias("tag"), perm.cast("bigint").alias("perm"))
    listed = F.array(entry("owner", F.col("p_size") % 8), entry("group", F.lit(6)), entry("other", F.lit(4)))
    masked = F.when(F.col("p_size") % 2 == 0, F.array_append(listed, entry("mask", F.lit(5)))).otherwise(listed)
    created = modes.created_mode(F.lit(511).cast("long"), F.lit(18).cast("long"), masked)
    return T.read(spark, sf_dir, "part").select("p_partkey", created.alias("created"))


@query("SELECT event_id, len(json_keys(props)) AS attributes, array_to_string(list_sort(json_keys(props)), ',') AS names FROM events WHERE props IS NOT NULL")
def xattr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as an attribute map, its names in order."""
    attributes = F.from_json("props", "map<string,string>")
    rows = T.read(spark, sf_dir, "events").where("props IS NOT NULL").withColumn("x", attributes)
    names = F.transform(modes.sorted_entries(F.col("x")), lambda e: e["key"])
    return rows.select("event_id", F.size("x").cast("long").alias("attributes"), F.concat_ws(",", names).alias("names"))


_ERRNO = "(VALUES ('click', 0), ('error', 5), ('purchase', 17), ('signup', 2)) AS e(event_type, errno)"


@query(f"SELECT event_id, coalesce(errno, 22) AS errno FROM events LEFT JOIN {_ERRNO} USING (event_type)")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine errors to codes; what isn't in the map is 22."""
    codes = F.create_map(*[F.lit(x) for pair in (("click", 0), ("error", 5), ("purchase", 17), ("signup", 2)) for x in pair])
    return T.read(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(22)).alias("errno"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'error' QUALIFY place <= 1024")
def corruption_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log's bound, the newest 1024 (the bound is the feature)."""
    from pyspark.sql import Window

    newest = T.read(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1024)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id")))  # over at most 1024 rows
    return newest.select("event_id", place.cast("long").alias("place"))


@query(sql("SELECT (SELECT count(*) FROM blob) AS files, (SELECT count(*) FROM chunk_ref) AS refs, (SELECT count(*) FROM location) AS index_entries, (SELECT count(DISTINCT segment_id) FROM location) AS segments, (SELECT max(segment_id) FROM location) AS last_segment", "location"))
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts."""
    refs = T.chunk_refs(spark, sf_dir)
    files = T.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("files"))
    counted = refs.agg(F.count(F.lit(1)).alias("refs"))
    index = T.locations(refs).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    stored = index.agg(F.sum("n").alias("index_entries"), F.count(F.lit(1)).alias("segments"), F.max("segment_id").alias("last_segment"))
    return files.crossJoin(counted).crossJoin(stored)  # one row each


_ZONES = "z AS (SELECT l_orderkey AS kind_id, l_linenumber - 1 + CASE WHEN l_linenumber > 3 AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS ordinal, l_linestatus AS state FROM lineitem)"


@query(f"WITH {_ZONES}, n AS (SELECT *, row_number() OVER (PARTITION BY kind_id ORDER BY ordinal) - 1 AS want FROM z) SELECT kind_id, count(*) FILTER (ordinal = want) AS owned, count(*) FILTER (ordinal <> want) AS orphans FROM n GROUP BY kind_id")
def zone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose ordinals run from 0 belong to the segment; what follows a gap is an orphan."""
    from pyspark.sql import Window

    gap = ((F.col("l_linenumber") > 3) & (F.col("l_orderkey") % 5 == 0)).cast("int")
    zones = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kind_id"), (F.col("l_linenumber") - 1 + gap).alias("ordinal"))
    want = F.row_number().over(Window.partitionBy("kind_id").orderBy("ordinal")) - 1
    counted = zones.withColumn("owned", F.col("ordinal") == want)
    return counted.groupBy("kind_id").agg(F.count_if("owned").alias("owned"), F.count_if(~F.col("owned")).alias("orphans"))
