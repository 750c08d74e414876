"""Addresses, chunks, dedup, segments, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.functions import chunker, codecs
from siltstone.operators import store
from siltstone.plans.catalogue import query
from siltstone.sources import tables as T

sql = T.with_tables


@query(sql("SELECT ino, octet_length(bytes) AS n_bytes, sha256(bytes) AS content_hash, sha256(bytes) = sha256(encode(decode(bytes))) AS ok FROM blob", "blob"))
def address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content address of every blob, verified against its text encoded again."""
    blob = T.blobs(spark, sf_dir).withColumn("content_hash", A.address(F.col("bytes")))
    again = F.encode(F.decode("bytes", "utf-8"), "utf-8")
    return blob.select(
        "ino", F.octet_length("bytes").cast("long").alias("n_bytes"), "content_hash", A.verified(again, F.col("content_hash")).alias("ok")
    )


@query(sql("SELECT epoch, count(DISTINCT sha256(encode('key-' || epoch) || bytes)) AS addresses, count(*) AS n FROM blob, (SELECT unnest([1, 2]) AS epoch) GROUP BY epoch", "blob"))
def keyed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses under two epochs' keys."""
    blob = T.blobs(spark, sf_dir).select("bytes", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
    key = F.encode(F.concat(F.lit("key-"), F.col("epoch").cast("string")), "utf-8")
    own = blob.select("epoch", A.keyed_address(key, F.col("bytes")).alias("a")).groupBy("epoch", "a").count()
    return own.groupBy("epoch").agg(F.count(F.lit(1)).alias("addresses"), F.sum("count").alias("n"))


@query(sql("SELECT CASE WHEN octet_length(bytes) <= 512 THEN 'inline' ELSE 'chunked' END AS content_tag, count(*) AS files, CAST(sum(octet_length(bytes)) AS BIGINT) AS n_bytes FROM blob GROUP BY 1", "blob"))
def inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at or under the inline threshold."""
    size = F.octet_length("bytes")
    tag = F.when(size <= T.INLINE, "inline").otherwise("chunked").alias("content_tag")
    return T.blobs(spark, sf_dir).groupBy(tag).agg(F.count(F.lit(1)).alias("files"), F.sum(size.cast("long")).alias("n_bytes"))


_PADDED = """
CASE WHEN n < 2 THEN n ELSE ((n + (1 << greatest(e - (length(bin(e)) - 1 + 1), 0)) - 1) // (1 << greatest(e - (length(bin(e)) - 1 + 1), 0))) * (1 << greatest(e - (length(bin(e)) - 1 + 1), 0)) END
"""


@query(sql(f"SELECT padded, count(*) AS files, CAST(sum(padded - n) AS BIGINT) AS overhead FROM (SELECT n, {_PADDED} AS padded FROM (SELECT n, length(bin(n)) - 1 AS e FROM (SELECT CAST(octet_length(bytes) AS BIGINT) AS n FROM blob))) GROUP BY padded", "blob"))
def padding_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """padded lengths and what they cost."""
    n = F.octet_length("bytes").cast("long")
    sized = T.blobs(spark, sf_dir).select(n.alias("n"), A.padded_len(n).alias("padded"))
    return sized.groupBy("padded").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("padded") - F.col("n")).alias("overhead"))


@query(
    """
WITH z0 AS (SELECT user_id, (CAST(user_id AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS z FROM events),
z1 AS (SELECT user_id, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS z FROM z0),
z2 AS (SELECT user_id, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS z FROM z1)
SELECT CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 31) % 16 AS BIGINT) AS shard, count(*) AS n, count(DISTINCT user_id) AS inodes FROM z2 GROUP BY 1
"""
)
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by the shard of their inode; one routing per inode, not per event."""
    per = T.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    routed = per.select(A.shard_for_inode(F.col("user_id"), 16).alias("shard"), "n")
    return routed.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("inodes"))


@query(sql("SELECT ((instr('0123456789abcdef', substr(content_hash, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(content_hash, 2, 1)) - 1) % 64 AS bucket, count(*) AS entries FROM location GROUP BY 1", "location"))
def cache_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index entries by cache bucket."""
    known = T.chunk_refs(spark, sf_dir).select("content_hash").distinct()
    return known.groupBy(A.cache_bucket(F.col("content_hash")).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hex_id, decode(unhex(replace(lower(hex(encode(c_name))), '-', ''))) = c_name AS ok FROM customer")
def uuid_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to hex digits and back, dashes ignored."""
    named = T.read(spark, sf_dir, "customer").withColumn("hex_id", A.uuid_hex(F.encode("c_name", "utf-8")))
    dashed = F.concat(F.substring("hex_id", 1, 8), F.lit("-"), F.substr(F.col("hex_id"), F.lit(9)))
    return named.select("c_custkey", "hex_id", (F.decode(A.uuid_bytes(dashed), "utf-8") == F.col("c_name")).alias("ok"))


@query(sql("SELECT ino, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS n_bytes, min(len) AS least, sha256(string_agg(content_hash, '' ORDER BY ordinal)) AS list_hash FROM chunk_ref GROUP BY ino", "chunk_ref"))
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed blocks of every blob and the address of the list."""
    refs = T.chunk_refs(spark, sf_dir)
    hashes = F.array_sort(F.collect_list(F.struct("ordinal", "content_hash")))["content_hash"]
    return refs.groupBy("ino").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("len").alias("n_bytes"),
        F.min("len").alias("least"),
        F.sha2(F.concat_ws("", hashes), 256).alias("list_hash"),
    )


@query("SELECT source AS dir, count(*) AS lines, count(DISTINCT line) AS distinct_lines FROM (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY source")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, by directory."""
    docs = T.read(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("dir"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    each = lines.groupBy("dir", F.sha2(F.col("line"), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("dir").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("distinct_lines"))


@query()
def chunk_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks; contiguous, bounded, and the list rebuilds the blob (tested)."""
    blob = T.blobs(spark, sf_dir)
    chunks = T.addressed(chunker.chunked(blob))
    return chunks.select("ino", "ordinal", "logical_offset", "len", "content_hash")


@query(
    sql(
        """
SELECT coalesce(dir, '') AS dir, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * len) AS BIGINT) AS logical_bytes, CAST(sum(len) AS BIGINT) AS stored_bytes
FROM (SELECT dir, content_hash, count(*) AS n, min(len) AS len FROM chunk_ref GROUP BY dir, content_hash) GROUP BY dir
UNION ALL
SELECT '*' AS dir, CAST(sum(n) AS BIGINT), count(*), CAST(sum(n * len) AS BIGINT), CAST(sum(len) AS BIGINT) FROM (SELECT content_hash, count(*) AS n, min(len) AS len FROM chunk_ref GROUP BY content_hash)
""",
        "chunk_ref",
    )
)
def dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical and stored bytes by directory and over all (``*``)."""
    by_dir, whole = store.savings(T.chunk_refs(spark, sf_dir), "dir")
    return by_dir.withColumn("dir", F.coalesce("dir", F.lit(""))).unionByName(whole.withColumn("dir", F.lit("*")))


@query(sql("SELECT hit, count(*) AS chunks, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(len) AS BIGINT) AS n_bytes FROM (SELECT content_hash, min(len) AS len, count(*) AS refs, content_hash IN (SELECT content_hash FROM chunk_ref WHERE lang = 'en') AS hit FROM chunk_ref WHERE lang IS DISTINCT FROM 'en' GROUP BY content_hash) GROUP BY hit", "chunk_ref"))
def dedup_new_vs_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store that holds the English files has of the others' chunks."""
    refs = T.chunk_refs(spark, sf_dir)
    found = store.new_and_known(refs.where("lang <> 'en'"), refs.where("lang = 'en'"))
    return found.groupBy("hit").agg(F.count(F.lit(1)).alias("chunks"), F.sum("refs").alias("refs"), F.sum("len").alias("n_bytes"))


@query(
    sql(
        """
, copies AS (SELECT content_hash, ino AS segment_id, logical_offset AS "offset" FROM chunk_ref),
low AS (SELECT content_hash, min(segment_id * 131072 + "offset") AS canon, count(*) AS n FROM copies GROUP BY content_hash)
SELECT c.content_hash, canon // 131072 AS canonical_segment, canon % 131072 AS canonical_offset, segment_id AS loser_segment, "offset" AS loser_offset
FROM copies c JOIN low USING (content_hash) WHERE n > 1 AND segment_id * 131072 + "offset" <> canon
""",
        "chunk_ref",
    )
)
def dedup_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob a segment, duplicates point at the lowest place."""
    places = T.chunk_refs(spark, sf_dir).select(
        F.lit(0).alias("vdev_id"), "content_hash", F.col("ino").alias("segment_id"), F.col("logical_offset").alias("offset")
    )
    found = store.convergence(places)
    return found.select(
        "content_hash",
        F.col("canonical.segment_id").alias("canonical_segment"),
        F.col("canonical.offset").alias("canonical_offset"),
        F.col("loser.segment_id").alias("loser_segment"),
        F.col("loser.offset").alias("loser_offset"),
    )


@query(sql("SELECT content_hash, count(DISTINCT dir) AS groups, count(*) AS refs FROM chunk_ref GROUP BY content_hash HAVING count(DISTINCT dir) > 1", "chunk_ref"))
def shared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: chunks that more than one directory uses."""
    return store.shared(T.chunk_refs(spark, sf_dir), "dir")


@query(sql("SELECT content_hash, CAST(sum(d) AS BIGINT) AS pins FROM (SELECT content_hash, 1 AS d FROM chunk_ref UNION ALL SELECT content_hash, -1 FROM chunk_ref WHERE lang = 'es') GROUP BY content_hash HAVING sum(d) > 0", "chunk_ref"))
def pinned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference pins, deleting the Spanish files unpins; what is still held."""
    refs = T.chunk_refs(spark, sf_dir)
    up = refs.select("content_hash", F.lit(1).alias("delta"))
    down = refs.where("lang = 'es'").select("content_hash", F.lit(-1).alias("delta"))
    return store.pins(up.unionByName(down))


@query("""
SELECT o_orderkey AS ino, CAST(n AS BIGINT) AS blocks, CAST(n - CASE WHEN n > 1 THEN 1 ELSE 0 END AS BIGINT) AS stored FROM (SELECT o_orderkey, 2 AS n FROM orders)
""")
def zero_chunk_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a data block and a block of zeros; the zeros become holes."""
    key = F.sha2(F.col("o_orderkey").cast("string"), 256)
    blob = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ino"),
        F.concat(F.encode(F.repeat(key, F.lit(4)), "utf-8"), F.unhex(F.repeat(F.lit("00"), F.lit(256)))).alias("bytes"),
    )
    blocks = T.fixed_blocks(blob)
    counted = lambda df, name: df.groupBy("ino").agg(F.count(F.lit(1)).alias(name))
    return counted(blocks, "blocks").join(counted(store.without_holes(blocks, 256), "stored"), "ino")


@query(sql('SELECT content_hash, len, seq, shard, record_len, segment_id, "offset" FROM location', "location"))
def segment_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies in shard order, offsets from running sums."""
    return T.locations(T.chunk_refs(spark, sf_dir))


@query(
    sql(
        """RECURSIVE , g AS MATERIALIZED (SELECT shard, seq, record_len, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM location),
w(shard, seq, record_len, n, segment_no, pos) AS (
  SELECT shard, seq, record_len, n, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g WHERE n = 1
  UNION ALL SELECT g.shard, g.seq, g.record_len, g.n, w.segment_no + CASE WHEN w.pos + w.record_len + g.record_len > 65536 THEN 1 ELSE 0 END,
    CASE WHEN w.pos + w.record_len + g.record_len > 65536 THEN 0 ELSE w.pos + w.record_len END FROM w JOIN g ON g.shard = w.shard AND g.n = w.n + 1)
SELECT shard, seq, record_len, segment_no, pos AS "offset" FROM w""",
        "location",
    )
)
def segment_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact roll, which is sequential by shard."""
    return store.greedy_segments(T.locations(T.chunk_refs(spark, sf_dir)), T.SEGMENT_CAP)


@query(sql("SELECT segment_id, count(*) AS record_count, CAST(sum(record_len) AS BIGINT) AS total_bytes, sha256(string_agg(content_hash, '' ORDER BY \"offset\")) AS fingerprint FROM location GROUP BY segment_id", "location"))
def segment_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3, A4: footers."""
    return store.sealed_segments(T.locations(T.chunk_refs(spark, sf_dir)))


@query(sql("SELECT content_hash, vdev_id, segment_id, \"offset\", len FROM replica WHERE content_hash > '8' ORDER BY content_hash, vdev_id LIMIT 8192", "replica"))
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyset page of the index (a page is the feature)."""
    index = T.replicas(T.locations(T.chunk_refs(spark, sf_dir))).select("content_hash", "vdev_id", "segment_id", "offset", "len")
    return store.page_after(index, ("8", -1), 8192)


@query(sql('SELECT content_hash, vdev_id, segment_id, "offset", len FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY vdev_id) AS k FROM replica) WHERE k = 1', "replica"))
def preferred_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hash on its lowest device."""
    return store.preferred(T.replicas(T.locations(T.chunk_refs(spark, sf_dir))))


@query(sql("SELECT content_hash, string_agg(CAST(vdev_id AS VARCHAR), ',' ORDER BY vdev_id) AS devices FROM replica GROUP BY content_hash", "replica"))
def replica_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices of each hash."""
    held = T.replicas(T.locations(T.chunk_refs(spark, sf_dir)))
    devices = F.array_sort(F.collect_list("vdev_id"))  # as many as there are devices
    return held.groupBy("content_hash").agg(F.concat_ws(",", F.transform(devices, lambda d: d.cast("string"))).alias("devices"))


@query(sql("SELECT c.ino, l.content_hash, l.segment_id, l.\"offset\" FROM chunk_ref c JOIN location l USING (content_hash) WHERE c.ordinal = 0", "location"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's first chunk lies."""
    refs = T.chunk_refs(spark, sf_dir)
    first = refs.where("ordinal = 0").select("ino", "content_hash")
    return first.join(T.locations(refs), "content_hash").select("ino", "content_hash", "segment_id", "offset")


@query(sql("SELECT content_hash, max(seq) AS seq FROM (SELECT content_hash, ino * 67108864 + ordinal AS seq FROM chunk_ref) GROUP BY content_hash", "chunk_ref"))
def scan_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scan into an index, later records over earlier ones."""
    rows = T.chunk_refs(spark, sf_dir).select("content_hash", T.sequence_number(F.col("ino"), F.col("ordinal")).alias("seq"))
    entries = rows.select("content_hash", "seq", F.col("seq").alias("version"))
    return store.upserted(entries.limit(0), entries, ["content_hash"]).select("content_hash", "seq")


@query(sql("SELECT content_hash, count(*) AS sources, min(p) AS source FROM (SELECT DISTINCT content_hash, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS p FROM chunk_ref) GROUP BY content_hash", "chunk_ref"))
def merged_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams in one hash space; the first source wins."""
    refs = T.chunk_refs(spark, sf_dir)
    stream = lambda cond: refs.where(cond).select("content_hash").distinct()
    en, other = stream("lang = 'en'"), stream("lang <> 'en' OR lang IS NULL")
    won = store.first_source_wins([en, other], "content_hash").select("content_hash", F.col("priority").cast("long").alias("source"))
    both = en.unionByName(other).groupBy("content_hash").agg(F.count(F.lit(1)).alias("sources"))
    return won.join(both, "content_hash").select("content_hash", "sources", "source")


@query()
def compress_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the codec of each blob, and that it unpacks to the same bytes."""
    packed = T.blobs(spark, sf_dir).withColumn("p", codecs.compressed(F.col("bytes")))
    back = codecs.decompressed(F.col("p.codec"), F.octet_length("bytes"), F.col("p.stored"))
    return packed.select(
        "ino", F.col("p.codec").alias("codec"), F.octet_length("p.stored").alias("stored_bytes"), (back == F.col("bytes")).alias("ok")
    )


@query(sql("SELECT ino, true AS opens, true AS refused FROM blob", "blob"))
def seal_open_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sealed with the header as associated data; opens with it and refuses another."""
    blob = T.blobs(spark, sf_dir)
    key, header = F.unhex(F.lit("00" * 16)), F.encode(F.col("ino").cast("string"), "utf-8")
    nonce = F.unhex(F.substring(F.sha2(header, 256), 1, 24))
    sealed = blob.withColumn("envelope", codecs.sealed(F.col("bytes"), key, nonce, header))
    return sealed.select(
        "ino",
        (codecs.opened(F.col("envelope"), key, header) == F.col("bytes")).alias("opens"),
        codecs.opened(F.col("envelope"), key, F.concat(header, F.lit(b"!"))).isNull().alias("refused"),
    )
