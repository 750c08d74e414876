"""Recovery, index rebuild, stripe upkeep, reads by place, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import addresses as A
from siltstone.functions import codecs
from siltstone.operators import recovery, stripes
from siltstone.plans import maintenance
from siltstone.plans.catalogue import query
from siltstone.plans.sets.devices import copies
from siltstone.sources import records
from siltstone.sources import tables as T
from siltstone.sources.work import small_batches, written

sql = T.with_tables

_SUPER = """, sb AS (SELECT shard_id, v AS vdev_id, max(epoch) * (3 + v) // 8 AS epoch, (shard_id + v) % 4 <> 0 AS ok FROM (SELECT shard_id, epoch, unnest(range(0, 2)) AS v FROM delta) GROUP BY shard_id, v),
far AS (SELECT shard_id, max(epoch) AS epoch, arg_min(vdev_id, (-epoch, vdev_id)) AS vdev_id FROM sb WHERE ok GROUP BY shard_id)"""


def shard_superblocks(log: DataFrame) -> DataFrame:
    """Two devices' copies of each shard's superblock; one is further along, and of some shards that one is damaged."""
    last = log.groupBy("shard_id").agg(F.max("epoch").alias("last"))
    rows = last.select("shard_id", "last", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("vdev_id"))
    return rows.select("shard_id", "vdev_id", F.floor(F.col("last") * (3 + F.col("vdev_id")) / 8).alias("epoch"), ((F.col("shard_id") + F.col("vdev_id")) % 4 != 0).alias("ok"))


@query(sql(f"{_SUPER} SELECT shard_id, epoch, vdev_id FROM far", "delta"))
def shard_superblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's superblock that is furthest along among the valid ones."""
    return recovery.furthest(shard_superblocks(T.delta_log(spark, sf_dir)), F.col("ok"))


@query(
    sql(
        f"""{_SUPER}, l AS (SELECT *, event_id % 97 <> 0 AS readable FROM delta),
torn AS (SELECT shard_id, segment_id, min(epoch) AS at FROM l WHERE NOT readable GROUP BY ALL),
e AS (SELECT l.* FROM l LEFT JOIN torn USING (shard_id, segment_id) LEFT JOIN far ON far.shard_id = l.shard_id WHERE l.epoch <= far.epoch OR torn.at IS NULL OR l.epoch < torn.at)
SELECT shard_id, ino, arg_max(new_object_hash, epoch) AS new_object_hash, max(epoch) AS epoch FROM e GROUP BY shard_id, ino""",
        "delta",
    )
)
def recovered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the furthest valid superblocks, and over it the log's readable entries; torn segments end early."""
    log = T.delta_log(spark, sf_dir).withColumn("readable", F.col("event_id") % 97 != 0)
    marks = recovery.furthest(shard_superblocks(log), F.col("ok"))
    covered = log.join(marks.select("shard_id", F.col("epoch").alias("mark")), "shard_id").where("epoch <= mark")
    base = covered.groupBy("shard_id", "ino").agg(F.max_by("new_object_hash", "epoch").alias("new_object_hash"), F.max("epoch").alias("epoch"))
    return recovery.recovered(base, log, marks)


@query(sql("""SELECT content_hash, CAST(vdev_id AS INTEGER) AS vdev_id, segment_id, "offset" FROM replica WHERE good
UNION ALL SELECT content_hash, CAST(-1 AS INTEGER), segment_id, "offset" FROM location WHERE content_hash NOT IN (SELECT content_hash FROM replica WHERE good)""", "replica"))
def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index made anew from what each device's records and the stripes' bodies hold."""
    index = T.locations(T.chunk_refs(spark, sf_dir))
    return recovery.rebuilt_index(T.replicas(index).where("good"), index)


@query(sql("""SELECT content_hash, vdev_id, segment_id, "offset" FROM replica WHERE NOT (vdev_id = 1 AND content_hash LIKE '_a%' AND content_hash NOT LIKE '__c%')""", "replica"))
def index_remove_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: entries of device 1 are removed by key if they still point to the segment that is named; some have moved since."""
    held = copies(spark, sf_dir).select("content_hash", "vdev_id", "segment_id", "offset")
    told = held.where("vdev_id = 1 AND content_hash LIKE '_a%'").withColumn("segment_id", F.col("segment_id") + F.col("content_hash").like("__c%").cast("long"))
    return recovery.removed_where_still(held, told)


_UPKEEP = """, seg AS (SELECT segment_id, CAST(sum(record_len) AS BIGINT) AS total, CAST(sum(CASE WHEN content_hash IN (SELECT content_hash FROM chunk_ref WHERE lang = 'en') AND segment_id % 7 <> 0 THEN record_len ELSE 0 END) AS BIGINT) AS live FROM location GROUP BY segment_id)"""


@query(sql(f"{_UPKEEP} SELECT segment_id, CASE WHEN live = 0 THEN 'drop' WHEN live < 0.3 * total THEN 'repack' WHEN segment_id % 4 < 3 THEN 'unstripe' ELSE 'keep' END AS action FROM seg", "location"))
def stripe_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripes to drop, to repack, and to turn back because they name a device that leaves."""
    refs = T.chunk_refs(spark, sf_dir).withColumn("live", F.expr("lang = 'en'"))
    index = T.locations(refs, F.max("live").alias("live"))
    kept = F.when(F.col("live") & (F.col("segment_id") % 7 != 0), F.col("record_len")).otherwise(0)
    per = index.groupBy("segment_id").agg(F.sum("record_len").alias("total_bytes"), F.sum(kept).alias("live_bytes"))
    devices = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("segment_id") + i) % 4).cast("int"))
    return recovery.stripe_upkeep(per.withColumn("devices", devices), 0.3, F.lit(2))


@query(sql("SELECT ino AS segment_id, CAST(i AS INTEGER) AS shard_index, true AS ok FROM (SELECT ino, unnest([0, 4]) AS i FROM blob WHERE octet_length(bytes) > 0)", "blob"))
def shard_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 and 4 of every blob, striped at 3 + 2, were lost and are made again; they have the hashes that they had."""
    body = T.blobs(spark, sf_dir).select(F.col("ino").alias("segment_id"), F.col("bytes").alias("body")).where("octet_length(body) > 0")
    shards = stripes.encoded(body, 3, 2)
    again = stripes.rebuilt(shards.where("shard_index NOT IN (0, 4)"), 3, 2).select("segment_id", "shard_index", F.sha2("bytes", 256).alias("found"))
    met = again.join(shards.select("segment_id", "shard_index", "shard_hash"), ["segment_id", "shard_index"], "left")
    return met.select("segment_id", "shard_index", (F.col("found") == F.col("shard_hash")).alias("ok"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as a segment of its chunks."""
    chunks = T.chunk_refs(spark, sf_dir, keep_payload=True)
    return records.write_segments(chunks.select(F.col("ino").alias("segment_id"), F.col("ordinal").alias("seq"), "content_hash", "payload"))


@query(sql("SELECT ino AS segment_id, count(*) AS n, count(*) AS good FROM chunk_ref GROUP BY ino", "chunk_ref"))
def stripe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments striped at 2 + 1 that lost a shard, put together again and scanned."""
    shards = stripes.encoded(_segments(spark, sf_dir).select("segment_id", F.col("raw").alias("body")), 2, 1)
    whole = stripes.bodies(shards.where("shard_index <> segment_id % 3"), 2, 1)
    seen = records.scan_segments(whole).where("kind = 'record'")
    return seen.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))


_UNSTRIPED = """, r AS (SELECT ino, ordinal, content_hash, substr(content_hash, 1, 1) < '4' AS live, len + octet_length(encode('{"magic": "SLT1", "hash": "' || content_hash || '", "kind": "RawChunk", "codec": "none", "stored": ' || len || ', "size": ' || len || '}')) + 8 AS n FROM chunk_ref),
act AS (SELECT ino, CASE WHEN live = 0 THEN 'drop' WHEN ino % 13 = 0 THEN 'keep' WHEN live < 0.3 * total THEN 'repack' WHEN ino % 4 < 3 THEN 'unstripe' ELSE 'keep' END AS action
  FROM (SELECT ino, sum(n) AS total, sum(CASE WHEN live THEN n ELSE 0 END) AS live FROM r GROUP BY ino)),
kept AS (SELECT content_hash, ino, action, CAST(4096 + sum(n) OVER (PARTITION BY ino ORDER BY ordinal) - n AS BIGINT) AS "offset", CAST(n AS BIGINT) AS len FROM r JOIN act USING (ino) WHERE action IN ('keep', 'unstripe') OR action = 'repack' AND live)"""


@query(sql(f"""{_UNSTRIPED} SELECT content_hash, -1 AS vdev_id, ino AS segment_id, "offset", len FROM kept WHERE action = 'keep'
UNION ALL SELECT content_hash, unnest([0, 1, 3]), ino + 1099511627776, "offset", len FROM kept WHERE action <> 'keep'""", "chunk_ref"))
def stripe_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as segments striped at 2 + 1 that lost a shard, after the upkeep for device 2 that leaves; each thirteenth lost two and can only be dropped."""
    small_batches(spark)
    segments = written(_segments(spark, sf_dir), "pass-segments")
    scanned = written(records.scan_segments(segments, payloads=False).where("kind = 'record'"), "pass-index")
    index = scanned.select("content_hash", F.lit(-1).alias("vdev_id"), "segment_id", F.col("start").alias("offset"), (F.col("stop") - F.col("start")).alias("len"))
    alive = F.substring("content_hash", 1, 1) < "4"
    per = index.groupBy("segment_id").agg(F.sum("len").alias("total_bytes"), F.sum(F.when(alive, F.col("len")).otherwise(0)).alias("live_bytes"))
    devices = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("segment_id") + i) % 4).cast("int"))
    actions = recovery.stripe_upkeep(per.withColumn("devices", devices), 0.3, F.lit(2))
    shards = stripes.encoded(segments.select("segment_id", F.col("raw").alias("body")), 2, 1)
    held = shards.where("shard_index <> segment_id % 3 AND (segment_id % 13 <> 0 OR shard_index <> (segment_id + 1) % 3)")
    online = F.array(F.lit(0), F.lit(1), F.lit(3))
    return maintenance.unstripe(held, index, actions, index.where(alive), online, 2, 1, F.col("segment_id") + T.SEGMENTS_A_SHARD)


@query(sql("SELECT ino AS segment_id, ordinal AS place, content_hash FROM chunk_ref", "chunk_ref"))
def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by their headers alone, payloads stepped over."""
    return records.headers(_segments(spark, sf_dir)).select("segment_id", "place", "content_hash")


@query(sql("SELECT ino AS segment_id, content_hash, 'none' AS codec, len AS stored, true AS ok, content_hash AS raw_hash FROM chunk_ref", "chunk_ref"))
def read_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record read by its location, verified, with its stored bytes."""
    segments = _segments(spark, sf_dir)
    got = records.read_records(segments, records.headers(segments))
    return got.select("segment_id", "content_hash", "codec", "stored", "ok", F.sha2("raw", 256).alias("raw_hash"))


@query(sql("""SELECT content_hash || printf('%04x', vdev_id) AS key, printf('%016x', segment_id) || printf('%016x', "offset") || printf('%08x', len) AS value, true AS ok FROM replica""", "replica"))
def index_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index keys and values as sortable bytes, and back."""
    held = copies(spark, sf_dir).select("content_hash", "vdev_id", "segment_id", "offset", "len")
    coded = held.withColumns({"key": codecs.index_key(F.col("content_hash"), F.col("vdev_id")), "value": codecs.index_value(F.col("segment_id"), F.col("offset"), F.col("len"))})
    back = codecs.index_entry(F.col("key"), F.col("value"))
    told = F.struct("content_hash", F.col("vdev_id").cast("long").alias("vdev_id"), "segment_id", F.col("offset").cast("long").alias("offset"), F.col("len").cast("long").alias("len"))
    return coded.select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"), (back == told).alias("ok"))


@query(sql("SELECT ino, sha256('derive:2:' || ino) AS key_hash, substr(sha256('check:' || sha256('derive:2:' || ino)), 1, 8) AS check_value, true AS unwraps, true AS refused FROM blob", "blob"))
def key_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys derived by epoch, their check values, wrapped under another key and unwrapped; a wrong key is refused."""
    keyed = T.blobs(spark, sf_dir).select("ino", codecs.derived_key(F.lit(2), F.col("ino").cast("string")).alias("key"))
    master, wrong = F.unhex(F.lit("11" * 16)), F.unhex(F.lit("22" * 16))
    nonce = F.unhex(F.substring(F.sha2(F.col("ino").cast("string"), 256), 1, 24))
    wrapped = keyed.withColumn("wrapped", codecs.sealed(F.unhex("key"), master, nonce, F.encode(F.lit("key"), "utf-8")))
    unwrapped = lambda k: codecs.opened(F.col("wrapped"), k, F.encode(F.lit("key"), "utf-8"))
    return wrapped.select("ino", F.col("key").alias("key_hash"), codecs.check_value(F.col("key")).alias("check_value"), (F.lower(F.hex(unwrapped(master))) == F.col("key")).alias("unwraps"), unwrapped(wrong).isNull().alias("refused"))


@query(sql("SELECT ino, octet_length(bytes) AS size, true AS same, true AS refused FROM blob", "blob"))
def object_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inode objects as checked bytes, decoded again; a flipped byte is refused."""
    inode = F.struct("ino", F.octet_length("bytes").alias("size"), F.lit("file").alias("kind"), F.coalesce("dir", F.lit("")).alias("dir"))
    rows = T.blobs(spark, sf_dir).select(inode.alias("inode")).withColumn("raw", codecs.encoded_object(F.col("inode")))
    kind = "ino long, size int, kind string, dir string"
    spoilt = F.concat(F.substring("raw", 1, 6), F.lit(b"\x00"), F.substring("raw", 8, 1 << 30))
    return rows.select("inode.ino", "inode.size", (codecs.decoded_object(F.col("raw"), kind) == F.col("inode")).alias("same"), codecs.decoded_object(spoilt, kind).isNull().alias("refused"))


_DEVICE_MOVES = {
    ("absent", "signup"): "attached",
    ("attached", "purchase"): "online",
    ("attached", "error"): "absent",
    ("online", "error"): "faulted",
    ("online", "view"): "offline",
    ("offline", "purchase"): "online",
    ("faulted", "signup"): "attached",
    ("offline", "error"): "absent",
}


@query(
    "WITH RECURSIVE m(state, event, goes) AS (VALUES " + ", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in _DEVICE_MOVES.items()) + """),
e AS (SELECT user_id, event_type AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS last FROM events),
w(user_id, n, last, state, refused) AS (
  SELECT user_id, CAST(0 AS BIGINT), any_value(last), 'absent', CAST(0 AS BIGINT) FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, e.n, w.last, coalesce(m.goes, w.state), w.refused + CASE WHEN m.goes IS NULL THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1 LEFT JOIN m ON m.state = w.state AND m.event = e.event)
SELECT user_id % 7 AS pool, user_id AS vdev_id, state, refused FROM w WHERE n = last"""
)
def device_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's state after its history of attach, detach, online and offline; moves that a state doesn't know are refused."""
    told = T.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("pool"), F.col("user_id").alias("vdev_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("event"))
    return recovery.device_states(told, _DEVICE_MOVES, "absent")


@query("""WITH d AS (SELECT s_nationkey AS pool, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS vdev_id, count(*) OVER (PARTITION BY s_nationkey) AS vdev_count, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root_uid, bool_and(s_acctbal > -900) OVER (PARTITION BY s_nationkey) AS ok FROM supplier)
SELECT pool, CAST(vdev_id AS INTEGER) AS vdev_id, vdev_count, CAST(1 AS BIGINT) AS generation, CAST(1 AS BIGINT) AS root_ino, root_uid, CAST(2 AS BIGINT) AS next_ino FROM d WHERE ok""")
def create_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pools on blank devices, their numbering, first checkpoint, and a root that belongs to the creator."""
    devices = T.read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pool"), F.lpad(F.col("s_suppkey").cast("string"), 20, "0").alias("path"), F.col("s_suppkey").alias("uid"), (F.col("s_acctbal") > -900).alias("blank")
    )
    return recovery.created_pool(devices)


@query(sql('SELECT shard, segment_id, row_number() OVER (PARTITION BY shard ORDER BY segment_id) AS place FROM (SELECT DISTINCT shard, segment_id FROM location)', "location"))
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each owner, in order."""
    ids = T.locations(T.chunk_refs(spark, sf_dir)).select("shard", "segment_id").distinct()
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("segment_id")).cast("long"))


@query("SELECT event_id, sha256(encode(CAST(user_id AS VARCHAR))) || substr(sha256(sha256(encode(CAST(user_id AS VARCHAR)))), 1, 4) AS line, true AS ok, false AS ok_spoilt FROM events")
def key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identities as hex lines with a checksum; a line with a digit changed is refused, by the checksum or by the slot."""
    identity = F.sha2(F.col("user_id").cast("string"), 256)
    rows = T.read(spark, sf_dir, "events").select("event_id", codecs.key_line(identity).alias("line"), codecs.recipient_of(identity).alias("slot"))
    spoilt = F.concat(F.when(F.substring("line", 1, 1) == "0", "1").otherwise("0"), F.coalesce(F.substring("line", 2, 200), F.lit("")))
    opens = lambda line: codecs.key_line_opens(line, F.col("slot"))
    return rows.select("event_id", "line", opens(F.col("line")).alias("ok"), opens(spoilt).alias("ok_spoilt"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.' || json_keys(props)[1]), '') AS first_value, CAST(len(json_keys(props)) AS INTEGER) AS fields FROM events WHERE props IS NOT NULL")
def control_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages parsed, field by field."""
    rows = T.read(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.coalesce(F.get(F.map_values("m"), 0), F.lit("")).alias("first_value"), F.size("m").alias("fields"))


_PERIODS = {"checkpoint": 5, "coalesce": 60, "dedup": 30}


@query("WITH p(task, period) AS (VALUES " + ", ".join(f"('{t}', {s})" for t, s in _PERIODS.items()) + """), t AS (SELECT user_id % 16 AS shard_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS opened, CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) AS now FROM events GROUP BY 1)
SELECT shard_id, task, (now - opened) // period AS runs, opened + ((now - opened) // period + 1) * period AS next_due FROM t, p""")
def periodic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each shard's periodic tasks ran between its first and last event, and when they are due next."""
    secs = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    per = T.read(spark, sf_dir, "events").groupBy((F.col("user_id") % T.SHARDS).alias("shard_id")).agg(secs(F.min("ts")).alias("opened"), secs(F.max("ts")).alias("now"))
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(s).cast("long").alias("period")) for t, s in _PERIODS.items()])).alias("t")
    runs = F.floor((F.col("now") - F.col("opened")) / F.col("t.period"))
    return per.select("shard_id", "opened", "now", tasks).select("shard_id", "t.task", runs.alias("runs"), (F.col("opened") + (runs + 1) * F.col("t.period")).alias("next_due"))


@query(sql('SELECT shard, CAST(pos // 1048576 AS BIGINT) AS tick, count(*) AS chunks, CAST(sum(record_len) AS BIGINT) AS n_bytes FROM (SELECT shard, record_len, CAST(sum(record_len) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) - record_len AS pos FROM location) GROUP BY shard, pos // 1048576', "location"))
def conversion_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converting is throttled to a MiB a tick and shard; which tick each chunk falls in."""
    index = T.locations(T.chunk_refs(spark, sf_dir)).withColumn("range", F.floor(F.col("seq") / (T.BLOCKS_A_FILE * T.FILES_A_RANGE)))
    placed = T.sums_before(index, "shard", "range", ["seq"], "record_len", "pos")
    return placed.groupBy("shard", F.floor(F.col("pos") / (1 << 20)).alias("tick")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("record_len").alias("n_bytes"))


@query("SELECT s_suppkey AS slot, ['passphrase', 'recipient', 'tpm'][CAST(s_suppkey % 3 AS INTEGER) + 1] AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END, s_suppkey) AS place FROM supplier")
def slot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key slots of a pool in the order in which they are tried, those that need the machine's chip last."""
    kind = F.element_at(F.array(F.lit("passphrase"), F.lit("recipient"), F.lit("tpm")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slot"), "s_nationkey", kind.alias("kind"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("kind") == "tpm", "slot"))
    return rows.select("slot", "kind", place.cast("long").alias("place"))
