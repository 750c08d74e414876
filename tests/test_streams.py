"""Streams against their batch twins, run in several micro-batches."""

from pyspark.sql import functions as F

from siltstone.functions.addresses import slice_of
from siltstone.operators import delta, extents, stripes
from siltstone.streaming import streams

LOG = "shard_id int, ino long, new_object_hash string, epoch long"
ROWS = [(i % 2, i % 5, f"h{i}", i) for i in range(40)]


def written(spark, rows, schema, folder, order):
    frame = spark.createDataFrame(rows, schema)
    frame.repartitionByRange(4, order).sortWithinPartitions(order).write.parquet(folder)
    return frame


def test_latest_state_above_a_watermark(spark, tmp_path):
    log = written(spark, ROWS, LOG, f"{tmp_path}/log", "epoch")
    marks = spark.createDataFrame([(0, 20), (1, 38)], "shard_id int, watermark long")
    source = streams.source(spark, f"{tmp_path}/log", log)
    stream = streams.above_watermark(source, marks).drop("watermark")
    found = streams.latest_now(stream, f"{tmp_path}/out", ["shard_id", "ino"], "epoch")
    columns = ["shard_id", "ino", "new_object_hash", "epoch"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, delta.replayed(log, marks).select(columns).collect()))


def test_upserts_by_batch(spark, tmp_path):
    log = written(spark, ROWS, LOG, f"{tmp_path}/log", "epoch")
    streams.upsert_into(streams.source(spark, f"{tmp_path}/log", log), f"{tmp_path}/out", ["ino"], "epoch", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    newest = out.groupBy("ino").agg(F.max_by("new_object_hash", "epoch").alias("h"))
    assert {r["ino"]: r["h"] for r in newest.collect()} == {i: f"h{35 + i}" for i in range(5)}
    assert out.select("batch").distinct().count() > 1


def test_sessions_go_on_from_batch_to_batch(spark, tmp_path):
    rows = [(i % 3, i, (i // 3 % 4) * 8, 8) for i in range(60)]
    writes = spark.createDataFrame(rows, "ino long, seq long, offset long, len long")
    for i in range(4):  # files come in the order in which a log is written
        writes.where(f"seq DIV 15 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = streams.append_sessions(streams.source(spark, f"{tmp_path}/log", writes))
    found = streams.available_now(stream, f"{tmp_path}/out")
    batch = extents.append_sessions(writes).select("ino", "seq", "session")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_descriptor_sanity_and_slices(spark):
    rows = [(2, 1, [0, 1, 2], 4096, 8000, 0), (2, 1, [0, 1], 4096, 8000, 0), (2, 1, [0, 1, 2], 4096, 9000, 0), (2, 1, [0, 1, 2], 4096, 8000, 3), (1, 1, [0, 1], 4096, 9, 0), (2, 1, [0, 1, 2], 0, 0, 0), (2, 1, [0, 1, 2], 1 << 32, 9, 0), (2, 1, None, 4096, 9, 0)]
    frame = spark.createDataFrame(rows, "k int, m int, devices array<int>, shard_size long, logical long, i int")
    sane = stripes.is_sane(*(F.col(c) for c in ("k", "m", "devices", "shard_size", "logical", "i")))
    assert [r[0] for r in frame.select(sane).collect()] == [True] + [False] * 7
    cut = spark.createDataFrame([(b"abcdef", 2, 3), (b"abc", 2, 9), (b"abc", 5, 1)], "b binary, o int, n int").select(slice_of(F.col("b"), F.col("o"), F.col("n")))
    assert [bytes(r[0]) for r in cut.collect()] == [b"cde", b"c", b""]
