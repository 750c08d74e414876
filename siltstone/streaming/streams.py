"""The change log as a stream: latest state, first chunks, idle seals, append sessions.

Sources are folders of Parquet files, read ``maxFilesPerTrigger`` at a time,
which is the back-pressure: nothing is dropped, a slow consumer falls behind.
``available_now`` drains what is there and stops; its sink is a folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, like: DataFrame, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def latest_state(log: DataFrame) -> DataFrame:
    """ino, epoch, new_object_hash: the newest entry of each inode so far (update or complete mode)."""
    return log.groupBy("shard_id", "ino").agg(
        F.max("epoch").alias("epoch"), F.max_by("new_object_hash", "epoch").alias("new_object_hash")
    )


def above_watermark(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Entries that the checkpointed base state doesn't contain yet; a stream-static join."""
    return log.join(watermarks, "shard_id").where(F.col("epoch") > F.col("watermark"))


def first_seen(chunks: DataFrame, time: str, delay: str) -> DataFrame:
    """New content hashes; repetitions within the delay are dropped and their state is forgotten after it."""
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def idle_seals(records: DataFrame, time: str, idle: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """shard_id, opened, sealed, records: a segment is sealed when its shard was idle."""
    window = F.session_window(time, idle)
    out = records.withWatermark(time, delay).groupBy("shard_id", window).agg(F.count(F.lit(1)).alias("records"))
    return out.select("shard_id", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("sealed"), "records")


SESSIONS = "ino long, seq long, session long"
_STATE = "expected long, session long"


def append_sessions(writes: DataFrame) -> DataFrame:
    """ino, seq, session: like the batch form, with the expected offset kept as state by inode.

    Writes of an inode have to arrive in order from batch to batch, as a log has them.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, session = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        sessions = []
        for offset, length in zip(rows["offset"].tolist(), rows["len"].tolist(), strict=True):
            session += offset != expected
            expected = offset + length
            sessions.append(session)
        state.update((int(expected), int(session)))
        yield pd.DataFrame({"ino": rows["ino"], "seq": rows["seq"], "session": sessions})

    return writes.groupBy("ino").applyInPandasWithState(run, SESSIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def committed(ops: DataFrame) -> DataFrame:
    """shard_id, event_id, epoch: the commit counter of each shard as state; operations in arrival order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        rows["epoch"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["shard_id", "event_id", "epoch"]]

    return ops.groupBy("shard_id").applyInPandasWithState(
        run, "shard_id int, event_id long, epoch long", "last long", "append", GroupStateTimeout.NoTimeout
    )


def available_now(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an appending stream over what its source has; its rows are files in ``folder``, none of them on the driver."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest_now(stream: DataFrame, folder: str, keys: list[str], version: str) -> DataFrame:
    """Runs a stream of changes over what its source has; each batch leaves its newest row a key, the newest of these are the state."""
    upsert_into(stream, f"{folder}/batches", keys, version, f"{folder}/checkpoint")
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batches/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("t")).select(*keys, *[f"t.{c}" for c in rest])


def upsert_into(stream: DataFrame, folder: str, keys: list[str], version: str, checkpoint: str) -> None:
    """foreachBatch sink: each micro-batch is written under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("t")).select(*keys, *[f"t.{c}" for c in rest])
        newest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
