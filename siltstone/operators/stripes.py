"""Erasure-coded segments: layout, status, parity and recovery."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.codecs import coding_rows, gf_apply, rs_decode, rs_encode

SHARDS = "segment_id long, shard_index int, logical_len long, body_hash string, shard_hash string, bytes binary"


#: Fixed value: offsets in a segment have 32 bits.
MOST_OFFSET = 2**32 - 1


def is_sane(k: Column, m: Column, devices: Column, shard_size: Column, logical: Column, index: Column) -> Column:
    """Whether a descriptor can be acted on; one with a null field can't."""
    total = k + m
    shape = (k >= 2) & (m >= 1) & (F.size(devices) == total) & (index >= 0) & (index < total)
    # whether the body fits is asked by division: k shards of the greatest size still fit 64 bits, a damaged k may not
    fits = shard_size.between(1, MOST_OFFSET) & (logical >= 0) & (F.ceil(logical / k) <= shard_size)
    return F.coalesce(shape & fits, F.lit(False))


def is_valid_shape(k: Column, m: Column) -> Column:
    """Whether a pool may be given this stripe policy; 0 and 0 stand for none."""
    return F.coalesce(((k == 0) & (m == 0)) | ((k >= 2) & (m >= 1) & (k + m <= 255)), F.lit(False))


def encoded(bodies: DataFrame, k: int, m: int) -> DataFrame:
    """segment_id, body to its k + m shards; a segment is a row, so its work stays in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segment, body in zip(b["segment_id"].to_pylist(), b["body"].to_pylist(), strict=True):
                whole = hashlib.sha256(body).hexdigest()
                for i, shard in enumerate(rs_encode(body, k, m)):
                    rows.append((segment, i, len(body), whole, hashlib.sha256(shard).hexdigest(), shard))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["segment_id", "shard_index", "logical_len", "body_hash", "shard_hash", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return bodies.select("segment_id", "body").mapInArrow(run, SHARDS)


def reconstructed(shards: DataFrame, k: int, m: int) -> DataFrame:
    """segment_id, good (shards that verify), ok (the body was rebuilt and has its hash), body_bytes."""

    def run(t: pa.Table) -> pa.Table:
        held, body_hash, length = {}, None, 0
        for row in t.to_pylist():
            body_hash, length = row["body_hash"], row["logical_len"]
            if hashlib.sha256(row["bytes"]).hexdigest() == row["shard_hash"]:
                held[row["shard_index"]] = row["bytes"]
        ok = len(held) >= k and hashlib.sha256(rs_decode(held, k, m, length)).hexdigest() == body_hash
        return pa.table({"segment_id": t["segment_id"][:1], "good": pa.array([len(held)], pa.int32()), "ok": [ok], "body_bytes": pa.array([length], pa.int64())})

    return shards.groupBy("segment_id").applyInArrow(run, "segment_id long, good int, ok boolean, body_bytes long")


def inconsistent(shards: DataFrame, k: int, m: int, page: int = 4096) -> DataFrame:
    """(rule, key, detail) of stripes whose shards contradict each other: descriptor, parity or body.

    The shard with the least number gives the descriptor; shards that say another are named and left aside. The
    others that verify are encoded again where there are at least k; fewer are for other rules.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["shard_index"], r["body_hash"], r["logical_len"]))
        body_hash, length = rows[0]["body_hash"], rows[0]["logical_len"]
        size, held, found = -(-(-(-length // k)) // page) * page, {}, []
        for r in rows:
            if (r["body_hash"], r["logical_len"]) != (body_hash, length):
                found.append(f"shard {r['shard_index']} disagrees with its siblings")
            elif r["bytes"] is not None and len(r["bytes"]) == size and hashlib.sha256(r["bytes"]).hexdigest() == r["shard_hash"]:
                held[r["shard_index"]] = r["bytes"]
        if len(held) >= k:
            whole = rs_decode(held, k, m, size * k)
            again = gf_apply(coding_rows(k, m), np.frombuffer(whole, np.uint8).reshape(k, size))
            found += [f"parity shard {j} does not match the data shards" for j in range(k, k + m) if j in held and again[j].tobytes() != held[j]]
            if hashlib.sha256(whole[:length]).hexdigest() != body_hash:
                found.append("body does not have its hash")
        rule, key = ["StripeInconsistent"] * len(found), [str(rows[0]["segment_id"])] * len(found)
        return pa.table({c: pa.array(v, pa.string()) for c, v in (("rule", rule), ("key", key), ("detail", found))})

    return shards.groupBy("segment_id").applyInArrow(run, "rule string, key string, detail string")


def rebuilt(shards: DataFrame, k: int, m: int) -> DataFrame:
    """Shards that are missing or don't verify, made again from any ``k`` that do: segment_id, shard_index, shard_hash, bytes."""

    def run(t: pa.Table) -> pa.Table:
        held, length = {}, 0
        for row in t.to_pylist():
            length = row["logical_len"]
            if hashlib.sha256(row["bytes"]).hexdigest() == row["shard_hash"]:
                held[row["shard_index"]] = row["bytes"]
        again = dict(enumerate(rs_encode(rs_decode(held, k, m, length), k, m))) if len(held) >= k else {}
        lost = sorted(set(again) - set(held))
        return pa.table(
            {
                "segment_id": pa.array([t["segment_id"][0].as_py()] * len(lost), pa.int64()),
                "shard_index": pa.array(lost, pa.int32()),
                "shard_hash": pa.array([hashlib.sha256(again[i]).hexdigest() for i in lost], pa.string()),
                "bytes": pa.array([again[i] for i in lost], pa.binary()),
            }
        )

    return shards.groupBy("segment_id").applyInArrow(run, "segment_id long, shard_index int, shard_hash string, bytes binary")


def bodies(shards: DataFrame, k: int, m: int) -> DataFrame:
    """segment_id, raw: bodies put together again from any ``k`` shards that verify; those without are left out."""

    def run(t: pa.Table) -> pa.Table:
        held, length, body_hash = {}, 0, None
        for row in t.to_pylist():
            length, body_hash = row["logical_len"], row["body_hash"]
            if hashlib.sha256(row["bytes"]).hexdigest() == row["shard_hash"]:
                held[row["shard_index"]] = row["bytes"]
        raw = rs_decode(held, k, m, length) if len(held) >= k else None
        good = raw is not None and hashlib.sha256(raw).hexdigest() == body_hash
        return pa.table({"segment_id": t["segment_id"][: int(good)], "raw": pa.array([raw] if good else [], pa.binary())})

    return shards.groupBy("segment_id").applyInArrow(run, "segment_id long, raw binary")


def missing_shards(descriptors: DataFrame, present: DataFrame) -> DataFrame:
    """segment_id, shard_index, vdev_id: shards that a descriptor's device list names and nobody has."""
    named = descriptors.select("segment_id", F.posexplode("devices").alias("shard_index", "vdev_id"))
    return named.join(present, ["segment_id", "shard_index"], "left_anti")


def status(shards: DataFrame, k: int, copies: int) -> DataFrame:
    """stripes, logical_bytes, shard_bytes, mirrored_bytes, saved_bytes, missing, unreadable of (segment_id, logical, shard_size, state)."""
    per = shards.groupBy("segment_id").agg(
        F.max("logical").alias("logical"),
        F.sum(F.when(F.col("state") != "missing", F.col("shard_size")).otherwise(0)).alias("held"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "unreadable").alias("unreadable"),
        F.count_if(F.col("state") == "good").alias("good"),
    )
    mirrored = F.sum("logical") * copies
    return per.agg(
        F.count(F.lit(1)).alias("stripes"),
        F.sum("logical").alias("logical_bytes"),
        F.sum("held").alias("shard_bytes"),
        mirrored.alias("mirrored_bytes"),
        F.greatest(mirrored - F.sum("held"), F.lit(0)).alias("saved_bytes"),
        F.sum("missing").alias("missing"),
        F.sum("unreadable").alias("unreadable"),
        F.count_if(F.col("good") < k).alias("unrecoverable"),
    )
