"""Versioned tables in a folder: publish, read as of, snapshots, freshness.

A version is a directory of Parquet files; publishing it is one row in the
manifest, written only after all files are there, so a failed write leaves
nothing visible. That row's file is named by the generation and made only if it
isn't there, so of two writers one publishes and the other is told so. Readers
take the newest published version, or the one that a snapshot names. The
manifest is added to and never rewritten.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "kind string, name string, generation long, version string, created_at_nanos long"
RESERVED = ".staging/"
#: Beside the manifest, and not named with a dot or underscore, which readers skip.
LOCK = "lock.json"


class LockedError(RuntimeError):
    """Another writer holds the table."""


class StaleError(RuntimeError):
    """Another generation was published since the one that the caller read."""


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    folder: str

    def manifest(self) -> DataFrame:
        path = f"{self.folder}/manifest"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(MANIFEST).json(path) if there else self.spark.createDataFrame([], MANIFEST)

    def _append(self, kind: str, name: str, generation: int, version: str) -> None:
        row = [(kind, name, generation, version, time.time_ns())]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def generation(self) -> int:
        return self.manifest().where("kind = 'publish'").agg(F.max("generation")).first()[0] or 0

    def publish(self, rows: DataFrame, expected: int | None = None) -> int:
        """Writes a version and makes it visible; refuses if ``expected`` is no longer the newest generation."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{version}")
        while True:
            now = self.generation()
            if expected is not None and now != expected:
                raise StaleError(f"generation {now} was published after {expected}")
            if self._claim(now + 1, version):
                return now + 1

    def _claim(self, generation: int, version: str) -> bool:
        """Makes the manifest's file of a generation; false if another writer made it."""
        row = {"kind": "publish", "name": "", "generation": generation, "version": version, "created_at_nanos": time.time_ns()}
        return self._made(f"manifest/generation-{generation:020d}.json", row)

    def _file(self, name: str) -> tuple[JavaObject, JavaObject]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _made(self, name: str, row: dict) -> bool:
        """Makes a file that must not exist; false if it is there."""
        path, files = self._file(name)
        try:
            out = files.create(path, False)  # fails if it exists
        except Py4JJavaError as e:
            if files.exists(path):
                return False
            raise e
        try:
            out.write(bytearray(json.dumps(row).encode() + b"\n"))
        finally:
            out.close()
        return True

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Holds the table for one writer; others are refused at once.

        The lock is a file beside the manifest. It stays if its holder is lost;
        ``break_lock`` removes it, and is for whoever knows that the holder is
        gone. Publishing is safe without it, see ``_claim``. A holder whose lock
        was broken removes only a lock of its own.
        """
        held = uuid.uuid4().hex
        if not self._made(LOCK, {"holder": held, "created_at_nanos": time.time_ns()}):
            raise LockedError(self.folder)
        try:
            yield
        finally:
            if self.holder() == held:
                self.break_lock()

    def holder(self) -> str | None:
        """Who holds the table, or null."""
        path, files = self._file(LOCK)
        if not files.exists(path):
            return None
        found = self.spark.read.schema("holder string").json(path.toString()).first()
        return found["holder"] if found else None

    def break_lock(self) -> None:
        path, files = self._file(LOCK)
        files.delete(path, False)

    def read(self, generation: int | None = None) -> DataFrame:
        wanted = self.generation() if generation is None else generation
        found = self.manifest().where((F.col("kind") == "publish") & (F.col("generation") == wanted)).first()
        if found is None:
            raise KeyError(f"no generation {wanted}")
        return self.spark.read.parquet(f"{self.folder}/data/{found['version']}")

    def snapshots(self) -> DataFrame:
        """name, generation of snapshots that exist; reserved names are hidden."""
        rows = self.manifest().where("kind IN ('snapshot', 'drop')").where(~F.col("name").startswith(RESERVED))
        last = rows.groupBy("name").agg(F.max_by(F.struct("kind", "generation"), "created_at_nanos").alias("t"))
        return last.where("t.kind = 'snapshot'").select("name", "t.generation")

    def snapshot(self, name: str) -> None:
        if name.startswith(RESERVED) or not name:
            raise ValueError(f"{name!r} can't name a snapshot")
        if not self.snapshots().where(F.col("name") == name).isEmpty():
            raise ValueError(f"there is a snapshot {name!r}")
        self._append("snapshot", name, self.generation(), "")

    def drop_snapshot(self, name: str) -> None:
        if self.snapshots().where(F.col("name") == name).isEmpty():
            raise KeyError(name)
        self._append("drop", name, 0, "")

    def read_snapshot(self, name: str) -> DataFrame:
        found = self.snapshots().where(F.col("name") == name).first()
        if found is None:
            raise KeyError(name)
        return self.read(found["generation"])
