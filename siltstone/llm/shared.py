"""What the corpus operators share: work folders, written steps, word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of words in the query contracts (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns a worker's free memory to the system: workers are used again, and would keep the most they ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _in_batches(spark: SparkSession) -> None:
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES; the worker gives its free memory back when the task ends."""
    _in_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


def applied(groups: GroupedData, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``groups.applyInArrow``; the worker gives its free memory back after each group."""

    def run(t: pa.Table) -> pa.Table:
        out = kernel(t)
        del t
        give_back()
        return out

    return groups.applyInArrow(run, schema)


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder is
    made once and kept in the session's configuration.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """How many partitions hold ``amount`` at ``each`` apiece: grows with the input, without an upper limit."""
    return max(least, int(amount // each) + 1)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column has (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
