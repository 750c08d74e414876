"""A corpus from raw documents to a training mix: five stages over ``documents``.

Each stage works on all rows that its predecessor kept and is written before
the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from siltstone.llm.shared import table, unused, written

#: Documents whose language scores less than this are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows and rejects documents of no identifiable language.

    A null, empty or letterless text is rejected, as is all if no row has a
    label; long texts are judged whole; repeated rows are judged alike; ties go
    to the language first by code point; an empty table stays empty; all other
    columns keep their values, whatever their names.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    label, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    found = language_id.identify(docs, model, (label, score))
    return found.where((F.col(label) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links at five words and 0.8.

    Where ids repeat or are missing each row is a document: rows are numbered
    and linked by number, and of a group the row with the smallest id stays
    (then of the least hash of its text; rows without an id come last), so of
    repeated rows one stays. Null, empty and wordless texts link with nothing
    and all stay; long texts are compared whole; an empty table stays empty;
    other columns are kept, whatever their names.
    """
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return _drop_near_duplicate_rows(docs)
    classes = jaccard_join.similar(docs, n=5, percent=80)
    gone = classes.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _drop_near_duplicate_rows(docs: DataFrame) -> DataFrame:
    row = unused("row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    classes = jaccard_join.similar(rows.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("row")).alias("o")
    met = rows.select(F.col(row).alias("row"), order).join(classes.select(F.col("doc_id").alias("row"), "component_id"), "row")
    kept = met.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 100 bytes or more that also starts earlier; n_chars follows.

    Documents come in the order of their ids, rows that repeat an id in that of
    a hash of their texts; exact repetitions of a row are one text; rows without
    an id, and null or short texts, stay as they are; a text that loses
    everything goes; an empty table stays empty; other columns are kept,
    whatever their names.
    """
    return suffix_dedup.without_repeats(docs, length=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten words in a row of a benchmark item occur (or all of an item that has fewer).

    Each row is judged by its whole text alone, so null and empty texts,
    repeated rows and rows without an id stay unless they match; empty tables
    (of documents or items) lose nothing; other columns are kept.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many times the mix takes each document: doc_id, source, size, source_size, target, times, taken.

    A null source is one of its own, last in order; null and empty texts have
    size 0; repeated rows each have a row; an empty table gives an empty
    result; other columns are ignored.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the language model, nor the sampling: tests/llm holds every stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
