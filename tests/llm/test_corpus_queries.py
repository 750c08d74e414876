"""The queries' contracts on a small table, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import queries

COLUMNS = {
    "op1_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert rows
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations", "pages", "benchmark"):
            path = f"{sf_dir}/{t}.parquet"
            files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
        asked = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(asked, key=repr)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows} if k < 4 else {r["doc_id"]: None for r in rows}
        assert 0.8 * len(before) < len(after) <= len(before) and set(after) <= set(before), name
        if name in ("language_id", "near_duplicates", "decontamination"):
            assert all(before[i] == t for i, t in after.items())
        before = after
