"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: defined results for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, jaccard_join, language_id, licenses, media, mixing, suffix_dedup, toxicity, warc_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, component_id string, bucket int, mark double, found string"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 3, 0.0, "x", "y", 1, 1.5, "f"),
    (2, None, "en", "a", None, None, None, None, None, None, None),
    (3, "", None, None, 0, None, None, None, None, None, None),
    (4, LONG, "en", "b", 5, None, None, None, None, None, None),
    (5, LONG, None, "b", 5, None, None, None, None, None, None),
    (6, "   \n\t ", "de", "b", 5, None, None, None, None, None, None),
    (None, "a text without an id but with words in it", "de", None, 5, None, None, None, None, None, None),
    (7, "12345 !!! ---", "de", "c", 5, None, None, None, None, None, None),
    (8, "the quick brown fox jumps over the lazy dog and runs away", "en", "c", 3, None, None, None, None, None, None),
    (8, "the quick brown fox jumps over the lazy dog and runs away", "en", "c", 3, None, None, None, None, None, None),
    (9, "der schnelle braune fuchs springt über den faulen hund", "de", "c", 3, None, None, None, None, None, None),
    (9, "another text that goes by the same id as the one before it", "de", "c", 3, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(docs, none):
    rows = jaccard_join.similar(docs, n=3, percent=90).collect()
    assert len(rows) == len(ROWS)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert of[1] == {(10, 1)} and of[8] == {(10, 1)} and of[2] == {(0, 2)} and of[3] == {(0, 3)} and of[6] == {(0, 6)}
    assert {c for _, c in of[5]} == {4} and {c for _, c in of[None]} == {None} and {c for _, c in of[9]} == {9}
    assert jaccard_join.similar(none).collect() == []


def test_suffix_dedup(docs, none):
    rows = suffix_dedup.report(suffix_dedup.with_spans(docs.select("doc_id", "text"), 20)).collect()
    assert len(rows) == len(ROWS)
    by = {(r["doc_id"], r["kept_sha256"]): r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[2, empty]["n_bytes"] == 0 and by[8, empty]["n_removed"] == len(ROWS[0][1]) and by[5, empty]["n_spans"] == 1
    assert next(r for r in rows if r["doc_id"] == 4)["n_removed"] == 0
    assert next(r for r in rows if r["doc_id"] is None)["n_removed"] == 0
    cut = suffix_dedup.without_repeats(docs, 20)
    assert cut.schema == docs.schema
    assert {r["doc_id"] for r in cut.collect()} == {1, 2, 3, 4, 6, 7, 9, None}
    assert {(r["doc_id"], r["spans"], r["mark"], r["found"]) for r in cut.collect()} >= {(1, "x", 1.5, "f"), (2, None, None, None)}
    assert suffix_dedup.with_spans(none, 20).collect() == []


def test_language_id(docs, none):
    model = language_id.fit(docs)
    found = language_id.identify(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 6, 7}
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(none, model).collect() == []


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert sum(r["target"] / sum(1 for x in rows if x["source"] == r["source"]) for r in rows) == pytest.approx(
        1.5 * sum(r["size"] for r in rows), rel=1e-9
    )
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert mixing.mix(none).collect() == []


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(
        [(10, "Quick brown FOX jumps over the lazy dog and runs"), (11, None), (12, ""), (13, "fox jumps"), (13, "fox jumps"), (None, "braune fuchs")],
        "item_id long, text string",
    )
    rows = decontaminate.contamination(decontaminate.scan_documents(docs, items)).collect()
    assert len(rows) == len(ROWS)
    assert {(r["n_hit"], r["n_items"]) for r in rows if r["doc_id"] in (1, 8)} == {(10, 2)}
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5, 6, 7, 9, None}
    assert decontaminate.scan_documents(none, items).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(decontaminate.scan_documents(docs, items.limit(0))).collect()} == {0}
    several = decontaminate.contamination(decontaminate.scan_documents(docs.dropDuplicates(["doc_id"]), items, automaton_bytes=1))
    assert {(r["n_hit"], r["n_items"]) for r in several.collect() if r["doc_id"] == 1} == {(10, 2)}


def test_licenses(spark, docs, none):
    assert licenses.scan_licenses(docs).collect() == []
    assert licenses.scan_licenses(none).collect() == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["expected_severity"] <= 3 for r in rows)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(none, labels) is None
    assert {r["toxic"] for r in toxicity.score(docs, None).collect()} == {False}
    assert toxicity.score(none, model).collect() == []


def test_media(docs, none, spark):
    folder = media.shard_folder(spark)
    clashing = docs.withColumn("digest", F.lit(1)).withColumn("width", F.lit("w")).withColumn("own0", F.lit("o")).coalesce(1)
    index = media.store(clashing, "text", folder).cache()
    rows = media.placed(index, media.with_media(media.with_header(media.places(index), folder), folder)).collect()
    assert len(rows) == len(ROWS) and {r["own0"] for r in rows} == {"o"} and {r["width"] for r in rows} == {media.WIDTH}
    assert sorted((repr(r["doc_id"]), repr(r["spans"])) for r in rows) == sorted((repr(r[0]), repr(r[6])) for r in ROWS)
    empty = {(r["n_bytes"], r["payload_bytes"], r["feature"]) for r in rows if r["doc_id"] in (2, 3)}
    assert empty == {(0, 576, "576x1;mean=255;ahash=0000000000000000")}
    assert len({r["digest"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert media.store(none.select("doc_id", "text"), "text", media.shard_folder(spark)).collect() == []


def test_warc(spark):
    long = "<p>" + "x" * 500_000
    pages = spark.createDataFrame(
        [(1, "http://a\r\nb", long, 1), (2, None, long, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1), (None, "u", long, 1), (2, "again", long, 1)],
        "page_id long, url string, html string, digest int",
    )
    back = warc_store.read_archive(spark, warc_store.write_archive(pages))
    kind, refers = warc_store.header_field("WARC-Type").alias("kind"), warc_store.header_field("WARC-Refers-To").alias("refers")
    rows = sorted((r["page_id"] or 0, r["kind"], r["refers"], r["n"]) for r in back.select("page_id", kind, refers, F.length("payload").alias("n")).collect())
    first = "<urn:page:1>"
    assert rows == [
        (0, "revisit", first, len(long)),
        (1, "response", None, len(long)),
        (2, "revisit", first, len(long)),
        (2, "revisit", first, len(long)),
        (3, "response", None, 0),
        (4, "response", None, 0),
        (5, "response", None, 5),
        (6, "response", None, 5),
    ]
    none = warc_store.write_archive(pages.limit(0))
    assert warc_store.read_archive(spark, none).collect() == []


def test_chat_format(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", None, "c"), (1, 1, None, "x", "c"), (1, 1, None, "x", "c"), (None, None, "assistant", "no id", "c"), (2, 0, "assistant", LONG, "c")],
        "conv_id long, turn long, role string, text string, block string",
    )
    rows = {r["conv_id"]: r for r in chat_format.format_conversations(turns).collect()}
    assert set(rows) == {1, 2, None} and all(r["round_trip"] for r in rows.values())
    assert [(t["role"], t["text"]) for t in rows[1]["turns"]] == [("user", ""), ("", "x"), ("", "x")]
    assert chat_format.format_conversations(turns.limit(0)).collect() == []
