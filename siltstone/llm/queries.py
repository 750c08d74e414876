"""The corpus operators over the test tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, jaccard_join, language_id, licenses, media, mixing, suffix_dedup, toxicity, warc_store
from siltstone.llm.shared import table, written

Query = Callable[[SparkSession, str], DataFrame]

#: The conversation that the contract adds: both turns say control strings.
CLASHING = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CLASHING).alias("text"))
    return chat_format.digest_columns(chat_format.format_conversations(turns.unionByName(more)))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), least_coverage=0.8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.report(suffix_dedup.with_spans(docs, length=100))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_store.write_archive(table(spark, sf_dir, "pages"), least_bytes=100)
    back = warc_store.read_archive(spark, archive)
    refers = F.regexp_extract(warc_store.header_field("WARC-Refers-To"), r"urn:page:(-?\d+)", 1)
    return back.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        warc_store.header_field("WARC-Type").alias("record_type"),
        refers.cast("long").alias("refers_to"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.shard_folder(spark)
    index = written(media.store(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", folder), "media-index")
    known = written(media.with_media(media.with_header(media.places(index), folder), folder), "media-known")
    return media.placed(index, known).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.col("length").alias("media_bytes"),
        F.col("digest").alias("media_sha256"),
        "feature",
        "width",
        "height",
        "bits",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(decontaminate.scan_documents(docs, benchmark, window=10))


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_media": op9_media,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op5_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k
  FROM (SELECT doc_id, p, b[p : p + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100))
), m AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS begins FROM w WHERE k > 1
), g AS (
  SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m
), s AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, g
), k AS (
  SELECT d.doc_id, coalesce(lag(s.z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 1) AS a, s.a AS z, d.b FROM s JOIN d ON s.doc_id = d.doc_id
  UNION ALL
  SELECT d.doc_id, coalesce(t.z, 1), d.n + 1, d.b FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) t ON t.doc_id = d.doc_id
), h AS (
  SELECT doc_id, string_agg(CASE WHEN z > a THEN hex(b[a : z - 1]) ELSE '' END, '' ORDER BY a, z) AS x FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.r, 0) AS BIGINT) AS n_removed, coalesce(t.c, 0) AS n_spans, sha256(unhex(h.x)) AS kept_sha256
FROM d JOIN h ON h.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, sum(z - a) AS r, count(*) AS c FROM s GROUP BY doc_id) t ON t.doc_id = d.doc_id
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)
), l AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION
  SELECT l.y, r.label FROM r JOIN l ON l.x = r.node WHERE r.label < l.y
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.label) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY ALL
""",
    "op8_warc": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op10_decontaminate": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
