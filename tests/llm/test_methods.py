"""Each operator against brute force, an exact round trip, or held-out accuracy."""

import functools
import hashlib
import io
import math
import random
import re
import tarfile
import urllib.parse
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, jaccard_join, language_id, licenses, media, mixing, suffix_dedup, toxicity, warc_store
from siltstone.llm.deep_shallow import common_prefix, deep_shallow
from siltstone.llm.kernels import first_minima, gram_hashes
from siltstone.llm.shared import WORD, table, written


# chat formatting


def test_every_clash_comes_back(spark):
    nasty = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|", "<\\\\|im_end|>", "<|<|", "a<|", "|>", "\n\n", " x ", "%0A", "<", "$1 \\1"]
    texts = [*nasty, *(a + b for a in nasty for b in nasty)]
    roles = ["assistant", "user\nx", "a%0Ab", "<|im_start|>", "%25"]
    rows = [(i, j, roles[(i + j) % len(roles)], t) for i, t in enumerate(texts) for j in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns)
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")
    for r in out.select("conv_id", "formatted", "turns", "round_trip", loss).collect():
        want = [(role, t) for c, _, role, t in rows if c == r["conv_id"]]
        assert r["round_trip"] and [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert len(re.findall(r"<\|im_(start|end)\|>", r["formatted"])) == 4


def test_plain_text_stays_plain(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi\nthere")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(turns).first()["formatted"] == "<|im_start|>user\nhi\nthere<|im_end|>\n"


# license scans


def test_licenses_are_found_edited_and_whole(spark):
    mit = dict(licenses.TEMPLATES[2:3])["MIT"]
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 20 != 7)
    texts = ["before. " + mit + " after", "x " + edited, "Released under the mit LICENSE!", "Licensed under CC BY-NC 4.0.", "released under the moon", mit[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: r["license"] for i, r in rows.items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "CC-BY-NC-4.0"}
    assert rows[0]["coverage"] == 1 and 0.9 < rows[1]["coverage"] < 1
    span = rows[0]["spans"][0]
    assert texts[0][span["start"] : span["stop"]] == mit.rstrip(".")


def test_competing_names_are_ranked(spark):
    texts = ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "This is licensed under CC BY 4.0, that is licensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["license"], r["coverage"]) for r in licenses.scan_licenses(docs).collect())
    assert found == [(0, "CC-BY-4.0", 1.0), (1, "CC-BY-NC-4.0", 1.0), (2, "CC-BY-4.0", 1.0), (2, "CC-BY-NC-4.0", 1.0)]


def test_candidates_recall_against_aligning_everything():
    """Edited templates among other words: the share of alignments of all templates that the fingerprints lead to."""
    draw, index, found, all_ = random.Random(11), licenses.LicenseIndex(), 0, 0
    for _ in range(300):
        name, text = draw.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(max(1, int(len(words) * draw.choice([0.0, 0.05, 0.1])))):
            k = draw.randrange(len(words))
            words[k : k + 1] = draw.choice([[], ["zq"], [words[k], "zq"]])
        body = " ".join([*(f"p{i}" for i in range(30)), *words, *(f"q{i}" for i in range(30))])
        ids = np.array([index.vocabulary.get(w, 0) for w in licenses.fold(body).split()], np.int64)
        true = {t for t, own in enumerate(index.ids) if licenses.matches(own, ids, 0, len(ids), 0.8, 4)}
        all_ += len(true)
        found += len(true & {t for t, _ in index.hits(ids)})
    print(f"recall {found} of {all_}")
    assert all_ > 200 and found >= 0.9 * all_


def test_licenses_in_pieces_are_found(spark):
    n, mit = 17, dict(licenses.TEMPLATES[2:3])["MIT"].split()
    isc = dict(licenses.TEMPLATES)["ISC"].split()
    other = [f"w{i}" for i in range(40)]
    texts = [
        mit[:45] + mit[51:],
        mit[:45] + other[:7] + mit[45:],
        mit[:30] + other[:30] + mit[30:60] + other[:9] + mit[60:],
        isc[:n] + other[:20] + isc[n:],
        mit + other[:3] + mit[:45] + other[:12] + mit[45:],
        mit[:45] + other * 10 + mit[45:],
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: r["license"] for i, r in rows.items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "ISC", 4: "MIT"}
    assert 0.9 < rows[0]["coverage"] < 1 and all(rows[i]["coverage"] == 1 for i in (1, 2, 3, 4))
    assert [len(rows[i]["spans"]) for i in range(5)] == [1, 1, 1, 1, 2]
    for i in range(4):
        text = " ".join(texts[i])
        assert [tuple(x) for x in rows[i]["spans"]] == [(0, len(text) - 1)]



def test_all_templates_of_a_license_have_spans(spark):
    mit, (_, header) = dict(licenses.TEMPLATES[2:3])["MIT"], licenses.TEMPLATES[4]
    line, edited = "Released under the MIT License.", mit.replace("merge, ", "").replace("sublicense, ", "")
    secure = header.replace("http:", "https:")
    docs = spark.createDataFrame([(0, secure), (1, f"{line} Some prose goes between. {edited}"), (2, f"{mit} {mit} {line}")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    texts = {i: [secure] if i == 0 else [line, edited] if i == 1 else [mit, mit, line] for i in range(3)}
    for r in docs.collect():
        found = [r["text"][a:b] for a, b in rows[r["doc_id"]]["spans"]]
        assert found == [t.rstrip(".") for t in texts[r["doc_id"]]]
    n = len(licenses.fold(header).split())
    assert (rows[0]["license"], rows[0]["matched_words"], rows[0]["template_words"]) == ("Apache-2.0", n - 1, n)
    n = len(licenses.fold(mit).split())
    assert [(rows[i]["license"], rows[i]["matched_words"], rows[i]["template_words"]) for i in (1, 2)] == [("MIT", n - 2, n), ("MIT", n, n)]



def test_edited_lines_are_found_between_other_words(spark):
    lines = {"Licensed under the Apache OSS License, Version 2.0": "Apache-2.0"}
    lines |= {f"Licensed under CC {w} 4.0": "CC-BY-NC-4.0" for w in ("BX-NC",)}
    words = ["Licensed", "under", "the", "Apache", "License", "Version", "2", "0"]
    for i in range(1, len(words)):
        lines[" ".join([*words[:i], "zq", *words[i:]])] = "Apache-2.0"
    for k in range(30):
        around = [" ".join(f"p{k}x{j}y{s}" for j in range(6)) for s in (0, 1)]
        texts = [f"{around[0]} {line} {around[1]}" for line in lines]
        index = licenses.LicenseIndex()
        assert [[r[0] for r in index.scan(t, 0.8, 4)] for t in texts] == [[name] for name in lines.values()]


def test_lines_with_any_word_replaced_are_found():
    index = licenses.LicenseIndex()
    for t, (name, _) in enumerate(licenses.TEMPLATES):
        words = [w.decode() for w in index.words[t]]
        for i in range(len(words) if len(words) < 20 else 0):
            line = ["p1", "p2", *words[:i], "an", *words[i + 1 :], "q1", "q2"]
            ids = np.array([index.vocabulary.get(w.encode(), 0) for w in line], np.int64)
            assert t in {u for u, _ in index.hits(ids)}
            if name == "MIT":
                assert [r[:3] for r in index.scan(" ".join(line), 0.8, 4)] == [("MIT", 0.8, 4)]



# mixing


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_flight_keeps_totals(units, seed):
    prob, size = [p for p, _ in units], [s for _, s in units]
    before = sum(prob), sum(p * s for p, s in zip(prob, size, strict=True))
    moved = mixing.flight(list(prob), size, random.Random(seed))
    assert sum(0 < p < 1 for p in moved) <= 2
    assert sum(moved) == pytest.approx(before[0], abs=1e-4) and sum(p * s for p, s in zip(moved, size, strict=True)) == pytest.approx(before[1], abs=1e-3)
    landed = mixing.land(prob, list(moved), size, random.Random(seed))
    assert all(p in (0, 1) for p in landed) and all(p == q for p, q in zip(prob, landed, strict=True) if p in (0, 1))


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, 2 / 3 * 250, 1 / 3 * 250]
    assert mixing.targets([10, 0, 1000], [5, 2, 1]) == [20, 0, 1495]
    assert mixing.targets([], []) == []


def test_mix_is_close_bounded_and_repeatable(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for units, off in ((4096, 0.02), (16, 0.4)):  # few units are open in the last level of small buckets
        of = mixing.mix(docs, bucket_units=units).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
        assert all(abs(r["taken"] - r["target"]) <= off * r["target"] for r in of.collect())
    rows = mixing.mix(docs, bucket_units=16).collect()
    again = mixing.mix(docs.repartition(7), bucket_units=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    wanted = {r["doc_id"]: len(re.findall(WORD, r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == wanted


# language


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.where(language_id.held_out()), model)
    n, right = found.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.97


def test_unseen_words_back_off(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("schnelligkeit heiterkeit", "de"), ("nation station", "en")] * 5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_id.predict(model, pa.array(["dankbarkeit", "relation", "42", None]))[0] == ["de", "en", "und", "und"]


def test_a_rare_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 7)}{chr(97 + j % 11)}wort" for j in range(40)), "de") for i in range(400)]
    rows += [(1000 + i, "hitz arraroak hemen", "eu") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=60)
    assert model.langs == ["de", "eu"]
    assert language_id.predict(model, pa.array(["hitz arraroak"]))[0] == ["eu"]


def test_predictions_equal_a_plain_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    seen = defaultdict(lambda: defaultdict(Counter))
    words = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    for r in rows[::2]:
        for w in words(r["text"]):
            seen[0][r["lang"]][w] += 1
            for n in range(1, 6):
                seen[n][r["lang"]].update(grams(w, n))
    langs = sorted(seen[0])
    kept = {k: {lang: {u: c for u, c in own.items() if c > 1} for lang, own in by.items()} for k, by in seen.items()}
    units = {k: set().union(*by.values()) for k, by in kept.items()}
    log = lambda k, u: np.array([math.log((kept[k][x].get(u, 0) + 0.5) / (sum(kept[k][x].values()) + 0.5 * len(units[k]))) for x in langs])

    @functools.cache
    def said(w):
        if w in units[0]:
            return log(0, w)
        for step, n in enumerate((5, 4, 3, 2, 1), 1):
            if known := [g for g in grams(w, n) if g in units[n]]:
                return np.mean([log(n, g) for g in known], axis=0) * 0.4**step
        return np.zeros(len(langs))

    half = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows[::2]], "doc_id long, text string, lang string")
    model = language_id.fit(half, fit_rows=10**6)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    for r in rows:
        own = words(r["text"])
        if not own:
            assert found[r["doc_id"]] == ("und", 0.0)
            continue
        total = sum(map(said, own)) * min(1, 25 / len(own))
        odds = np.exp(total - total.max())
        assert found[r["doc_id"]] == (langs[int(odds.argmax())], pytest.approx(odds.max() / odds.sum(), rel=1e-6))


# suffix arrays


@given(st.sets(st.binary(max_size=12), max_size=40), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_deep_shallow_sorts(strings, shallow):
    ordered, shared = deep_shallow(list(strings), shallow)
    assert ordered == sorted(strings)
    assert shared == [0, *(common_prefix(a, b) for a, b in zip(ordered, ordered[1:], strict=False))][: len(ordered)]


def test_kernels():
    data = np.frombuffer(b"abcabcabcxabcabcabd", np.uint8)
    for k in (1, 2, 3, 5, 7, 8):
        h = gram_hashes(data, k)
        grams = [bytes(data[i : i + k]) for i in range(len(data) - k + 1)]
        assert all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))
    values = np.array([5, 3, 3, 9, 1, 1, 7, 0, 0], np.uint64)
    for w in range(1, 9):
        assert first_minima(values, w).tolist() == [i + int(values[i : i + w].argmin()) for i in range(len(values) - w + 1)]


def brute_spans(docs: list[tuple[int, bytes]], length: int) -> dict[int, list[tuple[int, int]]]:
    seen, out = set(), {}
    for doc_id, raw in sorted(docs):
        spans = []
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                spans.append((p, p + length))
            seen.add(s)
        out[doc_id] = suffix_dedup.merged(spans)
    return out


@pytest.mark.parametrize("length,letters,hot", [(12, "ab", 20_000), (12, "ab", 2), (20, "abc", 20_000), (100, "xyé", 20_000), (33, "a", 5)])
def test_repeats_equal_brute_force(spark, length, letters, hot):
    draw = random.Random(length)
    piece = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [piece(draw.randrange(length, 4 * length)) for _ in range(5)]
    docs = [(i, "".join(draw.choice([piece(draw.randrange(1, 40)), draw.choice(shared)]) for _ in range(draw.randrange(0, 7)))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = suffix_dedup.with_spans(frame, length, hot=hot, part_bytes=1500)
    got = {r["doc_id"]: suffix_dedup.spans_of(r["spans"]) for r in found.collect()}
    assert got == brute_spans([(i, t.encode()) for i, t in docs], length)


def test_cut_keeps_characters_whole(spark):
    text = "é" * 80
    rows = suffix_dedup.without_repeats(spark.createDataFrame([(1, text, 80), (2, "ab" + text + "x", 83)], "doc_id long, text string, n_chars long")).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and "�" not in "".join(r["text"] for r in rows)


# Jaccard


def brute_components(docs: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, text in docs:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("n,percent,size", [(3, 90, 80), (5, 80, 60), (1, 50, 12), (2, 75, 25), (3, 90, 9)])
def test_components_equal_brute_force(spark, n, percent, size):
    draw = random.Random(n * percent)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 2 * size))] for _ in range(12)]
    line = [draw.choice(vocabulary) for _ in range(7)]
    docs = []
    for i in range(240):
        words = list(draw.choice(bases))
        for _ in range(draw.randrange(0, max(2, len(words) // 12))):
            words[draw.randrange(len(words))] = draw.choice([draw.choice(vocabulary), "Edited", f"own{i}"])
        docs.append((i, " ".join(line + words if draw.random() < 0.3 else words)))
    docs += [(300, ""), (301, docs[0][1].upper()), (302, " \n")]
    found = jaccard_join.similar(spark.createDataFrame(docs, "doc_id long, text string"), n, percent, hub_share=7, part_values=500)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(docs, n, percent)


def test_a_repeated_doc_id_speaks_for_no_other_set(spark):
    words = [f"w{i}" for i in range(60)]
    b, near, larger = words[:40], [*words[:39], "other"], [f"v{i}" for i in range(50)]
    rows = [(5, b), (7, b), (5, larger), (8, near), (9, larger), (None, near)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in order], "doc_id long, text string").coalesce(1)
        found = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar(docs, n=3, percent=90).collect()}
        assert found == {5: 5, 7: 7, 8: 7, 9: 5, None: None}


def test_rows_that_repeat_a_doc_id_are_dropped_one_by_one(spark):
    import corpus_pipeline

    a, clean, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    near = a + " more"
    rows = [(1, a), (1, a), (2, near), (2, clean), (3, b), (4, b), (None, b), (None, clean + " x y"), (5, "lone words that nobody else has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a), (2, clean), (3, b), (5, rows[-1][1])])
    distinct = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], docs.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, distinct, "").collect()) == [0, 3, 4, 8]


def test_shingles_don_t_depend_on_batches():
    texts = ["a b c d", None, "", "one", "A\tB\nC d", "x" * 50 + " y z", "b c"] * 9
    column = pa.array(texts)
    whole = [s.tolist() for s in jaccard_join.shingle_sets(column, 3)]
    assert whole == [s.tolist() for s in jaccard_join.shingle_sets(column, 3, piece=1)]
    assert whole == [next(jaccard_join.shingle_sets(pa.array([t], pa.string()), 3)).tolist() for t in texts]
    assert whole[0] == whole[4] and [len(w) for w in whole[:4]] == [2, 0, 0, 1]


# media


def test_shards_are_tar_files_and_media_come_back(spark, sf_dir):
    some = table(spark, sf_dir, "documents").select("doc_id", "text")
    # copies in other tasks, clashing names; files, since the rows are computed twice
    docs = written(some.unionByName(some.withColumn("doc_id", F.col("doc_id") + 10**6)).repartition(7).withColumn("digest", F.lit("x")).withColumn("raw", F.lit("own")), "media-test")
    folder = media.shard_folder(spark)
    index = written(media.store(docs, "text", folder, shard_bytes=1 << 16), "media-test")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    path = Path(urllib.parse.urlparse(folder).path)
    known = media.with_media(media.with_header(media.places(index), folder), folder)
    rows = media.placed(index, known).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and len({r["shard"] for r in rows}) > 2 and {r["raw"] for r in rows} == {"own"}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        whole = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = (path / r["shard"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert hashlib.sha256(stored).hexdigest() == r["digest"] and media.decode_png(stored) == whole
        grid = [whole[i : i + 576] for i in range(0, len(whole), 576)]
        bands = [sum(sum(line[i : i + 9]) for line in grid) for i in range(0, 576, 9)]
        code = int("".join("1" if 64 * x > sum(bands) else "0" for x in bands), 2)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert (r["tail_crc32"], r["width"], r["height"], r["bits"]) == (zlib.crc32(whole[-32:]), 576, len(grid), 8)
        assert r["feature"] == f"576x{len(grid)};mean={sum(bands) // len(whole)};ahash={code:016x}"
    # each payload is in one shard, once
    members = []
    for shard in path.glob("*.tar"):
        with tarfile.open(fileobj=io.BytesIO(shard.read_bytes())) as tar:
            members += [m.name[:-4] for m in tar]
            assert all(hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name[:-4] for m in tar)
    assert len(members) == len(set(members)) == len(set(texts.values())) and set(members) == {r["digest"] for r in rows}
    with pytest.raises(ValueError):
        media.decode_png(stored[:60] + b"\0" + stored[61:])


# decontamination


def brute_hits(text: str, items: dict[str, str], window: int) -> tuple[int, set[int], set[str]]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    own, hit, found = words(text), set(), set()
    for item, t in items.items():
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(own), hit, found


def test_windows_equal_brute_force(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["a", "B", "c", "é", "d1"])
    join = lambda n: "".join(word() + draw.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = {str(i): join(draw.randrange(0, 7)) for i in range(12)}
    docs = [(i, join(draw.randrange(0, 60))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(int(k), v) for k, v in items.items()], "item_id long, text string")
    for most in (1 << 20, 10):
        for r in decontaminate.scan_documents(frame, asked, window=4, automaton_bytes=most).collect():
            n, hit, found = brute_hits(docs[r["doc_id"]][1], items, 4)
            assert (r["n_words"], set(r["hit"]), set(r["items"])) == (n, hit, found)
            raw = docs[r["doc_id"]][1].encode()
            spanned = b" ".join(raw[s["start"] : s["stop"]] for s in r["spans"])
            assert len(decontaminate.fold(spanned.decode()).split()) == len(hit)


def test_portions_keep_rows_that_repeat_a_doc_id(spark):
    texts = ["x a b c y d e f", "d e f", "nothing here", "a b c d e f", ""]
    rows = [(key, t) for key in (1, 1, 2, None) for t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    one, several = (
        sorted(map(repr, decontaminate.scan_documents(frame, asked, window=3, automaton_bytes=most).collect())) for most in (1 << 20, 1)
    )
    assert len(one) == len(rows) and several == one


# toxicity


def test_ordinal_regression_orders_grades():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2, (600, 5)).astype(np.float32)
    latent = x @ np.array([2.0, 1.0, 0.0, -1.0, 3.0]) + draw.logistic(size=600)
    grade = np.searchsorted([1.0, 3.0, 5.0], latent)
    w, theta = toxicity.fit_ordinal(x, grade)
    assert np.all(np.diff(theta) > 0) and np.allclose(w, [2, 1, 0, -1, 3], atol=0.6) and np.allclose(theta, [1, 3, 5], atol=0.8)


def test_severity_equals_a_plain_computation(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    graded = labels.withColumn("toxic", F.col("toxic") * (1 + F.col("doc_id") % 3) - F.lit(1) * (F.col("doc_id") % 2))
    for given in (labels, graded):
        model = toxicity.fit(docs, given, least_docs=2, least_z=1.0)
        assert (np.diff(model.thresholds) > 0).all()
        got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
        for r in docs.collect():
            units = {u for w in re.findall(r"[^\W\d_]+", r["text"].lower()) for u in (f"={w}", *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n))}
            places = {zlib.crc32(u.encode()) % (1 << 20) for u in units}
            x = sum(model.weights[k] for p, k in model.keep.items() if p in places)
            above = [1 / (1 + math.exp(min(700, t - x))) for t in model.thresholds]
            each = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
            assert got[r["doc_id"]]["expected_severity"] == pytest.approx(sum(j * p for j, p in enumerate(each)), abs=1e-9)
            assert each[got[r["doc_id"]]["severity"]] == pytest.approx(max(each), abs=1e-9)


def test_toxic_texts_are_caught(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~fold))
    rows = toxicity.score(docs, model).join(labels.where(fold).withColumnRenamed("toxic", "label"), "doc_id").collect()
    caught = [r for r in rows if r["toxic"]]
    assert sum(r["label"] for r in caught) / len(caught) > 0.9
    assert sum(r["label"] for r in caught) / sum(r["label"] for r in rows) > 0.8


# WARC


def test_records_are_rebuilt_byte_for_byte(spark):
    from siltstone.llm import warc_store

    pages = spark.createDataFrame([(1, "http://a", "é" * 100), (2, "http://b", "é" * 100), (3, None, "x")], "page_id long, url string, html string")
    back = warc_store.read_archive(spark, warc_store.write_archive(pages))
    records = {r["page_id"]: bytes(r["b"]) for r in back.select("page_id", warc_store.record_bytes(F.col("header"), F.col("payload")).alias("b")).collect()}
    for i, record in records.items():
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        assert (fields[b"WARC-Type"] == b"revisit") == (i == 2)
    assert records[1].endswith("é".encode() * 100 + b"\r\n\r\n") and b"WARC-Refers-To: <urn:page:1>" in records[2]
    stored = spark.read.parquet(warc_store.write_archive(pages).payloads)
    assert stored.count() == 2


def test_a_payload_of_many_pages_is_verified_and_shared(spark):
    pages = spark.createDataFrame([(i, "u", "<p>" + "same " * 60 if i % 3 else f"<p>{i}") for i in range(300)], "page_id long, url string, html string")
    back = warc_store.read_archive(spark, warc_store.write_archive(pages)).collect()
    assert {(r["page_id"], r["payload"].decode()) for r in back} == {(r["page_id"], r["html"]) for r in pages.collect()}


def test_a_conversation_that_does_not_come_back_ends_the_job(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "a <| b")], "conv_id long, turn long, role string, text string")
    spoilt = chat_format.format_conversations(turns).withColumn("round_trip", F.lit(False))
    with pytest.raises(Exception, match="come back identical"):
        chat_format.digest_columns(spoilt).collect()


def test_damage_is_noticed(spark):
    from siltstone.llm import warc_store

    archive = warc_store.write_archive(spark.createDataFrame([(1, "u", "y" * 200)], "page_id long, url string, html string"))
    spoilt = spark.read.parquet(archive.payloads).withColumn("digest", F.lit("0" * 64))
    spoilt.write.parquet(archive.payloads + "-spoilt")
    headers = spark.read.parquet(archive.headers).withColumn("digest", F.lit("0" * 64))
    headers.write.parquet(archive.headers + "-spoilt")
    broken = warc_store.Archive(archive.payloads + "-spoilt", archive.headers + "-spoilt")
    with pytest.raises(Exception, match="damaged"):
        warc_store.read_archive(spark, broken).collect()


def test_repeats_of_real_texts_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    want = brute_spans([(r["doc_id"], r["text"].encode()) for r in docs.collect()], 100)
    for hot in (20_000, 3):
        found = suffix_dedup.with_spans(docs, 100, hot=hot, part_bytes=1 << 16)
        assert {r["doc_id"]: suffix_dedup.spans_of(r["spans"]) for r in found.collect()} == want


def test_near_copies_of_one_base_equal_brute_force(spark):
    """A large family of copies with edits of their own and with shared ones, in tiles."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(draw.randrange(0, 12)):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], [f"own{i}"], [words[at]] * 2, ["same"]])
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        found = jaccard_join.similar(frame, n, percent, hub_share=50, tile=40)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(docs, n, percent)


def test_trie_bounds_and_prunes_like_brute_force():
    draw = np.random.default_rng(7)
    for _ in range(150):
        space = int(draw.integers(1, 60))
        one = lambda: np.unique(draw.integers(0, space, draw.integers(0, 40)).astype(np.uint64))  # noqa: E731, B023
        sets = [one() for _ in range(int(draw.integers(1, 25)))]
        label, tokens = draw.integers(0, 3, len(sets)), one()
        trie, true = jaccard_join.Trie(sets, label), np.array([len(np.setxor1d(s, tokens)) for s in sets])
        for reach in (0, 3, 10, 1000):
            got = trie.probe(tokens, reach)
            near = true <= reach
            assert (got.low <= true).all() and (got.high >= true).all() and (got.high[near] == got.low[near]).all()
            other = near & (label != 1)
            assert (trie.probe(tokens, reach, 1).high[other] == true[other]).all()
