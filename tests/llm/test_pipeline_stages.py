"""Each stage of the pipeline on rows with every awkward value, against brute force."""

import itertools
import re

import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from siltstone.llm import language_id, mixing
from siltstone.llm.shared import WORD

STAGE = dict(corpus_pipeline.STAGES)
OTHERS = "lang_pred score spans mark found component_id row o hit items bucket size target".split()
SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
for other in OTHERS:
    SCHEMA = SCHEMA.add(other, "string")
PROSE = {
    "en": "the old river ran slowly past the mill while children counted boats and wrote their names on the wooden bridge",
    "de": "der alte fluss floss langsam an der mühle vorbei während kinder boote zählten und ihre namen auf die brücke schrieben",
}
LONG = " ".join(f"{w}{i}" for i in range(50_000) for w in ("alpha", "beta"))
LEAK = "how many boats did the children count before the mill wheel stopped turning that day"


def rows_of(texts):
    """(doc_id, text, lang, source) with other columns that have names which the operators use."""
    return [(i, t, lang, source, None if t is None else len(t), *(f"{c}{k}" for c in OTHERS)) for k, (i, t, lang, source) in enumerate(texts)]


ROWS = rows_of(
    [
        (1, PROSE["en"], "en", "a"),
        (2, PROSE["de"], "de", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \t\n", "de", "b"),
        (6, "12345 -- !!", "en", "b"),
        (7, LONG, None, "c"),
        (8, PROSE["en"] + " yesterday", "en", "a"),
        (8, "another text under an id that is there already and it is long enough to be linked with others", "en", "a"),
        (9, PROSE["de"], "de", None),
        (9, PROSE["de"], "de", None),
        (None, "a row without an id says something of its own about the weather in spring", "en", "c"),
        (None, None, None, None),
        (10, f"some words {LEAK.upper()} and more words", "en", "b"),
        (11, "So. " + PROSE["en"] + " Und: " + PROSE["de"], "de", "b"),
    ]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('stages')}"
    spark.createDataFrame([(1, LEAK), (2, None), (3, "12345 67890"), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def kept(spark, folder, name, docs):
    out = STAGE[name](spark, docs, folder)
    assert out.schema == docs.schema
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_an_empty_table(spark, folder, name):
    assert STAGE[name](spark, spark.createDataFrame([], SCHEMA), folder).collect() == []


def test_languages(spark, folder, docs):
    want = [r for r in ROWS if re.search(r"[^\W\d_]", r[1] or "")]
    got = kept(spark, folder, "language_id", docs)
    assert set(got) <= set(want) and {r[0] for r in got} >= {1, 2, 8, 9, 10}
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    label, score = language_id.predict(model, pa.array([r[1] for r in want]))
    assert got == sorted((r for r, x, s in zip(want, label, score, strict=True) if x != "und" and s >= corpus_pipeline.LEAST_SCORE), key=repr)


def shingles(text, n=5):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def without_near_duplicates(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return groups.values()


@pytest.mark.parametrize("unique", [False, True])
def test_near_duplicates(spark, folder, unique):
    rows = [(k, *r[1:]) for k, r in enumerate(ROWS)] if unique else ROWS
    got = kept(spark, folder, "near_duplicates", spark.createDataFrame(rows, SCHEMA))
    groups = list(without_near_duplicates(rows))
    assert len(got) == len(groups)
    for group in groups:
        mine = [r for r in got if r in group]
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least


def test_passages(spark, folder, docs):
    got = kept(spark, folder, "repeated_passages", docs)
    seen, want = set(), []
    order = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    texts = {}
    for r in order:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        if (r[0], r[1]) in texts:  # an exact repetition is the same text
            gone = texts[r[0], r[1]]
        else:
            for i in range(len(raw) - 99):
                if raw[i : i + 100] in seen:
                    gone[i : i + 100] = b"\1" * 100
                seen.add(raw[i : i + 100])
            texts[r[0], r[1]] = gone
        chars, at = [], 0
        for c in r[1] or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                chars.append(c)
            at += n
        left = "".join(chars) if any(gone) else r[1]
        if left or not any(gone):
            want.append((r[0], left, *r[2:4], None if left is None else len(left), *r[5:]))
    want += [r for r in ROWS if r[0] is None]
    assert got == sorted(want, key=repr)


def test_leaks(spark, folder, docs):
    def leaks(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        items = [LEAK.split(), ["12345", "67890"]]
        return any(words[i : i + min(10, len(x))] == x[j : j + 10] for x in items for j in range(max(1, len(x) - 9)) for i in range(len(words) - min(10, len(x)) + 1))

    assert kept(spark, folder, "decontamination", docs) == sorted((r for r in ROWS if not leaks(r[1])), key=repr)


def test_mix(spark, folder, docs):
    rows = STAGE["mixing"](spark, docs, folder).collect()
    size = lambda r: len(re.findall(WORD, r[1] or ""))
    assert sorted((repr(r["doc_id"]), repr(r["source"]), r["size"]) for r in rows) == sorted((repr(r[0]), repr(r[3]), size(r)) for r in ROWS)
    names = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in ROWS if r[3] == s) for s in names]
    goal = dict(zip(names, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] == r["times"] * r["size"] <= 2 * r["size"]
    for s, n in zip(names, sizes, strict=True):
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {n}
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(r["size"] for r in own)
    again = STAGE["mixing"](spark, docs.repartition(3), folder).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
