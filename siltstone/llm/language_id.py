"""Language identification: known words first, then ever shorter n-grams.

A model is log frequencies by language of units of two kinds: words (maximal
runs of letters, lower-cased) and character n-grams of the words' edges and
insides (an edged word begins with ``^`` and ends with ``$``). A known word is
scored by its own frequencies. An unseen word backs off to its n-grams of the
greatest length of which the model knows one: the mean of those it knows, with
the weight ``backoff ** steps`` (how many of its n-grams are known doesn't
matter); a word of which nothing is known says nothing.

Fitting reads a bounded sample of labelled rows (``fit_rows``, a parameter,
shared out evenly over the languages so that none falls out; rows are chosen
by a hash of doc_id, so the sample doesn't depend on order) and keeps every
unit that occurs ``least`` times in it. The sample bounds the model, which is
what is broadcast: 8 bytes a unit and 8 a unit and language, as units are
named by 64-bit hashes of their code points. Prediction reads every whole
text; a batch scores each of its distinct words once.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text when nothing could be learned; ties go to the language
first by code point; text of which no unit is known gets the language with
the most training words and its share as score. Empty tables give an empty
result; repeated rows are each predicted. Other columns pass through, but for
ones that are named like the two that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.kernels import mix64
from siltstone.llm.shared import mapped

UNKNOWN = "und"
_U = np.uint64
_CODE, _PLACE = _U(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column, each occurrence's number, and each text's first occurrence (one more than texts)."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.utf8_trim(pc.replace_substring_regex(lower, r"\P{L}+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    coded = lists.flatten().dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # a text without a letter splits into one empty word
        real = place != empty
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        place = place[real]
    return words, place, starts


class Units:
    """Hashes of words and of their n-grams: sums of mixed code points and places, so one pass does for all lengths."""

    def __init__(self, words: pa.Array) -> None:
        codes = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes.astype(np.uint64)
        self.length = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(codes)) - self.start[self.word]

    def words(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        mixed = mix64(self.codes * _CODE + (self.place + 1).astype(np.uint64) * _U(_PLACE))
        return mix64(np.add.reduceat(mixed, self.start) + _U(1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word of every n-gram."""
        total = np.zeros(max(0, len(self.codes) - n + 1), np.uint64)
        for j in range(n):
            total += mix64(self.codes[j : j + len(total)] * _CODE + _U((j + 1) * _PLACE % (1 << 64)))
        whole = self.place[: len(total)] + n <= self.length[self.word[: len(total)]]
        return mix64(total[whole] + _U(n + 1)), self.word[: len(total)][whole]


@dataclass(frozen=True)
class Model:
    """langs in code-point order; by kind (0 for words, n for n-grams) the units' hashes in order and their log frequencies."""

    langs: list[str]
    prior: np.ndarray
    units: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    lengths: tuple[int, ...]
    backoff: float

    def find(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Rows of units; -1 for unknown ones."""
        known = self.units.get(kind, np.zeros(0, np.uint64))
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)


def fit(
    labelled: DataFrame,
    fit_rows: int = 6000,
    least: int = 2,
    lengths: tuple[int, ...] = (5, 4, 3, 2, 1),
    backoff: float = 0.4,
    smooth: float = 0.5,
) -> Model:
    """Learns from ``text`` and ``lang`` of a bounded sample of ``labelled``."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row a language, as the model has a column a language
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    spread, each = 1 << 30, fit_rows / max(len(found), 1)
    below = F.lit(0)
    if found:
        parts = [F.lit(x) for lang, n in found.items() for x in (lang, int(spread * min(1.0, each / n)))]
        below = F.element_at(F.create_map(*parts), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b["lang"].dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words, place, _ = split_words(b["text"].filter(pc.equal(langs.indices, k)))
                times = np.bincount(place, minlength=len(words))
                units = Units(words)
                for kind in (0, *lengths):
                    hashes, word = units.grams(kind) if kind else (units.words(), np.arange(len(words)))
                    unit, at = np.unique(hashes, return_inverse=True)
                    n = np.bincount(at, weights=times[word], minlength=len(unit)).astype(np.int64)
                    unit, n = unit[n > 0], n[n > 0]
                    columns = [pa.array([lang] * len(unit), pa.string()), pa.array(np.full(len(unit), kind, np.int32)), pa.array(unit.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "kind", "unit", "n"])

    counts = (
        mapped(chosen.select("lang", "text"), count, "lang string, kind int, unit long, n long")
        .groupBy("lang", "kind", "unit")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .toArrow()
    )
    langs = sorted(set(counts["lang"].unique().to_pylist()))
    lang = pc.index_in(counts["lang"], value_set=pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    kind, n = counts["kind"].to_numpy(), counts["n"].to_numpy()
    unit = counts["unit"].to_numpy().view(np.uint64)
    units, logs = {}, {}
    words = np.ones(len(langs))
    for k in np.unique(kind).tolist():
        here = kind == k
        units[k], at = np.unique(unit[here], return_inverse=True)
        table = np.zeros((len(units[k]), len(langs)))
        table[at, lang[here]] = n[here]
        logs[k] = np.log((table + smooth) / (table.sum(axis=0) + smooth * len(table)))
        words = table.sum(axis=0) if k == 0 else words
    return Model(langs, words / words.sum(), units, logs, tuple(sorted(lengths, reverse=True)), backoff)


def vectors(model: Model, words: pa.Array) -> np.ndarray:
    """What each word says for each language."""
    units = Units(words)
    out = np.zeros((len(words), len(model.langs)))
    row = model.find(0, units.words())
    known = row >= 0
    if known.any():
        out[known] = model.logs[0][row[known]]
    for step, n in enumerate(model.lengths, 1):
        if known.all():
            break
        hashes, word = units.grams(n)
        open_ = ~known[word]
        row, word = model.find(n, hashes[open_]), word[open_]
        row, word = row[row >= 0], word[row >= 0]
        if not len(word):
            continue
        # the n-grams of a word are neighbours
        first = np.flatnonzero(np.diff(word, prepend=-1))
        mean = np.add.reduceat(model.logs[n][row], first, axis=0) / np.diff(np.append(first, len(word)))[:, None]
        out[word[first]] = mean * model.backoff**step
        known[word[first]] = True
    return out


def predict(model: Model, texts: pa.Array, evidence: int = 25) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    words, place, starts = split_words(texts)
    n = np.diff(starts)
    has = np.flatnonzero(n)
    label, score = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts))
    if not len(has) or not model.langs:
        return label.tolist(), score
    total = np.add.reduceat(vectors(model, words)[place], starts[has], axis=0)
    # Evidence counts as that of at most so many words: the score tells texts apart instead of saturating.
    total *= np.minimum(1.0, evidence / n[has])[:, None]
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    odds = np.where(total.any(axis=1)[:, None], odds / odds.sum(axis=1, keepdims=True), model.prior)
    best = odds.argmax(axis=1)
    label[has] = np.array(model.langs, object)[best]
    score[has] = odds[np.arange(len(has)), best]
    return label.tolist(), score


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and the score (0 to 1) behind its own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = predict(shared.value, b["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(score)], [*b.schema.names, *names])

    return mapped(docs, run, schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold that fitting never sees."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))
