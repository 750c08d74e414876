"""Toxicity as severity grades: cumulative-link ordinal regression.

Grades 0..G share one weight vector over sparse text features and differ by
ordered thresholds: ``P(grade > j) = sigmoid(w x - theta_j)``. The result is
the expected grade, ``sum_j P(grade > j)``, with the most likely grade; the
cut from which a text counts as toxic is the one with the best F1 on the
fitted rows.

Features are the distinct words of a text and the words' prefixes of
``prefixes`` letters (inflected or compounded words share them), hashed to
``2 ** bits`` places. Fitting keeps the places whose share of graded texts
differs clearly between grade 0 and the rest (``least_z`` standard errors, at
least ``least_docs`` texts), at most ``most_features`` of them: a documented
bound of the model, as its fit is dense.

Where labels say only yes or no, the grades of toxic texts are made here, in
thirds of how many clearly toxic features they have: a restatement of what the
model sees, longer texts included, and no judgement of people. (By the share of
a text's features, precision on held-out labels of sf0.1 fell from over 0.9 to
0.87.) Labels that have grades are taken as they are, negative ones as 0.

Fitting reads at most ``fit_rows`` graded rows, those with the least hash of
doc_id; prediction reads every whole text. The sample's ids are broadcast
(bounded by ``fit_rows``), so fitting doesn't shuffle the texts.

Defined results: null or wordless texts have no features and get the grade of
an empty text; where nothing or only one grade could be learned, every text
has expected severity 0; repeated rows are each scored; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import mapped

_WORD = re.compile(r"[^\W\d_]+")
SCORES = "doc_id long, expected_severity double, severity int, p_toxic double, toxic boolean"


def places_of(word: str, prefixes: tuple[int, ...], bits: int) -> list[int]:
    units = [f"={word}", *(f"^{word[:n]}" for n in prefixes if len(word) > n)]
    return [zlib.crc32(u.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for u in units]


class Features:
    """Places of a text's features; what a word has is remembered, up to ``remember`` words."""

    def __init__(self, prefixes: tuple[int, ...], bits: int, keep: dict[int, int] | None = None, remember: int = 400_000):
        self.prefixes, self.bits, self.keep, self.remember = prefixes, bits, keep, remember
        self.known: dict[str, list[int]] = {}

    def of(self, text: str | None) -> list[int]:
        if len(self.known) > self.remember:
            self.known.clear()
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())) if text else ():
            places = self.known.get(word)
            if places is None:
                places = places_of(word, self.prefixes, self.bits)
                if self.keep is not None:
                    places = [self.keep[p] for p in places if p in self.keep]
                self.known[word] = places
            if places:
                found.update(places)
        return sorted(found)


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    keep: dict[int, int]
    prefixes: tuple[int, ...]
    bits: int
    cut: float

    def above(self, columns: list[int]) -> np.ndarray:
        """P(grade > j) for each j."""
        return _sigmoid(self.weights[columns].sum() - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, steps: int = 1200, rate: float = 0.05, ridge: float = 2e-5):
    """Weights and increasing thresholds by full-batch Adam on the cumulative-link likelihood."""
    top = int(grade.max())
    w = np.zeros(x.shape[1])
    # thresholds: the first one free, the others by positive gaps
    free = np.concatenate([[2.0], np.zeros(top - 1)])
    m = np.zeros(len(w) + top)
    v = np.zeros_like(m)
    at = np.arange(len(grade))
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = x @ w
        above = np.concatenate([np.ones((len(x), 1)), _sigmoid(score[:, None] - theta), np.zeros((len(x), 1))], axis=1)
        slope = above * (1 - above)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        to_score = (slope[at, grade + 1] - slope[at, grade]) / p / len(x)
        to_theta = np.zeros(top + 2)
        np.add.at(to_theta, grade, slope[at, grade] / p / len(x))
        np.add.at(to_theta, grade + 1, -slope[at, grade + 1] / p / len(x))
        to_theta = to_theta[1:-1]
        tail = np.cumsum(to_theta[::-1])[::-1]
        grad = np.concatenate([x.T @ to_score + ridge * w, [tail[0]], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, free = w - move[: len(w)], free - move[len(w) :]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def select_features(rows: list[np.ndarray], bad: np.ndarray, bits: int, least_docs: int, least_z: float, most: int):
    """Places whose share of texts differs between ``bad`` and the rest, the clearest first."""
    size = 1 << bits
    count = lambda which: np.bincount(np.concatenate([*which, np.zeros(0, np.int64)]), minlength=size)
    pos, neg = count([r for r, b in zip(rows, bad, strict=True) if b]), count([r for r, b in zip(rows, bad, strict=True) if not b])
    n1, n0 = max(int(bad.sum()), 1), max(int((~bad).sum()), 1)
    both = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((pos + neg >= least_docs) & (np.abs(z) >= least_z))
    good = good[np.lexsort((good, -np.abs(z[good])))][:most]
    return {int(p): i for i, p in enumerate(good)}


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, bits: int, grades: int = 3, most: int = 512) -> np.ndarray:
    """Grades from yes-or-no labels: toxic texts are ranked by how many clearly toxic features (``most`` at most) they have."""
    keep = select_features(rows, toxic, bits, 4, 6.0, most)
    hits = np.array([sum(p in keep for p in r.tolist()) for r in rows])
    out = np.zeros(len(rows), np.int64)
    if toxic.any():
        cuts = np.quantile(hits[toxic], [j / grades for j in range(1, grades)])
        out[toxic] = 1 + np.searchsorted(cuts, hits[toxic], side="left")
    return out


def best_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """The probability from which calling a text toxic gives the best F1 on the fitted rows."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(bad[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + bad.sum())
    # only places where the probability changes can be a cut; between two it lies in the middle
    ends = np.flatnonzero(np.append(p[order][1:] < p[order][:-1], True))
    best = ends[np.argmax(f1[ends])]
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + after) / 2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    fit_rows: int = 6000,
    prefixes: tuple[int, ...] = (4, 5, 6),
    bits: int = 20,
    least_docs: int = 5,
    least_z: float = 5.0,
    most_features: int = 1024,
) -> Ordinal | None:
    """Learns from ``labels`` (doc_id and an integer ``label``, 0 or 1, or grades); None if there is one grade only."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.greatest(F.max(label).cast("int"), F.lit(0)).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(prefixes, bits)
        for b in batches:
            found = [np.array(features.of(t), np.int32).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["grade"], pa.array(found, pa.binary())], ["doc_id", "grade", "f"])

    given = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of two numbers
    rows = mapped(given.select("doc_id", "grade", "text"), run, "doc_id long, grade int, f binary").toArrow()
    order = np.lexsort((rows["grade"].to_numpy(), rows["doc_id"].to_numpy())) if rows.num_rows else []
    given = rows["grade"].to_numpy()[order] if rows.num_rows else np.zeros(0, np.int64)
    binary = rows["f"].to_pylist()
    sets = [np.frombuffer(binary[i], np.int32).astype(np.int64) for i in order]
    if len(set(given.tolist())) < 2:
        return None
    grade = severity_grades(sets, given > 0, bits) if given.max() == 1 else given.astype(np.int64)
    keep = select_features(sets, grade > 0, bits, least_docs, least_z, most_features)
    x = np.zeros((len(sets), len(keep)))
    for i, s in enumerate(sets):
        x[i, [keep[p] for p in s.tolist() if p in keep]] = 1
    weights, thresholds = fit_ordinal(x, grade)
    cut = best_cut(_sigmoid(x @ weights - thresholds[0]), grade > 0)
    return Ordinal(weights, thresholds, keep, prefixes, bits, cut)


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """doc_id, expected_severity, severity (most likely grade), p_toxic (grade above 0), toxic (p_toxic from the fitted cut on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(m.prefixes, m.bits, m.keep) if m else None
        for b in batches:
            above = [m.above(features.of(t)) for t in b["text"].to_pylist()] if m else [np.zeros(1)] * b.num_rows
            grades = [int(np.argmax(-np.diff(np.concatenate([[1.0], a, [0.0]])))) for a in above]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([float(a.sum()) for a in above], pa.float64()),
                    pa.array(grades, pa.int32()),
                    pa.array([float(a[0]) for a in above], pa.float64()),
                    pa.array([bool(m and a[0] >= m.cut) for a in above], pa.bool_()),
                ],
                ["doc_id", "expected_severity", "severity", "p_toxic", "toxic"],
            )

    return mapped(docs.select("doc_id", "text"), run, SCORES)
