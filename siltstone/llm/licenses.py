"""License scans: winnowed fingerprints find candidates, alignment decides.

Templates and texts are folded to lower-case runs of letters and digits. Every
run of ``gram`` words of a template is hashed; of each ``window`` consecutive
hashes the least is kept (winnowing), and an inverted index leads from a kept
hash to the templates that have it. Texts are winnowed alike, so
any ``gram + window - 1`` words in common share a fingerprint. Runs that no
template has sort last, so they never take the place of one that counts. Of
templates with less than ``short`` words every run is indexed and looked up: any
``gram`` words in common are a hit. Where replaced words may leave enough of one
but no such run, runs are as short as what stays. Hits of one template make
stretches of text, and a local alignment of the template with a stretch (match
2, other -1) tells which template words the text has: the matched coverage and
the span of the text, in bytes of its UTF-8 form. A gap
costs at most ``band`` however long it is, so pieces on different diagonals
count together; words of the text up to the template's length are such a gap.

Words that no template has can't be in a fingerprint that matters; they share
one number. The index is as large as the templates and travels with the job;
texts stay where they are, so there is no shuffle.

Defined results: null and wordless texts match nothing; a text may match many
templates and one template many times, each a span; a license has the
spans of all templates of its name, and the counts and coverage of the span with
the most matched words (then the best coverage); a span inside one with more
matched words, or as many and a better coverage, is left to that one, whatever
the names; repeated rows are each reported; empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.kernels import mix64
from siltstone.llm.shared import mapped

#: Public notices and license texts, by SPDX name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

MATCHES = "doc_id long, license string, coverage double, matched_words int, template_words int, spans array<struct<start:int,stop:int>>"

#: Bytes to bytes of the same place: lower case for A-Z, space for other ASCII that isn't a letter or digit.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def winnow(grams: np.ndarray, window: int, known: np.ndarray | None = None) -> np.ndarray:
    """Places of the kept grams: the first least hash of each window (of those ``known``, if there are any); all of one window if there are fewer."""
    if not len(grams):
        return np.zeros(0, np.int64)
    hashes = mix64(grams.astype(np.uint64))
    if known is not None:
        hashes = np.where(known, hashes, np.uint64(2**64 - 1))
    views = np.lib.stride_tricks.sliding_window_view(hashes, min(window, len(hashes)))
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def kept_run(n: int, least: float) -> int:
    """The longest run that is sure to stay of ``n`` words when replaced ones leave a share of ``least``."""
    gone = n - math.ceil(least * n - 1e-9)
    return -(-(n - gone) // (gone + 1))


class LicenseIndex:
    """Templates, their vocabulary and the inverted index of their fingerprints; ``least`` is the coverage that counts."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = 3, window: int = 3, short: int = 20, least: float = 0.8) -> None:
        self.gram, self.window = gram, window
        self.names = [name for name, _ in templates]
        self.words = [fold(text).split() for _, text in templates]
        self.vocabulary: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [np.array([self.vocabulary[w] for w in words], np.int64) for words in self.words]
        self.postings: dict[int, set[int]] = defaultdict(set)
        for t, ids in enumerate(self.ids):
            grams = self.grams(ids)
            for place in winnow(grams, window if len(ids) >= short else 1):
                self.postings[int(grams[place])].add(t)
        self.keys = np.array(sorted(self.postings), np.int64)
        self.of_short = np.array([any(len(self.ids[t]) < short for t in self.postings[int(k)]) for k in self.keys], bool)
        #: Of short templates that may keep no run of ``gram`` words: by the length of what they keep, run to templates.
        shorter: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for t, ids in enumerate(self.ids):
            size = kept_run(len(ids), least)
            if len(ids) < short and 0 < size < gram:
                for g in self.grams(ids, size).tolist():
                    shorter[size][g].add(t)
        self.shorter = {size: (np.array(sorted(runs), np.int64), dict(runs)) for size, runs in shorter.items()}

    def grams(self, ids: np.ndarray, size: int | None = None) -> np.ndarray:
        """One exact number for each run of ``size`` (``gram``) words; those with a word of no template are 0."""
        size = size or self.gram
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            out = out * (len(self.vocabulary) + 1) + ids[j : j + n]
            known &= ids[j : j + n] > 0
        return np.where(known, out, 0)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Template and place in the text: of the text's kept fingerprints that the index has, and of the shorter runs."""
        for size, (keys, runs) in self.shorter.items():
            grams = self.grams(ids, size)
            for place in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams):
                for t in runs[int(grams[place])]:
                    yield t, int(place)
        grams = self.grams(ids)
        if not grams.any():
            return
        if not len(self.keys):
            return
        found = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        known = self.keys[found] == grams
        if not known.any():
            return
        kept = np.union1d(winnow(grams, self.window, known), np.flatnonzero(known & self.of_short[found]))
        for place in kept[known[kept]]:
            for t in self.postings[int(grams[place])]:
                yield t, int(place)

    def scan(self, text: str | None, least: float, band: int) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
        """License, coverage, matched words, template words (all three of the span with the most) and byte spans."""
        folded = fold(text)
        words = folded.split()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        by: dict[int, list[int]] = defaultdict(list)
        for t, place in self.hits(ids):
            by[t].append(place)
        every: list[tuple[int, int, int, int]] = []  # matched words, template, first and last text word
        for t, found in by.items():
            for a, b in _stretches(found, len(self.ids[t]), len(ids)):
                every += [(m, t, first, last) for m, first, last in matches(self.ids[t], ids, a, b, least, band)]
        if not every:
            return []
        starts, at = [], 0
        for w in words:
            at = folded.index(w, at)
            starts.append(at)
            at += len(w)
        # A span that lies in one with more matched words, or as many of a shorter template, is that one's, read too generously.
        rank = lambda m, t: (m, -len(self.ids[t]))
        own: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)
        for m, t, first, last in every:
            if not any(a <= first and last <= b and rank(o, u) > rank(m, t) for o, u, a, b in every):
                own[self.names[t]].append((m, t, first, last))
        out = []
        for name, spans in sorted(own.items()):
            m, t = max(((m, t) for m, t, _, _ in spans), key=lambda x: (x[0], -len(self.ids[x[1]])))
            places = sorted({(starts[a], starts[b] + len(words[b])) for _, _, a, b in spans})
            out.append((name, m / len(self.ids[t]), m, len(self.ids[t]), places))
        return out


def _stretches(places: list[int], n: int, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of the text, apart from each other, with two lengths of the template around the hits."""
    start = before = None
    for place in sorted(places):
        if before is None or place > before + 4 * n:
            if before is not None:
                yield max(0, start - 2 * n), before + 2 * n
            start = place
        before = place
    if before is not None:
        yield max(0, start - 2 * n), min(words, before + 2 * n)


def matches(template: np.ndarray, text: np.ndarray, start: int, stop: int, least: float, band: int) -> list[tuple[int, int, int]]:
    """Matched words, first and last text word of the matches in a range: the best ones that don't overlap, then those between."""
    out, waiting, need = [], [(start, stop)], least * len(template)
    times = np.bincount(template)
    while waiting:
        start, stop = waiting.pop()
        part = text[start:stop]
        # no alignment matches more words than both have
        if np.minimum(np.bincount(part[part < len(times)], minlength=len(times)), times).sum() < need:
            continue
        ends = align(template, part, band)
        count = (ends >> _FIRST_BITS) & ((1 << _COUNT_BITS) - 1)
        good = np.flatnonzero((count >= need) & (count > 0))
        used, taken = np.zeros(len(part), bool), []
        for last in good[np.argsort(-ends[good], kind="stable")].tolist():
            first = int(ends[last]) & ((1 << _FIRST_BITS) - 1)
            if not used[first : last + 1].any():
                used[first : last + 1] = True
                taken.append((int(count[last]), start + first, start + last))
        taken.sort(key=lambda m: m[1])
        if taken:
            out += taken
            waiting += zip([start, *(m[2] + 1 for m in taken)], [*(m[1] for m in taken), stop], strict=True)
    return out


#: A path is one number: its score, below it its matched words, below them its first text word (the later the better).
_COUNT_BITS, _FIRST_BITS = 16, 28
_ONE = 1 << (_COUNT_BITS + _FIRST_BITS)


def align(template: np.ndarray, text: np.ndarray, band: int) -> np.ndarray:
    """For each text word the best path of a local alignment that ends in a match of it, or 0.

    A match scores 2, a replaced word -1, a gap in either -1 a word, but -``band`` at most; a gap in the text
    is no longer than the template.
    """
    n = len(text)
    fresh = np.arange(n, dtype=np.int64)
    ahead = lambda paths, k: np.concatenate([np.zeros(min(k, n), np.int64), paths[: max(0, n - k)]])
    paths, ever, ends = (np.zeros(n, np.int64) for _ in range(3))
    for word in template.tolist():
        same, before = text == word, ahead(paths, 1)
        matched = np.where(same, np.maximum(before, fresh) + (2 * _ONE + (1 << _FIRST_BITS)), 0)
        ends = np.maximum(ends, matched)
        here = np.maximum(np.maximum(matched, np.where(same, 0, before - _ONE)), np.maximum(paths - _ONE, ever - band * _ONE))
        here[here < _ONE] = 0
        skipped = _most_before(here, len(template)) - band * _ONE
        for k in range(1, band):
            skipped = np.maximum(skipped, ahead(here, k) - k * _ONE)
        paths = np.maximum(here, skipped)
        paths[paths < _ONE] = 0
        ever = np.maximum(ever, paths)
    return ends


def _most_before(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the most of the ``width`` values before it (0 if there are none), from block-wise running maxima."""
    blocks = -(-len(values) // width) + 1
    padded = np.zeros(blocks * width + width, np.int64)
    padded[width : width + len(values)] = values
    grid = padded.reshape(-1, width)
    up = np.maximum.accumulate(grid, axis=1).ravel()
    down = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(down[: len(values)], up[width - 1 : width - 1 + len(values)])


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    least_coverage: float = 0.8,
    gram: int = 3,
    window: int = 3,
    band: int = 4,
) -> DataFrame:
    """doc_id, license, coverage (share of the template's words), matched_words, template_words, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(LicenseIndex(templates, gram, window, least=least_coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = [
                {
                    "doc_id": doc_id,
                    "license": name,
                    "coverage": coverage,
                    "matched_words": matched,
                    "template_words": n,
                    "spans": [{"start": s, "stop": e} for s, e in spans],
                }
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)
                for name, coverage, matched, n, spans in index.scan(text, least_coverage, band)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_MATCHES_ARROW)

    return mapped(docs.select("doc_id", "text"), run, MATCHES)


_MATCHES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("license", pa.string()),
        ("coverage", pa.float64()),
        ("matched_words", pa.int32()),
        ("template_words", pa.int32()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)
