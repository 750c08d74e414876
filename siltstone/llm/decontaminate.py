"""Benchmark decontamination with one Aho-Corasick automaton.

The items (questions and answers) are normalised and cut into windows of
``window`` consecutive words; an item with fewer words, but some, is one
window. All windows go into one automaton, which is sent to the executors and
scans every normalised document once. A match is mapped back to the words it
covers and to their byte offsets in the original text.

Normalising keeps bytes in place: A-Z become a-z, the other ASCII bytes that
aren't letters or digits become spaces, all else stays. So words are maximal
runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing and a word's
place is its place in the original UTF-8 text.

What is broadcast is bounded: the items are cut into portions whose windows
have at most ``automaton_bytes`` bytes, each portion has its own automaton and
scan. Any number of items is thus searched whole; benchmarks of usual size make
one portion and one scan. For several, the rows are numbered and written once
and the scans' results meet by row, so that the results are those of one scan.

Defined results: null or wordless texts have no words and no hits; an item
without words has no window; repeated doc_id rows are each scanned and
reported; empty tables give empty or unhit results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import mapped, written

AUTOMATON_BYTES = 16 << 20

#: Bytes to bytes: lower-casing of A-Z, spaces for ASCII that is neither letter nor digit.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: What a scan finds in a row; runs are of consecutive hit words, by number and by bytes.
_SCANNED = "n_words long, hit array<int>, items array<string>, runs array<struct<first:int,last:int,start:int,stop:int>>"
_SCANNED_ARROW = [
    ("n_words", pa.int64()),
    ("hit", pa.list_(pa.int32())),
    ("items", pa.list_(pa.string())),
    ("runs", pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "stop")]))),
]


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def windows_of(text: str | None, window: int) -> list[bytes]:
    words = fold(text).split()
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def portions(items: Iterable[tuple[str, str | None]], window: int, most: int) -> Iterator[dict[str, tuple[int, set[str]]]]:
    """Windows (latin-1 strings with a space at either end) to their word count and item ids, portion by portion."""
    part: dict[str, tuple[int, set[str]]] = {}
    held = 0
    for item_id, text in items:
        for w in windows_of(text, window):
            key = f" {w.decode('latin-1')} "
            if key not in part:
                part[key] = (w.count(b" ") + 1, set())
                held += len(key)
            part[key][1].add(item_id)
            if held >= most:  # also within an item: its windows may be in several portions
                yield part
                part, held = {}, 0
    if part:
        yield part


def scanner(part: dict[str, tuple[int, set[str]]]) -> Callable[[str | None], tuple[int, list[int], list[str], list[tuple[int, int, int, int]]]]:
    """A function from a text to its word count, the hit words' numbers, the items found and the runs of hit words."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for key, value in part.items():
        machine.add_word(key, value)
    if part:
        machine.make_automaton()

    def scan(text: str | None):
        folded = fold(text)
        words = folded.split()
        if not part or not words:
            return len(words), [], [], []
        joined = f" {b' '.join(words).decode('latin-1')} "
        hit: set[int] = set()
        items: set[str] = set()
        ends: dict[int, int] | None = None
        for stop, (n, ids) in machine.iter(joined):
            if ends is None:  # only texts with a match pay for the map from offsets to words
                ends, at = {}, 0
                for k, w in enumerate(words):
                    at += len(w) + 1
                    ends[at] = k
            last = ends[stop]
            hit.update(range(last - n + 1, last + 1))
            items |= ids
        runs: list[tuple[int, int, int, int]] = []
        if hit:
            at, before = 0, -2
            for k, w in enumerate(words):
                start = folded.index(w, at)
                at = start + len(w)
                if k in hit:
                    if before == k - 1:
                        runs[-1] = (runs[-1][0], k, runs[-1][2], at)
                    else:
                        runs.append((k, k, start, at))
                    before = k
        return len(words), sorted(hit), sorted(items), runs

    return scan


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """doc_id, n_words, hit (word numbers), items (ids as text, sorted) and spans (byte ranges of the original)."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(p) for p in _portions_of(benchmark, window, automaton_bytes)]
    if len(shared) < 2:
        return _with_spans(_scan_portion(docs, shared[0] if shared else context.broadcast({}), "doc_id"))
    # Several portions: every row is scanned once for each; what they find meets by the row's number, not its doc_id.
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "decontaminate-rows")
    found = reduce(DataFrame.unionByName, (_scan_portion(rows, s, "row", "doc_id") for s in shared))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    met = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), *map(merged, ("hit", "items", "runs")))
    none = F.array().cast("array<struct<first:int,last:int,start:int,stop:int>>")
    return _with_spans(met.withColumn("runs", F.aggregate("runs", none, _with_run)))


def _with_spans(scanned: DataFrame) -> DataFrame:
    span = lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))
    return scanned.select("doc_id", "n_words", "hit", "items", F.transform("runs", span).alias("spans"))


def _with_run(runs: Column, run: Column) -> Column:
    """Runs in order, one more behind them; it grows the last one where they overlap or are neighbours."""
    last = F.get(runs, F.size(runs) - 1)
    longer = lambda c: F.greatest(last[c], run[c]).alias(c)
    grown = F.struct(last["first"].alias("first"), longer("last"), last["start"].alias("start"), longer("stop"))
    joins = run["first"] <= last["last"] + 1
    return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))).otherwise(F.array_append(runs, run))


def _portions_of(benchmark: DataFrame, window: int, most: int) -> Iterator[dict[str, tuple[int, set[str]]]]:
    """Streams the items through the driver, holding one portion at a time."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return portions(named.orderBy("item_id", "text").toLocalIterator(), window, most)


def _scan_portion(docs: DataFrame, shared, *keys: str) -> DataFrame:
    """The keys (64-bit numbers) of each row and what one portion's scan finds in its text."""
    schema = pa.schema([*((k, pa.int64()) for k in keys), *_SCANNED_ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(shared.value)
        for b in batches:
            out = [scan(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    **{k: b[k] for k in keys},
                    "n_words": [x[0] for x in out],
                    "hit": [x[1] for x in out],
                    "items": [x[2] for x in out],
                    "runs": [[dict(zip(("first", "last", "start", "stop"), r, strict=True)) for r in x[3]] for x in out],
                },
                schema=schema,
            )

    names = ", ".join(f"{k} long" for k in keys)
    return mapped(docs.select(*keys, "text"), run, f"{names}, {_SCANNED}")


def contamination(found: DataFrame) -> DataFrame:
    """The report of :func:`scan_documents`' rows: counts, the digest of the items' ids, the verdict."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """The documents, all columns, in which no window occurs. The scan runs where the rows are: no text is shuffled."""
    kept = docs
    for part in _portions_of(benchmark, window, automaton_bytes):
        kept = mapped(kept, _clean_only(docs.sparkSession.sparkContext.broadcast(part)), docs.schema)
    return kept


def _clean_only(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(shared.value)
        for b in batches:
            yield b.filter(pa.array([not scan(t)[1] for t in b["text"].to_pylist()], pa.bool_()))

    return run
