r"""Exact substring deduplication over a sparse, partitioned suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one. Strings
are judged on the input, never cross documents, and may overlap.

A suffix array of all positions of a corpus neither fits a machine nor is
needed. Every window of ``length`` bytes names one of its positions, the first
with the least hash of ``gram`` bytes there: equal windows name equal places,
so only named places have to be sorted. Windows that follow each other mostly
name the same place; such a run is one *entry*, which is split in two by the
distance to the named place, so that all windows of an entry share a core of
about two thirds of ``length`` bytes.

1. Each entry's core hash is dealt out, packed, 10 bytes an entry. Hashes that
   occur once are done with: most text is unique.
2. The other entries come with their bytes. Within a task, entries with equal
   bytes are settled at once: the earliest stays to stand for them, so a text
   that a third of all documents share costs one entry a task. Entries of a
   core that is very frequent (``hot``) but continues differently each time
   are taken apart into single windows, which have keys of their own.
3. A bucket's suffixes from the core on are sorted deep-shallow; neighbours
   that share the core are a group. Left contexts are sorted alike. For each
   distance from the core the windows that agree on both sides are one class;
   its earliest window stays and the others are removed.

The hash of step 1 only selects: a collision costs an extra entry, and what
is equal is decided on bytes. Shuffles: the packed hashes, the texts once (by
doc_id; both later uses share it), the candidate entries (deflated), spans.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; rows that repeat a doc_id with another text are ordered by a hash of
the text, and exact repetitions of a row are one text with one result; rows
with a null doc_id take no part and lose nothing; empty tables give an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.deep_shallow import deep_shallow
from siltstone.llm.kernels import first_minima, flat_bytes, gram_hashes, mix64, portions
from siltstone.llm.shared import applied, mapped, parts_for, text_or_empty, unused

_U = np.uint64
Span = tuple[int, int]


@dataclass(frozen=True)
class Shape:
    """How windows name places: gram bytes at a place, places in a window, where an entry's distances split, core bytes."""

    length: int

    @property
    def gram(self) -> int:
        return max(1, self.length * 8 // 25)

    @property
    def places(self) -> int:
        return self.length - self.gram + 1

    @property
    def half(self) -> int:
        return (self.places + 1) // 2

    @property
    def core(self) -> int:
        return self.length - self.half + 1


#: first window, how many follow it in the entry, the core's distance from the first window, hash
ENTRY = np.dtype([("start", "<u4"), ("more", "u1"), ("core", "u1"), ("hash", "<u4")])

#: An entry whose hash occurs again: one row each, so that their number follows the input's size alone.
FOUND = np.dtype([("start", "<u4"), ("more", "u1"), ("core", "u1"), ("key", "<u8"), ("hot", "u1")])


def entries(flat: np.ndarray, starts: np.ndarray, shape: Shape, piece: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first window (in the row), windows that follow, distance of the core, and the core's hash, for a batch's bytes."""
    length, half = shape.length, shape.half
    for at in range(0, len(flat) - length + 1, piece):
        part = flat[at : at + piece + length - 1]
        named = first_minima(gram_hashes(part, shape.gram), shape.places)
        window = np.arange(len(named))
        row = np.searchsorted(starts, at + window, "right") - 1
        whole = at + window + length <= starts[row + 1]
        far = named - window >= half
        core = np.where(far, named - half, named)
        # an entry ends where the row, the named place or the side changes
        change = np.ones(len(window), bool)
        change[1:] = (row[1:] != row[:-1]) | (named[1:] != named[:-1]) | (far[1:] != far[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(change & whole)
        if not len(first):
            continue
        stop = np.flatnonzero(np.append(change[1:], True) & whole)
        hashes = gram_hashes(part, shape.core)[core[first]] ^ np.where(far[first], _U(0x5851F42D4C957F2D), _U(0))
        yield row[first], at + first - starts[row[first]], stop - first, core[first] - first, mix64(hashes)


def _dealt(shape: Shape, parts: int):
    """Step 1, map side: one row a batch and part, the entries by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in portions(whole, "text", 8 << 20)):
            flat, starts = flat_bytes(b["text"])
            found = list(entries(flat, starts, shape))
            if not found:
                continue
            row, start, more, core, hashes = (np.concatenate(c) for c in zip(*found, strict=True))
            part = (hashes >> _U(32)) % _U(parts)
            packed = np.zeros(len(row), ENTRY)
            packed["start"], packed["more"], packed["core"] = start, more, core
            packed["hash"] = hashes & _U(0xFFFFFFFF)
            order = np.lexsort((start, row, part))
            row, part, packed = row[order], part[order], packed[order]
            doc, mark = b["doc_id"].to_numpy(), b["mark"].to_numpy()
            cuts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            out = {"part": [], "docs": [], "marks": [], "counts": [], "packed": []}
            for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True):
                rows, count = np.unique(row[i:j], return_counts=True)
                out["part"].append(int(part[i]))
                out["docs"].append(doc[rows].astype(np.int64).tobytes())
                out["marks"].append(mark[rows].astype(np.int64).tobytes())
                out["counts"].append(count.astype(np.uint32).tobytes())
                out["packed"].append(packed[i:j].tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "part" else pa.binary()) for k, v in out.items()})

    return run


DEALT = "part long, docs binary, marks binary, counts binary, packed binary"
REPEATED = "doc_id long, mark long, entry binary"


def _repeated(hot: int):
    """Step 1, reduce side: the entries of hashes that occur more than once; which of them are hot."""

    def run(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        packed, counts = join("packed", ENTRY), join("counts", np.uint32)
        who = np.repeat(np.arange(len(counts)), counts)
        _, back, times = np.unique(packed["hash"], return_inverse=True, return_counts=True)
        times = times[back]
        keep = np.flatnonzero(times > 1)
        out = np.zeros(len(keep), FOUND)
        for name in ("start", "more", "core"):
            out[name] = packed[name][keep]
        part = t["part"][0].as_py() if t.num_rows else 0
        out["key"] = packed["hash"][keep].astype(np.uint64) | _U(part << 32)
        out["hot"] = times[keep] > hot
        who, raw, n = who[keep], out.tobytes(), FOUND.itemsize
        return pa.table(
            {
                "doc_id": pa.array(join("docs", np.int64)[who]),
                "mark": pa.array(join("marks", np.int64)[who]),
                "entry": pa.Array.from_buffers(pa.binary(n), len(keep), [None, pa.py_buffer(raw)]).cast(pa.binary()),
            }
        )

    return run


def merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


#: An entry with its document, as it goes to step 3 (the bytes follow apart), and a span to remove.
CARRIED = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("more", "u1"), ("core", "u1")])
REMOVED = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def _pack_removed(gone: dict[tuple[int, int], list[Span]]) -> bytes:
    rows = [(doc, mark, a, b) for (doc, mark), spans in gone.items() for a, b in merged(spans)]
    return np.array(rows, REMOVED).tobytes()


def _carried(length: int, buckets: int, most: int = 60_000):
    """Step 2: entries with their bytes, equal ones settled within the task; one row a bucket and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, bytes], tuple[int, int, int, int]] = {}
        gone: dict[tuple[int, int], list[Span]] = defaultdict(list)

        def settle(key: int, core: int, content: bytes, doc: int, mark: int, start: int) -> None:
            mine = (doc, mark, start)
            held = best.get((key, core, content))
            if held == mine:  # the row is there twice
                return
            if held is None or mine < held:
                best[key, core, content] = mine
                mine = held
            if mine is not None:
                gone[mine[:2]].append((mine[2], mine[2] + len(content)))

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = defaultdict(list)
            for (key, core, content), (doc, mark, start) in best.items():
                by[key % buckets].append((doc, mark, start, len(content) - length, core, content))
            out = {"bucket": [], "carried": [], "content": [], "removed": []}
            for bucket, rows in by.items():
                rows.sort(key=lambda r: r[:3])
                out["bucket"].append(bucket)
                out["carried"].append(zlib.compress(np.array([r[:5] for r in rows], CARRIED).tobytes(), 1))
                out["content"].append(zlib.compress(b"".join(r[5] for r in rows), 1))
                out["removed"].append(b"")
            if gone:
                out["bucket"].append(next(iter(gone))[0] % buckets)
                out["carried"].append(b"")
                out["content"].append(b"")
                out["removed"].append(zlib.compress(_pack_removed(gone), 1))
            best.clear()
            gone.clear()
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in out.items()})

        for b in batches:
            columns = (b[c].to_pylist() for c in ("doc_id", "mark", "text", "found"))
            for doc, mark, text, found in zip(*columns, strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for start, more, core, key, is_hot in np.frombuffer(b"".join(found), FOUND).tolist():
                    if not is_hot:
                        settle(key, core, raw[start : start + more + length], doc, mark, start)
                        continue
                    for at in range(start, start + more + 1):
                        window = raw[at : at + length]
                        settle(xxhash.xxh3_64_intdigest(window), 0, window, doc, mark, at)
                if len(best) > most:
                    yield from flush()
        if best or gone:
            yield from flush()

    return run


CARRIED_ROWS = "bucket long, carried binary, content binary, removed binary"
SPANS = "doc_id long, mark long, span binary"


def later_windows(rows: list[tuple[int, int, int, int, int, bytes]], shape: Shape) -> dict[tuple[int, int], list[Span]]:
    """Step 3 for (doc, mark, start, more, core, content) rows: the spans whose windows also start earlier."""
    gone: dict[tuple[int, int], list[Span]] = defaultdict(list)
    length = shape.length
    by_right: dict[bytes, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        by_right[r[5][r[4] :]].append(i)
    ordered, shared = deep_shallow(list(by_right))
    group: list[tuple[bytes, int]] = []
    for k, suffix in enumerate(ordered):
        if k and shared[k] < shape.core:
            _settle_group(group, by_right, rows, length, gone)
            group = []
        group.append((suffix, shared[k]))
    _settle_group(group, by_right, rows, length, gone)
    return gone


def _settle_group(group, by_right, rows, length: int, gone) -> None:
    """Classes of equal windows among entries whose suffixes share the core; ``group`` is (suffix, bytes shared with the last)."""
    members = [i for suffix, _ in group for i in by_right[suffix]]
    if len(members) < 2:
        return
    # one entry stands for all with equal bytes on both sides
    held: dict[tuple[int, bytes], int] = {}
    for i in members:
        key = rows[i][4], rows[i][5]
        j = held.get(key)
        if j is not None and rows[i][:3] == rows[j][:3]:  # the row is there twice
            continue
        if j is None or rows[i][:3] < rows[j][:3]:
            held[key], i = i, j
        if i is not None:
            doc, mark, start, more = rows[i][:4]
            gone[doc, mark].append((start, start + more + length))
    if len(held) < 2:
        return
    lefts = {i: rows[i][5][: rows[i][4]][::-1] for i in held.values()}
    left_ordered, left_shared = deep_shallow(list(set(lefts.values())))
    place = {s: k for k, s in enumerate(left_ordered)}
    right_place = {suffix: k for k, (suffix, _) in enumerate(group)}
    # (suffix's place, left context's place, first and last distance of its windows from the core, row)
    alive = [
        (right_place[rows[i][5][rows[i][4] :]], place[lefts[i]], rows[i][4] - rows[i][3], rows[i][4], i) for i in held.values()
    ]
    for distance in range(min(a[2] for a in alive), max(a[3] for a in alive) + 1):
        here = [a for a in alive if a[2] <= distance <= a[3]]
        if len(here) < 2:
            continue
        right_class = _classes([s for _, s in group], length - distance)
        left_class = _classes(left_shared, distance)
        first: dict[tuple[int, int], int] = {}
        for r, l, _, core, i in here:
            key = right_class[r], left_class[l]
            at = rows[i][2] + core - distance
            j = first.get(key)
            if j is None:
                first[key] = i
                continue
            mine, other = (*rows[i][:2], at), (*rows[j][:2], rows[j][2] + rows[j][4] - distance)
            if mine == other:
                continue
            if mine < other:
                first[key], i, at = i, j, other[2]
            gone[rows[i][:2]].append((at, at + length))


def _classes(shared: list[int], n: int) -> list[int]:
    """Numbers of the classes that agree in ``n`` bytes, along a sorted order."""
    out, k = [], 0
    for i, s in enumerate(shared):
        k += bool(i and s < n)
        out.append(k)
    return out


def _compared(shape: Shape):
    def run(t: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[Span]] = defaultdict(list)
        rows: list[tuple] = []
        for carried, content, removed in zip(*(t[c].to_pylist() for c in ("carried", "content", "removed")), strict=True):
            if removed:
                for doc, mark, start, stop in np.frombuffer(zlib.decompress(removed), REMOVED).tolist():
                    gone[doc, mark].append((start, stop))
            if carried:
                raw, at = zlib.decompress(content), 0
                for doc, mark, start, more, core in np.frombuffer(zlib.decompress(carried), CARRIED).tolist():
                    rows.append((doc, mark, start, more, core, raw[at : at + more + shape.length]))
                    at += more + shape.length
        for key, spans in later_windows(rows, shape).items():
            gone[key] += spans
        # one row a span, so that their number follows the input's size alone
        spans = np.array([(*key, a, b) for key, own in gone.items() for a, b in merged(own)], REMOVED)
        pairs = np.ascontiguousarray(np.stack([spans["start"], spans["stop"]], axis=1).astype("<u4"))
        packed = pa.Array.from_buffers(pa.binary(8), len(spans), [None, pa.py_buffer(pairs.tobytes())])
        return pa.table({"doc_id": spans["doc"], "mark": spans["mark"], "span": packed.cast(pa.binary())})

    return run


def with_spans(docs: DataFrame, length: int = 100, hot: int = 20_000, part_bytes: int = 48 << 20, name: str = "spans") -> DataFrame:
    """``docs`` with the column ``name`` (one that is there is replaced): an array of packed 32-bit offsets (start, stop) to remove.

    The spans of a document may touch or overlap.
    """
    spark = docs.sparkSession
    shape = Shape(length)
    if not 4 <= length <= 250:
        raise ValueError("length must be from 4 to 250 bytes")
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = [c for c in docs.columns if c != name]
    # the other columns travel under numbers, so that none has a name that is used here
    others = {c: f"own{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text")}
    given = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(own) for c, own in others.items()))
    marked = given.withColumn("mark", F.xxhash64(text_or_empty("text")))
    known = marked.where(F.col("doc_id").isNotNull())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(total, part_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2 or 1)
    buckets = 8 * parts
    dealt = mapped(known.select("doc_id", "mark", text_or_empty("text").alias("text")), _dealt(shape, parts), DEALT)
    repeated = (
        applied(dealt.repartition(parts, "part").groupBy("part"), _repeated(hot), REPEATED)
        .groupBy("doc_id", "mark")
        .agg(F.collect_list("entry").alias("found"))  # no more than a document has
    )
    # Both joins take the same rows and columns of ``known``, so that one exchange of the texts serves them.
    carried = mapped(known.join(repeated, ["doc_id", "mark"]).select(*known.columns, "found"), _carried(length, buckets), CARRIED_ROWS)
    spans = (
        applied(carried.repartition(buckets, "bucket").groupBy("bucket"), _compared(shape), SPANS)
        .groupBy("doc_id", "mark")
        .agg(F.collect_list("span").alias("spans"))
    )
    back = [F.col(others.get(c, c)).alias(c) for c in columns]
    found = known.join(spans, ["doc_id", "mark"], "left").select(*back, F.col("spans").alias(name))
    nameless = marked.where(F.col("doc_id").isNull()).select(*back, F.lit(None).cast("array<binary>").alias(name))
    return found.unionByName(nameless)


def spans_of(packed: list[bytes] | None) -> list[Span]:
    return merged([tuple(s) for p in packed or [] for s in np.frombuffer(p, "<u4").reshape(-1, 2).tolist()])


def kept(raw: bytes, spans: list[Span]) -> bytes:
    at, out = 0, []
    for start, stop in spans:
        out.append(raw[at:start])
        at = stop
    return b"".join([*out, raw[at:]])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, packed in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
            raw, spans = (text or "").encode("utf-8", "surrogatepass"), spans_of(packed)
            rows.append((len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept(raw, spans)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(marked: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`with_spans`' rows."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return mapped(marked.select("doc_id", "text", "spans"), _reported, schema)


def char_spans(raw: bytes, spans: list[Span]) -> list[Span]:
    """The spans drawn in to whole characters: a character that is only partly covered stays."""
    out = []
    for start, stop in spans:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        while start < stop and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs``, all columns, their texts without the repeated spans; n_chars follows; texts that lose everything go."""
    columns, schema, name = docs.columns, docs.schema, unused("spans", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for text, packed in zip(b["text"].to_pylist(), b[name].to_pylist(), strict=True):
                if packed and text:
                    raw = text.encode("utf-8", "surrogatepass")
                    text = kept(raw, char_spans(raw, spans_of(packed))).decode("utf-8", "surrogatepass")
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            whole = b.select(columns)
            whole = whole.set_column(columns.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in columns:
                sizes = pa.array([None if t is None else len(t) for t in texts], whole.schema.field("n_chars").type)
                whole = whole.set_column(columns.index("n_chars"), "n_chars", sizes)
            yield whole.filter(pa.array(keep, pa.bool_()))

    return mapped(with_spans(docs, length, name=name), run, schema)
