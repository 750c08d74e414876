"""N-gram Jaccard self-join with prefix trees, and its components.

A text's set is its distinct runs of ``n`` words (the whole text as one run if
it is shorter; a text without words has an empty set and no link). Two texts
link when ``100 * |A and B| >= percent * |A or B|``. Sets are hashes in one
global order, that of the hash.

Which sets have to meet is found without a list of all pairs. A linked pair of
sizes up to ``hi`` differs in at most ``D = 2 hi (100 - percent) / (100 +
percent)`` elements, so of ``m > D`` ranges of the global order at least
``m - D`` are equal in both. Each set says one signature a range, for its own
size class and the next one; equal signatures meet in a reducer. Ranges with
fewer than ``q`` elements say nothing as long as the others suffice (``m`` has
room for that); a set with too many of them says all its ranges in a space of
its own, where it meets its likes.

The sets that meet are joined by tree: globally ordered sets are stored in a
trie (edges are runs) and a set is carried down it, level by level, with the
overlap so far, which counts once for all sets that share a prefix. A subtree
is left as soon as the remaining lengths allow no distance in it that matters,
or if all of it is in the component of the set that is carried down.

What meets is not yet paired. Elements that no other set that meets has are
counted (``alone``): a set with too many of them links with nothing and goes.
Within a group a trie of the members is probed with one hub, the set with the
fewest elements alone, which settles a group of true copies in linear work and
gives bounds of all distances d to it. Members that missed the hub are then
joined with the others that met it, by what they differ in from it: x and y
differ exactly where their differences to the hub do, so a trie of these short
sets is all that is needed. Elements alone count on both ways, d(x, y) >= d(y,
hub) + 2 alone(x) - d(x, hub), and members that this excludes for all stay out.
Such a join goes in tiles of at most ``tile`` rows a side and gives one link a
pair of components, never a pair of rows of one component; no link between
different texts is lost.

Scale: equal sets are one class, found by a digest that is summed up in the
map tasks; signatures and elements travel packed (6 bytes each and the ids);
a hub with many partners is salted, so no task holds more than some
``hub_share`` partners of it; texts, not sets, are shuffled, once by doc_id,
and those that meet others are written for the later steps.

Defined results: rows with a null doc_id link with nothing and have a null
component; of rows that repeat a doc_id with other texts the one with the
largest set (then the greatest digest) links for all of them; ties don't
matter as components are named by the smallest id; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.kernels import flat_bytes, mix64, portions
from siltstone.llm.shared import applied, mapped, parts_for, written

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(257, 513, dtype=np.uint64) * _U(_BASE))
#: Lower-casing of A-Z, byte by byte.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, for i below n."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(data: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a lower-cased buffer; tables are as long as a piece or the longest word."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + piece, "right")))
        base, n = start[i], int(stop[j - 1] - start[i])
        up, down = _powers(1 << max(20, n.bit_length()))
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data[base : base + n]] * up[:n], dtype=np.uint64)])
        own = (total[stop[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
        out[i:j] = mix64(own + (stop[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return out, start


def shingle_sets(column: pa.Array, n: int, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word runs; buffers of about ``piece`` bytes at a time."""
    flat, starts = flat_bytes(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + piece, "right")) - 1)
        part = _LOWER[flat[starts[row] : starts[stop]]]
        bounds = starts[row : stop + 1] - starts[row]
        # a text may end in a word and the next begin with one: cut between them by a space that both see
        cut = np.insert(part, bounds[1:-1], 32)
        bounds = bounds + np.arange(len(bounds))
        bounds[-1] -= 1
        hashes, at = _word_hashes(cut)
        first = np.searchsorted(at, bounds)
        for i in range(stop - row):
            words = hashes[first[i] : first[i + 1]]
            if len(words) >= n:
                grams = np.zeros(len(words) - n + 1, np.uint64)
                for j in range(n):
                    grams = grams * _U(_BASE) + words[j : j + len(grams)]
                yield np.unique(mix64(grams))
            elif len(words):
                whole = _U(0)
                with np.errstate(over="ignore"):
                    for w in words:
                        whole = whole * _U(_BASE) + w
                yield mix64(np.array([whole ^ _U(len(words) << 56)]))
            else:
                yield np.zeros(0, np.uint64)
        row = stop


@dataclass(frozen=True)
class Level:
    """The ranges of one size class: how many, how few elements say nothing, how many may say nothing."""

    number: int
    ranges: int
    least: int
    silent: int


class Classes:
    """Size classes: linked sets are in the same class or in neighbouring ones."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low = [1, 2]
        self.levels: dict[int, Level] = {}

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self._extend()
        return int(np.searchsorted(self.low, size, "right")) - 1

    def _extend(self) -> None:
        self.low.append(self.low[-1] * 100 // self.percent + 1)

    def level(self, k: int) -> Level:
        """For pairs whose larger set is in class ``k``, the other in ``k`` or ``k - 1``."""
        if k not in self.levels:
            while k + 1 >= len(self.low):
                self._extend()
            differ = 2 * (self.low[k + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            least, silent = 1, 0
            if differ:
                for q in (4, 3, 2):
                    room = math.ceil(0.12 * (differ + 1)) + 1
                    mean = self.low[max(k - 1, 0)] / (differ + 1 + room)
                    if sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(q)) <= 0.06:
                        least, silent = q, room
                        break
                else:
                    silent = math.ceil(0.05 * (differ + 1)) + 1
            self.levels[k] = Level(k, differ + 1 + silent, least, silent)
        return self.levels[k]


def signatures(tokens: np.ndarray, level: Level) -> np.ndarray:
    """What a set says at a level: at least one is equal in any two sets that link there."""
    m = level.ranges
    edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
    at = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
    total = np.concatenate([[_U(0)], np.cumsum(mix64(tokens), dtype=np.uint64)])
    seed = mix64(np.arange(m, dtype=np.uint64) + _U(level.number << 32) + _U(1 << 56))
    said = mix64((total[at[1:]] - total[at[:-1]]) ^ seed)
    heard = np.diff(at) >= level.least
    if m - int(heard.sum()) <= level.silent:
        return said[heard]
    return np.concatenate([said[heard], mix64(said + _U(1))])


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass(frozen=True)
class Reached:
    """What a probe knows of the distance to each stored set: its bounds, which are equal where no subtree was left."""

    low: np.ndarray
    high: np.ndarray


class Trie:
    """Globally ordered sets as a tree of runs, level by level; each node knows the sizes and labels below it.

    Sets are kept in the order of their elements, so that those below a node
    are neighbours and those that end in it come first among them.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray | None = None) -> None:
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()), np.int64)
        self.size = np.array([len(sets[i]) for i in self.order], np.int64)
        self.label = None if labels is None else labels[self.order]
        rows: list[tuple[int, int, int, int, int]] = []
        runs: list[np.ndarray] = []
        self.levels: list[tuple[int, int]] = []
        waiting = [(0, len(sets), 0, -1)] if sets else []
        while waiting:
            following = []
            self.levels.append((len(rows), len(rows) + len(waiting)))
            for lo, hi, depth, parent in waiting:
                first, last = sets[self.order[lo]], sets[self.order[hi - 1]]
                # in order, so what the first and the last share all share
                m = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:m] != last[depth:m])
                stop = depth + int(differ[0]) if len(differ) else m
                begin = lo
                while begin < hi and self.size[begin] == stop:
                    begin += 1
                rows.append((lo, hi, stop, parent, begin))
                runs.append(first[depth:stop])
                while begin < hi:
                    head = sets[self.order[begin]][stop]
                    end = begin + 1
                    while end < hi and sets[self.order[end]][stop] == head:
                        end += 1
                    following.append((begin, end, stop, len(rows) - 1))
                    begin = end
            waiting = following
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.lo, self.hi, self.stop, self.parent, self.ended = table.T
        self.length = np.array([len(r) for r in runs], np.int64)
        self.elements, self.flat = np.unique(np.concatenate([*runs, np.zeros(0, np.uint64)]), return_inverse=True)
        self.flat = self.flat.astype(np.int32)
        self.at = np.cumsum(self.length) - self.length
        self.last = np.array([r[-1] if len(r) else 0 for r in runs], np.uint64)
        below = lambda f, of: np.array([f(of[i:j]) for i, j in zip(self.lo, self.hi, strict=True)], np.int64)
        self.least, self.greatest = below(np.min, self.size), below(np.max, self.size)
        if self.label is not None:
            self.one_label = below(np.min, self.label) == below(np.max, self.label)

    def probe(self, tokens: np.ndarray, reach: int, label: int | None = None) -> Reached:
        """Distances of ``tokens`` to the stored sets, in the order they were given in.

        The overlap of a run counts once for all sets below it. A subtree is
        left as soon as the remaining lengths allow no distance up to
        ``reach`` in it, or if all below has ``label``.
        """
        n = len(tokens)
        found = np.searchsorted(self.elements, tokens)
        found = found[(found < len(self.elements)) & (self.elements[np.minimum(found, len(self.elements) - 1)] == tokens)] if len(self.elements) else found[:0]
        mine = np.zeros(len(self.elements), np.int8)
        mine[found] = 1
        overlap = np.zeros(len(self.lo), np.int64)
        rest = np.full(len(self.lo), n, np.int64)
        alive = np.zeros(len(self.lo) + 1, bool)
        alive[-1] = True  # the root's parent
        low, high = np.zeros(len(self.size), np.int64), n + self.size
        for start, stop in self.levels:
            here = start + np.flatnonzero(alive[self.parent[start:stop]])
            if label is not None:
                here = here[~(self.one_label[here] & (self.label[self.lo[here]] == label))]
            if not len(here):
                break
            length = self.length[here]
            if 2 * len(here) > stop - start:  # a level's runs are neighbours: all of them take less than picking some
                edges = self.at[here] - self.at[start]
                picked = self.flat[self.at[start] : self.at[stop - 1] + self.length[stop - 1]]
            else:
                edges = np.cumsum(length) - length
                picked = self.flat[np.repeat(self.at[here] - edges, length) + np.arange(int(length.sum()))]
            hits = np.concatenate([[0], np.cumsum(mine[picked], dtype=np.int32)])
            parent = self.parent[here]
            overlap[here] = np.where(parent >= 0, overlap[parent], 0) + hits[edges + length] - hits[edges]
            rest[here] = np.where(length > 0, n - np.searchsorted(tokens, self.last[here], "right"), np.where(parent >= 0, rest[parent], n))
            # the size below at which the distance can be least
            size = np.clip(self.stop[here] + rest[here], self.least[here], self.greatest[here])
            nearest = n + size - 2 * (overlap[here] + np.minimum(rest[here], size - self.stop[here]))
            alive[here] = nearest <= reach
            # what is known of all sets below; deeper nodes say it again and better
            lo, count = self.lo[here], self.hi[here] - self.lo[here]
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            node = np.repeat(here, count)
            high[at] = n + self.size[at] - 2 * overlap[node]
            low[at] = high[at] - 2 * np.minimum(rest[node], self.size[at] - self.stop[node])
        back = np.argsort(self.order)
        return Reached(low[back], high[back])


#: Hex digits of a set's digest that name it where signatures meet; classes that share a name meet, and are then compared.
_NAME_DIGITS = 15


def _name_of(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), 1, _NAME_DIGITS), 16, 10).cast("long")


def _described(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = [], []
            for s in shingle_sets(b["text"], n):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            columns = [b["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key"])

    return run


def _signed(n: int, percent: int, parts: int):
    """Packed signatures by part: the sets' names, how many signatures each has, their lower 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent), set()
        for b in (part for whole in batches for part in portions(whole, "text")):
            ids, said = [], []
            for doc_id, s in zip(b["doc_id"].to_pylist(), shingle_sets(b["text"], n), strict=True):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                # equal sets are one class and speak under its name, whichever row a task meets first
                if not len(s) or doc_id is None or key in seen:
                    continue
                seen.add(key)
                k = classes.of(len(s))
                own = np.concatenate([signatures(s, classes.level(k)), signatures(s, classes.level(k + 1))])
                ids.append(int(key.hex()[:_NAME_DIGITS], 16))
                said.append(own)
            if not ids:
                continue
            yield _packed_rows(ids, said, parts)

    return run


SIGNED = "part long, ids binary, counts binary, low binary, high binary"
MET = "gid long, member long"


def _meeting(t: pa.Table) -> pa.Table:
    """The groups of equal signatures of one part: (gid, member), each set of members once."""
    said, who = _unpacked(t)
    begin = np.flatnonzero(np.diff(said, prepend=said[0] ^ _U(1)) != 0) if len(said) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(said)))
    # a number for each set of members: order doesn't matter, so sums of mixed ids do
    mixed = np.concatenate([[_U(0)], np.cumsum(mix64(who.astype(np.uint64)), dtype=np.uint64)])
    gid = (mixed[np.append(begin, len(said))[1:]] - mixed[begin]) if len(begin) else np.zeros(0, np.uint64)
    begin, size, gid = begin[size > 1], size[size > 1], gid[size > 1]
    # a set of members is said once; other sets with the same number (of other size or least member) stay, and share its name
    least = who[begin]
    order = np.lexsort((least, size, gid))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (gid[order][1:] != gid[order][:-1]) | (size[order][1:] != size[order][:-1]) | (least[order][1:] != least[order][:-1])
    begin, size, gid = begin[order][fresh], size[order][fresh], gid[order][fresh]
    group = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + begin[group]
    return pa.table({"gid": pa.array(gid[group].view(np.int64)), "member": pa.array(who[place])})


def _kept_texts(n: int):
    """The rows (member, key, text) whose set has the digest ``key``, packed: of a repeated doc_id the one that links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in portions(whole, "text")):
            sets = zip(shingle_sets(b["text"], n), b["key"].to_pylist(), strict=True)
            same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key for s, key in sets], pa.bool_())
            kept = b.filter(same)
            packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 6) for t in kept["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([kept["member"], pa.array(packed, pa.binary())], ["member", "packed"])

    return run


def _packed_sets(column: pa.Array | pa.ChunkedArray, n: int) -> list[np.ndarray]:
    """The sets of packed texts; they are unpacked a few at a time."""
    out: list[np.ndarray] = []
    packed = column.to_pylist()
    for at in range(0, len(packed), 256):
        texts = [zlib.decompress(p).decode("utf-8", "surrogatepass") for p in packed[at : at + 256]]
        out += shingle_sets(pa.array(texts, pa.string()), n)
    return out


def _packed_rows(ids: list[int], values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """64-bit values dealt to parts by their upper bits; a row has ids, how many values each has, and the lower 48 bits."""
    counts = [len(v) for v in values]
    every = np.concatenate(values) if values else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(ids)), counts)
    part = (((every >> _U(48)) * _U(parts)) >> _U(16)).astype(np.int64) if parts <= 1 << 16 else (every % _U(parts)).astype(np.int64)
    order = np.lexsort((who, part))
    part, who, every = part[order], who[order], every[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ids_of = np.array(ids, np.int64)
    rows: dict[str, list] = {"part": [], "ids": [], "counts": [], "low": [], "high": []}
    for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
        there, count = np.unique(who[i:j], return_counts=True)
        rows["part"].append(int(part[i]))
        rows["ids"].append(ids_of[there].tobytes())
        rows["counts"].append(count.astype(np.uint32).tobytes())
        rows["low"].append((every[i:j] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
        rows["high"].append(((every[i:j] >> _U(32)) & _U(0xFFFF)).astype(np.uint16).tobytes())
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "part" else pa.binary()) for k, v in rows.items()})


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values (of one part) in order and their ids, each pair once."""
    join = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    who = np.repeat(join("ids", np.int64), join("counts", np.uint32))
    value = (join("high", np.uint16).astype(np.uint64) << _U(32)) | join("low", np.uint32)
    order = np.lexsort((who, value))
    value, who = value[order], who[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[fresh], who[fresh]


def _elements(n: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in portions(whole, "packed", 2 << 20)):
            yield _packed_rows(b["member"].to_pylist(), _packed_sets(b["packed"], n), parts)

    return run


def _shared_elements(t: pa.Table) -> pa.Table:
    """How many of a member's elements in this part other members have too."""
    value, who = _unpacked(t)
    same = value[1:] == value[:-1]
    shared = np.zeros(len(value), bool)
    shared[1:] |= same
    shared[:-1] |= same
    member, count = np.unique(who[shared], return_counts=True)
    return pa.table({"member": pa.array(member), "shared": pa.array(count.astype(np.int64))})


CHECKED = "hub long, member long, low long, high long, linked boolean"


def _joined(n: int, percent: int):
    """The tree join of a bucket's rows (hub, salt, member, packed); the hub's own row has member = hub."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hub", "ascending"), ("salt", "ascending"), ("member", "ascending")]).combine_chunks()
        hub, salt, member = (t[c].to_numpy() for c in ("hub", "salt", "member"))
        cuts = np.flatnonzero((np.diff(hub, prepend=hub[0] - 1) != 0) | (np.diff(salt, prepend=salt[0] - 1) != 0)) if len(hub) else []
        found: list[tuple[np.ndarray, ...]] = []
        for i, j in zip(cuts, [*cuts[1:], len(hub)], strict=True):
            sets = _packed_sets(t["packed"].slice(int(i), int(j - i)), n)
            own = [k for k in range(j - i) if member[i + k] == hub[i] and len(sets[k])]
            others = np.array([k for k in range(j - i) if member[i + k] != hub[i] and len(sets[k])], np.int64)
            if not len(others) or not own:
                continue
            size = np.array([len(sets[k]) for k in others], np.int64)
            most = (len(sets[own[0]]) + size) * (100 - percent) // (100 + percent)
            # beyond twice the distance of linked sets nothing links with a set that links with the hub
            near = Trie([sets[k] for k in others]).probe(sets[own[0]], 2 * int(most.max()))
            found.append((np.full(len(others), hub[i]), member[i + others], near.low, near.high, near.high <= most))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        return pa.table(dict(zip(("hub", "member", "low", "high", "linked"), map(pa.array, columns), strict=True)))

    return run


def checked(pairs: DataFrame, texts: DataFrame, n: int, percent: int, hub_share: int) -> DataFrame:
    """The pairs (hub, member) with the distance of their sets and whether they link, by tree join."""
    spark = texts.sparkSession
    share = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / hub_share).alias("shares"))
    salted = written(
        pairs.join(share, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("shares")).alias("salt"), "member"), "join-pairs"
    )
    buckets = max(parts_for(salted.count(), 2000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    need = salted.unionByName(salted.select("hub", "salt", F.col("hub").alias("member")).distinct())
    met = need.join(texts, "member").select("hub", "salt", "member", "packed")
    bucketed = met.withColumn("bucket", F.pmod(F.xxhash64("hub", "salt"), F.lit(buckets)))
    return applied(bucketed.repartition(buckets, "bucket").groupBy("bucket"), _joined(n, percent), CHECKED)


def similar(docs: DataFrame, n: int = 5, percent: int = 80, hub_share: int = 512, part_values: int = 2_000_000, tile: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    facts = written(mapped(docs, _described(n), "doc_id long, n_shingles long, key binary"), "join-facts")
    # one set for a doc_id, one representative for a class of equal sets
    of_doc = facts.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "key")).alias("t"))
    own = of_doc.select("doc_id", F.col("t.n_shingles").alias("n"), "t.key")
    # a table of its own, so that the join with it has exchanges on both sides and a hot class can be split
    first = written(own.groupBy("key").agg(F.min("doc_id").alias("rep")), "join-classes")
    named = written(own.join(first, "key").select("doc_id", "n", "key", "rep"), "join-names")

    elements = facts.agg(F.sum("n_shingles")).first()[0] or 0
    parts = parts_for(elements * (100 - percent) / (100 + percent) * 5, part_values, 48)
    signed = mapped(docs, _signed(n, percent, parts), SIGNED)
    met = applied(signed.repartition(parts, "part").groupBy("part"), _meeting, MET)
    # a set that represents no doc_id has no name here: what it said goes
    to_rep = first.select(_name_of(F.col("key")).alias("member"), "rep")
    groups = written(met.join(to_rep, "member").select("gid", F.col("rep").alias("member")).distinct(), "join-groups")

    classes = named.where("doc_id = rep").select(F.col("doc_id").alias("member"), "n", "key")
    several = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("gid")
    meeting = classes.join(groups.join(several, "gid").select("member").distinct(), "member", "left_semi")
    texts = written(
        mapped(docs.withColumnRenamed("doc_id", "member").join(meeting.select("member", "key"), "member"), _kept_texts(n), "member long, packed binary"),
        "join-texts",
    )
    stats = _weighed(texts, meeting.select("member", "n"), n, percent, part_values)
    members = written(groups.join(stats, "member"), "join-members")
    hubs = members.groupBy("gid").agg(F.min(F.struct("alone", "member")).alias("h"), F.count(F.lit(1)).alias("size"))
    # written, so that the join with them has exchanges on both sides and a large group can be split
    hubs = written(hubs.where("size > 1").select("gid", F.col("h.member").alias("hub")), "join-hubs")
    pairs = members.join(hubs, "gid").where("member <> hub").select("hub", "member").distinct()
    seen = written(checked(pairs, texts, n, percent, hub_share), "join-seen")
    links = seen.where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    labels = components(links)
    more = written(_missed(stats, seen, labels, texts, n, percent, tile), "join-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    of = named.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("label", "rep").alias("component"))
    return facts.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


def _weighed(texts: DataFrame, sizes: DataFrame, n: int, percent: int, part_values: int) -> DataFrame:
    """member, n, alone of the sets that can still link: enough of their elements occur in other sets that meet."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(total, part_values, 48)
    dealt = mapped(texts, _elements(n, parts), SIGNED).repartition(parts, "part").groupBy("part")
    shared = applied(dealt, _shared_elements, "member long, shared long").groupBy("member").agg(F.sum("shared").alias("shared"))
    least = _needed(F.col("n"), F.ceil(F.col("n") * percent / 100 - 1e-9), percent)
    met = sizes.join(shared, "member").where(F.col("shared") >= least)
    return written(met.select("member", "n", (F.col("n") - F.col("shared")).alias("alone")), "join-stats")


def _missed(stats: DataFrame, seen: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) between components of members that met one hub; one link a pair of components and tile."""
    spark = seen.sparkSession
    label = labels.select(F.col("node").alias("member"), "label")
    hub_label = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    at = (
        seen.join(stats, "member")
        .join(label, "member", "left")
        .join(hub_label, "hub", "left")
        .select("hub", "member", "n", "alone", "low", "high", F.coalesce("label", "member").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
        .withColumn("apart", F.col("label") != F.col("hub_label"))
        .withColumn("gain", 2 * F.col("alone") - F.col("high"))
    )
    at = written(at, "join-at")
    # What the bounds need of a hub's members: the least distance and gain of all and of those that missed it,
    # and the greatest distance that linked sets near it may have.
    missed = lambda c: F.min(F.when(F.col("apart"), F.col(c))).alias(f"missed_{c}")
    # edge and sized are written, so that joins with them have exchanges on both sides and a large hub can be split
    edge = (
        at.groupBy("hub")
        .agg(
            missed("low"),
            missed("gain"),
            F.min("low").alias("least_low"),
            F.min("gain").alias("least_gain"),
            F.floor(2 * F.max("n") * (100 - percent) / (100 + percent)).alias("most"),
        )
        .where("missed_low IS NOT NULL")
    )
    edge = written(edge, "join-edge")
    asks = F.expr("apart AND low + least_gain <= most AND least_low + gain <= most")
    holds = F.expr("missed_low + gain <= most AND low + missed_gain <= most")
    near = at.join(edge, "hub").select("hub", "member", "n", "label", asks.alias("asks"), holds.alias("holds")).where("asks OR holds")
    near = written(near, "join-held")
    sized = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"), F.max("asks").alias("asked")).where("asked").drop("asked")
    sized = written(sized, "join-sized")
    near = near.join(sized, "hub").withColumn("own", F.pmod(F.xxhash64("member"), F.col("tiles")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    columns = ["hub", "member", "n", "label"]
    no = F.lit(False)
    asked = near.where("asks").select(*columns, F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"), no.alias("holds"))
    held = near.where("holds").select(*columns, every.alias("i"), F.col("own").alias("j"), no.alias("asks"), F.lit(True).alias("holds"))
    rows = asked.unionByName(held).groupBy(*columns, "i", "j").agg(F.max("asks").alias("asks"), F.max("holds").alias("holds"))
    rows = written(rows, "join-near")
    hubs = rows.select("hub", F.col("hub").alias("member"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("label"), "i", "j").distinct()
    need = rows.unionByName(hubs.withColumn("asks", no).withColumn("holds", no))
    buckets = max(parts_for(rows.count(), 2000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = need.join(texts, "member").withColumn("bucket", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(buckets)))
    return applied(met.repartition(buckets, "bucket").groupBy("bucket"), _tiles(n, percent), "a long, b long")


def _tiles(shingle: int, percent: int):
    """For each tile (hub, i, j) the links of those that ask with those that are held, from the differences to the hub.

    x and y differ exactly where their differences to the hub do, so the
    differences of those that are held are stored in a trie and those of each
    that asks are carried down; subtrees of its own component are left.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("hub", "i", "j", "member")]).combine_chunks()
        key = np.stack([t[c].to_numpy() for c in ("hub", "i", "j")])
        hub, member, n, label, asks, holds = (t[c].to_numpy(zero_copy_only=False) for c in ("hub", "member", "n", "label", "asks", "holds"))
        cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(member) else []
        links: dict[tuple[int, int], tuple[int, int]] = {}
        for start, stop in zip(cuts, [*cuts[1:], len(member)], strict=True):
            centre = [k for k in range(start, stop) if member[k] == hub[k]]
            x = np.array([k for k in range(start, stop) if holds[k]], np.int64)
            if not centre or not len(x):
                continue
            sets = _packed_sets(t["packed"].slice(int(start), int(stop - start)), shingle)
            base = sets[centre[0] - start]
            differ = [np.setxor1d(base, s, assume_unique=True) for s in sets]
            del sets
            trie, greatest = Trie([differ[k - start] for k in x], label[x]), int(n[x].max())
            for y in (k for k in range(start, stop) if asks[k]):
                reach = (greatest + int(n[y])) * (100 - percent) // (100 + percent)
                far = trie.probe(differ[y - start], reach, int(label[y])).high
                for k in x[(far <= (n[x] + n[y]) * (100 - percent) // (100 + percent)) & (label[x] != label[y])]:
                    pair = (int(label[y]), int(label[k]))
                    links.setdefault((min(pair), max(pair)), (int(member[y]), int(member[k])))
        return pa.table({"a": pa.array([v[0] for v in links.values()], pa.int64()), "b": pa.array([v[1] for v in links.values()], pa.int64())})

    return run
