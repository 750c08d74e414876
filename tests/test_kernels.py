"""Kernels and imperative operators: properties, models, planted damage."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import addresses, chunker, codecs
from siltstone.operators import delta, integrity, namespace, reach, replicas, store, stripes
from siltstone.sources import records, slots, tables, versions


@given(st.binary(max_size=20_000), st.sampled_from([(256, 64, 1024), (1024, 256, 4096)]))
@settings(max_examples=60, deadline=None)
def test_chunks_are_bounded_and_rebuild_the_blob(data, sizes):
    average, least, most = sizes
    stops = chunker.cuts(data, average, least, most)
    starts = [0, *stops[:-1]] if stops else []
    lengths = [b - a for a, b in zip(starts, stops, strict=True)]
    assert b"".join(data[a:b] for a, b in zip(starts, stops, strict=True)) == data
    assert all(n <= most for n in lengths) and all(n >= least for n in lengths[:-1])


def test_an_insertion_moves_few_cuts():
    data = random.Random(1).randbytes(200_000)

    def digests(d):
        stops = chunker.cuts(d, 1024, 256, 4096)
        return {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *stops[:-1]], stops, strict=True)}

    before, after = digests(data), digests(data[:50_000] + b"!" + data[50_000:])
    assert len(after - before) <= 5


@given(st.binary(max_size=60_000))
@settings(max_examples=40, deadline=None)
def test_compression_comes_back(data):
    codec, stored = codecs.compress(data)
    assert codecs.decompress(codec, len(data), stored) == data


def test_compression_decides():
    assert codecs.compress(b"the same sentence again and again. " * 400)[0] == "zstd"
    assert codecs.compress(random.Random(2).randbytes(60_000))[0] == "none" and codecs.compress(b"")[0] == "none"
    with pytest.raises(ValueError):
        codecs.decompress("none", codecs.MOST_BYTES + 1, b"")


@pytest.mark.parametrize("k,m", [(1, 1), (2, 1), (4, 2), (5, 3)])
def test_any_k_shards_rebuild(k, m):
    draw = random.Random(k)
    for n in (0, 1, 4095, 30_000):
        body = draw.randbytes(n)
        shards = dict(enumerate(codecs.rs_encode(body, k, m)))
        for lost in (range(m), range(k, k + m), draw.sample(range(k + m), m)):
            assert codecs.rs_decode({i: s for i, s in shards.items() if i not in set(lost)}, k, m, n) == body
    with pytest.raises(ValueError):
        codecs.rs_decode({}, k, m, 0)


def test_padded_lengths(spark):
    sizes = [0, 1, 7, 9, 1000, 65536, 65537]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(addresses.padded_len(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in rows] == [0, 1, 7, 10, 1024, 65536, 67584]


def test_scans_get_past_damage():
    parts = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    body = b"SLTSEG".ljust(records.PAGE, b"\0") + b"".join(records.encode_record(h, "RawChunk", "none", bytes([i]), 1) for i, h in enumerate(parts)) + records.FOOTER
    assert [k for k, *_ in records.scan(body)] == ["record"] * 5 + ["footer"]
    spoilt = bytearray(body)
    second = list(records.scan(body))[1]
    spoilt[second[1] + 10 : second[1] + 20] = b"\xff" * 10
    seen = list(records.scan(bytes(spoilt)))
    assert [k for k, *_ in seen] == ["record", "damaged", "record", "record", "record", "footer"] and seen[1][1:3] == second[1:3]
    assert [k for k, *_ in records.scan(body[: -len(records.FOOTER)])][-1] == "eof"


def test_stripes_survive_and_report(spark):
    bodies = spark.createDataFrame([(i, random.Random(i).randbytes(9000 * i + 1)) for i in range(4)], "segment_id long, body binary")
    shards = stripes.encoded(bodies, 3, 2)
    assert all(r["ok"] and r["good"] == 3 for r in stripes.reconstructed(shards.where("shard_index > 1"), 3, 2).collect())
    assert not any(r["ok"] for r in stripes.reconstructed(shards.where("shard_index > 2"), 3, 2).collect())


def test_convergence_keeps_the_named_place(spark):
    places = spark.createDataFrame([(0, "a", 1, 5), (0, "a", 0, 9), (0, "a", 2, 0), (0, "b", 1, 1), (1, "a", 7, 7)], "vdev_id int, content_hash string, segment_id long, offset long")
    named = places.where("segment_id = 2")
    losers = lambda current: sorted((r["canonical"]["segment_id"], r["loser"]["segment_id"]) for r in store.convergence(places, current).collect())
    assert losers(None) == [(0, 1), (0, 2)] and losers(named) == [(2, 0), (2, 1)]


def test_marks_fail_closed(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "ino long, content_hash string")
    roots = spark.createDataFrame([(1,)], "ino long")
    whole = spark.createDataFrame([("a",), ("b",)], "content_hash string")
    assert {r[0] for r in reach.marked(roots, refs, whole).collect()} == {"a", "b"}
    assert reach.marked(roots, refs, whole.where("content_hash = 'a'")).collect() == []


def test_healing_needs_a_good_copy(spark):
    copies = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False), ("b", 1, False)], "content_hash string, vdev_id int, good boolean")
    assert sorted(map(tuple, replicas.heal_sources(copies).select("content_hash", "vdev_id", "source").collect()), key=repr) == [("a", 0, 1), ("b", 0, None), ("b", 1, None)]


def test_replay_above_the_watermark_is_idempotent(spark):
    log = spark.createDataFrame([(0, 1, "x", 1), (0, 1, "y", 2), (0, 2, "z", 3), (1, 1, "w", 1)], "shard_id int, ino long, new_object_hash string, epoch long")
    marks = spark.createDataFrame([(0, 1), (1, 1)], "shard_id int, watermark long")
    once = delta.replayed(log, marks)
    assert sorted(map(tuple, once.collect())) == [(0, 1, "y", 2), (0, 2, "z", 3)]
    assert sorted(map(tuple, delta.replayed(log.unionByName(log), marks).collect())) == sorted(map(tuple, once.collect()))


def test_versions_and_snapshots(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.generation() == 0
    assert t.publish(spark.range(3).toDF("x")) == 1
    t.snapshot("first")
    assert t.publish(spark.range(5).toDF("x"), expected=1) == 2
    with pytest.raises(versions.StaleError):
        t.publish(spark.range(1).toDF("x"), expected=1)
    assert t.read().count() == 5 and t.read(1).count() == 3 and t.read_snapshot("first").count() == 3
    with pytest.raises(ValueError):
        t.snapshot("first")
    with pytest.raises(ValueError):
        t.snapshot(versions.RESERVED + "x")
    t.drop_snapshot("first")
    assert t.snapshots().collect() == []
    with pytest.raises(KeyError):
        t.read_snapshot("first")


PATHS = ["/n0", "/n1", "/n0/m0", "/n0/m1", "/n1/m0", "/n0/m0/k0"]


class Model:
    """An independent model: paths to kind and content, hard links by shared lists."""

    def __init__(self):
        self.at = {}

    def parent(self, p):
        up = p.rpartition("/")[0]
        return up == "" or (up in self.at and self.at[up] == "dir")

    def apply(self, op, path, target, offset, data):
        there = self.at.get(path)
        if op == "write":
            if there is None and self.parent(path):
                there = self.at[path] = [b""]
            if isinstance(there, list):
                there[0] = there[0].ljust(offset, b"\0")[:offset] + data + there[0][offset + len(data) :] if len(there[0]) > offset or data else there[0].ljust(offset, b"\0")
        elif op == "mkdir" and there is None and self.parent(path):
            self.at[path] = "dir"
        elif op == "rmdir" and there == "dir" and not any(p.startswith(path + "/") for p in self.at):
            del self.at[path]
        elif op == "unlink" and isinstance(there, list):
            del self.at[path]
        elif op == "link" and isinstance(there, list) and target not in self.at and self.parent(target):
            self.at[target] = there
        elif op == "rename" and there is not None and self.parent(target) and path != target and not target.startswith(path + "/"):
            old = self.at.get(target)
            if isinstance(old, list) and old is there:  # two names of one file
                return
            if old is not None and ((old == "dir") != (there == "dir") or any(p.startswith(target + "/") for p in self.at)):
                return
            moved = {p: v for p, v in self.at.items() if p == path or p.startswith(path + "/")}
            for p in moved:
                del self.at[p]
            self.at.pop(target, None)
            self.at |= {target + p[len(path) :]: v for p, v in moved.items()}


operations = st.tuples(st.sampled_from(["write", "mkdir", "rmdir", "unlink", "link", "rename"]), st.sampled_from(PATHS), st.sampled_from(PATHS), st.integers(0, 40), st.binary(max_size=20))


@given(st.lists(operations, max_size=29))
@settings(max_examples=300, deadline=None)
def test_namespace_equals_the_model(ops):
    tree, model = namespace.Tree(), Model()
    for op, path, target, offset, data in ops:
        try:
            tree.apply({"op": op, "path": path, "target": target, "offset": offset, "data": data})
        except namespace.Refused:
            pass
        model.apply(op, path, target, offset, data)
    got = {r[1]: "dir" if r[2] == "dir" else r[5] for r in tree.rows(0)}
    assert got == {p: v if v == "dir" else hashlib.sha256(v[0]).hexdigest() for p, v in model.at.items()}


def test_a_directory_replaces_an_empty_one_only():
    tree = namespace.Tree()
    for path in ("/n0", "/n0/m0", "/n1", "/n2", "/n2/m1"):
        tree.mkdir(path)
    tree.rename("/n0", "/n1")
    assert sorted(r[1] for r in tree.rows(0)) == ["/n1", "/n1/m0", "/n2", "/n2/m1"]
    for source, target in (("/n1", "/n2"), ("/n1", "/n1/m0/n")):
        with pytest.raises(namespace.Refused):
            tree.rename(source, target)


def test_closure_and_paths_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(70)], "node long, parent long, name string")
    assert {tuple(r) for r in reach.ancestors(edges).collect()} == {(i, j) for i in range(70) for j in range(i)}
    paths = {r["node"]: (r["path"].count("/"), r["depth"]) for r in reach.tree_paths(edges.where("node < 6"), "/").collect()}
    assert paths == {i: (i + 1, i) for i in range(6)}
    looped = edges.where("node < 3").unionByName(spark.createDataFrame([(1, 2, "again")], "node long, parent long, name string"))
    with pytest.raises(ValueError):
        reach.tree_paths(looped, "/")


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(1).toDF("x"))
    monkeypatch.setattr(versions.VersionedTable, "generation", lambda self: 0)  # read before the other published
    assert not t._claim(1, "other")
    monkeypatch.undo()
    assert t.publish(spark.range(2).toDF("x")) == 2 and t.read(1).count() == 1 and t.read().count() == 2


def test_one_writer_holds_a_table(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    ours, theirs = versions.VersionedTable(spark, folder), versions.VersionedTable(spark, folder)
    with ours.lock():
        with pytest.raises(versions.LockedError), theirs.lock():
            pass
        assert ours.holder() is not None and ours.publish(spark.range(2).toDF("x")) == 1
    assert theirs.holder() is None
    with theirs.lock():
        theirs.break_lock()
        with ours.lock():
            held = ours.holder()
            assert held is not None
    with pytest.raises(ZeroDivisionError), ours.lock():
        1 / 0
    assert ours.holder() is None and ours.read().count() == 2


def test_marks_go_to_the_next_checkpoint_that_publishes(spark):
    marks = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (3, 9), (4, 5), (None, 6)], "generation long, ino long")
    attempts = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "generation long, published boolean")
    found = sorted(map(tuple, delta.drained(marks, attempts).collect()), key=repr)
    assert found == sorted([(1, 7), (3, 7), (3, 8), (3, 9), (None, 5), (None, 6)], key=repr)


def test_unreadable_segments_count_as_old(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, None), ("a", 3, 1), ("a", 3, 2)], "stream string, segment_id long, epoch int")
    assert list(map(tuple, delta.census(rows, 2).collect())) == [("a", 3, 2)]


def test_sums_before_equal_one_window(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(3), i, draw.randrange(100)) for i in range(500)]
    frame = spark.createDataFrame(rows, "shard int, seq long, n long").withColumn("range", F.floor(F.col("seq") / 37))
    got = {(r["shard"], r["seq"]): r["at"] for r in tables.sums_before(frame, "shard", "range", ["seq"], "n", "at").collect()}
    assert got == {(s, i): sum(n for t, j, n in rows if t == s and j < i) for s, i, _ in rows}


steps = st.tuples(st.sampled_from(["write", "zero", "resize", "grow"]), st.integers(0, 40), st.integers(0, 40), st.binary(min_size=1, max_size=1))


@settings(max_examples=200, deadline=None)
@given(st.lists(steps, max_size=20))
def test_sparse_content_equals_plain_bytes(ops):
    class Small(namespace.Content):
        PAGE = 8

    content, plain = Small(), bytearray()
    for op, a, n, byte in ops:
        if op == "write":
            plain.extend(bytes(max(a + n - len(plain), 0)))
            plain[a : a + n] = byte * n
            content.write(a, byte * n)
        elif op == "zero":
            stop = min(a + n, len(plain))
            plain[a:stop] = bytes(max(stop - a, 0)) if a < stop else plain[a:stop]
            content.zero(a, a + n)
        elif op == "resize":
            plain = plain[:a] + bytes(max(a - len(plain), 0))
            content.resize(a)
        else:
            plain.extend(bytes(max(a - len(plain), 0)))
            content.grow(a)
        assert b"".join(content.parts(5)) == plain
    assert content.sha256() == hashlib.sha256(plain).hexdigest()


def test_a_hole_takes_no_memory():
    tree = namespace.Tree()
    tree.write("/a", namespace.MOST_BYTES - 1, b"x")
    tree.truncate("/a", namespace.MOST_BYTES)
    content = tree.file("/a")["data"]
    assert content.size == namespace.MOST_BYTES and len(content.pages) == 1
    with pytest.raises(namespace.Refused):
        tree.truncate("/a", namespace.MOST_BYTES + 1)
    with pytest.raises(namespace.Refused):
        tree.write("/a", namespace.MOST_BYTES, b"x")


def test_fallocate_modes():
    tree = namespace.Tree()
    tree.write("/a", 0, b"x" * 10)
    tree.fallocate("/a", 2, 3, "punch", True)
    tree.fallocate("/a", 8, 6, "zero", True)
    assert b"".join(tree.file("/a")["data"].parts()) == b"xx\0\0\0xxx\0\0"
    tree.fallocate("/a", 0, 12, "allocate", False)
    assert tree.file("/a")["data"].size == 12
    for bad in ((0, 0), (namespace.MOST_BYTES, 1)):
        with pytest.raises(namespace.Refused):
            tree.fallocate("/a", *bad, "zero", False)


def test_routing_is_the_finaliser(spark):
    def plain(x):
        z = (x + addresses.SPLITMIX[0]) % 2**64
        z = (z ^ (z >> 30)) * addresses.SPLITMIX[1] % 2**64
        z = (z ^ (z >> 27)) * addresses.SPLITMIX[2] % 2**64
        return (z ^ (z >> 31)) % 7

    rows = spark.range(50).select("id", addresses.shard_for_inode(F.col("id"), 7).alias("s")).collect()
    assert all(r["s"] == plain(r["id"]) for r in rows)


def test_gear_sums_see_64_bytes():
    data = np.frombuffer(random.Random(5).randbytes(300), np.uint8)
    whole, part = chunker.gear_sums(data), chunker.gear_sums(data[100:])
    assert (whole[163:] == part[63:]).all()


def test_fixed_blocks_of_empty_files(spark):
    blob = spark.createDataFrame([(1, b""), (2, b"abc")], "ino long, bytes binary")
    assert [tuple(r) for r in tables.fixed_blocks(blob, 2).select("ino", "ordinal", "payload").collect()] == [(2, 0, b"ab"), (2, 1, b"c")]


def test_collecting_garbage_twice_is_once(spark, monkeypatch):
    from siltstone.plans import maintenance

    rows = [(f"{s}{i}", s, 100, s * 1000 + i // 4, i % 4 * 100) for s in range(2) for i in range(16)]
    records = spark.createDataFrame(rows, "content_hash string, shard int, record_len long, segment_id long, offset long")
    live = records.where("content_hash LIKE '%1' OR content_hash LIKE '%5'").select("content_hash")
    pinned = records.where("content_hash = '02'").select("content_hash")
    once = maintenance.collect_garbage(records, live, pinned, 0.9, 1, 400).cache()
    kept = {r["content_hash"] for r in once.collect()}
    assert {"02", "01", "05", "012"} <= kept and "00" not in kept and len(kept) < len(rows)
    assert {r[0] for r in live.collect()} <= kept
    places = once.groupBy("segment_id", "offset").count().where("count > 1")
    assert places.isEmpty()
    # one segment a range gives the same places
    monkeypatch.setattr(maintenance, "RANGE_BITS", 0)
    again = maintenance.collect_garbage(records, live, pinned, 0.9, 1, 400)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_xattr_flags_and_limits(spark):
    from siltstone.operators import attributes

    current = spark.createDataFrame([(1, {"a": "1"}), (2, None)], "ino long, xattrs map<string,string>")
    sets = spark.createDataFrame(
        [(1, "a", "2", "create"), (1, "b", "3", None), (2, "c", "4", "replace"), (2, "d" * 256, "5", None)], "ino long, name string, value string, flag string"
    )
    assert sorted(r["outcome"] for r in attributes.set_outcomes(current, sets).collect()) == ["exists", "missing", "ok", "too long"]
    assert {r["ino"]: r["xattrs"] for r in attributes.applied(current, sets).collect()} == {1: {"a": "1", "b": "3"}, 2: None}


# integrity rules


def test_stripes_that_contradict_each_other_are_found(spark):
    draw = random.Random(5)
    bodies = spark.createDataFrame([(i, draw.randbytes(9000 + i)) for i in range(5)], "segment_id long, body binary")
    rows = [r.asDict() for r in stripes.encoded(bodies, 3, 2).collect()]
    for r in rows:
        at = (r["segment_id"], r["shard_index"])
        if at in ((1, 4), (4, 0)):  # other bytes under a hash of their own
            r["bytes"] = bytes([r["bytes"][0] ^ 1]) + bytes(r["bytes"][1:])
            r["shard_hash"] = hashlib.sha256(r["bytes"]).hexdigest()
        if at == (2, 3):
            r["logical_len"] += 1
        if at == (3, 1):  # damaged: another rule's
            r["bytes"] = b"x"
    frame = spark.createDataFrame([tuple(r[c] for c in ("segment_id", "shard_index", "logical_len", "body_hash", "shard_hash", "bytes")) for r in rows], stripes.SHARDS)
    found = sorted((r["key"], r["detail"]) for r in stripes.inconsistent(frame, 3, 2).collect())
    assert found == [
        ("1", "parity shard 4 does not match the data shards"),
        ("2", "shard 3 disagrees with its siblings"),
        ("4", "body does not have its hash"),
        ("4", "parity shard 3 does not match the data shards"),
        ("4", "parity shard 4 does not match the data shards"),
    ]


def test_a_foreign_device_is_one_finding(spark):
    rows = [(1, 0, "a", 0, 2, 5, "x"), (1, 1, "b", 1, 2, 5, "x"), (1, 2, "c", 1, 3, 9, "y"), (2, 0, "d", 0, 1, 1, "y")]
    members = spark.createDataFrame(rows, "pool long, position int, path string, vdev_id int, vdev_count int, generation long, pool_uuid string")
    found = {r["path"]: r["finding"] for r in slots.membership(members, slots.foreign()).collect()}
    assert found == {"a": None, "b": None, "c": "foreign", "d": None}


def test_format_versions_out_of_range(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5), ("d", 6)], "slot string, format_version int")
    found = integrity.versions(rows, "slot", "format_version", 4, 5).collect()
    assert sorted(map(tuple, found)) == [("LegacyFormatVersion", "a", "3"), ("UnsupportedFormatVersion", "d", "6")]


def test_every_device_or_a_refusal(spark):
    hashes = spark.createDataFrame([("a",), ("b",)], "content_hash string")
    devices = spark.createDataFrame([(0,), (0,), (None,), (5,)], "vdev_id int")
    assert sorted(map(tuple, replicas.on_every_device(hashes, devices).collect())) == [("a", 0), ("a", 5), ("b", 0), ("b", 5)]
    assert replicas.on_every_device(hashes, devices.limit(0)).count() == 0
    most = replicas.MOST_DEVICES
    full = spark.range(most).select(F.col("id").cast("int").alias("vdev_id"))
    assert replicas.on_every_device(hashes, full).count() == 2 * most
    more = spark.range(most + 1).select(F.col("id").cast("int").alias("vdev_id"))
    with pytest.raises(Exception, match=f"more than {most} devices"):
        replicas.on_every_device(hashes, more).collect()


def test_stripes_are_copied_forward_or_stay(spark):
    from siltstone.plans import maintenance

    texts = {s: [f"{s}-{i}".encode() * 50 for i in range(6)] for s in range(7)}
    address = lambda b: hashlib.sha256(b).hexdigest()
    chunks = [(s, i, address(p) if (s, i) != (5, 2) else address(b"another"), p) for s, own in texts.items() for i, p in enumerate(own)]
    segments = records.write_segments(spark.createDataFrame(chunks, "segment_id long, seq long, content_hash string, payload binary"))
    raw = {r["segment_id"]: bytes(r["raw"]) for r in segments.collect()}
    held = records.scan_segments(segments).where("kind = 'record'").collect()
    index = [(r["content_hash"], -1, r["segment_id"], r["start"], r["stop"] - r["start"]) for r in held]
    # 0 stays, 1 goes, 2 keeps two records (one of them isn't in the index), 3 and 5 to be turned back, 4 has lost two shards, 6 has nothing live
    told = [(0, "keep"), (1, "drop"), (2, "repack"), (3, "unstripe"), (4, "repack"), (5, "unstripe"), (6, "repack")]
    lost = {(2, 0), (3, 1), (4, 0), (4, 2)}
    bodies = spark.createDataFrame(list(raw.items()), "segment_id long, body binary")
    shards = stripes.encoded(bodies, 2, 1).where(~F.concat_ws("-", "segment_id", "shard_index").isin([f"{a}-{b}" for a, b in lost]))
    live = [(address(texts[s][i]),) for s in (0, 2, 4) for i in (1, 4)]
    unknown = address(texts[2][4])
    columns = "content_hash string, vdev_id int, segment_id long, offset long, len long"
    known = spark.createDataFrame([r for r in index if r[0] != unknown], columns)
    after = maintenance.unstripe(
        shards, known, spark.createDataFrame(told, "segment_id long, action string"), spark.createDataFrame(live * 2, "content_hash string"), F.array(F.lit(0), F.lit(3)), 2, 1, F.col("segment_id") + 100
    )
    size = {r[0]: r[4] for r in index}
    want = [r for r in index if r[2] in (0, 4, 5)]  # a record of 5 isn't what its hash says, so the stripe stays
    for vdev in (0, 3):
        want += [(h, vdev, s + 100, at, n) for h, _, s, at, n in index if s == 3]
        first, second = address(texts[2][1]), unknown
        want += [(first, vdev, 102, records.PAGE, size[first]), (second, vdev, 102, records.PAGE + size[first], size[second])]
    assert sorted(map(tuple, after.collect())) == sorted(want)
