"""Tables: batches, versions, compaction, conflicts; a random walk against a dict."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lamina.plans import compaction
from lamina.plans.log import Action, CommitLog, Snapshot, fold
from lamina.plans.table import KVTable, Options
from lamina.schema import ADDED, ConflictError, CorruptError, HousekeepingError, InvalidMutationError, InvalidRangeError


def batch(spark, rows):
    return spark.createDataFrame([(k.encode(), None if v is None else v.encode()) for k, v in rows], "key binary, value binary")


def keys(spark, names):
    return spark.createDataFrame([(k.encode(),) for k in names], "key binary")


def state(df):
    return {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KVTable(spark, str(tmp_path / "t"), Options(auto_compact=False))


def test_put_get_delete_scan(spark, table):
    assert table.scan().count() == 0
    table.put(batch(spark, [("a", "1"), ("b", "1"), ("c", None)]))
    table.put(batch(spark, [("b", "2")]))
    table.delete(keys(spark, ["a", "nothing"]))
    assert state(table.scan()) == {"b": "2", "c": ""}
    assert state(table.get(b"b")) == {"b": "2"}
    assert table.get(b"a").count() == 0
    assert state(table.scan(version=1)) == {"a": "1", "b": "1", "c": ""}
    assert [bytes(r["key"]) for r in table.iterate()] == [b"b", b"c"]
    with pytest.raises(InvalidRangeError):
        table.scan(b"z", b"a")
    assert table.scan(b"b", b"b").count() == 0
    assert {bytes(r["key"]): r["state"] for r in table.multi_get(keys(spark, ["a", "b", "zz"])).collect()} == {b"a": "deleted", b"b": "found", b"zz": "absent"}


def test_batches_that_are_refused(spark, table):
    with pytest.raises(InvalidMutationError):
        table.put(batch(spark, [("a", "1"), ("a", "2")]))
    with pytest.raises(InvalidMutationError):
        table.put(spark.createDataFrame([(None, b"x")], "key binary, value binary"))
    assert table.scan().count() == 0
    table.put(spark.createDataFrame([(b"a", b"1", 0), (b"a", b"2", 1)], "key binary, value binary, ordinal long"))
    assert state(table.scan()) == {"a": "2"}


def test_generations_through_compaction(spark, tmp_path):
    table = KVTable(spark, str(tmp_path / "g"), Options(auto_compact=False))
    name = lambda i: f"key-{i:06d}"
    n = 600
    table.put(batch(spark, [(name(i), "gen1") for i in range(n)]))
    table.put(batch(spark, [(name(i), "gen2") for i in range(0, n, 2)]))
    table.compact(force=True)
    table.delete(keys(spark, [name(i) for i in range(0, n, 4)]))
    table.put(batch(spark, [(name(i), "gen4") for i in range(0, n, 8)]))
    expected = {name(i): "gen4" if i % 8 == 0 else "gen2" if i % 2 == 0 else "gen1" for i in range(n) if i % 8 == 0 or i % 4}
    assert len(expected) == 525
    before = table.log.snapshot().version
    assert state(table.scan()) == expected
    table.compact(force=True)
    assert state(table.scan()) == expected
    stats = table.stats().first()
    assert stats["l0_count"] == 0 and stats["l1_disjoint"]
    assert table.mutations().filter("op = 2").count() == 0
    assert state(table.scan(version=before)) == expected
    table.vacuum(keep_versions=0)
    assert state(table.scan()) == expected


def test_disjoint_files_stay(spark, tmp_path):
    table = KVTable(spark, str(tmp_path / "d"), Options(auto_compact=False))
    table.put(batch(spark, [(f"aaa-{i:06d}", "1") for i in range(200)]))
    table.compact(force=True)
    old = {f.file for f in table.log.snapshot().level(1)}
    table.put(batch(spark, [(f"zzz-{i:06d}", "1") for i in range(200)]))
    table.compact(force=True)
    assert old < {f.file for f in table.log.snapshot().level(1)}
    assert table.scan().count() == 400


def test_everything_deleted_leaves_no_file(spark, table):
    table.put(batch(spark, [("a", "1")]))
    table.delete(keys(spark, ["a"]))
    table.compact(force=True)
    assert table.log.snapshot().files == {} and table.scan().count() == 0


def test_a_lost_race_is_written_again(spark, table, monkeypatch):
    other = KVTable(spark, table.root, Options(auto_compact=False))
    commit, raced = table.log.commit, []

    def late(version, actions, streams=None):
        if not raced:
            raced.append(version)
            other.put(batch(spark, [("a", "other")]))
        commit(version, actions, streams)

    monkeypatch.setattr(table.log, "commit", late)
    assert table.put(batch(spark, [("a", "mine")])) == 2
    assert state(table.scan()) == {"a": "mine"}


@pytest.mark.parametrize("step", ["_write", "_stats", "commit"])
def test_a_failed_compaction_changes_nothing(spark, table, monkeypatch, step):
    for i in range(3):
        table.put(batch(spark, [("a", str(i)), (f"k{i}", "x")]))
    table.delete(keys(spark, ["k0"]))
    before = state(table.scan())
    table.options.l0_threshold, table.options.auto_compact = 1, True
    with monkeypatch.context() as m:
        real_write = table._write
        if step == "commit":
            real = table.log.commit
            m.setattr(table.log, "commit", lambda v, a, s=None: real(v, a, s) if all(x.action == ADDED and x.level == 0 for x in a) else (_ for _ in ()).throw(OSError("disk")))
        elif step == "_write":
            m.setattr(table, "_write", lambda rows, folder, size: real_write(rows, folder, size) if size == table.options.flush_bytes else (_ for _ in ()).throw(OSError("disk")))
        else:
            real = table._stats
            m.setattr(table, "_stats", lambda folder, level: real(folder, level) if level == 0 else (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(HousekeepingError) as caught:
            table.put(batch(spark, [("b", "1")]))
        assert isinstance(caught.value.__cause__, OSError)
    assert state(KVTable(spark, table.root).scan()) == before | {"b": "1"}
    table.vacuum()
    table.compact(force=True)
    assert state(table.scan()) == before | {"b": "1"}


def test_log_errors(spark, tmp_path):
    own = CommitLog(spark, str(tmp_path / "l"))
    own.commit(1, [Action(ADDED, "a")])
    with pytest.raises(ConflictError):
        own.commit(1, [])
    own.commit(3, [])
    with pytest.raises(CorruptError):
        own.snapshot()


def test_snapshots_of_the_log_agree_with_the_fold(spark, tmp_path):
    own = CommitLog(spark, str(tmp_path / "s"))
    for v in range(1, 71):
        own.commit(v, [Action(ADDED, f"f{v}"), *([Action(2, f"f{v - 2}")] if v > 2 else [])])
    assert set(own.snapshot().files) == {"f69", "f70"} and set(own.snapshot(40).files) == {"f39", "f40"}
    assert own.prune(20) == 0 and len(own.versions()) == 70
    assert own.prune(69) == 64 and own.versions() == [*range(64, 71)]
    assert set(own.snapshot().files) == {"f69", "f70"} and set(own.snapshot(64).files) == {"f63", "f64"}
    with pytest.raises(ValueError):
        own.snapshot(63)
    own.commit(71, [Action(ADDED, "f71")])
    assert own.prune(71) == 64 and own.snapshot().version == 71
    (tmp_path / "s/_log" / f"{64:020d}.snapshot").unlink()
    with pytest.raises(CorruptError):
        own.snapshot()


def test_commits_by_rename(spark, tmp_path):
    own = CommitLog(spark, str(tmp_path / "r"))
    own._local = False
    own.commit(1, [Action(ADDED, "a")])
    with pytest.raises(ConflictError):
        own.commit(1, [Action(ADDED, "b")])
    assert set(own.snapshot().files) == {"a"} and [x for x in os.listdir(tmp_path / "r/_log") if x.endswith(".tmp")] == []
    with pytest.raises(ValueError):
        CommitLog._scheme("s3a")


def test_files_have_rows_and_keys_as_their_footers_say(spark, tmp_path):
    table = KVTable(spark, str(tmp_path / "f"), Options(auto_compact=False, file_rows=7))
    rows = [(b"\xff" + b"k" * 9000, b"long"), (b"", b"empty"), (b"\x80", b"h"), *((b"k%03d" % i, b"v") for i in range(40))]
    table.put(spark.createDataFrame(rows, "key binary, value binary"))
    listed = table.files().collect()
    assert sum(x["entries"] for x in listed) == len(rows) and max(x["entries"] for x in listed) <= 7
    for x in listed:
        own = [bytes(r["key"]) for r in spark.read.parquet(f"{table.root}/{x['file']}").collect()]
        assert (bytes(x["min_key"]), bytes(x["max_key"]), x["entries"]) == (min(own), max(own), len(own))


def test_plans():
    file = lambda name, level, low, high, size=10: Action(ADDED, f"{name}/x", level, low, high, 1, size)
    snap = Snapshot(1, fold([file("n1", 0, "01", "05"), file("n2", 0, "04", "06"), file("o1", 1, "00", "02"), file("o2", 1, "03", "09"), file("o3", 1, "10", "20")]))
    assert compaction.level_0(snap, 2) is None
    chosen = compaction.level_0(snap, 1)
    assert {f.file for f in chosen.inputs} == {"n1/x", "n2/x", "o1/x", "o2/x"} and chosen.drop_tombstones
    assert not compaction.spent([file("n2", 0, "04", "06")], snap)
    assert compaction.level_1(snap, 20, 15) is not None or compaction.level_1(snap, 20, 100) is not None
    assert compaction.level_1(snap, 30, 100) is None


def test_random_walk(spark, tmp_path):
    r = random.Random(7)
    table, model = KVTable(spark, str(tmp_path / "w"), Options(l0_threshold=2)), {}
    for _ in range(10):
        names = r.sample([f"k{i:02d}" for i in range(30)], 8)
        if r.random() < 0.35:
            table.delete(keys(spark, names))
            for k in names:
                model.pop(k, None)
        else:
            value = str(r.random())
            table.put(batch(spark, [(k, value) for k in names]))
            model |= dict.fromkeys(names, value)
        low, high = sorted(r.sample([f"k{i:02d}" for i in range(31)], 2))
        got = [(bytes(x["key"]).decode(), bytes(x["value"]).decode()) for x in table.scan(low.encode(), high.encode()).collect()]
        assert got == sorted((k, v) for k, v in model.items() if low <= k < high)


def test_stream_batches_are_written_once(spark, tmp_path):
    from lamina.streaming.sink import write_stream

    table = KVTable(spark, str(tmp_path / "t"), Options(auto_compact=False))
    source = str(tmp_path / "in")
    rows = spark.range(20).select(F.format_string("k%d", F.col("id") % 5).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.lit(1).cast("byte").alias("op"), F.col("id").alias("ordinal"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    write_stream(stream, table, "s", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert state(table.scan()) == {f"k{i}": str(15 + i) for i in range(5)}
    version = table.log.snapshot().version
    assert table.apply(rows.limit(1), stream=("s", 0)) == version
