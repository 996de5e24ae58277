"""Resolution, reads and files on small hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import files, newest, read
from lamina.schema import InvalidRangeError


def log(spark, rows):
    """Rows (key, value) in order; a value None deletes."""
    data = [(k.encode(), None if v is None else v.encode(), 2 if v is None else 1, i) for i, (k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "key binary, value binary, op int, seq long")


def state(df):
    return {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in df.collect()}


def test_delete_then_put_revives_and_missing_delete_is_fine(spark):
    df = log(spark, [("a", "1"), ("a", None), ("a", "2"), ("ghost", None)])
    assert state(newest.visible(df)) == {"a": "2"}
    assert {bytes(r["key"]) for r in newest.newest_wins(df).collect()} == {b"a", b"ghost"}


def test_tombstones_go_after_resolution(spark):
    df = log(spark, [("a", "1"), ("a", None)])
    assert state(newest.visible(df)) == {}
    assert state(newest.visible(newest.live(df))) == {"a": "1"}  # the wrong order brings it back


def test_both_forms_agree(spark):
    df = log(spark, [(f"k{i % 7}", None if i % 5 == 0 else str(i)) for i in range(60)])
    rows = lambda x: sorted((bytes(r["key"]), r["seq"], r["op"]) for r in x.collect())
    assert rows(newest.newest_wins(df)) == rows(newest.newest_wins_wide(df))


@pytest.mark.parametrize("seed", range(3))
def test_merge_of_random_sources_against_a_dict(spark, seed):
    r = random.Random(seed)
    tables = [{f"k{r.randrange(25)}": r.choice([None, f"v{r.random()}"]) for _ in range(r.randint(0, 20))} for _ in range(r.randint(1, 5))]
    model = {}
    for t in tables:
        model |= t
    sources = [log(spark, [*t.items()]).drop("seq") for t in reversed(tables)]
    assert state(newest.merge(sources, drop_tombstones=True)) == {k: v for k, v in model.items() if v is not None}
    assert {bytes(x["key"]).decode(): x["value"] and bytes(x["value"]).decode() for x in newest.merge(sources).collect()} == model


def test_equal_orders_go_to_the_larger_row(spark):
    rows = [(b"a", b"1", 1, 5), (b"a", b"3", 1, 5), (b"a", b"2", 2, 5), (b"a", None, 2, 5), (b"b", b"9", 1, 1), (b"b", None, 2, 2)]
    for _ in range(3):
        random.shuffle(rows)
        df = spark.createDataFrame(rows, "key binary, value binary, op int, seq long").repartition(3)
        assert sorted((bytes(x["key"]), x["value"] and bytes(x["value"]), x["op"]) for x in newest.newest_wins(df).collect()) == [(b"a", b"3", 1), (b"b", None, 2)]


def test_tombstone_coverage(spark):
    older, newer = log(spark, [("x", "stale")]).drop("seq"), log(spark, [("x", None)]).drop("seq")
    assert state(newest.merge([newer, older], drop_tombstones=True)) == {}
    dropped = newest.merge([newer], drop_tombstones=True)
    assert state(newest.live(newest.merge([dropped, older]))) == {"x": "stale"}  # the hazard
    kept = newest.merge([newer])
    assert state(newest.live(newest.merge([kept, older]))) == {}


def test_all_tombstoned(spark):
    sources = [log(spark, [("a", None)]).drop("seq"), log(spark, [("a", "1")]).drop("seq")]
    assert newest.merge(sources, drop_tombstones=True).count() == 0


def test_scans(spark):
    with pytest.raises(InvalidRangeError):
        read.key_range(b"z", b"a")
    df = log(spark, [(k, k) for k in "abcde"])
    keys = lambda *a, **k: [bytes(r["key"]).decode() for r in read.scan(df, *a, **k).collect()]
    assert keys(b"b", b"b") == []
    assert keys(b"x", b"z") == []
    assert keys(b"b", b"e") == ["b", "c", "d"]
    assert keys(b"b", None) == ["b", "c", "d", "e"]
    assert keys(None, b"c", reverse=True) == ["b", "a"]
    assert keys(b"a", b"z", limit=2) == ["a", "b"]


def test_keys_are_unsigned_bytes(spark):
    rows = [(b"\x80", b"h", 1, 0), (b"", b"", 1, 1), (b"\x7f", b"l", 1, 2), (b"\x7f\x00", b"m", 1, 3), (b"\xff", b"x", 1, 4)]
    df = spark.createDataFrame(rows, "key binary, value binary, op int, seq long")
    assert [bytes(r["key"]) for r in read.scan(df).collect()] == [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]


def test_multi_get_states(spark):
    df = log(spark, [("a", "1"), ("b", "1"), ("b", None), ("c", "")])
    asked = spark.createDataFrame([(x.encode(),) for x in ["a", "b", "c", "d", "a"]], "key binary")
    got = {bytes(r["key"]).decode(): (r["state"], None if r["value"] is None else bytes(r["value"])) for r in read.multi_get(df, asked).collect()}
    assert got == {"a": ("found", b"1"), "b": ("deleted", None), "c": ("found", b""), "d": ("absent", None)}


def test_verify_counts(spark):
    df = log(spark, [("a", "1"), ("b", "other")])
    expected = spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")], "key binary, value binary")
    assert read.verify(expected, df).first().asDict() == {"verified": 1, "lost": 1, "corrupt": 1}
    assert read.verify(expected.limit(0), df).first().asDict() == {"verified": 0, "lost": 0, "corrupt": 0}


@pytest.mark.parametrize("seed", range(4))
def test_live_set_of_random_edits_against_a_set(spark, seed):
    r = random.Random(seed)
    edits = [(f"f{r.randrange(8)}", r.choice([1, 2])) for _ in range(12 * seed)]
    live = set()
    for file, action in edits:
        live = live | {file} if action == 1 else live - {file}
    df = spark.createDataFrame([(f, a, i, i // 3, i % 3) for i, (f, a) in enumerate(edits)], "file string, action int, level int, version int, ordinal int").repartition(3)
    assert [x["file"] for x in files.live_set(df).collect()] == sorted(live)


def test_level_comes_from_the_last_addition(spark):
    rows = [("f", 1, 0, 0, 0), ("f", 2, 0, 1, 0), ("f", 1, 1, 2, 0)]
    df = spark.createDataFrame(rows, "file string, action int, level int, version int, ordinal int")
    assert [(r["file"], r["level"]) for r in files.live_set(df).collect()] == [("f", 1)]


def test_locate_and_overlap(spark):
    level = spark.createDataFrame([("f1", "b", "d"), ("f2", "f", "h")], "file string, min_key string, max_key string")
    keys = spark.createDataFrame([(x,) for x in ["a", "b", "d", "e", "h", "i", None]], "key string")
    assert {r["key"]: r["file"] for r in files.locate(keys, level).collect()} == {"a": None, "b": "f1", "d": "f1", "e": None, "h": "f2", "i": None, None: None}
    r = random.Random(1)
    bounds = sorted(r.sample(range(1000), 80))
    many = spark.createDataFrame([(f"f{i}", f"{a:03d}", f"{b:03d}") for i, (a, b) in enumerate(zip(bounds[::2], bounds[1::2], strict=True))], level.schema)
    asked = spark.createDataFrame([(f"{i:03d}", i) for i in range(1000)] + [(None, -1)], "key string, i int")
    brute = {i: next((f"f{k}" for k, (a, b) in enumerate(zip(bounds[::2], bounds[1::2], strict=True)) if a <= i <= b), None) for i in range(-1, 1000)}
    for most in (50_000, 7, 1):
        assert {x["i"]: x["file"] for x in files.locate(asked, many, most=most).collect()} == brute
    assert files.locate(asked, many.limit(0)).filter("file IS NOT NULL").count() == 0
    assert files.overlapping_neighbours(level).count() == 0
    more = level.union(spark.createDataFrame([("f3", "h", "k")], level.schema))
    assert [r["file"] for r in files.overlapping_neighbours(more).collect()] == ["f3"]


def test_scalars(spark):
    row = spark.createDataFrame([(b"123456789", 7, "000042.sst", "x.sst")], "b binary, n long, name string, bad string").select(
        scalar.crc("b").alias("crc"), scalar.file_name(F.col("n"), "log").alias("file"), scalar.file_number(F.col("name"), "sst").alias("number"), scalar.file_number(F.col("bad"), "sst").alias("bad"),
        scalar.sample_key(F.col("n")).alias("key"), scalar.fnv1a_column("b").alias("fnv"), scalar.bloom_bits(F.col("n")).alias("bits"),
    ).first()
    assert (row["crc"], row["file"], row["number"], row["bad"], row["key"], row["bits"]) == (3421780262, "000007.log", 42, None, "key:00000007", 68)
    assert int(row["fnv"]) == scalar.fnv1a(b"123456789") == 0x06D5573923C6CDFC


def test_bloom_has_no_false_negatives_and_few_false_positives():
    own = scalar.Bloom(5000)
    for i in range(5000):
        own.add(b"present-%d" % i)
    assert all(b"present-%d" % i in own for i in range(5000))
    rate = sum(b"absent-%d" % i in own for i in range(5000)) / 5000
    assert 0.001 < rate < 0.03


def test_empty_tables(spark):
    df = spark.createDataFrame([], "key binary, value binary, op int, seq long")
    assert newest.visible(df).count() == 0
    assert read.scan(df, b"a", b"b").count() == 0
