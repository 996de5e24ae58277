"""Byte formats: round trips, torn and corrupt files."""

import pytest

from lamina.schema import CorruptError
from lamina.sources import binary
from lamina.sources.generate import sample_rows

ROWS = [(1, b"k%04d" % i, b"v%d" % i) if i % 5 else (2, b"k%04d" % i, None) for i in range(300)]


def test_records_and_torn_tails():
    data = b"".join(binary.encode_record(*r) for r in ROWS)
    assert [*binary.records(data)] == [(op, k, v or b"") for op, k, v in ROWS]
    assert not binary.torn(data) and binary.torn(data[:-3])
    assert len([*binary.records(data[:-3], tolerant=True)]) == 299
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(CorruptError):
        [*binary.records(bytes(broken))]


def test_tables():
    for bloom in (True, False):
        table = binary.decode_table(binary.encode_table(ROWS, bloom))
        assert (table.min_key, table.max_key, table.entries, len(table.index)) == (b"k0000", b"k0299", 300, 5)
        assert all(table.get(k) == (op, k, v or b"") for op, k, v in ROWS)
        assert table.get(b"k0000x") is None and table.get(b"zz") is None and (table.bloom is not None) == bloom
    content = binary.encode_table(ROWS, False)
    import struct
    import zlib

    _, offset = struct.unpack(">IQ", content[-12:])
    body = content[offset:-13]
    old = content[:offset] + body + struct.pack(">IQ", zlib.crc32(body), offset)
    assert binary.decode_table(old).bloom is None
    with pytest.raises(CorruptError):
        binary.decode_table(content[:-1] + b"\0")
    assert binary.decode_table(binary.encode_table([])).get(b"a") is None


def test_edits():
    data = binary.encode_edit(1, "000001.sst") + binary.encode_edit(2, "000001.sst", 1)
    assert [*binary.edits(data)] == [(1, "000001.sst", 0), (2, "000001.sst", 1)]
    old = binary._sealed(bytes([1]) + binary._field(b"f"))
    assert [*binary.edits(old)] == [(1, "f", 0)]
    assert [*binary.edits(data[:-2], tolerant=True)] == [(1, "000001.sst", 0)]
    with pytest.raises(CorruptError):
        [*binary.edits(binary._sealed(bytes([9]) + binary._field(b"f")))]
    assert binary.current(b"EDITS-000001\n") == "EDITS-000001"
    with pytest.raises(CorruptError):
        binary.current(b"\n")


def test_readers(spark, tmp_path):
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal/000001.log").write_bytes(binary.encode_record(1, b"a", b"1") + binary.encode_record(2, b"a", b"")[:-1])
    (tmp_path / "wal/000002.log").write_bytes(binary.encode_record(1, b"b", b"2"))
    rows = sorted((r["file"], r["ordinal"], r["op"], bytes(r["key"])) for r in binary.read_log(spark, str(tmp_path / "wal")).collect())
    assert rows == [("000001.log", 0, 1, b"a"), ("000002.log", 0, 1, b"b")]
    (tmp_path / "t.sst").write_bytes(binary.encode_table(ROWS))
    found = binary.read_tables(spark, str(tmp_path / "t.sst"))
    assert found.count() == 300 and found.filter("op = 2 AND value IS NULL").count() == 60
    (tmp_path / "m").write_bytes(binary.encode_edit(1, "x", 1))
    assert binary.read_edits(spark, str(tmp_path / "m")).first()["level"] == 1


def test_files_are_made_probed_and_saved(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 3}", op, k, v) for i, (op, k, v) in enumerate(ROWS)], "path string, op int, key binary, value binary")
    made = binary.encode(rows, "tables", "key")
    assert {x["path"]: x["entries"] for x in binary.footers(made).collect()} == {"t0": 100, "t1": 100, "t2": 100}
    asked = spark.createDataFrame([("t0", b"k0000"), ("t0", b"k0001"), ("t0", b"zz"), ("t9", b"k0000"), ("t0", b"k0000")], "path string, key binary")
    got = sorted((x["path"], bytes(x["key"]), x["outcome"]) for x in binary.probe(made, asked).collect())
    assert got[0] == got[1] == ("t0", b"k0000", "found") and got[2][2] in ("filter", "absent") and got[3:] == [("t0", b"zz", "range"), ("t9", b"k0000", None)]
    assert binary.save(made, str(tmp_path / "out")) == 3 and binary.read_tables(spark, str(tmp_path / "out")).count() == 300


def test_generator(spark):
    assert [(bytes(r["key"]), bytes(r["value"])) for r in sample_rows(spark, 2).collect()] == [(b"key:00000000", b"val:00000000"), (b"key:00000001", b"val:00000001")]
