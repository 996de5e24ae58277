"""Byte formats of an embedded log-structured store: write-ahead logs, sorted tables, edit logs.

Numbers are big-endian. A record is `crc:4 op:1 key_length:4 key value_length:4 value`, with the CRC-32 of
all after it. A sorted table is records, then a footer (sparse index, smallest and largest key, count,
optional Bloom filter), then `crc:4 footer_offset:8`. An edit is `crc:4 type:1 name_length:4 name`, and for
types 3 and 4 `level:4`; types 1 and 2 are older and mean level 0.

Files are read by Spark's `binaryFile` source, one row for each, and decoded where they are; the records of a
file leave the task in batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lamina.functions.scalar import Bloom
from lamina.schema import ADDED, DELETE, FIELD_LIMIT, PUT, REMOVED, CorruptError

INDEX_EVERY = 64
TRAILER = struct.Struct(">IQ")
#: Edit types by what they say, as (action, has a level).
EDITS = {1: (ADDED, False), 2: (REMOVED, False), 3: (ADDED, True), 4: (REMOVED, True)}
ROWS = 4096


class _Reader:
    """A position in bytes; reading beyond the end is corruption."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CorruptError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def field(self) -> bytes:
        n = self.number(4)
        if n > FIELD_LIMIT:
            raise CorruptError("field above the limit")
        return self.take(n)


def _sealed(body: bytes) -> bytes:
    return zlib.crc32(body).to_bytes(4, "big") + body


def _field(data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + data


def encode_record(op: int, key: bytes, value: bytes | None) -> bytes:
    if max(len(key), len(value or b"")) > FIELD_LIMIT:
        raise ValueError("field above the limit")
    return _sealed(bytes([op]) + _field(key) + _field(value or b""))


def decode_record(reader: _Reader) -> tuple[int, bytes, bytes]:
    """The next record: op, key, value."""
    crc, begin = reader.number(4), reader.at
    op = reader.number(1)
    key, value = reader.field(), reader.field()
    if zlib.crc32(reader.data[begin : reader.at]) != crc:
        raise CorruptError("checksum")
    return op, key, value


def records(data: bytes, tolerant: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
    """All records; a bad one ends a tolerant reading and is an error otherwise."""
    reader = _Reader(data)
    while reader.at < len(data):
        try:
            yield decode_record(reader)
        except CorruptError:
            if tolerant:
                return
            raise


def torn(data: bytes) -> bool:
    """Whether a log ends in the middle of a record."""
    try:
        for _ in records(data):
            pass
    except CorruptError:
        return True
    return False


def encode_edit(action: int, file: str, level: int = 0) -> bytes:
    kind = {ADDED: 3, REMOVED: 4}[action]
    return _sealed(bytes([kind]) + _field(file.encode()) + level.to_bytes(4, "big"))


def edits(data: bytes, tolerant: bool = False) -> Iterator[tuple[int, str, int]]:
    """All edits (action, file, level) of an edit log; a bad one ends a tolerant reading."""
    reader = _Reader(data)
    while reader.at < len(data):
        try:
            crc, begin = reader.number(4), reader.at
            kind = reader.number(1)
            if kind not in EDITS:
                raise CorruptError("unknown edit")
            action, leveled = EDITS[kind]
            name = reader.field()
            level = reader.number(4) if leveled else 0
            if zlib.crc32(data[begin : reader.at]) != crc:
                raise CorruptError("checksum")
        except CorruptError:
            if tolerant:
                return
            raise
        yield action, name.decode(), level


@dataclass
class Table:
    """What a sorted table's footer says."""

    index: list[tuple[bytes, int]] = field(default_factory=list)
    min_key: bytes = b""
    max_key: bytes = b""
    entries: int = 0
    bloom: Bloom | None = None
    data: bytes = b""

    def get(self, key: bytes) -> tuple[int, bytes, bytes] | None:
        """The record of a key: by the range, the filter, the sparse index, then at most one block."""
        if not self.entries or not self.min_key <= key <= self.max_key or (self.bloom and key not in self.bloom):
            return None
        at = max((offset for k, offset in self.index if k <= key), default=0)
        reader = _Reader(self.data, at)
        for _ in range(INDEX_EVERY):
            if reader.at >= len(self.data):
                return None
            op, k, value = decode_record(reader)
            if k >= key:
                return (op, k, value) if k == key else None
        return None


def encode_table(rows: Iterable[tuple[int, bytes, bytes | None]], bloom: bool = True) -> bytes:
    """A sorted table of records in ascending order of distinct keys."""
    data, index, keys = bytearray(), [], []
    for i, (op, key, value) in enumerate(rows):
        if keys and key <= keys[-1]:
            raise ValueError("keys must ascend")
        if i % INDEX_EVERY == 0:
            index.append(_field(key) + len(data).to_bytes(8, "big"))
        keys.append(key)
        data += encode_record(op, key, value)
    body = len(index).to_bytes(4, "big") + b"".join(index) + _field(keys[0] if keys else b"") + _field(keys[-1] if keys else b"") + len(keys).to_bytes(8, "big")
    if bloom and keys:
        own = Bloom(len(keys))
        for key in keys:
            own.add(key)
        body += b"\x01" + own.hashes.to_bytes(4, "big") + _field(own.bits.tobytes())
    else:
        body += b"\x00"
    return bytes(data) + body + TRAILER.pack(zlib.crc32(body), len(data))


def decode_table(content: bytes) -> Table:
    """The footer of a sorted table with its data; older tables end without the byte that announces a filter."""
    if len(content) < TRAILER.size:
        raise CorruptError("truncated")
    crc, offset = TRAILER.unpack(content[-TRAILER.size :])
    body = content[offset : -TRAILER.size]
    if offset > len(content) - TRAILER.size or zlib.crc32(body) != crc:
        raise CorruptError("footer")
    reader, out = _Reader(body), Table(data=content[:offset])
    out.index = [(reader.field(), reader.number(8)) for _ in range(reader.number(4))]
    out.min_key, out.max_key, out.entries = reader.field(), reader.field(), reader.number(8)
    if reader.at < len(body) and reader.number(1):
        out.bloom = Bloom.of(reader.number(4), reader.field())
    return out


SCHEMAS = {
    "log": "file string, ordinal long, op tinyint, key binary, value binary",
    "tables": "file string, ordinal long, op tinyint, key binary, value binary",
    "edits": "version string, ordinal long, action tinyint, file string, level int",
}


def decode(files: DataFrame, kind: str) -> DataFrame:
    """The entries of files (path, content), as `read_log`, `read_tables` and `read_edits` give them; `kind` is a key of `SCHEMAS`."""
    schema = SCHEMAS[kind]
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                name, content = file.rsplit("/", 1)[-1], bytes(content)
                found: Iterator[tuple]
                if kind == "edits":
                    found = edits(content, tolerant=True)
                elif kind == "log":
                    found = ((op, k, None if op == DELETE else v) for op, k, v in records(content, tolerant=True))
                else:
                    found = ((op, k, None if op == DELETE else v) for op, k, v in records(decode_table(content).data))
                out: list[tuple] = []
                for i, row in enumerate(found):
                    if kind != "edits" and row[0] not in (PUT, DELETE):
                        raise CorruptError(f"unknown op {row[0]}")
                    out.append((name, i, *row))
                    if len(out) == ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def encode(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """Files (path, content) of rows with a `path`: one for each, with its rows in the order of the column `order`.

    For logs and tables rows have op, key and value, for edits action, file and level. What a file holds has to
    fit a task, as it does when the file is read; deal rows over as many paths as that needs.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        if kind == "edits":
            content = b"".join(encode_edit(int(a), f, int(n)) for a, f, n in zip(frame["action"], frame["file"], frame["level"], strict=True))
        else:
            entries = [(int(op), bytes(k), None if v is None else bytes(v)) for op, k, v in zip(frame["op"], frame["key"], frame["value"], strict=True)]
            content = b"".join(encode_record(*x) for x in entries) if kind == "log" else encode_table(entries)
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [content]})

    return rows.groupBy("path").applyInPandas(run, "path string, content binary")


def footers(files: DataFrame) -> DataFrame:
    """path, min_key, max_key, entries, blocks (in the sparse index), bloom (whether there is a filter) of sorted tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [decode_table(bytes(x)) for x in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "min_key": [x.min_key for x in own], "max_key": [x.max_key for x in own], "entries": [x.entries for x in own], "blocks": [len(x.index) for x in own], "bloom": [x.bloom is not None for x in own]})

    return files.select("path", "content").mapInPandas(run, "path string, min_key binary, max_key binary, entries long, blocks long, bloom boolean")


def probe(files: DataFrame, probes: DataFrame) -> DataFrame:
    """path, key, outcome of every probe (path, key) of a sorted table: outside its range, not in its filter, absent or found.

    The first two read no record; a probe of a table that is not there has no outcome.
    """

    def run(tables: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = decode_table(bytes(tables["content"].iloc[0])) if len(tables) else None
        out = []
        for key in map(bytes, asked["key"]):
            if own is None:
                out.append(None)
            elif not own.entries or not own.min_key <= key <= own.max_key:
                out.append("range")
            elif own.bloom and key not in own.bloom:
                out.append("filter")
            else:
                out.append("found" if own.get(key) else "absent")
        return pd.DataFrame({"path": asked["path"], "key": asked["key"], "outcome": pd.Series(out, dtype=object)})

    return files.groupBy("path").cogroup(probes.groupBy("path")).applyInPandas(run, "path string, key binary, outcome string")


def save(files: DataFrame, folder: str) -> int:
    """Writes files (path, content) into a folder on any file system that Spark writes to, one at a time; returns how many."""
    spark = files.sparkSession
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = new_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new_path(folder))
    n = 0
    for row in files.select("path", "content").toLocalIterator():
        stream = fs.create(new_path(f"{folder.rstrip('/')}/{row['path']}"), False)
        try:
            stream.write(bytearray(row["content"]))
        finally:
            stream.close()
        n += 1
    return n


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path), kind)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, op, key, value of write-ahead logs; each ends at its first torn or corrupt record, the next goes on."""
    return _read(spark, path, "log")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, op, key, value of sorted tables; a corrupt one is an error."""
    return _read(spark, path, "tables")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """version (the file), ordinal, action, file, level of edit logs, up to the first corrupt edit."""
    return _read(spark, path, "edits")


def current(text: bytes) -> str:
    """The name of the edit log that a pointer file holds."""
    if not (name := text.decode().strip()):
        raise CorruptError("empty pointer")
    return name
