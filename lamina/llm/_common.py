"""What the operators of this subpackage share: shipping code, cutting lineage, Arrow maps, word hashes."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 100_000
#: Rows that are turned into Python objects together; texts may be long.
ROWS = 1000
#: Bytes of a batch that is sent to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Where a session says so.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: As many rows as a batch has, for short rows.
ALL_ROWS = 1 << 30

#: Counters by which hot keys are found; their number is fixed, whatever the input.
COUNTERS = 1 << 14
#: Rows that a key may have in one task in any case.
LEAST_HOT = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once per application, whatever their import path is.

    A session that does not say how many bytes a batch has gets `BATCH_BYTES`, since an executor holds a batch of
    each task twice, in the JVM and in the worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lamina-"), "lamina.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("lamina", os.path.relpath(path, top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once into the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is that of `spark.checkpoint.dir`. Where it is unset, a local session gets a temporary one; on a
    cluster, whose executors would not share that, it is an error.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lamina-checkpoint-"))
    return df.checkpoint(eager=True)


def salted_join(many: DataFrame, few: DataFrame, key: str | list[str], by: str, how: str = "inner", weights: DataFrame | None = None) -> DataFrame:
    """`many` joined on `key` with `few`, which has a key once; the rows of a hot key in `many` are dealt by `by`.

    Rows are counted by `COUNTERS` buckets of the key's hash. A bucket with over twice a partition's share is
    dealt over as many tasks as it has shares, and the rows of `few` that are in it are copied to each. Copies
    are few: they add as many rows as there are shares in hot buckets, for each key there. `weights` (key and n) tells
    how many rows a key has, if that is cheaper than to read `many` twice. `how` is inner, left or left_semi.
    """
    session = many.sparkSession
    keys = [key] if isinstance(key, str) else key
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNTERS))
    number = F.count("*") if weights is None else F.sum("n")
    counts = [(r["bucket"], r["n"]) for r in (many if weights is None else weights).groupBy(bucket.alias("bucket")).agg(number.alias("n")).collect()]  # COUNTERS rows at most
    share = max(LEAST_HOT, sum(n for _, n in counts) // max(1, int(session.conf.get("spark.sql.shuffle.partitions"))))
    hot = [(b, -(-n // share)) for b, n in counts if n > 2 * share]
    if not hot:
        return many.join(few, keys, how)
    table = F.broadcast(session.createDataFrame(hot, "__bucket long, __salts long"))  # COUNTERS rows at most
    salts = F.coalesce("__salts", F.lit(1))
    left = many.withColumn("__bucket", bucket).join(table, "__bucket", "left").withColumn("__salt", F.pmod(F.xxhash64(by), salts)).drop("__bucket", "__salts")
    right = few.withColumn("__bucket", bucket).join(table, "__bucket", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__bucket", "__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another system's
        return None


def tidy() -> None:
    """Gives memory that a task has freed back to the system; workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = ROWS) -> DataFrame:
    """`function` over the Arrow batches of `df`, `rows` at a time, without a shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                if (out := function(whole.slice(at, rows))) is not None:
                    yield out
        tidy()

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of the given arrays; plain lists and numpy arrays are converted."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class _Words(dict):
    """Packed 64-bit hashes of words, kept for the words seen of late."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.frombuffer(b"".join(map(_words.__getitem__, words)), dtype="<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers, one for each place in a shingle.
_PLACES = np.frombuffer(b"".join(xxhash.xxh3_64_digest(b"place %d" % i) for i in range(64)), dtype="<u8") | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` items; none if there are fewer items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = hashes[:n] * _PLACES[0]
    for i in range(1, width):
        total = total + hashes[i : i + n] * _PLACES[i]
    return mix(total)
