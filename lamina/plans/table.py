"""Tables of keyed mutations on Parquet files.

Writes append sorted files of mutations (level 0). Reads take a version's files, leave out those whose key
range cannot matter, and resolve the rest by newest-wins. Compaction merges level 0 and what it overlaps
into disjoint, sorted files (level 1). Every change of the file set is one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lamina import schema
from lamina.operators import newest, read
from lamina.plans import compaction
from lamina.plans.compaction import Compaction
from lamina.plans.log import Action, CommitLog, Snapshot
from lamina.schema import ADDED, MUTATION, REMOVED, ConflictError, HousekeepingError, InvalidMutationError

#: Footers that are read at once.
FOOTERS = 16
#: Mutations of a version are ordered below it: seq = version << ORDINAL_BITS | ordinal.
ORDINAL_BITS = 36


@dataclass
class Options:
    """flush_bytes: what a batch's file holds, about; l0_threshold: batches beyond which level 0 is compacted;
    l1_ratio: level 1 is rewritten beyond so many times flush_bytes; file_bytes: of a compacted file;
    file_rows: of any file at most, 0 for no limit; auto_compact: compact after each write if a threshold is passed."""

    flush_bytes: int = 128 << 20
    l0_threshold: int = 4
    l1_ratio: int = 10
    file_bytes: int = 512 << 20
    file_rows: int = 0
    auto_compact: bool = True


class KVTable:
    """A table in `root`; `KVTable(spark, root)` opens or makes it."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None) -> None:
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.log = CommitLog(spark, self.root)

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; for symmetry with `with`."""

    def set_flush_threshold(self, n: int) -> None:
        self.options.flush_bytes = n

    def set_l0_compaction_threshold(self, n: int) -> None:
        self.options.l0_threshold = n

    set_compaction_threshold = set_l0_compaction_threshold

    def set_l1_size_ratio(self, n: int) -> None:
        self.options.l1_ratio = n

    # Writing

    def put(self, batch: DataFrame) -> int:
        """Writes (key, value[, ordinal]) and returns the version; a null value is the empty one."""
        return self.apply(schema.puts(batch))

    def delete(self, batch: DataFrame) -> int:
        """Deletes the keys of (key[, ordinal]), whether they are there or not, and returns the version."""
        return self.apply(schema.deletes(batch))

    def apply(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Writes (key, value, op[, ordinal]) as one version.

        A batch that has a key more than once needs ordinals that tell its rows apart; without them, or
        with equal ones, it is refused, as is a null key or a field above the limit. `stream` names a
        stream and its batch; a batch that the log has seen is not written again.
        """
        if "ordinal" not in batch.columns:
            batch = batch.withColumn("ordinal", F.lit(0).cast("long"))
        while True:
            snapshot = self.log.snapshot()
            if stream and snapshot.streams.get(stream[0], -1) >= stream[1]:
                return snapshot.version
            version = snapshot.version + 1
            rows = batch.select("key", "value", F.col("op").cast("byte").alias("op"), (F.lit(version << ORDINAL_BITS) + F.col("ordinal")).alias("seq"), schema.invalid(batch).alias("_why"))
            rows = rows.withColumn("_why", F.when(F.shiftright("seq", ORDINAL_BITS) != version, "ordinal out of range").otherwise(F.col("_why")))
            dealt = rows.repartitionByRange("key")  # also keeps the mutations of a key together for the window
            twice = F.count("*").over(Window.partitionBy("key", "seq")) > 1
            dealt = dealt.withColumn("_why", F.when(twice & F.col("_why").isNull(), "a key has two mutations in no order").otherwise(F.col("_why")))
            guarded = dealt.withColumn("key", F.when(F.col("_why").isNull(), F.col("key")).otherwise(F.raise_error(F.col("_why")))).drop("_why")
            folder = f"data/{uuid.uuid4().hex}"
            try:
                self._write(guarded, folder, self.options.flush_bytes)
            except Exception as e:
                if "USER_RAISED_EXCEPTION" in str(e):
                    raise InvalidMutationError(str(e).splitlines()[0]) from e
                raise
            added = self._stats(folder, 0)
            try:
                self.log.commit(version, added, dict([stream]) if stream else None)
                break
            except ConflictError:
                continue  # the mutations' order depends on the version, so they are written again
        if self.options.auto_compact:
            try:
                self.compact()
            except Exception as e:
                raise HousekeepingError(f"version {version} is committed") from e
        return version

    def _write(self, rows: DataFrame, folder: str, file_bytes: int) -> None:
        """Sorted files, with statistics and a Bloom filter on the key, of rows that are dealt by ranges of keys."""
        writer = rows.sortWithinPartitions("key", F.desc("seq")).write.mode("errorifexists")
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.enable.dictionary#key", "false")
        writer = writer.option("parquet.block.size", min(file_bytes, 128 << 20)).option("maxRecordsPerFile", self.options.file_rows)
        writer.parquet(f"{self.root}/{folder}")

    def _stats(self, folder: str, level: int) -> list[Action]:
        """The additions for the files of a folder, from their footers alone; files without rows are left out."""
        new_path, fs = self.log._new_path, self.log._fs
        found = [(x.getPath(), x.getLen()) for x in fs.listStatus(new_path(f"{self.root}/{folder}")) if x.getPath().getName().endswith(".parquet")]
        with ThreadPoolExecutor(FOOTERS) as pool:
            footers = [*pool.map(self._footer, [path for path, _ in found])]
        out = [Action(ADDED, f"{folder}/{path.getName()}", level, *own, size) for (path, size), own in zip(found, footers, strict=True) if own[2]]
        return sorted(out, key=lambda a: a.file)

    def _footer(self, path: object) -> tuple[str, str, int]:
        """Smallest and largest key, as in the log, and the number of rows of a file."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            blocks = list(reader.getFooter().getBlocks())
        finally:
            reader.close()
        rows = sum(b.getRowCount() for b in blocks)
        stats = [c.getStatistics() for b in blocks for c in b.getColumns() if c.getPath().toDotString() == "key"]
        if rows and not all(x.hasNonNullValue() for x in stats):  # keys above some kilobytes have none
            own = self.spark.read.schema(MUTATION).parquet(path.toString()).agg(F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high")).first()
            return own["low"], own["high"], rows
        lows, highs = [bytes(x.getMinBytes()).hex().upper() for x in stats], [bytes(x.getMaxBytes()).hex().upper() for x in stats]
        return min(lows, default=""), max(highs, default=""), rows

    # Reading

    def mutations(self, version: int | None = None, start: bytes | None = None, end: bytes | None = None, files: list[Action] | None = None) -> DataFrame:
        """All mutations of a version's files that may have keys in [start, end)."""
        files = list(self.log.snapshot(version).files.values()) if files is None else files
        low, high = start.hex().upper() if start is not None else None, end.hex().upper() if end is not None else None
        files = [f for f in files if (low is None or f.max_key >= low) and (high is None or f.min_key < high)]
        if not files:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.root}/{f.file}" for f in files])

    def get(self, key: bytes, version: int | None = None) -> DataFrame:
        """(key, value) of a key, or no row."""
        return read.get(self.mutations(version, key, key + b"\0"), key).select("key", "value")

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(key, state, value) for every distinct key of `keys`."""
        return read.multi_get(self.mutations(version), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """(key, value) of start <= key < end in the order of the keys, as of a version."""
        read.key_range(start, end)
        if start is not None and start == end:
            return self.spark.createDataFrame([], MUTATION).select("key", "value")
        return read.scan(self.mutations(version, start, end), start, end, reverse, limit).select("key", "value")

    def iterate(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None) -> Iterator[Row]:
        """The rows of a scan, pulled partition by partition."""
        return self.scan(start, end, version).toLocalIterator(prefetchPartitions=True)

    def files(self, version: int | None = None) -> DataFrame:
        """The live files, as rows."""
        rows = [(f.file, f.level, bytearray.fromhex(f.min_key), bytearray.fromhex(f.max_key), f.entries, f.bytes) for f in self.log.snapshot(version).files.values()]
        return self.spark.createDataFrame(rows, schema.FILE)

    def stats(self) -> DataFrame:
        """Files and bytes of each level, and whether level 1 is disjoint, as one row."""
        snapshot = self.log.snapshot()
        new, old = snapshot.level(0), snapshot.level(1)
        row = (snapshot.version, len(new), len(old), sum(f.bytes for f in new), sum(f.bytes for f in old), compaction.disjoint(old))
        return self.spark.createDataFrame([row], "version long, l0_count int, l1_count int, l0_bytes long, l1_bytes long, l1_disjoint boolean")

    # Maintenance

    def compact(self, force: bool = False) -> int:
        """Runs both compactions as their thresholds say (or level 0's in any case) and returns the version."""
        level_0: Callable[[Snapshot], Compaction | None] = lambda s: compaction.level_0(s, 0 if force else self.options.l0_threshold)
        level_1: Callable[[Snapshot], Compaction | None] = lambda s: compaction.level_1(s, self.options.l1_ratio * self.options.flush_bytes, self.options.file_bytes)
        for plan in (level_0, level_1):
            while self._compact(plan):
                if plan is level_1:
                    break
        return self.log.snapshot().version

    maybe_compact = compact

    def _compact(self, plan: Callable[[Snapshot], Compaction | None]) -> bool:
        """Merges what the plan takes, if anything; planned anew if another writer was first."""
        while True:
            snapshot = self.log.snapshot()
            if (chosen := plan(snapshot)) is None:
                return False
            merged = newest.newest_wins(self.mutations(files=list(chosen.inputs)))
            merged = newest.live(merged) if chosen.drop_tombstones else merged
            folder = f"data/{uuid.uuid4().hex}"
            files = max(1, -(-sum(f.bytes for f in chosen.inputs) // self.options.file_bytes))
            self._write(merged.select("key", "value", "op", "seq").repartitionByRange(files, "key"), folder, self.options.file_bytes)
            added = self._stats(folder, chosen.level)
            try:
                self.log.commit(snapshot.version + 1, [*added, *(Action(REMOVED, f.file, f.level) for f in chosen.inputs)])
                return True
            except ConflictError:
                continue

    def vacuum(self, keep_versions: int = 0) -> list[str]:
        """Deletes data files that no version of the last `keep_versions` and the latest one uses; returns their names.

        The log's files of older versions go as well, so that opening the table lists few. Readers of older versions
        must be done. Run it while no writer is between its files and its commit.
        """
        last = self.log.snapshot().version
        first = self.log.prune(max(0, last - keep_versions))
        used = {f for v in range(max(first, last - keep_versions), last + 1) for f in self.log.snapshot(v).files}
        fs, new_path = self.log._fs, self.log._new_path
        top = new_path(f"{self.root}/data")
        dropped = []
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            name = f"data/{folder.getPath().getName()}"
            for file in fs.listStatus(folder.getPath()):
                path = f"{name}/{file.getPath().getName()}"
                if path.endswith(".parquet") and path not in used:
                    fs.delete(file.getPath(), False)
                    dropped.append(path)
            if not any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder.getPath())):
                fs.delete(folder.getPath(), True)
        return sorted(dropped)
