"""Queries over the sample tables that show the operators, each with the SQL that gives the same rows.

`events` is read as a log of mutations: the key is user and hour, an `error` deletes, `event_id` orders.
`orders` is another: the key is the customer, status `P` deletes. Sources are simulated by generations of
`WIDTH` event ids, of which the last is the newest. The queries `kv_*` write the log into a table of their own, in
four batches by age, and read it back; those named for byte formats encode it into files' contents and decode these.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import files, newest, read
from lamina.plans.table import ORDINAL_BITS, KVTable, Options
from lamina.schema import DELETE, PUT
from lamina.sources import binary

WIDTH = 2500
#: Bytes at which a generation is written out.
FLUSH_BYTES = 60_000
START, END = "000010:00", "000060:00"

LOG = """log AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS key,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
  event_id AS seq, event_id // 2500 AS gen FROM events)"""
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"
STATE = f"WITH {LOG}, {NEWEST}"
#: Generations are files; three of them make up level 0, the others level 1.
FILES = f"WITH {LOG}, files AS (SELECT gen AS file, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM log GROUP BY gen)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, op, seq of the events."""
    key = F.concat_ws(":", F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lpad(F.hour("ts").cast("string"), 2, "0"))
    deleted = F.col("event_type") == "error"
    return _table(spark, sf_dir, "events").select(
        key.alias("key"), F.when(~deleted, F.col("value")).alias("value"), F.when(deleted, DELETE).otherwise(PUT).alias("op"), F.col("event_id").alias("seq")
    )


def _with_gen(log: DataFrame) -> DataFrame:
    """The log with the generation of each mutation."""
    return log.withColumn("gen", F.expr(f"seq DIV {WIDTH}"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, op, seq of the orders."""
    deleted = F.col("o_orderstatus") == "P"
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.when(~deleted, F.col("o_totalprice")).alias("value"), F.when(deleted, DELETE).otherwise(PUT).alias("op"), F.col("o_orderkey").alias("seq"))


def _generations(log: DataFrame) -> DataFrame:
    return files.file_stats(log.withColumn("file", F.expr(f"seq DIV {WIDTH}")))


def put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = event_log(spark, sf_dir).filter(F.col("op") == PUT)
    return newest.newest_wins(puts).select("key", "value", "seq")


def delete_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.visible(event_log(spark, sf_dir)).select("key", "value")


def delete_shadow_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.visible(order_log(spark, sf_dir)).select("key", "value")


def newest_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.newest_wins_wide(event_log(spark, sf_dir)).select("key", "op", "seq")


def delete_then_put_revives(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    ever = log.groupBy("key").agg(F.min(F.when(F.col("op") == DELETE, F.col("seq"))).alias("deleted_at"))
    return newest.visible(log).join(ever, "key").filter(F.col("deleted_at") < F.col("seq")).select("key", "value", "deleted_at")


def get_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.get(event_log(spark, sf_dir), "000000:01").select("key", "value")


def get_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.get(event_log(spark, sf_dir), "000000:99").select("key", "value")


def get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key that is deleted at the end."""
    log = event_log(spark, sf_dir)
    asked = newest.newest_wins(log).filter(F.col("op") == DELETE).agg(F.min("key").alias("key"))
    return read.multi_get(log, asked).select("key", "state")


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    asked = log.select("key").union(log.select(F.concat("key", F.lit("x"))))
    return read.multi_get(log, asked)


def scan_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(event_log(spark, sf_dir), START, END).select("key", "value")


def scan_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(event_log(spark, sf_dir), START, START).select("key", "value")


def scan_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(event_log(spark, sf_dir), END).select("key", "value")


def reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(event_log(spark, sf_dir), START, END, reverse=True).select("key", "value")


def limit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(event_log(spark, sf_dir), START, END, limit=25).select("key", "value")


def scan_memtable_plus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).filter(read.key_range(START, END))
    new, old = (newest.newest_wins(_with_gen(log).filter(F.col("gen") % 2 == i).drop("gen")) for i in (1, 0))
    merged = newest.merge([new, old], drop_tombstones=True)
    return merged.select("key", "value")


def merge_three_way_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    sources = [newest.newest_wins(log.filter(F.col("seq") % 3 == i)) for i in range(3)]
    return newest.merge(sources).select("key", "op", "seq")


def snapshot_as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.visible(newest.as_of(event_log(spark, sf_dir), 2 * WIDTH)).select("key", "value")


def wal_replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("segment", F.expr("seq DIV 1000")).withColumn("ordinal", F.col("seq") % 1000)
    return newest.newest_wins(log, order=["segment", "ordinal"]).select("key", "op", "segment", "ordinal")


def compact_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.live(newest.newest_wins(event_log(spark, sf_dir))).select("key", "value", "seq")


def compact_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest.newest_wins(event_log(spark, sf_dir)).select("key", "value", "op", "seq")


def compact_incomplete_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half compacted alone keeps its tombstones, so the whole still reads right."""
    log = event_log(spark, sf_dir)
    newer = newest.merge([log.filter(F.col("seq") >= 2 * WIDTH).transform(newest.newest_wins)])
    return newest.visible(newer.unionByName(log.filter(F.col("seq") < 2 * WIDTH))).select("key", "value")


def l0_to_l1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations 2 and up are level 0; the older ones that overlap their range are merged with them."""
    log = event_log(spark, sf_dir)
    stats = _generations(log)
    chosen = stats.filter("file >= 2").select("file").union(files.overlapping(stats.filter("file < 2"), stats.filter("file >= 2")).select("file"))
    return newest.visible(_with_gen(log).join(chosen.select(F.col("file").alias("gen")), "gen", "left_semi").drop("gen")).select("key", "value")


def _ranged(log: DataFrame, column: Column) -> DataFrame:
    return files.file_stats(log.withColumn("file", column))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint files of a sorted level: a file for each first four digits of the key."""
    return _ranged(newest.newest_wins(event_log(spark, sf_dir)), F.substring("key", 1, 5))


def l1_disjoint_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a sorted level that a batch with the keys of a range leaves as they are."""
    log, level = event_log(spark, sf_dir), _slices(spark, sf_dir)
    batch = _ranged(log.filter(read.key_range(START, END)), F.lit("batch"))
    taken = files.overlapping(level, batch).select("file")
    return level.join(taken, "file", "left_anti").select("file", "entries")


def l1_full_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("entries").alias("entries"))


def l1_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.overlapping_neighbours(_generations(event_log(spark, sf_dir))).select("file", "reach")


def l1_locate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = event_log(spark, sf_dir).select("key").distinct()
    return files.locate(keys, _slices(spark, sf_dir)).select("key", "file")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(event_log(spark, sf_dir)).select("file", "min_key", "max_key", "entries")


def file_skip_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.skip_for_range(_slices(spark, sf_dir), START, END).select("file", "skipped")


def sparse_index_every_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = newest.newest_wins(_with_gen(event_log(spark, sf_dir)).withColumnRenamed("gen", "file"), keys=("file", "key"))
    return files.sparse_index(log).select("file", "key", F.col("place").cast("long").alias("place"))


def sparse_index_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every key, the last indexed key at or before it."""
    log = newest.newest_wins(_with_gen(event_log(spark, sf_dir)).withColumnRenamed("gen", "file"), keys=("file", "key"))
    order = Window.partitionBy("file").orderBy("key")
    place = F.row_number().over(order) - 1
    indexed = log.withColumn("place", place).withColumn("mark", F.when(F.col("place") % 64 == 0, F.col("key")))
    return indexed.select("file", "key", F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("floor_key"))


def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _generations(event_log(spark, sf_dir))
    sized = stats.withColumn("bits", scalar.bloom_bits(F.col("entries")))
    return sized.select("file", "entries", "bits", scalar.bloom_hashes(F.col("entries"), F.col("bits")).alias("hashes"))


def flush_trigger_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which generations hold enough bytes of keys and values to be written out."""
    log = event_log(spark, sf_dir).join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "props"), "seq")
    sized = _with_gen(log).groupBy("gen").agg(F.sum(scalar.entry_bytes("key", "props")).alias("bytes"))
    return sized.select("gen", "bytes", (F.col("bytes") >= FLUSH_BYTES).alias("flush"))


def level_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of the levels, if the first generation is level 1 and the others are level 0."""
    log = event_log(spark, sf_dir).join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "props"), "seq")
    sized = _with_gen(log).groupBy("gen").agg(F.sum(scalar.entry_bytes("key", "props")).alias("bytes"))
    return files.level_bytes(sized.withColumn("level", F.when(F.col("gen") == 0, 1).otherwise(0)))


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    level = F.when(F.col("file") >= 2, 0).otherwise(1)
    return _generations(log).groupBy(level.alias("level")).agg(F.count("*").alias("files"), F.sum("entries").alias("entries"))


def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _with_gen(event_log(spark, sf_dir)).select(scalar.file_name(F.col("gen") + 1, "sst").alias("name")).distinct()
    return names.agg((F.max(scalar.file_number(F.col("name"), "sst")) + 1).alias("next_seq"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits: a file for each customer, removed by status P, its level from the order."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("action"), (F.col("o_orderkey") % 2).cast("int").alias("level"), F.col("o_orderkey").alias("version"), F.lit(0).alias("ordinal")
    )


def manifest_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.live_set(_edits(spark, sf_dir).drop("level")).select("file")


def manifest_leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.live_set(_edits(spark, sf_dir)).select("file", "level")


def chaos_verify_lost_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every key was put to last, held against the final state."""
    log = event_log(spark, sf_dir)
    expected = newest.newest_wins(log.filter(F.col("op") == PUT))
    return read.verify(expected, log)


def key_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the keys and values and the first and last key of every user."""
    state = newest.visible(event_log(spark, sf_dir)).join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "props"), "seq")
    return state.groupBy(F.substring("key", 1, 6).alias("user")).agg(F.sum(scalar.entry_bytes("key", "props")).cast("long").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))


# Tables


def _byte_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a batch: the value is the event's number; `part` is its quarter of the numbers, by age."""
    log = event_log(spark, sf_dir)
    most = log.agg(F.max("seq").alias("_most"))
    value = F.when(F.col("op") == PUT, F.col("seq").cast("string").cast("binary"))
    rows = log.crossJoin(F.broadcast(most))  # one row
    return rows.select(F.col("key").cast("binary").alias("key"), value.alias("value"), F.col("op").cast("byte").alias("op"), F.col("seq").alias("ordinal"), F.expr("seq * 4 DIV (_most + 1)").alias("part"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lamina-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def _loaded(spark: SparkSession, sf_dir: str, parts: int = 4, options: Options | None = None) -> KVTable:
    """A table with the first parts of the log, one version each."""
    table = KVTable(spark, scratch(spark), options or Options(auto_compact=False))
    log = _byte_log(spark, sf_dir)
    for i in range(parts):
        table.apply(log.filter(F.col("part") == i).drop("part"))
    return table


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("long").alias("seq"))


def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_loaded(spark, sf_dir).scan())


def kv_reverse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_loaded(spark, sf_dir).scan(START.encode(), END.encode(), reverse=True))


def kv_get_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key that an iterator gives, looked up."""
    table = _loaded(spark, sf_dir)
    return _shown(table.get(bytes(next(table.iterate())["key"])))


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key and as many absent ones."""
    table = _loaded(spark, sf_dir)
    keys = event_log(spark, sf_dir).select("key").distinct()
    asked = keys.union(keys.select(F.concat("key", F.lit("x")))).select(F.col("key").cast("binary").alias("key"))
    found = table.multi_get(asked)
    return _shown(found).join(found.select(F.col("key").cast("string").alias("key"), "state"), "key")


def kv_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All puts as one batch, then every key that an error names deleted, whether it is there or not."""
    table = KVTable(spark, scratch(spark), Options(auto_compact=False))
    log = _byte_log(spark, sf_dir)
    table.put(log.filter(F.col("op") == PUT).select("key", "value", "ordinal"))
    table.delete(log.filter(F.col("op") == DELETE).select("key").distinct())
    return _shown(table.scan())


def kv_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutations that are left by a compaction of everything: one put for each visible key, in its old order."""
    table = _loaded(spark, sf_dir)
    table.compact(force=True)
    rows = table.mutations()
    return _shown(rows).join(rows.select(F.col("key").cast("string").alias("key"), F.col("op").cast("int").alias("op"), F.shiftright("seq", ORDINAL_BITS).alias("version")), "key")


def kv_delta_on_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the levels after a compaction of three batches and one more batch, whose tombstones stay."""
    table = _loaded(spark, sf_dir, 3)
    table.compact(force=True)
    table.apply(_byte_log(spark, sf_dir).filter("part = 3").drop("part"))
    levels = table.files().groupBy("level").agg(F.sum("entries").alias("entries"))
    stats = table.stats().select("l1_disjoint", (F.col("l0_bytes") > 0).alias("has_delta"))
    return levels.crossJoin(F.broadcast(stats))  # one row


def kv_second_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compactions, the second over the files of the first, and a vacuum; the state is that of the log."""
    table = _loaded(spark, sf_dir, 2)
    table.compact(force=True)
    log = _byte_log(spark, sf_dir)
    for i in (2, 3):
        table.apply(log.filter(F.col("part") == i).drop("part"))
    table.compact(force=True)
    dropped = len(table.vacuum())
    return _shown(table.scan()).withColumn("vacuumed", F.lit(dropped > 0))


def kv_level_1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small files of level 1 merged into one; the rows are the same."""
    table = _loaded(spark, sf_dir, 4, Options(auto_compact=False, file_bytes=16_384))
    table.compact(force=True)
    before = table.stats().first()["l1_count"]
    table.options.file_bytes, table.options.flush_bytes, table.options.l1_ratio = 1 << 30, 1, 1
    table.compact()
    return _shown(table.scan()).withColumns({"had_several": F.lit(before > 1), "files": F.lit(table.stats().first()["l1_count"])})


def kv_as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after two of four batches."""
    return _shown(_loaded(spark, sf_dir).scan(version=2))


def kv_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as another opening of its folder sees it, with automatic compaction after every batch."""
    table = _loaded(spark, sf_dir, 4, Options(l0_threshold=1))
    with KVTable(spark, table.root) as again:
        return _shown(again.scan())


# Byte formats


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files of write-ahead log, of a thousand records or fewer."""
    rows = _byte_log(spark, sf_dir).withColumn("path", F.format_string("%012d.log", F.expr("ordinal DIV 1000")))
    return binary.encode(rows, "log", "ordinal")


def _generation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generations as sorted tables."""
    rows = _byte_log(spark, sf_dir).withColumn("path", F.expr(f"cast(ordinal DIV {WIDTH} as string)"))
    return binary.encode(newest.newest_wins(rows.drop("part"), ("path", "key"), ["ordinal"]), "tables", "key")


def wal_replay_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that all lost their last three bytes, replayed: every one gives up its last record alone."""
    torn = _segments(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, length(content) - 3)"))
    rows = binary.decode(torn, "log").withColumn("segment", scalar.file_number(F.col("file"), "log"))
    state = newest.newest_wins(rows.select("key", "op", "segment", "ordinal"), order=["segment", "ordinal"])
    return state.select(F.col("key").cast("string").alias("key"), F.col("op").cast("int").alias("op"), "segment", "ordinal")


def wal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and bytes of every segment."""
    files_ = _segments(spark, sf_dir)
    sizes = files_.select(F.col("path").alias("file"), F.length("content").cast("long").alias("bytes"))
    return binary.decode(files_, "log").groupBy("file").agg(F.count("*").alias("records")).join(sizes, "file")


def table_files_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted tables of the generations, decoded and merged."""
    rows = binary.decode(_generation_tables(spark, sf_dir), "tables").withColumn("file", F.col("file").cast("long"))
    return _shown(newest.live(newest.newest_wins(rows.select("key", "value", "op", "file"), order=["file"])))


def table_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary.footers(_generation_tables(spark, sf_dir))
    return found.select(F.col("path").cast("long").alias("file"), F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"), "entries", "blocks", "bloom")


def table_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's key, and one that is nowhere, asked of the next generation's table: what its range, its filter and its records say."""
    asked = _byte_log(spark, sf_dir).select(F.expr(f"cast(ordinal DIV {WIDTH} + 1 as string)").alias("path"), "key").distinct()
    absent = asked.select("path", F.concat("key", F.lit(b"x")).alias("key"))
    found = binary.probe(_generation_tables(spark, sf_dir), asked.union(absent)).filter("outcome IS NOT NULL")
    return found.groupBy(F.col("path").cast("long").alias("file"), "outcome").agg(F.count("*").alias("n"))


def edit_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as edit logs, encoded, decoded and folded into the live files and their levels."""
    edits = _edits(spark, sf_dir).select(F.format_string("%012d", F.expr("version DIV 1000")).alias("path"), F.col("version").alias("order"), "action", F.col("file").cast("string").alias("file"), "level")
    decoded = binary.decode(binary.encode(edits, "edits", "order"), "edits")
    return files.live_set(decoded).select(F.col("file").cast("long").alias("file"), "level")


def key_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 and FNV-1a of every key."""
    keys = event_log(spark, sf_dir).select("key").distinct()
    return keys.select("key", scalar.crc(F.col("key").cast("binary")).alias("crc"), scalar.fnv1a_column(F.col("key").cast("binary")).cast("string").alias("fnv"))


@dataclass(frozen=True)
class Case:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str


_RANGE = f"key >= '{START}' AND key < '{END}'"
_SLICES = f"{STATE}, slices AS (SELECT substr(key, 1, 5) AS file, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM newest GROUP BY 1)"
_PLACED = f"WITH {LOG}, per_file AS (SELECT * FROM (SELECT *, gen AS file, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1), placed AS (SELECT file, key, row_number() OVER (PARTITION BY file ORDER BY key) - 1 AS place FROM per_file)"
_LAST_EDIT = "SELECT o_custkey AS file, CAST(o_orderkey % 2 AS INTEGER) AS level, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders"


#: FNV-1a of `key`, of ASCII characters, in integers of 128 bits.
_FNV = f"list_reduce(list_concat([CAST({scalar.FNV_OFFSET} AS HUGEINT)], list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, b: xor(h, b) * CAST({scalar.FNV_PRIME} AS HUGEINT) % CAST({1 << 64} AS HUGEINT))"
_SIZED = "sized AS (SELECT l.gen, CAST(sum(strlen(l.key) + coalesce(strlen(e.props), 0)) AS BIGINT) AS bytes FROM log l JOIN events e ON e.event_id = l.seq GROUP BY l.gen)"


def _visible_before(condition: str) -> str:
    return f"WITH {LOG}, part AS (SELECT * FROM log WHERE {condition}) SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM part) WHERE rn = 1 AND op = 1"


CASES = (
    Case(put_latest, f"WITH {LOG} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op = 1) WHERE rn = 1"),
    Case(delete_shadow, f"{STATE} SELECT key, value FROM newest WHERE op = 1"),
    Case(delete_shadow_orders, "SELECT key, value FROM (SELECT o_custkey AS key, o_totalprice AS value, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderstatus <> 'P'"),
    Case(newest_wide, f"{STATE} SELECT key, op, seq FROM newest"),
    Case(delete_then_put_revives, f"{STATE} SELECT n.key, n.value, d.deleted_at FROM newest n JOIN (SELECT key, min(seq) AS deleted_at FROM log WHERE op = 2 GROUP BY key) d ON d.key = n.key WHERE n.op = 1 AND d.deleted_at < n.seq"),
    Case(get_hit, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND key = '000000:01'"),
    Case(get_miss, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND key = '000000:99'"),
    Case(get_deleted, f"{STATE} SELECT min(key) AS key, 'deleted' AS state FROM newest WHERE op = 2"),
    Case(multi_get, f"{STATE}, asked AS (SELECT key FROM log UNION SELECT key || 'x' FROM log) SELECT a.key, CASE WHEN n.op IS NULL THEN 'absent' WHEN n.op = 2 THEN 'deleted' ELSE 'found' END AS state, CASE WHEN n.op = 1 THEN n.value END AS value FROM asked a LEFT JOIN newest n ON n.key = a.key"),
    Case(scan_half_open, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND {_RANGE} ORDER BY key"),
    Case(scan_empty_range, f"{STATE} SELECT key, value FROM newest WHERE key >= '{START}' AND key < '{START}'"),
    Case(scan_seek, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND key >= '{END}' ORDER BY key"),
    Case(reverse_scan, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND {_RANGE} ORDER BY key DESC"),
    Case(limit_scan, f"{STATE} SELECT key, value FROM newest WHERE op = 1 AND {_RANGE} ORDER BY key LIMIT 25"),
    Case(scan_memtable_plus_files, f"WITH {LOG}, per AS (SELECT *, row_number() OVER (PARTITION BY gen % 2, key ORDER BY seq DESC) AS rn FROM log), best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen % 2 DESC) AS r2 FROM per WHERE rn = 1) SELECT key, value FROM best WHERE r2 = 1 AND op = 1 AND {_RANGE}"),
    Case(merge_three_way_rank, f"WITH {LOG}, per AS (SELECT *, seq % 3 AS rank, row_number() OVER (PARTITION BY seq % 3, key ORDER BY seq DESC) AS rn FROM log) SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS r2 FROM per WHERE rn = 1) WHERE r2 = 1"),
    Case(snapshot_as_of_seq, _visible_before(f"seq <= {2 * WIDTH}")),
    Case(wal_replay_fold, f"{STATE} SELECT key, op, seq // 1000 AS segment, seq % 1000 AS ordinal FROM newest"),
    Case(compact_drop_tombstones, f"{STATE} SELECT key, value, seq FROM newest WHERE op = 1"),
    Case(compact_keep_tombstones, f"{STATE} SELECT key, value, op, seq FROM newest"),
    Case(compact_incomplete_coverage, f"{STATE} SELECT key, value FROM newest WHERE op = 1"),
    Case(l0_to_l1_merge, f"{FILES}, chosen AS (SELECT file FROM files WHERE file >= 2 UNION SELECT f.file FROM files f, (SELECT min(min_key) AS low, max(max_key) AS high FROM files WHERE file >= 2) r WHERE f.file < 2 AND f.max_key >= r.low AND r.high >= f.min_key) SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE gen IN (SELECT file FROM chosen)) WHERE rn = 1 AND op = 1"),
    Case(l1_disjoint_untouched, f"{_SLICES} SELECT file, entries FROM slices, (SELECT min(key) AS low, max(key) AS high FROM log WHERE {_RANGE}) r WHERE NOT (max_key >= r.low AND r.high >= min_key)"),
    Case(l1_full_merge, f"{_SLICES} SELECT min(min_key) AS min_key, max(max_key) AS max_key, CAST(sum(entries) AS BIGINT) AS entries FROM slices"),
    Case(l1_overlap_check, f"{FILES} SELECT file, reach FROM (SELECT *, max(max_key) OVER (ORDER BY min_key, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM files) WHERE reach >= min_key"),
    Case(l1_locate_file, f"{_SLICES} SELECT k.key, s.file FROM (SELECT DISTINCT key FROM log) k LEFT JOIN slices s ON k.key >= s.min_key AND k.key <= s.max_key"),
    Case(file_stats, f"{FILES} SELECT file, min_key, max_key, entries FROM files"),
    Case(file_skip_for_range, f"{_SLICES} SELECT file, (max_key < '{START}' OR min_key >= '{END}') AS skipped FROM slices"),
    Case(sparse_index_every_64, f"{_PLACED} SELECT file, key, place FROM placed WHERE place % 64 = 0"),
    Case(sparse_index_floor, f"{_PLACED} SELECT p.file, p.key, i.key AS floor_key FROM placed p JOIN placed i ON i.file = p.file AND i.place = p.place - p.place % 64"),
    Case(bloom_sizing, f"{FILES}, bits AS (SELECT file, entries, greatest(8, CAST(ceil(-entries * ln(0.01) / power(ln(2), 2)) AS BIGINT)) AS bits FROM files) SELECT file, entries, bits, CAST(greatest(1, round(bits / entries * ln(2))) AS BIGINT) AS hashes FROM bits"),
    Case(flush_trigger_by_bytes, f"WITH {LOG}, {_SIZED} SELECT gen, bytes, bytes >= {FLUSH_BYTES} AS flush FROM sized"),
    Case(level_bytes, f"WITH {LOG}, {_SIZED} SELECT CASE WHEN gen = 0 THEN 1 ELSE 0 END AS level, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM sized GROUP BY 1"),
    Case(table_stats, f"{FILES} SELECT CASE WHEN file >= 2 THEN 0 ELSE 1 END AS level, count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries FROM files GROUP BY 1"),
    Case(next_sequence, f"WITH {LOG} SELECT max(gen) + 2 AS next_seq FROM log"),
    Case(manifest_live_set, f"SELECT file FROM ({_LAST_EDIT}) WHERE rn = 1 AND o_orderstatus <> 'P'"),
    Case(manifest_leveled, f"SELECT file, level FROM ({_LAST_EDIT}) WHERE rn = 1 AND o_orderstatus <> 'P'"),
    Case(chaos_verify_lost_corrupt, f"{STATE}, expected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE op = 1) WHERE r = 1) SELECT CAST(coalesce(sum(CASE WHEN n.key IS NOT NULL AND n.value IS NOT DISTINCT FROM e.value THEN 1 ELSE 0 END), 0) AS BIGINT) AS verified, CAST(coalesce(sum(CASE WHEN n.key IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS lost, CAST(coalesce(sum(CASE WHEN n.key IS NOT NULL AND n.value IS DISTINCT FROM e.value THEN 1 ELSE 0 END), 0) AS BIGINT) AS corrupt FROM expected e LEFT JOIN (SELECT * FROM newest WHERE op = 1) n ON n.key = e.key"),
    Case(key_sizes, f"{STATE} SELECT substr(key, 1, 6) AS \"user\", CAST(sum(strlen(key) + coalesce(strlen(e.props), 0)) AS BIGINT) AS bytes, min(key) AS first, max(key) AS last FROM newest n JOIN events e ON e.event_id = n.seq WHERE op = 1 GROUP BY 1"),
    Case(kv_scan, f"{STATE} SELECT key, seq FROM newest WHERE op = 1"),
    Case(kv_reverse_range, f"{STATE} SELECT key, seq FROM newest WHERE op = 1 AND {_RANGE} ORDER BY key DESC"),
    Case(kv_get_first, f"{STATE} SELECT key, seq FROM newest WHERE op = 1 ORDER BY key LIMIT 1"),
    Case(kv_multi_get, f"{STATE}, asked AS (SELECT key FROM log UNION SELECT key || 'x' FROM log) SELECT a.key, CASE WHEN n.op IS NULL THEN 'absent' WHEN n.op = 2 THEN 'deleted' ELSE 'found' END AS state, CASE WHEN n.op = 1 THEN n.seq END AS seq FROM asked a LEFT JOIN newest n ON n.key = a.key"),
    Case(kv_put_delete, f"WITH {LOG} SELECT key, max(seq) AS seq FROM log WHERE op = 1 AND key NOT IN (SELECT key FROM log WHERE op = 2) GROUP BY key"),
    Case(kv_compacted, f"{STATE} SELECT key, seq, op, seq * 4 // ((SELECT max(seq) FROM log) + 1) + 1 AS version FROM newest WHERE op = 1"),
    Case(kv_delta_on_compacted, f"WITH {LOG}, quarters AS (SELECT *, seq * 4 // ((SELECT max(seq) FROM log) + 1) AS part FROM log), old AS (SELECT key, arg_max(op, seq) AS op FROM quarters WHERE part < 3 GROUP BY key) SELECT 1 AS level, count(*) AS entries, true AS l1_disjoint, true AS has_delta FROM old WHERE op = 1 UNION ALL SELECT 0, count(*), true, true FROM quarters WHERE part = 3"),
    Case(kv_second_compaction, f"{STATE} SELECT key, seq, true AS vacuumed FROM newest WHERE op = 1"),
    Case(kv_level_1_merge, f"{STATE} SELECT key, seq, true AS had_several, 1 AS files FROM newest WHERE op = 1"),
    Case(kv_as_of_version, _visible_before("seq * 4 // ((SELECT max(seq) FROM log) + 1) < 2").replace("key, value FROM", "key, seq FROM")),
    Case(kv_reopened, f"{STATE} SELECT key, seq FROM newest WHERE op = 1"),
    Case(wal_replay_torn, f"WITH {LOG}, kept AS (SELECT *, seq // 1000 AS segment FROM log WHERE seq NOT IN (SELECT max(seq) FROM log GROUP BY seq // 1000)) SELECT key, op, segment, ordinal FROM (SELECT *, seq - min(seq) OVER (PARTITION BY segment) AS ordinal, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kept) WHERE rn = 1"),
    Case(wal_records, f"WITH {LOG} SELECT printf('%012d.log', seq // 1000) AS file, count(*) AS records, CAST(sum(13 + strlen(key) + CASE WHEN op = 1 THEN strlen(CAST(seq AS VARCHAR)) ELSE 0 END) AS BIGINT) AS bytes FROM log GROUP BY 1"),
    Case(table_files_merge, f"{STATE} SELECT key, seq FROM newest WHERE op = 1"),
    Case(table_footers, f"WITH {LOG} SELECT gen AS file, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS entries, (count(DISTINCT key) + 63) // 64 AS blocks, true AS bloom FROM log GROUP BY gen"),
    Case(table_probes, f"""WITH {LOG}, t AS (SELECT gen AS file, min(key) AS low, max(key) AS high, count(DISTINCT key) AS n FROM log GROUP BY gen),
sized AS (SELECT *, (greatest(8, CAST(ceil(-n * ln(0.01) / power(ln(2), 2)) AS BIGINT)) + 7) // 8 * 8 AS slots, CAST(greatest(1, floor(greatest(8, ceil(-n * ln(0.01) / power(ln(2), 2))) / n * ln(2) + 0.5)) AS BIGINT) AS k FROM t),
asked AS (SELECT DISTINCT gen + 1 AS file, key FROM log UNION ALL SELECT DISTINCT gen + 1, key || 'x' FROM log),
hashed AS (SELECT key, {_FNV} AS h FROM (SELECT DISTINCT key FROM asked UNION SELECT DISTINCT key FROM log)),
halves AS (SELECT key, CAST(h // 4294967296 AS BIGINT) AS high, CAST(h % 4294967296 AS BIGINT) AS low FROM hashed),
bits AS (SELECT s.file, list(DISTINCT p) AS ps FROM (SELECT DISTINCT gen, key FROM log) l JOIN sized s ON s.file = l.gen JOIN halves h ON h.key = l.key, unnest(list_transform(range(s.k), lambda i: (h.high + i * h.low) % 4294967296 % s.slots)) AS u(p) GROUP BY s.file),
probed AS (SELECT a.file, a.key, s.low, s.high, list_transform(range(s.k), lambda i: (h.high + i * h.low) % 4294967296 % s.slots) AS own, b.ps, EXISTS (SELECT 1 FROM log l WHERE l.gen = a.file AND l.key = a.key) AS there
  FROM asked a JOIN sized s ON s.file = a.file JOIN halves h ON h.key = a.key JOIN bits b ON b.file = a.file)
SELECT file, CASE WHEN key < low OR key > high THEN 'range' WHEN NOT list_has_all(ps, own) THEN 'filter' WHEN there THEN 'found' ELSE 'absent' END AS outcome, count(*) AS n FROM probed GROUP BY ALL"""),
    Case(edit_log_replay, f"SELECT file, level FROM ({_LAST_EDIT}) WHERE rn = 1 AND o_orderstatus <> 'P'"),
    Case(key_checksums, f"""WITH {LOG}, t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)
SELECT key, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc, CAST({_FNV} AS VARCHAR) AS fnv FROM (SELECT DISTINCT key FROM log), t"""),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {case.query.__name__: case.query for case in CASES}


def oracle_sql() -> dict[str, str]:
    return {case.query.__name__: case.sql for case in CASES}
