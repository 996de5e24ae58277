"""Shards by extendible hashing, in DataFrame operations only.

Every row has a 64-bit hash. A directory entry is a prefix of the hash, of as many bits as its depth. All
rows start in one bucket of depth 0; a bucket above the byte limit is split on the next bit, and only
such a bucket, until every bucket fits or holds one row (it is then marked oversized). A split whose rows all go one
way leaves an empty bucket on the other, which has its entry as well, so that any hash has exactly one.

The hash is of the key and the content, so that a hot key splits. Rows that are equal in both share a hash and go
together while they fit; where they do not, no bit would split them, and their number among the rows goes into
their hash too.

The first bits are decided from sums over hash prefixes, which are pre-aggregated on the map side (there are 2**`STEP`
prefixes for each shard, about) and give all the depths at once; buckets that are too large even then are split
further, one step of bits at a time, over their own rows alone.

Defined cases: a null text has no bytes; a text above the limit is an oversized shard of its own; null keys are
hashed like any other value; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import cut, salted_join

#: Bytes of text in a shard, at most.
LIMIT = 8 << 20
#: Bits decided by one pass over pre-aggregated sums.
STEP = 4
BITS = 64


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _prefix(value: Column, depth: int) -> Column:
    """The first `depth` bits of a 64-bit value, as a number."""
    return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")


def leaves(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets of the depths `low` to `high` that need no split, from `sums` (prefix, bytes, rows, hashes, first).

    `sums` has prefixes of `high` bits below buckets of depth `low` that are too large. A bucket is final
    if it fits while the one above it does not; at depth `high` the others are returned too, as not final.
    """
    by_depth = sums.withColumn("depth", F.explode(F.sequence(F.lit(low + 1), F.lit(high))))
    by_depth = by_depth.withColumn("prefix", F.expr(f"shiftrightunsigned(prefix, {high} - depth)"))
    buckets = by_depth.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))
    above = buckets.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_above"), fits.alias("_done"))
    joined = buckets.withColumn("_above", F.shiftrightunsigned("prefix", 1)).join(above, ["depth", "_above"], "left")
    there = joined.filter(~F.coalesce("_done", F.lit(False)))
    decided = there.filter(fits | (F.col("depth") == high)).select("depth", "prefix", "bytes", "rows", "low", "high", fits.alias("final"))
    lone = there.groupBy("depth", "_above").agg(F.count("*").alias("n"), F.first("prefix").alias("prefix")).filter("n = 1")
    none = F.lit(0).cast("long")
    empty = lone.select("depth", F.col("prefix").bitwiseXOR(F.lit(1)).alias("prefix"), none.alias("bytes"), none.alias("rows"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(True).alias("final"))
    return decided.unionByName(empty)


def directory(hashes: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """depth, prefix, bytes, rows, low, high (the hashes that it holds), oversized of every shard, from `hashes` (hash, bytes).

    The driver holds the number of the depth alone; what is too large stays distributed. Cut `hashes` before.
    """
    total = hashes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    many = max(1, -(-total // limit))
    depth, high = 0, min(BITS - 1, many.bit_length() + step)
    summed = (F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    columns = ("depth", "prefix", "bytes", "rows", "low", "high")
    if total <= limit:
        whole = hashes.groupBy(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")).agg(*summed)
        return whole.select(*columns, F.lit(False).alias("oversized"))
    found, rest = None, hashes
    while True:
        sums = rest.groupBy(_prefix(F.col("hash"), high).alias("prefix")).agg(*summed)
        decided = cut(leaves(sums, depth, high, limit))
        final = decided.filter("final")
        found = final if found is None else found.union(final)
        open_ones = decided.filter("NOT final")
        if high == BITS - 1 or open_ones.isEmpty():
            break
        rest = cut(rest.withColumn("_prefix", _prefix(F.col("hash"), high)).join(open_ones.select(F.col("prefix").alias("_prefix")), "_prefix", "left_semi").select("hash", "bytes"))
        depth, high = high, min(BITS - 1, high + step)
    if high == BITS - 1:
        found = found.union(open_ones)
    return found.select(*columns, (F.col("bytes") > limit).alias("oversized"))


def assign(docs: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """doc_id, bytes, shard (its prefix bits; empty if there is one shard), depth, shard_bytes, oversized of every row.

    The directory is matched depth by depth: each depth that it has is one equi-join key, so a row meets exactly
    one entry.
    """
    rows = cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), row_hash(*keys).alias("hash"), F.monotonically_increasing_id().alias("row")))
    shards = cut(directory(rows, limit))
    stuck = shards.filter("oversized AND rows > 1").select(F.col("low").alias("hash"), F.lit(True).alias("stuck"))
    if not stuck.isEmpty():
        rows = cut(salted_join(rows, stuck, "hash", "row", "left").select("doc_id", "bytes", F.when(F.col("stuck"), F.xxhash64("hash", "row")).otherwise(F.col("hash")).alias("hash"), "row"))
        shards = cut(directory(rows, limit))
    depths = [r["depth"] for r in shards.select("depth").distinct().orderBy("depth").collect()]  # 64 at most
    ladder = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("hash"), d).alias("prefix")) for d in depths]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    probes = rows.withColumn("_probe", F.explode(ladder)).select("doc_id", "bytes", F.col("_probe.depth").alias("depth"), F.col("_probe.prefix").alias("prefix"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    entries = shards.filter("rows > 0").select("depth", "prefix", F.col("bytes").alias("shard_bytes"), "oversized")
    return probes.join(entries, ["depth", "prefix"]).select("doc_id", "bytes", bits.alias("shard"), "depth", "shard_bytes", "oversized")
