"""Row shapes and what they allow.

A mutation is a row (key, value, op, seq): `op` is PUT or DELETE, `seq` orders the mutations of a key, and
the value is null only where the key is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 2
ADDED, REMOVED = 1, 2
#: Bytes that a key or a value may have.
FIELD_LIMIT = 64 << 20

MUTATION = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("op", T.ByteType(), False), T.StructField("seq", T.LongType(), False)])
FILE = T.StructType([T.StructField("file", T.StringType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("min_key", T.BinaryType()), T.StructField("max_key", T.BinaryType()), T.StructField("entries", T.LongType()), T.StructField("bytes", T.LongType())])


class InvalidRangeError(ValueError):
    """The start of a range is above its end."""


class InvalidMutationError(ValueError):
    """A batch has a null key, a field above the limit or two mutations of a key in no order."""


class HousekeepingError(Exception):
    """The batch is committed, but what follows a commit failed; `__cause__` says why."""


class ConflictError(Exception):
    """Another writer committed the version first."""


class CorruptError(ValueError):
    """Bytes that are not what their format says."""


def tombstone(op: Column | str = "op") -> Column:
    return (F.col(op) if isinstance(op, str) else op) == DELETE


def op_for(deleted: Column) -> Column:
    """The op of a mutation that deletes or puts."""
    return F.when(deleted, F.lit(DELETE)).otherwise(F.lit(PUT)).cast("byte")


def puts(df: DataFrame) -> DataFrame:
    """(key, value, op) of a batch of puts; a null value is the empty one."""
    return df.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), F.lit(PUT).cast("byte").alias("op"), *_order(df))


def deletes(df: DataFrame) -> DataFrame:
    """(key, value, op) of a batch of deletes; keys that were never put are allowed."""
    return df.select(F.col("key").cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), F.lit(DELETE).cast("byte").alias("op"), *_order(df))


def _order(df: DataFrame) -> list[Column]:
    return [F.col("ordinal").cast("long").alias("ordinal")] if "ordinal" in df.columns else []


def invalid(batch: DataFrame) -> Column:
    """Why a row of a batch cannot be written, null if it can."""
    return (
        F.when(F.col("key").isNull(), "null key")
        .when(F.length("key") > FIELD_LIMIT, "key above the limit")
        .when(F.length("value") > FIELD_LIMIT, "value above the limit")
        .when(~F.col("op").isin(PUT, DELETE), "unknown op")
    )
