"""Files as rows: their key ranges, which of them overlap, hold a key or can be skipped."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.schema import ADDED


def file_stats(rows: DataFrame, by: Sequence[str] = ("file",), key: str = "key") -> DataFrame:
    """Smallest and largest key and the number of entries of every file."""
    return rows.groupBy(*by).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entries"))


def combined_range(files: DataFrame) -> DataFrame:
    """The range that holds all files, as one row."""
    return files.agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def overlaps(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> Column:
    """Whether two closed ranges share a key."""
    return (max_a >= min_b) & (max_b >= min_a)


def overlapping_neighbours(files: DataFrame) -> DataFrame:
    """Files that start at or before the largest key of an earlier file, by smallest key.

    A running maximum finds every file that breaks the order without comparing all pairs. The file list
    is metadata, one row for each file.
    """
    order = Window.orderBy("min_key", "file")
    reach = F.max("max_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("reach", reach).filter(F.col("reach") >= F.col("min_key")).select("file", "min_key", "max_key", "reach")


def overlapping(files: DataFrame, by: DataFrame) -> DataFrame:
    """Files of `files` that overlap the combined range of `by`, which is one row."""
    bounds = combined_range(by).select(F.col("min_key").alias("_low"), F.col("max_key").alias("_high"))
    return files.join(F.broadcast(bounds), overlaps(F.col("min_key"), F.col("max_key"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def skip_for_range(files: DataFrame, start: object, end: object) -> DataFrame:
    """Every file with whether a scan of [start, end) can leave it out."""
    return files.withColumn("skipped", (F.col("max_key") < F.lit(start)) | (F.col("min_key") >= F.lit(end)))


#: Bounds that go with the tasks, at most.
BOUNDS = 50_000


def locate(keys: DataFrame, files: DataFrame, key: str = "key", most: int = BOUNDS) -> DataFrame:
    """Each key with the file of a disjoint set that may hold it; keys between files have none.

    A key's file is the last that starts at or before it, if it ends there or later. The first keys of every n-th
    file, `most` of them at most, go with the tasks and deal keys and files into ranges; where that is every file, each
    range has one, else a window over a range's keys and files finds it. So no key meets more than the files of a range.
    """
    many = files.count()
    every = max(1, -(-many // most))
    starts = [r["min_key"] for i, r in enumerate(files.select("min_key").orderBy("min_key").toLocalIterator()) if i % every == 0]
    bounds = np.array(starts, dtype=object)

    @F.pandas_udf("int")
    def range_of(column: pd.Series) -> pd.Series:
        """The last bound at or before each value, -1 before all."""
        there = column.notna().to_numpy()
        out = np.full(len(column), -1)
        out[there] = np.searchsorted(bounds, column[there].to_numpy(dtype=object), side="right") - 1
        return pd.Series(out)

    dealt = keys.withColumn("_range", range_of(key))
    own = files.select("min_key", F.col("max_key").alias("_max"), F.col("file"), range_of("min_key").alias("_range"))
    if every == 1:
        found = dealt.join(own.drop("min_key"), "_range", "left")
    else:
        names = keys.columns
        rows = dealt.select("_range", F.col(key).alias("_at"), F.lit(1).alias("_kind"), F.struct(*names).alias("_row"), F.lit(None).alias("_max"), F.lit(None).cast("string").alias("file"))
        marks = own.select("_range", F.col("min_key").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).alias("_row"), "_max", "file")
        order = Window.partitionBy("_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("_kind") == 0, F.struct("_max", "file")), ignorenulls=True).over(order)
        found = marks.unionByName(rows).withColumn("_last", last).filter("_kind = 1").select("_row.*", F.col("_last._max").alias("_max"), F.col("_last.file").alias("file"))
    return found.select(*keys.columns, F.when(F.col(key) <= F.col("_max"), F.col("file")).alias("file"))


def live_set(edits: DataFrame, order: Sequence[str] = ("version", "ordinal")) -> DataFrame:
    """The files whose newest edit adds them, with the level of that edit, by name."""
    carried = [c for c in edits.columns if c != "file"]
    last = edits.groupBy("file").agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("_edit"))
    return last.filter(F.col("_edit.action") == ADDED).select("file", *[F.col(f"_edit.{c}").alias(c) for c in carried if c == "level"]).orderBy("file")


def sparse_index(rows: DataFrame, every: int = 64, by: str = "file", key: str = "key") -> DataFrame:
    """The first and then every `every`-th key of each file, with its place from 0."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    return rows.select(by, key, place.alias("place")).filter(F.col("place") % every == 0)


def level_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
