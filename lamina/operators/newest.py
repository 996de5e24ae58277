"""Newest-wins resolution: which mutation of a key counts.

Tombstones take part in the choice and go afterwards; to drop them first would bring deleted keys back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.schema import DELETE, PUT


def newest_wins(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """One row for each key: the one whose `order` is largest. Partial aggregation runs before the shuffle.

    Of rows with equal orders the one with the largest other columns wins, from left to right, so the result does not
    hang on chance; a null is smaller than any value. All columns of `df` are carried through the aggregate, so select
    those that are needed first; they must have an order, which maps have not.
    """
    names = {x for x in order if isinstance(x, str)}
    carried = [c for c in df.columns if c not in keys and c not in names]
    fields = [(F.col(x) if isinstance(x, str) else x).alias(f"_{i}") for i, x in enumerate(order)]
    newest = F.max(F.struct(*fields, *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])).alias("_row")
    place = {x: f"_row._{i}" for i, x in enumerate(order) if isinstance(x, str)} | {c: f"_row.c{i}" for i, c in enumerate(carried)}
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(place[c]).alias(c) for c in df.columns if c not in keys])


def newest_wins_wide(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """As `newest_wins`, as a rank of one: for rows with many columns, whose groups are limited before the shuffle.

    Of rows with equal orders any one wins.
    """
    rank = Window.partitionBy(*keys).orderBy(*[F.col(x).desc() for x in order])
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def live(df: DataFrame) -> DataFrame:
    """Rows of resolved state that are not deleted."""
    return df.filter(F.col("op") == PUT)


def visible(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """The state that a reader sees."""
    return live(newest_wins(df, keys, order))


def ranked(sources: Sequence[DataFrame]) -> DataFrame:
    """The union of sources given newest first, with `rank` 0 for the newest."""
    if not sources:
        raise ValueError("no sources")
    out = sources[0].withColumn("rank", F.lit(0))
    for i, source in enumerate(sources[1:], 1):
        out = out.unionByName(source.withColumn("rank", F.lit(i)))
    return out


def merge(sources: Sequence[DataFrame], keys: Sequence[str] = ("key",), drop_tombstones: bool = False) -> DataFrame:
    """One row for each key from sources given newest first; a lower rank wins.

    Drop tombstones only if no older mutation of their keys is outside the sources.
    """
    merged = newest_wins(ranked(sources), keys, [-F.col("rank")]).drop("rank")
    return live(merged) if drop_tombstones else merged


def as_of(df: DataFrame, seq: int) -> DataFrame:
    """The mutations up to and including `seq`."""
    return df.filter(F.col("seq") <= seq)


def lookup_state(op: Column) -> Column:
    """found, deleted or absent, from the op of a key's newest row (null if there is none)."""
    return F.when(op.isNull(), "absent").when(op == DELETE, "deleted").otherwise("found")
