"""Point lookups, lookups of many keys and ordered half-open range scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.newest import lookup_state, newest_wins, visible
from lamina.schema import InvalidRangeError


def key_range(start: object | None, end: object | None, key: str = "key") -> Column:
    """start <= key < end; a missing bound is open. Catalyst pushes it to the scan, through the resolution."""
    if start is not None and end is not None and start > end:
        raise InvalidRangeError(f"{start!r} is above {end!r}")
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(key) >= F.lit(start))
    if end is not None:
        out = out & (F.col(key) < F.lit(end))
    return out


def get(mutations: DataFrame, key: object) -> DataFrame:
    """The visible row of a key: one or none."""
    return visible(mutations.filter(F.col("key") == F.lit(key)))


def scan(mutations: DataFrame, start: object | None = None, end: object | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """The visible rows of a range in the order of their keys."""
    rows = visible(mutations.filter(key_range(start, end)))
    rows = rows.orderBy(F.col("key").desc() if reverse else F.col("key"))
    return rows if limit is None else rows.limit(limit)


def multi_get(mutations: DataFrame, keys: DataFrame, carried: Sequence[str] = ("value",)) -> DataFrame:
    """Every distinct key of `keys` with its state (found, deleted, absent) and what is found.

    Mutations of other keys go before the resolution, so it handles what was asked for alone; which
    join does that is left to the optimizer, that knows the sizes.
    """
    asked = keys.select("key").distinct()
    newest = newest_wins(mutations.join(asked, "key", "left_semi")).select("key", "op", *carried)
    state = lookup_state(F.col("op"))
    return asked.join(newest, "key", "left").select("key", state.alias("state"), *[F.when(state == "found", F.col(c)).alias(c) for c in carried])


def verify(expected: DataFrame, mutations: DataFrame) -> DataFrame:
    """How many expected (key, value) rows are verified, lost or corrupt in the visible state, as one row."""
    seen = visible(mutations).select("key", F.col("value").alias("_seen"), F.lit(True).alias("_there"))
    joined = expected.select("key", "value").join(seen, "key", "left")
    lost = F.col("_there").isNull()
    same = F.col("value").eqNullSafe(F.col("_seen"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias
    return joined.agg(count(~lost & same)("verified"), count(lost)("lost"), count(~lost & ~same)("corrupt"))
