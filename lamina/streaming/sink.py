"""Streams into tables, and the newest state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lamina.operators.newest import newest_wins
from lamina.plans.table import KVTable


def write_stream(mutations: DataFrame, table: KVTable, name: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch of (key, value, op, ordinal) as one version.

    The commit carries the stream's name and batch number, so a batch that is delivered again after a
    failure is not written twice. Within a batch only the newest mutation of a key is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.apply(newest_wins(batch, order=["ordinal"]).select("key", "value", "op", "ordinal"), stream=(name, number))

    return mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)


def newest_state(mutations: DataFrame) -> DataFrame:
    """The newest mutation of every key of a stream, kept as aggregation state; write it in update mode."""
    newest = F.max_by(F.struct("value", "op", "seq"), "seq").alias("_row")
    return mutations.groupBy("key").agg(newest).select("key", "_row.value", "_row.op", "_row.seq")
