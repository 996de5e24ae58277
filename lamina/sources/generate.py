"""Rows made from numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.scalar import sample_key, sample_value


def sample_rows(spark: SparkSession, n: int) -> DataFrame:
    """n puts with keys `key:%08d` and values `val:%08d`."""
    return spark.range(n).select(sample_key(F.col("id")).cast("binary").alias("key"), sample_value(F.col("id")).cast("binary").alias("value"))
