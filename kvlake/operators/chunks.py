"""Time chunks: fixed intervals of a timestamp column as a partition column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(df: DataFrame, ts: str, width: str = "1 hour") -> DataFrame:
    """df with the start of each row's chunk."""
    return df.withColumn("chunk", F.window(ts, width)["start"])


def rollup(df: DataFrame, ts: str, values: list[str], width: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Number, sum, least and largest of values in each chunk."""
    aggregates = [f(c).alias(f"{name}_{c}") for c in values for name, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    return chunked(df, ts, width).groupBy("chunk", *(by or [])).agg(F.count(F.lit(1)).alias("n"), *aggregates)
