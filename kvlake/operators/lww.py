"""Last write wins over a log of mutations: key columns, value columns, a sequence number and a delete flag.

The newest mutation of a key is that of the largest sequence number. Aggregation combines on the map side, so that a key
with any share of the log costs a row for each task. Filters on keys pass below it to the scan; filters on values or the
delete flag belong behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_of(df: DataFrame, keys: list[str], values: list[str], seq: str, is_delete=None) -> DataFrame:
    """A mutation log of any table: its keys and values, seq and is_delete."""
    return df.select(*keys, *values, F.col(seq).cast("bigint").alias("seq"), (F.lit(False) if is_delete is None else is_delete).alias("is_delete"))


def latest(log: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """The newest mutation of each key, deletes included. One aggregate for each column stays a hash aggregate where
    values have a fixed width; a null of the newest mutation wins."""
    values = values if values is not None else [c for c in log.columns if c not in (*keys, "seq", "is_delete")]
    return log.groupBy(*keys).agg(*(F.max_by(c, "seq").alias(c) for c in values), F.max_by("is_delete", "seq").alias("is_delete"), F.max("seq").alias("seq"))


def live(log: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """The newest value of each key that isn't deleted."""
    return latest(log, keys, values).where(~F.col("is_delete")).drop("is_delete")


def merged(sources: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Sources from newest to oldest as one: of equal keys the first source's wins."""
    ranked = [s.select(*keys, *values, F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(*(F.min_by(c, "rank").alias(c) for c in values), F.min("rank").alias("source"))


def duplicate_seqs(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several mutations of the same sequence number, whose order isn't defined."""
    return log.groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
