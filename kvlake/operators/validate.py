"""Consistency of table metadata (id, level, size, entry_count, min_key, max_key), as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_ids(tables: DataFrame) -> DataFrame:
    return tables.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def misordered(tables: DataFrame) -> DataFrame:
    """Tables whose least key is beyond the largest, and, below level 0, tables that overlap one before."""
    before = Window.partitionBy("level").orderBy("min_key", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = tables.withColumn("reached", F.max("max_key").over(before))
    inverted = F.col("min_key") > F.col("max_key")
    overlaps = (F.col("level") > 0) & (F.col("min_key") <= F.col("reached"))
    return seen.where(inverted | F.coalesce(overlaps, F.lit(False))).select("id", "level", F.when(inverted, "inverted").otherwise("overlaps").alias("violation"))


def inconsistent(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Levels whose number of tables differs between two metadata tables."""
    count = lambda df, name: df.groupBy("level").agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "expected").join(count(found, "found"), "level", "full_outer")
    return both.select("level", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected != found")


def all_violations(tables: DataFrame, next_id: int) -> DataFrame:
    """Every violation as (check, id, detail)."""
    ids = duplicate_ids(tables).select(F.lit("duplicate id").alias("check"), "id", F.col("n").cast("string").alias("detail"))
    order = misordered(tables).select(F.lit("key order").alias("check"), "id", F.col("violation").alias("detail"))
    late = tables.where(F.col("id") >= next_id).select(F.lit("next id").alias("check"), "id", F.lit(str(next_id)).alias("detail"))
    return ids.unionByName(order).unionByName(late)
