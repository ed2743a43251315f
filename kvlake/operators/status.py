"""One-row health reports over table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(tables: DataFrame, *, log_batches: int = 0, log_bytes: int = 0, compactions: int = 0) -> DataFrame:
    """Counts and sizes of a store; too_many_batches and too_many_compactions are its warnings."""
    return tables.agg(
        F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("size"), F.lit(0)).alias("table_bytes"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("entries"),
        F.coalesce(F.max("level") + 1, F.lit(0)).cast("bigint").alias("levels"), F.coalesce(F.sum((F.col("level") == 0).cast("bigint")), F.lit(0)).alias("level0_tables"),
        F.coalesce(F.max("id") + 1, F.lit(0)).alias("next_table_id"),
    ).select("*", F.lit(log_batches).alias("log_batches"), F.lit(log_bytes).alias("log_bytes"), F.lit(compactions).alias("compactions"), F.lit(log_batches > 10).alias("too_many_batches"), F.lit(compactions > 2).alias("too_many_compactions"))
