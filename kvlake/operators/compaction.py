"""Tiered compaction: which level, and the merge itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.lww import latest


@dataclass(frozen=True)
class CompactionConfig:
    """Level 0 is due beyond level0_threshold tables; a deeper one with max_tables or more if it is the last or holds
    size_ratio times the next one's bytes (in whole numbers; the next one counts as a byte at least)."""

    level0_threshold: int = 4
    size_ratio: int = 10
    max_tables: int = 10


def level_due(levels: Sequence[tuple[int, int]], config: CompactionConfig) -> int | None:
    """The first level that is due, of levels given as (tables, bytes)."""
    for level, (tables, size) in enumerate(levels):
        if level == 0:
            if tables > config.level0_threshold:
                return 0
        elif tables >= config.max_tables:
            last = level == len(levels) - 1
            if last or size // max(levels[level + 1][1], 1) >= config.size_ratio:
                return level
    return None


def due_levels(tables: DataFrame, config: CompactionConfig) -> DataFrame:
    """The same over table metadata (level, size): one row with the first level that is due, or none. Levels are few."""
    levels = tables.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("size").alias("size"))
    order = Window.orderBy("level")
    beside = levels.withColumn("next_size", F.lead("size").over(order)).withColumn("last", F.lead("level").over(order).isNull())
    ratio = F.expr("size div greatest(next_size, 1)") >= config.size_ratio
    due = F.when(F.col("level") == 0, F.col("tables") > config.level0_threshold).otherwise((F.col("tables") >= config.max_tables) & (F.col("last") | F.coalesce(ratio, F.lit(False))))
    return beside.where(due).agg(F.min("level").alias("level")).where("level IS NOT NULL")


def merge(runs: DataFrame, *, drop_deletes: bool, ranged: bool = False) -> DataFrame:
    """The newest mutation of each key of runs (key, value, seq, is_delete). Deletes may go only if nothing older is left
    that they hide. ranged: runs are dealt out by ranges of keys once, which serves the aggregate and the sorted run it
    becomes. That is for runs, where a key has a row in each at most; a log's hot keys are combined before the shuffle."""
    runs = runs.repartitionByRange("key") if ranged else runs
    found = latest(runs, ["key"], ["value"]).select("key", "value", "seq", "is_delete")
    return found.where(~F.col("is_delete")) if drop_deletes else found
