"""Sorted runs: Parquet files range-partitioned and sorted by key, with metadata for pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.ranges import KeyRange
from kvlake.sources.files import Files
from kvlake.sources.manifest import TableMeta

LOG_SCHEMA = "key binary, value binary, seq bigint, is_delete boolean"
COLUMNS = ["key", "value", "seq", "is_delete"]


@dataclass(frozen=True)
class RunFormat:
    """Bytes of a row group and of a page of runs and log batches, and their compression. Pages have checksums."""

    row_group_bytes: int = 128 << 20
    page_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        """Of Parquet's writer. Version 2 pages without a dictionary hold keys as DELTA_BYTE_ARRAY: a key is the length of
        the prefix that it shares with the one before, and the rest."""
        return {
            "compression": self.codec, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#key": "false",
            "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes),
        }


def write_observed(rows: DataFrame, path: str, run_format: RunFormat, **more) -> dict:
    """Writes rows (LOG_SCHEMA) in place of what is at path. Returns entries, min_key, max_key, max_seq and the aggregates
    asked for, which are taken from the rows as they are written."""
    seen = Observation()
    aggregates = {"entries": F.count(F.lit(1)), "min_key": F.min("key"), "max_key": F.max("key"), "max_seq": F.max("seq")} | more
    rows.select(*COLUMNS).observe(seen, *(a.alias(n) for n, a in aggregates.items())).write.mode("overwrite").options(**run_format.options()).parquet(path)
    return seen.get


def write_run(rows: DataFrame, path: str, table_id: int, level: int, *, run_format: RunFormat | None = None, ranged: bool = False) -> TableMeta | None:
    """Writes rows (LOG_SCHEMA, a row for each key) as a run; None if there are none. Sorted files keep the ranges of row
    groups and pages narrow, so that key filters skip them, and let keys share prefixes. ranged: the rows are already
    partitioned by ranges of keys."""
    rows = rows if ranged else rows.repartitionByRange("key")
    seen = write_observed(rows.sortWithinPartitions("key"), path, run_format or RunFormat())
    files = Files(rows.sparkSession)
    if not seen["entries"]:
        files.delete(path)
        return None
    return TableMeta(table_id, level, files.size(path), seen["entries"], bytes(seen["min_key"]), bytes(seen["max_key"]), seen["max_seq"])


def read_paths(spark: SparkSession, paths: list[str], *, verify: bool = False) -> DataFrame:
    """Rows of runs and log batches. verify: pages' checksums are compared, and a wrong one is an error."""
    reader = spark.read.schema(LOG_SCHEMA).option("parquet.page.verify-checksum.enabled", str(verify).lower())
    return reader.parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def pruned(tables: list[TableMeta], within: KeyRange) -> list[TableMeta]:
    """Runs whose keys can lie in the range; files of the others aren't opened."""
    return [t for t in tables if within.meets(t.min_key, t.max_key)]


def run_metadata(rows: DataFrame, run: str, key: str, size=None) -> DataFrame:
    """Metadata of runs given as a column: entries, least and largest key of each."""
    aggregates = [F.count(F.lit(1)).alias("entry_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key")]
    return rows.groupBy(run).agg(*aggregates, *([F.sum(size).alias("size")] if size is not None else []))


def runs_for(metadata: DataFrame, key) -> DataFrame:
    """The runs that can hold a key."""
    return metadata.where((F.col("min_key") <= key) & (F.col("max_key") >= key))


def sparse_index(rows: DataFrame, block: str, key: str) -> DataFrame:
    """The first key of each block."""
    return rows.groupBy(block).agg(F.min(key).alias("first_key"))


def find_block(index: DataFrame, target, block: str) -> DataFrame:
    """The block that can hold target: that of the largest first key up to it, or none below all."""
    return index.where(F.col("first_key") <= target).agg(F.max_by(block, "first_key").alias(block), F.max("first_key").alias("first_key")).where(F.col(block).isNotNull())


def blocks_in(index: DataFrame, within: KeyRange) -> DataFrame:
    """The blocks of a sparse index that can hold keys in the range: from that of the largest first key up to the start, or
    the first of all, to the last one that begins before the end."""
    first = F.col("first_key")
    found = index if within.end is None else index.where(first <= within.end if within.end_included else first < within.end)
    if within.start is None:
        return found
    begin = index.where(first <= within.start).agg(F.max("first_key").alias("_begin"))
    return found.join(F.broadcast(begin), F.col("_begin").isNull() | (first >= F.col("_begin"))).drop("_begin")  # one row
