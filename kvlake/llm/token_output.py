"""Token ids as Parquet list columns, for selective reads.

Documents are dealt out by ranges of doc_id and sorted, so that the files hold them in ascending order and the row
groups' and pages' minima and maxima of doc_id are narrow. part and row number the ranges and the documents in each, in
the files' order. ids is a list of 32-bit integers; n_tokens stands beside it, so that counts need no ids. Dictionary encoding stores an id of a 50k vocabulary in 16 bits; delta encoding is the other
choice. Row-group and page sizes are parameters; Parquet's writer adds column and offset indexes.

Files are committed by Spark's writer: a lost executor's tasks write theirs again and nothing partial is read.

Defined cases: null text is empty; every document gets the end id; rows with the same doc_id are in the order of their
texts' hashes; null doc_ids come first; an empty table makes a data set without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

SCHEMA = "part int, row bigint, doc_id bigint, n_tokens bigint, ids array<int>"
#: Documents in a range.
ROWS_EACH = 1 << 18

#: Encodings of the writer. Version 2 pages without a dictionary hold integers as DELTA_BINARY_PACKED.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def _encode(batches: Iterator[pa.RecordBatch], *, vocabulary: str, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end, row = bpe.encoder(vocabulary, kind).encode, np.asarray([end_id], dtype="<u4").tobytes(), 0
    for batch in batches:
        found = [encode(text or "") + end for text in batch.column("text").to_pylist()]
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        values = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(found))])
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), pa.array(np.arange(row, row + len(n))), batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values)],
            names=["part", "row", "doc_id", "n_tokens", "ids"],
        )
        row += len(n)


def write_ids(documents: DataFrame, path: str, *, vocabulary: str, kind: str = "byte", end_id: int = 0, encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 1000, codec: str = "zstd") -> None:
    """Encodes documents (doc_id, text) and writes them to path."""
    common.python_workers(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    ranges = common.partitions_for(documents.sparkSession, documents.count(), ROWS_EACH)
    rows = rows.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = rows.withColumn("part", F.spark_partition_id()).mapInArrow(partial(_encode, vocabulary=vocabulary, kind=kind, end_id=end_id), SCHEMA)
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows), "compression": codec}
    ids.write.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, row, doc_id, n_tokens, ids. Columns not selected aren't read; filters on doc_id skip row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy() * 4
        view = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(offsets) // 4, pa.int64()), pa.array(crc, pa.int64())],
            names=["part", "row", "doc_id", "n_tokens", "ids_crc32"],
        )


def positions(lengths: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before, to rows of part, row, n_tokens. Sums run within the parts, which hold a
    bounded number of documents; only a row for each part meets in one place."""
    totals = lengths.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select("part", F.coalesce(F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, "part").withColumn("start", F.col("_before") + F.col("_within"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, since = common.scratch(spark, "token-ids"), common.made()
    write_ids(common.table(spark, sf_dir, "documents"), path, vocabulary=bpe.byte_vocabulary())
    read = common.written(read_ids(spark, path).mapInArrow(_checksums, "part int, row bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"), "token-checksums")
    common.remove(spark, path)
    return common.finished(positions(read).select("doc_id", "start", "n_tokens", "ids_crc32"), "token-positions", since)
