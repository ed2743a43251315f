"""Token counts of documents from flat token files, by a scan for separators.

A token file is nothing but unsigned integers of two or four bytes, little-endian; every document ends with an
end-of-document id, and there is no index. Files are cut into blocks of bytes; each block is searched for separators as
an array and gives their places. Stitching is a prefix scan over the blocks of a file: how many separators come before
a block, and where the last of them is, so that a document may span any number of blocks. Only a row for each block takes
part in the scan.

Files are written and read through Arrow's file systems, which takes the shared folder's URI. A task that writes names
its file anew each time; files of tasks that were lost or repeated aren't in the list that the writing query returns, and
are never read.

Defined cases: a file without bytes has no documents; tokens behind the last separator are a last document that isn't
complete; a file whose size isn't a whole number of tokens is refused; null texts are empty documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Bytes in a block.
BLOCK_BYTES = 8 << 20
#: The byte-level vocabulary's end-of-document id.
SEPARATOR = 50256

_TYPES = {2: "<u2", 4: "<u4"}


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], *, folder: str, vocabulary: str, kind: str, separator: int, width: int) -> Iterator[pa.RecordBatch]:
    encode, end = bpe.encoder(vocabulary, kind).encode, np.asarray([separator], _TYPES[width]).tobytes()
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    name, n, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
    for batch in batches:
        out = out or system.open_output_stream(f"{root}/{name}")
        for text in batch.column("text").to_pylist():
            ids = np.frombuffer(encode(text or ""), "<u4")
            if len(ids) and (int(ids.max()) >= 1 << (8 * width) or (ids == separator).any()):
                raise ValueError("an id that doesn't fit the width, or the separator within a text")
            out.write(ids.astype(_TYPES[width]).tobytes())
            out.write(end)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(np.arange(n, n + rows)), batch.column("doc_id")], names=["file", "number", "doc_id"])
        n += rows
    if out:
        out.close()


def write_tokens(documents: DataFrame, folder: str, *, vocabulary: str, kind: str = "byte", separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Writes flat token files to folder (a URI) and returns a written table of file, number (of the document in its
    file, from 0) and doc_id: which documents the files hold, not where."""
    common.python_workers(documents.sparkSession)
    rows = common.spread(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.written(rows.mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary, kind=kind, separator=separator, width=width), "file string, number bigint, doc_id bigint"), "token-files")


def _sizes(batches: Iterator[pa.RecordBatch], *, folder: str, width: int) -> Iterator[pa.RecordBatch]:
    system, root = _opened(folder)
    for batch in batches:
        names = batch.column("file").to_pylist()
        sizes = [i.size for i in system.get_file_info([f"{root}/{n}" for n in names])]
        for name, size in zip(names, sizes, strict=True):
            if size is None or size % width:
                raise ValueError(f"{name} isn't a whole number of tokens")
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "size"])


def _scan(batches: Iterator[pa.RecordBatch], *, folder: str, separator: int, width: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    system, root = _opened(folder)
    for batch in batches:
        for name, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True):
            with system.open_input_file(f"{root}/{name}") as f:
                ids = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), _TYPES[width])
            places = np.flatnonzero(ids == separator) + block * (block_bytes // width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([block], pa.int64()), pa.array([size // width], pa.int64()), pa.array([places.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n_tokens", "places"]
            )


def count_tokens(files: DataFrame, folder: str, *, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, number, start, n_tokens (without the separator), complete for every document in the files of folder that
    files (file) names."""
    spark = files.sparkSession
    common.python_workers(spark)
    block_bytes -= block_bytes % width
    sizes = files.select("file").distinct().mapInArrow(partial(_sizes, folder=folder, width=width), "file string, size bigint").where("size > 0")
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes))))
    found = common.written(
        blocks.repartition("file", "block").mapInArrow(partial(_scan, folder=folder, separator=separator, width=width, block_bytes=block_bytes), "file string, block bigint, n_tokens bigint, places array<bigint>"), "separators"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = found.select("file", "block", "n_tokens", F.size("places").alias("n"), F.try_element_at("places", F.lit(-1)).alias("last"))
    stitched = ends.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry")
    )
    ended = found.join(stitched, ["file", "block"]).where(F.size("places") > 0)
    pairs = F.arrays_zip(F.concat(F.array("carry"), F.slice("places", 1, F.size("places") - 1)).alias("from"), F.col("places").alias("to"))
    ended = ended.select("file", "first", F.posexplode(pairs).alias("i", "p"))
    complete = ended.select("file", (F.col("first") + F.col("i")).alias("number"), (F.col("p.from") + 1).alias("start"), (F.col("p.to") - F.col("p.from") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    tails = ends.groupBy("file").agg(F.sum("n").alias("number"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.max("n_tokens").alias("end")).where("last < end - 1")
    return complete.unionByName(tails.select("file", "number", (F.col("last") + 1).alias("start"), (F.col("end") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("complete")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (without the separator) of all documents, counted from flat files of their tokens."""
    folder, since = common.scratch(spark, "tokens"), common.made()
    held = write_tokens(common.table(spark, sf_dir, "documents"), folder, vocabulary=bpe.byte_vocabulary())
    counts = count_tokens(held, folder).where("complete")  # the separators are written: the files may go
    common.remove(spark, folder)
    return common.finished(held.join(counts, ["file", "number"]).select("doc_id", "n_tokens"), "token-counts", since)
