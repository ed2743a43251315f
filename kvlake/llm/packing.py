"""Packing of tokenised documents into sequences of a fixed size: best-fit decreasing with certified bounds.

Pieces are dealt out by hash, and each group is packed by best-fit decreasing: pieces from the longest to the shortest,
each into the sequence it fills best. The group's lower bound is the largest that the dual feasible functions give (the
identity, and for each threshold the function that counts pieces above capacity less the threshold as whole and drops
those below it). A group whose sequences equal its bound is certified and passes on only its emptiest sequence; a group
with a gap passes on every sequence that isn't full. What was passed on is dealt out again, whole sequences at a time, to
fewer groups, so that documents of different groups meet; there best-fit decreasing runs again, and its result replaces
the old sequences only where it has fewer of them. Groups stay small enough for a worker (MOST_PIECES). Rounds end when
nothing was saved, one group is left or ROUNDS are over. Each piece tells whether its last group was certified, and
certificate() gives the bound for all pieces together.

Defined cases: a null text is empty and is the end id alone; documents that repeat a doc_id are pieces of their own, told
apart by an order of their texts' hashes; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY = 2048
#: Pieces in a group at first and, on average, at most; the factor by which groups get fewer from round to round; the most
#: rounds.
GROUP_PIECES = 20_000
MOST_PIECES = 200_000
FEWER = 16
ROUNDS = 6
#: Stands for a null doc_id while pieces are packed.
NO_ID = -(2**63)

PIECE = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECE}, sequence_id bigint, offset bigint, passed_on boolean, saved bigint, certified boolean"


def _pieces(batches: Iterator[pa.RecordBatch], *, vocabulary: str, kind: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end = bpe.encoder(vocabulary, kind).encode, np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            ids = memoryview(encode(text) + end)
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append((doc_id, row, piece, at // 4, len(own) // 4, zlib.crc32(own)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
    common.release_memory()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length. Open sequences are kept by their free space, and a bit mask of the free spaces
    that occur finds the best fit at once."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, at, opened = capacity, opened, opened + 1
        sequence[i], offset[i] = at, capacity - free
        if left := free - size:
            by_free[left].append(at)
            mask |= 1 << left
    return sequence, offset


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most sequences that a dual feasible function proves necessary."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The same for numbers of pieces by length. With threshold t up to half the capacity, pieces over capacity - t take a
    whole sequence, pieces below t none, and the others their length."""
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    t = np.arange(capacity // 2 + 1)
    below = np.maximum(t - 1, 0)
    whole = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[below], 0)
    return int(np.max(whole + -(-middle // capacity)))


def _place(pdf: pd.DataFrame, *, capacity: int, number: int) -> pd.DataFrame:
    """Packs a group. Rows that come in sequences keep them unless fewer do."""
    pdf = pdf.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], ignore_index=True)
    lengths = pdf["length"].to_numpy()
    sequence, offset = best_fit_decreasing(lengths, capacity)
    n, had = int(sequence.max()) + 1, pdf["sequence_id"].nunique() if number else 0
    pdf["saved"] = max(had - n, 0) if number else 0
    if number and n >= had:
        codes, ids = pd.factorize(pdf["sequence_id"])
        sequence, n = codes.astype(np.int64), had
        out_ids = np.asarray(ids, np.int64)
    else:
        pdf["offset"] = offset
        out_ids = (number << 56) + (int(pdf["group"].iloc[0]) << 24) + np.arange(n, dtype=np.int64)
    pdf["sequence_id"] = out_ids[sequence]
    filled = np.bincount(sequence, weights=lengths, minlength=n)
    pdf["certified"] = certified = n <= lower_bound(lengths, capacity)
    passed = filled < capacity
    if certified:
        passed &= np.arange(n) == np.argmin(filled)
    pdf["passed_on"] = passed[sequence]
    return pdf[[c.split()[0] for c in PLACED.split(", ")]]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces (the columns of PIECE; a written table)."""
    common.python_workers(pieces.sparkSession)
    rows = pieces.count()
    pieces = pieces.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))  # pandas would turn ids with nulls into doubles
    groups = max(1, -(-rows // GROUP_PIECES))
    open_rows = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn("group", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)))
    final = None

    def placer(number: int):
        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            return _place(pdf, capacity=capacity, number=number)

        return place

    for number in range(ROUNDS):
        placed = common.written(open_rows.groupBy("group").applyInPandas(placer(number), PLACED), f"packed-{number}")
        last = placed.agg(F.sum(F.col("passed_on").cast("long")), F.max("saved")).first()
        over = groups == 1 or number == ROUNDS - 1 or not last[0] or number > 1 and not last[1]
        kept = placed if over else placed.where(~F.col("passed_on"))
        final = kept if final is None else final.unionByName(kept)
        if over:
            break
        # Where most is passed on, groups don't get fewer for ever: they must fit a worker, and each round deals anew.
        groups = max(-(-last[0] // MOST_PIECES), min(groups // FEWER, -(-last[0] // GROUP_PIECES)), 1)
        open_rows = placed.where("passed_on").drop("passed_on", "saved", "certified").withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
    return final.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))).drop("passed_on", "saved")


def certificate(packed: DataFrame, *, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and the fewest that the dual feasible functions prove necessary: they need the number
    of pieces of each length only, which are no more than capacity rows."""
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    lengths = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        lengths[r["length"]] = r["n"]
    return packed.select("sequence_id").distinct().count(), bound_of(lengths, capacity)


def pieces_of(documents: DataFrame, *, vocabulary: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of documents (doc_id, text), as a written table."""
    common.python_workers(documents.sparkSession)
    rows = common.spread(documents).select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("row", F.xxhash64("text"))
    return common.written(rows.select("doc_id", "row", "text").mapInArrow(partial(_pieces, vocabulary=vocabulary, kind=kind, end_id=end_id, capacity=capacity), PIECE), "pieces")


def pack_documents(documents: DataFrame, *, vocabulary: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of documents and their places, as a written table."""
    since = common.made()
    packed = pack(pieces_of(documents, vocabulary=vocabulary, kind=kind, end_id=end_id, capacity=capacity), capacity=capacity)
    return common.finished(packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"), "packed", since)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), vocabulary=bpe.word_vocabulary())
