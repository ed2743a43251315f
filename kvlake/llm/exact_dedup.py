"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256. A batch is reduced to one row for each digest before anything is
shuffled, a sort-merge anti-join with the index keeps the new digests, and those are appended: the batch is dealt out
with the index's own number of buckets, so neither the join nor the append moves the index. compact() makes one sorted
file of each bucket, which the join then reads as it is.

The index lives in a folder, beside numbered commits that name its number of buckets and the subfolder of its table; it
has one writer at a time. A batch has an id, which its rows in the index carry. A batch that comes again under the id it
had, because its result was lost after its digests had joined the index, gets the result it had.

Defined cases: a null text counts as empty; of equal texts in a batch the row with the largest doc_id stays (a null
doc_id is the smallest); rows that repeat doc_id and text are one document, of which add() returns one row (that of the
largest hash of its other columns) and verdicts() returns each row with the same verdict. An empty batch gives no rows.
Extra columns are carried by add() whatever their names.

Everything here is DataFrame operations.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.sources.files import Files

from . import common

#: Lets a scan of a bucketed table with one file for each bucket keep the files' order.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """digest, keep_id, group_size, batch: one row for each text seen, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, location: str | None = None, *, buckets: int | None = None):
        """Opens the index at location, or makes one (a temporary one in the shared folder if None). buckets is fixed when
        an index is made: take about one for each 100 MB of index expected; the default is the session's shuffle
        partitions. An index that exists has its own number, and another one asked for is an error."""
        self.spark, self.files, self.temporary = spark, Files(spark), location is None
        self.location = (location or common.scratch(spark, "digest-index")).rstrip("/")
        self.files.make_dir(f"{self.location}/commits")
        if not (found := self._commits()):
            self._commit(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
            found = self._commits()
        self.number = found[-1]
        state = json.loads(self.files.read(f"{self.location}/commits/{self.number:08d}.json"))
        self.buckets = state["buckets"]
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {self.location} has {self.buckets} buckets")
        self.name = self._table(state["folder"])

    def _commits(self) -> list[int]:
        return [int(n[:8]) for n in self.files.names(f"{self.location}/commits") if n.endswith(".json")]

    def _folder(self, number: int) -> str:
        return f"digests-{number:08d}"

    def _commit(self, number: int, buckets: int) -> None:
        if not self.files.put_if_absent(f"{self.location}/commits/{number:08d}.json", json.dumps({"buckets": buckets, "folder": self._folder(number)})):
            raise RuntimeError(f"another writer has made commit {number} of {self.location}")

    def _table(self, folder: str) -> str:
        """The name under which the session knows the table in folder."""
        name = f"kvlake_digests_{uuid.uuid4().hex}"
        self.files.make_dir(f"{self.location}/{folder}")
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/{folder}'"
        )
        return name

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Plans made here take the order of the index's files where a bucket has one."""
        before = self.spark.conf.get(SORTED_SCANS)
        self.spark.conf.set(SORTED_SCANS, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SORTED_SCANS, before)

    def unseen(self, batch: DataFrame, on: str = "digest", *, batch_id: str | None = None) -> DataFrame:
        """The rows of batch, which has one row for each digest, that the index lacks, besides what it has of batch_id."""
        known = self.table()
        known = known.where(F.col("batch") != batch_id) if batch_id is not None else known
        return batch.repartition(self.buckets, on).join(known.select(F.col("digest").alias(on)).hint("merge"), on, "left_anti")

    def append(self, groups: DataFrame, batch_id: str | None = None) -> None:
        """Adds rows of digest, keep_id, group_size whose digests are new, without those that it has of batch_id."""
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch_id or uuid.uuid4().hex).alias("batch"))
        begun = self.table().where(F.col("batch") == batch_id) if batch_id is not None else None
        if begun is not None and not begun.isEmpty():
            rows = rows.repartition(self.buckets, "digest").join(begun.select("digest").hint("merge"), "digest", "left_anti").select(*rows.columns)
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self) -> None:
        """One sorted file for each bucket. Readers of the files before must be done."""
        self.files.delete(f"{self.location}/{self._folder(self.number + 1)}")  # of a writer that didn't finish
        next_one = self._table(self._folder(self.number + 1))
        # From the files: of the bucketed table Spark may leave out the dealing, and then read it without its buckets.
        rows = self.spark.read.schema(self.table().schema).parquet(f"{self.location}/{self._folder(self.number)}")
        rows.repartition(self.buckets, "digest").write.insertInto(next_one)
        self._commit(self.number + 1, self.buckets)
        before, self.name = self.name, next_one
        self.spark.sql(f"DROP TABLE IF EXISTS {before}")
        self.files.delete(f"{self.location}/{self._folder(self.number)}")
        self.number += 1

    def close(self) -> None:
        """Ends the session's use of the index; a temporary one goes."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.temporary:
            self.files.delete(self.location)

    def drop(self) -> None:
        """Deletes the index."""
        self.close()
        self.files.delete(self.location)

    def add(self, batch: DataFrame, *, batch_id: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of batch to keep: of each text that the index lacks the row with the largest id. Its digests join
        the index. Which rows these are is a written table, so that the result doesn't change as the index grows; texts
        are shuffled once. With a batch_id, a batch that comes again gives the same rows."""
        since, batch_id = common.made(), batch_id or uuid.uuid4().hex
        rest = [F.col(f"`{c}`") for c in batch.columns if c not in (id_col, text_col)]
        keys = ["_digest", "_id", "_rest"]
        keyed = batch.select(F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("_row"), digest(F.col(text_col)).alias("_digest"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.lit(0), *rest).alias("_rest"))
        seen = common.written(keyed.select(*keys), "exact-dedup-keys")
        groups = seen.groupBy("_digest").agg(F.max(F.struct("_id", "_rest")).alias("_best"), F.count(F.lit(1)).alias("_size"))
        groups = common.written(groups, "exact-dedup-groups")  # else the anti-join would go below the aggregate, where keys are hot
        with self._in_order():
            fresh = common.written(self.unseen(groups, "_digest", batch_id=batch_id), "exact-dedup")
            self.append(fresh.select(F.col("_digest").alias("digest"), F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size")), batch_id)
        # Rows alike in all that is compared: one of them must be taken, which is rarely needed.
        repeats = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_repeated"))
        best = fresh.select("_digest", F.col("_best._id").alias("_id"), F.col("_best._rest").alias("_rest"))
        same = [best[c].eqNullSafe(repeats[c]) for c in keys]
        chosen = best.join(repeats, same[0] & same[1] & same[2], "left").select(best["_digest"].alias("d"), best["_id"].alias("i"), best["_rest"].alias("r"), F.coalesce("_repeated", F.lit(False)).alias("_repeated"))
        chosen = common.finished(chosen, "exact-dedup-chosen", since)
        kept = keyed.join(chosen, (keyed["_digest"] == chosen["d"]) & keyed["_id"].eqNullSafe(chosen["i"]) & (keyed["_rest"] == chosen["r"]))
        if chosen.where("_repeated").isEmpty():
            return kept.select("_row.*")
        once = kept.where("_repeated").groupBy(*keys).agg(F.first("_row").alias("_row"))
        return kept.where("NOT _repeated").select("_row.*").unionByName(once.select("_row.*"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """documents without all but one row of each text, through a fresh index."""
    index = DigestIndex(documents.sparkSession)
    kept = index.add(documents)
    index.close()
    return kept


def verdicts(documents: DataFrame, index: DigestIndex | None = None, *, batch_id: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents, as a written table, against an index (a
    fresh one by default) that has the digests of documents afterwards. A row whose text the index had before isn't kept,
    and keep_id and group_size are then the index's. With a batch_id, documents that come again get the same verdicts."""
    own, since, batch_id = index is None, common.made(), batch_id or uuid.uuid4().hex
    index = index or DigestIndex(documents.sparkSession)
    seen = common.written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    groups = seen.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = common.written(groups, "digest-groups")  # else the anti-join would go below the aggregate, where keys are hot
    with index._in_order():
        index.append(common.written(index.unseen(groups, batch_id=batch_id), "digests-new"), batch_id)

        # Of the index only the batch's digests, and hot are those with many rows in the batch.
        sizes = groups.select("digest", F.col("group_size").alias("in_batch")).repartition(index.buckets, "digest")
        known = common.written(index.table().join(sizes.hint("merge"), "digest"), "digests-known")
    found = common.join_salted(seen, known, "digest", F.col("in_batch"), seen.count(), F.col("doc_id")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch_id)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    found = common.finished(found, "verdicts", since)
    if own:
        index.close()
    return found


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
