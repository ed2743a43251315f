"""An ordered key/value store in a folder: log batches, sorted runs in levels, and a manifest.

  wal/<batch>/      mutations as they came, durable once Spark has committed the folder; _batch.json has their range of keys
  sst/<table>/      sorted runs
  manifest/<n>.json commits
  lock              held by the one writer

Every mutation has a sequence number, which grows with the batch and, within it, with the order of writing; reads take
the largest for each key, from all runs that can hold it and all batches that aren't flushed. A delete is a mutation too,
and differs from an empty value.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.ranges import KeyRange, prefix_range
from kvlake.operators import compaction, lww, scan, status, validate
from kvlake.sources.files import Files
from kvlake.sources.manifest import FORMAT, TABLE_META, Edit, Manifest, State, TableMeta, check_format
from kvlake.sources.runs import COLUMNS, LOG_SCHEMA, RunFormat, pruned, read_paths, write_observed, write_run

LOG = logging.getLogger("kvlake")
#: Sequence numbers of a batch.
BATCH_SEQS = 1 << 32


class ReadOnlyError(Exception):
    """The store is closed, or another one writes to it."""


class InvalidInputError(ValueError):
    """A mutation that can't be stored."""


class BusyError(Exception):
    """The same operation is running."""


@dataclass(frozen=True)
class StoreConfig:
    """max_buffer_bytes: key and value bytes of single writes that are held before they become a log batch. verify: reads
    compare the checksums of pages."""

    max_buffer_bytes: int = 64 << 20
    compaction: compaction.CompactionConfig = field(default_factory=compaction.CompactionConfig)
    run_format: RunFormat = field(default_factory=RunFormat)
    verify: bool = False


@dataclass(frozen=True)
class BatchMeta:
    """Entries and the range of keys of a log batch; without entries there are no keys. entries is None where a writer died
    before it noted them: then any key can be there. repeats: a key may have any number of rows."""

    entries: int | None = None
    min_key: bytes | None = None
    max_key: bytes | None = None
    repeats: bool = True

    def to_json(self) -> str:
        keys = {n: k.hex() if k is not None else None for n, k in (("min_key", self.min_key), ("max_key", self.max_key))}
        return json.dumps({"format": FORMAT, "entries": self.entries, "repeats": self.repeats} | keys)

    @classmethod
    def from_json(cls, text: str) -> BatchMeta:
        d = json.loads(text)
        check_format(d)
        return cls(d["entries"], *(bytes.fromhex(d[n]) if d[n] is not None else None for n in ("min_key", "max_key")), d.get("repeats", True))

    def meets(self, within: KeyRange) -> bool:
        return self.entries is None or self.entries > 0 and within.meets(self.min_key, self.max_key)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None, *, read_only: bool = False, break_lock: bool = False):
        """Opens or makes the store at path. Only one store at a time may be open for writing; break_lock takes the lock
        of a writer that is known to be dead."""
        self.spark, self.path, self.config, self.files = spark, path.rstrip("/"), config or StoreConfig(), Files(spark)
        for d in ("wal", "sst"):
            self.files.make_dir(f"{self.path}/{d}")
        self._writes = not read_only
        if self._writes:
            if break_lock:
                self.files.delete(f"{self.path}/lock")
            owner = f"{os.getpid()} {uuid.uuid4().hex}"
            if not self.files.put_if_absent(f"{self.path}/lock", owner):
                raise ReadOnlyError(f"{self.path} is open for writing: {self.files.read(f'{self.path}/lock')}")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self.state: State = self.manifest.state()
        self._buffer: list[tuple[bytes, bytes | None, bool]] = []
        self._buffered = 0
        self._batches = self._unflushed()
        self._metas = {b: self._meta(b) for b in self._batches}
        self._next_batch = max([self.state.flushed_wal, *self._batches, *(t.max_seq // BATCH_SEQS for t in self.state.tables.values())], default=-1) + 1
        self._running, self._mutex = Counter(), threading.Lock()

    def _unflushed(self) -> list[int]:
        """Committed log batches that no flush has taken, from the oldest."""
        names = (n for n in self.files.names(f"{self.path}/wal") if n.isdigit())
        return [int(n) for n in names if int(n) > self.state.flushed_wal and self.files.exists(f"{self.path}/wal/{n}/_SUCCESS")]

    def _batch(self, batch: int) -> str:
        return f"{self.path}/wal/{batch:08d}"

    def _meta(self, batch: int) -> BatchMeta:
        path = f"{self._batch(batch)}/_batch.json"
        return BatchMeta.from_json(self.files.read(path)) if self.files.exists(path) else BatchMeta()

    @contextmanager
    def _only(self, operation: str) -> Iterator[None]:
        """Guards an operation: it runs once at a time, and counts as running until it ends, however it does."""
        with self._mutex:
            if self._running[operation]:
                raise BusyError(operation)
            self._running[operation] += 1
        try:
            yield
        finally:
            self._running[operation] -= 1

    def is_operation_safe(self) -> bool:
        """Whether no flush and no compaction is running."""
        return not any(self._running.values())

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Makes what was written durable and gives the lock back."""
        if self._writes:
            self.sync()
            self.files.delete(f"{self.path}/lock")
            self._writes = False

    def _check(self) -> None:
        if not self._writes:
            raise ReadOnlyError(self.path)

    # Writes

    def _mutate(self, key: bytes, value: bytes | None, is_delete: bool) -> None:
        self._check()
        if key is None or value is None and not is_delete:
            raise InvalidInputError("a key and a value are needed")
        self._buffer.append((bytes(key), value, is_delete))
        self._buffered += len(key) + len(value or b"")
        if self._buffered >= self.config.max_buffer_bytes:
            self.sync()

    def set(self, key: bytes, value: bytes) -> None:
        """Sets a key. Durable after sync()."""
        self._mutate(key, value, False)

    def delete(self, key: bytes) -> None:
        self._mutate(key, None, True)

    def sync(self) -> None:
        """Makes single writes durable, as a log batch."""
        self._check()
        if self._buffer:
            rows = self.spark.createDataFrame([(k, v, i, d) for i, (k, v, d) in enumerate(self._buffer)], "key binary, value binary, place bigint, is_delete boolean")
            self._append(rows, repeats=False)  # no more than the buffer holds
            self._buffer, self._buffered = [], 0

    def _append(self, rows: DataFrame, *, repeats: bool) -> int:
        """Writes rows of key, value, place, is_delete as the next log batch. Rows that can't be stored are counted as they
        are written; with any, the batch goes again."""
        batch = self._next_batch
        path, low = self._batch(batch), batch * BATCH_SEQS
        numbered = rows.select("key", "value", (F.lit(low) + F.col("place")).alias("seq"), "is_delete")
        bad = F.col("key").isNull() | F.col("seq").isNull() | ~F.col("seq").between(low, low + BATCH_SEQS - 1) | F.col("is_delete").isNull() | F.col("value").isNull() & ~F.col("is_delete")
        seen = write_observed(numbered, path, self.config.run_format, bad=F.count_if(bad))
        if seen["bad"]:
            self.files.delete(path)
            raise InvalidInputError("keys, values and the order of writing must be given")
        meta = BatchMeta(seen["entries"], *(bytes(seen[n]) if seen[n] is not None else None for n in ("min_key", "max_key")), repeats)
        self.files.put_if_absent(f"{path}/_batch.json", meta.to_json())
        self._next_batch += 1
        self._batches.append(batch)
        self._metas[batch] = meta
        return batch

    def write(self, rows: DataFrame, *, order: str | None = None, batch_id: int | None = None) -> int | None:
        """Appends a table of key, value and perhaps is_delete as one log batch, at any size. order gives the order of
        writing of equal keys, below 2**32; without it keys must be distinct. With a batch_id that was written before
        nothing happens: a stream's batch may come again. Returns the batch's number."""
        self._check()
        if batch_id is not None and self.files.exists(f"{self.path}/ingested/{batch_id}"):
            return None
        self.sync()
        is_delete = F.col("is_delete") if "is_delete" in rows.columns else F.lit(False)
        place = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
        taken = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), place.alias("place"), is_delete.alias("is_delete"))
        batch = self._append(taken, repeats=order is not None)
        if not lww.duplicate_seqs(read_paths(self.spark, [self._batch(batch)]), ["key"]).isEmpty():
            del self._metas[self._batches.pop()]
            self.files.delete(self._batch(batch))
            raise InvalidInputError("equal keys have an order")
        if batch_id is not None:
            self.files.make_dir(f"{self.path}/ingested")
            self.files.put_if_absent(f"{self.path}/ingested/{batch_id}", str(batch))
        return batch

    # Reads

    def log(self, within: KeyRange | None = None, *, version: int | None = None) -> DataFrame:
        """All mutations that can concern the range; of a commit's tables alone, if version names one."""
        tables = self.state if version is None else self.manifest.state(version)
        paths = [self._table(t.id) for t in pruned(list(tables.tables.values()), within or KeyRange())]
        if version is None:
            paths += [self._batch(b) for b in self._batches if self._metas[b].meets(within or KeyRange())]
        found = read_paths(self.spark, paths, verify=self.config.verify)
        if version is None and self._buffer:
            low = self._next_batch * BATCH_SEQS
            held = self.spark.createDataFrame([(k, v, low + i, d) for i, (k, v, d) in enumerate(self._buffer)], LOG_SCHEMA)
            found = found.unionByName(held)
        return found

    def _table(self, table_id: int) -> str:
        return f"{self.path}/sst/{table_id:08d}"

    def get(self, key: bytes) -> bytes | None:
        rows = scan.get(self.log(KeyRange(key, key, end_included=True)), bytearray(key)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def scan(self, within: KeyRange | None = None, *, ordered: bool = True, version: int | None = None) -> DataFrame:
        """key, value of the range, in the order of keys."""
        within = within or KeyRange()
        plain = KeyRange(*(bytearray(b) if b is not None else None for b in (within.start, within.end)), within.start_included, within.end_included)
        return scan.scan(self.log(within, version=version), plain, ordered=ordered).select("key", "value")

    def scan_prefix(self, prefix: bytes, *, ordered: bool = True) -> DataFrame:
        return self.scan(prefix_range(prefix), ordered=ordered)

    def view(self, name: str) -> None:
        """Registers the live rows for SQL."""
        self.scan(ordered=False).createOrReplaceTempView(name)

    # Maintenance

    def flush(self) -> bool:
        """Log batches to one run of level 0; False if there are none. The run counts from the commit on, and the
        batches go behind it. Batches of distinct keys are shuffled once, by ranges; of others hot keys are combined first."""
        self._check()
        with self._only("flush"):
            self.sync()
            batches = list(self._batches)
            if not batches:
                return False
            ranged = not any(self._metas[b].repeats for b in batches)
            merged = compaction.merge(read_paths(self.spark, [self._batch(b) for b in batches], verify=self.config.verify), drop_deletes=False, ranged=ranged)
            table_id = self._new_table()
            meta = write_run(merged, self._table(table_id), table_id, 0, run_format=self.config.run_format, ranged=ranged)
            self.state = self.manifest.commit(Edit("flush", wal_ids=batches, added=[meta] if meta else []), self.state)
            self._batches = [b for b in self._batches if b not in batches]
            for b in batches:
                self.files.delete(self._batch(b))
                del self._metas[b]
            return True

    def _new_table(self) -> int:
        """An id whose folder isn't there; leftovers of a run that was never committed go."""
        table_id = self.state.next_table_id
        self.files.delete(self._table(table_id))
        return table_id

    def level_due(self) -> int | None:
        return compaction.level_due([(len(x), sum(t.size for t in x)) for x in self.state.levels()], self.config.compaction)

    def needs_flush(self) -> bool:
        return bool(self._batches or self._buffer)

    def needs_compaction(self) -> bool:
        return self.level_due() is not None

    def compact(self) -> bool:
        """Merges the tables of the level that is due, and those of the next one that overlap them, into a run of the next
        level; False if none is due. Deletes go when no older table can hold their keys."""
        self._check()
        with self._only("compaction"):
            return self._compact()

    def _compact(self) -> bool:
        level = self.level_due()
        if level is None:
            return False
        levels = self.state.levels()
        inputs = list(levels[level])
        whole = KeyRange(min(t.min_key for t in inputs), max(t.max_key for t in inputs), end_included=True)
        if level + 1 < len(levels):
            inputs += pruned(levels[level + 1], whole)
        reach = KeyRange(min(t.min_key for t in inputs), max(t.max_key for t in inputs), end_included=True)
        older = [t for deeper in levels[level + 2 :] for t in pruned(deeper, reach)]
        job = self.state.seq + 1
        self.state = self.manifest.commit(Edit("begin_compaction", job_id=job, source_level=level, target_level=level + 1), self.state)
        merged = compaction.merge(read_paths(self.spark, [self._table(t.id) for t in inputs], verify=self.config.verify), drop_deletes=not older, ranged=True)
        table_id = self._new_table()
        meta = write_run(merged, self._table(table_id), table_id, level + 1, run_format=self.config.run_format, ranged=True)
        edit = Edit("commit_compaction", job_id=job, source_level=level, target_level=level + 1, deleted=[t.id for t in inputs], added=[meta] if meta else [])
        self.state = self.manifest.commit(edit, self.state)
        for t in inputs:
            self.files.delete(self._table(t.id))
        return True

    # Reports

    def tables(self) -> DataFrame:
        """Metadata of all tables."""
        rows = [(t.id, t.level, t.size, t.entry_count, t.min_key, t.max_key) for t in self.state.tables.values()]
        return self.spark.createDataFrame(rows, TABLE_META)

    def log_batches(self) -> DataFrame:
        """batch, entries, size, min_key, max_key of the log batches that no flush has taken."""
        rows = [(b, self._metas[b].entries, self.files.size(self._batch(b)), self._metas[b].min_key, self._metas[b].max_key) for b in self._batches]
        return self.spark.createDataFrame(rows, "batch bigint, entries bigint, size bigint, min_key binary, max_key binary")

    def status(self) -> DataFrame:
        size = sum(self.files.size(self._batch(b)) for b in self._batches) + self._buffered
        return status.status(self.tables(), log_batches=len(self._batches), log_bytes=size, compactions=self._running["compaction"])

    def metrics(self) -> dict:
        """Sizes, counts and running operations, which go to the log as well."""
        levels = self.state.levels()
        found = {
            "buffer_bytes": self._buffered, "log_batches": len(self._batches), "flush_running": bool(self._running["flush"]), "compactions_running": self._running["compaction"],
            "next_table_id": self.state.next_table_id, "next_batch": self._next_batch, "level_tables": [len(x) for x in levels], "level_bytes": [sum(t.size for t in x) for x in levels],
        }
        LOG.info("metrics of %s: %s", self.path, found)
        return found

    def violations(self) -> DataFrame:
        return validate.all_violations(self.tables(), self.state.next_table_id)


__all__ = ["BusyError", "COLUMNS", "InvalidInputError", "KeyRange", "ReadOnlyError", "Store", "StoreConfig", "TableMeta"]
