"""Continuous ingest and periodic maintenance of a store, by Structured Streaming; a scheduler of background tasks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kvlake.store import Store

LOG = logging.getLogger("kvlake")


def maintain(store: Store, *, flush_batches: int = 1) -> None:
    """Flushes once there are so many log batches, then compacts while a level is due."""
    if len(store._batches) >= flush_batches:
        store.flush()
    while store.compact():
        pass


def ingest(stream: DataFrame, store: Store, *, checkpoint: str, order: str | None = None, every: str | None = None, flush_batches: int = 4) -> StreamingQuery:
    """Appends each micro-batch of stream (key, value, perhaps is_delete) to the store, once even if it is run again, and
    maintains the store. every: the interval; without one, all that is there is taken and the query ends."""

    def take(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, order=order, batch_id=batch_id)
        maintain(store, flush_batches=flush_batches)

    return _start(stream, take, checkpoint, every)


def periodic(spark, task: Callable[[int], None], *, checkpoint: str, every: str) -> StreamingQuery:
    """Runs task(run) at an interval until the query is stopped. Errors of a run are logged and the next one follows."""

    def run(_: DataFrame, batch_id: int) -> None:
        try:
            task(batch_id)
        except Exception:
            LOG.exception("run %d failed", batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return _start(ticks, run, checkpoint, every)


class Scheduler:
    """Background tasks of a session, which end together."""

    def __init__(self, spark: SparkSession, checkpoints: str):
        """checkpoints: a folder for the state of periodic tasks."""
        self.spark, self.checkpoints = spark, checkpoints.rstrip("/")
        self._queries: list[StreamingQuery] = []
        self._threads: list[InheritableThread] = []

    def register(self, name: str, task: Callable[[int], None], every: str) -> StreamingQuery:
        """Runs task(run) at an interval."""
        self._queries.append(query := periodic(self.spark, task, checkpoint=f"{self.checkpoints}/{name}", every=every))
        return query

    def spawn(self, task: Callable[[], None]) -> None:
        """Runs task once. An error is logged."""

        def run() -> None:
            try:
                task()
            except Exception:
                LOG.exception("a task failed")

        self._threads.append(thread := InheritableThread(target=run))
        thread.start()

    def shutdown(self) -> None:
        """Stops the periodic tasks and waits for all tasks to end."""
        for query in self._queries:
            query.stop()
        for query in self._queries:
            query.awaitTermination()
        for thread in self._threads:
            thread.join()
        self._queries, self._threads = [], []


def _start(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()
