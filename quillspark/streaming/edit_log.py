"""The edit log as a stream: idempotent on edit_id, merged batch by batch, counted by event time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..sources.keyed import KeyedTable

#: What keeps the state of last_per_section.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(path)


def unique(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each edit_id once within the watermark."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["edit_id"])


def counts(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """section, window, n: late events within `delay` still count."""
    return events.withWatermark("created_at", delay).groupBy(F.window("created_at", size), "section").agg(F.count("*").alias("n"))


def merge_into(events: DataFrame, store: KeyedTable, checkpoint: str, stream: str = "edits") -> StreamingQuery:
    """Upserts each batch of what has come into a keyed table. The table knows the last batch of the stream, so a batch that runs again, after a restart or a failure between the table and the checkpoint, changes nothing.

    Batches are numbered by the checkpoint, so it is part of the stream's name: with a new one all that comes is merged again, which keys make harmless.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(batch, f"{stream}/{_query(batch)}", number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _query(batch: DataFrame) -> str | None:
    """The identity of the streaming query, which its checkpoint keeps."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def last_per_section(events: DataFrame, n: int = 20, idle: int = 0) -> DataFrame:
    """section, edit_ids, newest: the last n edits (section, seq, edit_id) of each section as a list in state, put out as a whole whenever it changes; at most n a section are held.

    An edit that comes twice counts once. A section that has got none for `idle` milliseconds is forgotten, and put out empty (0: never). Needs the RocksDB state store (STATE_STORE).
    """

    class LastEdits(StatefulProcessor):
        """Within the function, so that it goes to workers as it is, whatever they can import."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "seq long, edit_id string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
            before = [tuple(r) for r in self.held.get()]
            last = set(before)
            for r in rows:
                last.add((r["seq"], r["edit_id"]))
                if len(last) > 8 * n:  # however many come, few are held
                    last = set(heapq.nlargest(n, last))
            after = sorted(heapq.nlargest(n, last))
            self.held.put(after)
            if idle:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle)
            if after != sorted(before):
                yield Row(section=key[0], edit_ids=[e for _, e in after], newest=after[-1][0])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            self.held.clear()
            yield Row(section=key[0], edit_ids=[], newest=None)

        def close(self) -> None:
            pass

    asked = events.select("section", F.col("seq").cast("long").alias("seq"), F.col("edit_id").cast("string").alias("edit_id"))
    mode = "processingTime" if idle else "none"
    return asked.groupBy("section").transformWithState(LastEdits(), "section string, edit_ids array<string>, newest long", "update", mode)


def latest_lists(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream of last_per_section over what has come and returns section, edit_ids: the lists as they stand, kept in a keyed table."""
    store = KeyedTable(spark, path, "section string, edit_ids array<string>, newest long, version long", ("section",), ("version",), 8)

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(batch.withColumn("version", F.lit(store.manifest().version).cast("long")), f"lists/{_query(batch)}", number)

    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        changes.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], before)
    return store.read().where(F.size("edit_ids") > 0).select("section", "edit_ids")
