"""Structured Streaming: continuous ingest, event windows, deduplication, limits per key."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import ingest
from lodestar.session import shared_dir
from lodestar.sources.writers import Collection


def shared(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar-streams/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A growing folder of Parquet files, or one file, as a stream; timestamps without zone become instants for watermarks.

    A stream takes a plain path for a folder, so a single file is given as a pattern that only it matches.
    """
    schema = spark.read.parquet(path).schema
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    rows = spark.readStream.schema(schema).parquet(f"{head}[{last}]")
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def event_windows(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    )
    return out.select(F.col("w.start").alias("started"), "event_type", "n", "value")


def deduplicated(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark's reach; its state is dropped afterwards."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def chunks(docs: DataFrame) -> DataFrame:
    return ingest.chunk_words(docs)


def upsert_into(collection: Collection, by_document: bool = True) -> Callable[[DataFrame, int], None]:
    """A batch function that upserts its points; a batch that is run again replaces its own points by equal ones."""
    return lambda batch, number: collection.upsert(batch, by_document) and None


def drain(stream: DataFrame, name: str, merge: Callable[[DataFrame, int], None]) -> None:
    """Give what is there now to ``merge``, batch by batch."""
    state = f"{shared(stream.sparkSession, name)}-state"
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into a Parquet table of the shared folder and return it; ``drain`` hands batches to a function.

    Appended rows go through the exactly-once file sink. In complete mode, each batch replaces the table by a folder of
    its own number, so a batch that is run again overwrites itself. A stream without a batch gives an empty table.
    """
    spark = stream.sparkSession
    path = shared(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{path}").awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


class RateLimit(StatefulProcessor):
    """Events of a key with more than ``limit`` events in the ``seconds`` up to and with them, whatever order they come in.

    State of a key: its events that are not judged yet, and the times of those that a later window may still reach. An event
    is judged when the watermark has passed it, by a timer, for then no earlier one can come; times out of every
    later window's reach are dropped, and a key without any loses its state.
    """

    def __init__(self, seconds: int, limit: int):
        self.reach, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "at array<bigint>, id array<bigint>")
        self.judged = handle.getValueState("judged", "at array<bigint>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        old = self.waiting.get() if self.waiting.exists() else None
        at, ids = (list(old[0]), list(old[1])) if old else ([], [])
        for part in rows:
            at += part["at"].tolist()
            ids += part["event_id"].tolist()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._wait(at, ids)
        return iter(())

    def _wait(self, at: list[int], ids: list[int]) -> None:
        self.waiting.update((at, ids))
        self.handle.registerTimer(min(at) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # A timer that only clears old times may find nothing that waits.
        at, ids = self.waiting.get() if self.waiting.exists() else ([], [])
        due = sorted((t, i) for t, i in zip(at, ids) if t < now)
        later = [(t, i) for t, i in zip(at, ids) if t >= now]
        times = sorted([*(self.judged.get()[0] if self.judged.exists() else []), *(t for t, _ in due)])
        found = []
        for t, i in due:
            # As in a range frame, events of the same time count together.
            recent = bisect_right(times, t) - bisect_left(times, t - self.reach)
            if recent > self.limit:
                found.append((i, key[0], recent))
        times = times[bisect_left(times, now - self.reach) :]
        if times:
            self.judged.update((times,))
        else:
            self.judged.clear()
        if later:
            self._wait([t for t, _ in later], [i for _, i in later])
        else:
            self.waiting.clear()
            if times:
                # Comes back once the last of them is out of reach.
                self.handle.registerTimer((times[-1] + self.reach) // 1000 + 1)
        yield pd.DataFrame(found, columns=["event_id", "user_id", "recent"])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, seconds: int, limit: int, delay: str) -> DataFrame:
    """(event_id, user_id, ts) -> event_id, user_id, recent, as observe.over_limit gives them, from arrivals up to ``delay`` late."""
    marked = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return marked.groupBy("user_id").transformWithStateInPandas(
        RateLimit(seconds, limit), "event_id long, user_id long, recent long", outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in the store that keyed processors need, for streams started within."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
