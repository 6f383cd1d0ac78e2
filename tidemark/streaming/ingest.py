"""A log as a stream: ingest by micro-batches, tailing, dedupe of deliveries, routing and running sequences."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark import errors
from tidemark.sources.store import FEED, LogStore


def ingest(stream: DataFrame, store: LogStore, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch; one that is delivered again after a failure is found by its number and not written twice."""
    write = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: store.append(df, source=f"{name}/{i}") and None)
    return (write.trigger(availableNow=True) if once else write).start()


def route(stream: DataFrame, destination, stores: dict[str, LogStore], checkpoint: str, name: str, unknown: LogStore | None = None) -> StreamingQuery:
    """Appends each record to its destination's store; those whose destination has none go to ``unknown``, and without it fail the micro-batch, so that none is lost."""
    known = F.coalesce(destination.isin(*stores), F.lit(False)) if stores else F.lit(False)

    def write(df: DataFrame, i: int) -> None:
        routed = df.withColumn("_to", F.when(known, destination)).persist()
        try:
            if unknown is None and (lost := routed.where("_to is null").count()):
                raise errors.Internal(f"{lost} records have a destination without a store")
            for to, store in [*stores.items(), *([(None, unknown)] if unknown else [])]:
                store.append(routed.where(F.col("_to").eqNullSafe(F.lit(to))).drop("_to"), source=f"{name}/{i}")
        finally:
            routed.unpersist()

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def tail(store: LogStore, write: Callable[[DataFrame, int], None], checkpoint: str, name: str, once: bool = True, commits: int = 1000) -> StreamingQuery:
    """Hands the events of new appends to ``write``, with the micro-batch's number, as they are committed, each once.

    It follows the store's commits, so what was never committed isn't seen, and a compaction, which adds no events, delivers none. A micro-batch holds so many commits at most."""

    def each(df: DataFrame, i: int) -> None:
        if paths := [r.events for r in df.where("kind = 'append'").orderBy("version").collect()]:
            write(store.appended(paths), i)

    feed = store.spark.readStream.schema(FEED).option("maxFilesPerTrigger", commits).json(f"{store.path}/feed")
    out = feed.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (out.trigger(availableNow=True) if once else out).start()


def deduped(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drops further deliveries of an id within the delay."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


class _Sequencer(StatefulProcessor):
    """The next sequence of a stream as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._next = handle.getValueState("next", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self._next.get() if self._next.exists() else None
        at = int(got[0]) if got is not None else 0
        # a micro-batch's rows of one stream, in the caller's order
        own = pd.concat(list(rows)).sort_values("ordinal")
        self._next.update((at + len(own),))
        yield pd.DataFrame({"topic": own.topic, "key": own.key, "event_id": own.event_id, "seq": range(at + 1, at + len(own) + 1)})

    def close(self) -> None:
        pass


def sequenced(stream: DataFrame) -> DataFrame:
    """topic, key, event_id and seq, numbered in each stream over all micro-batches. Needs the RocksDB state store."""
    keys = stream.select("ordinal", "topic", F.coalesce("key", F.lit("")).alias("key"), "event_id")
    return keys.groupBy("topic", "key").transformWithStateInPandas(_Sequencer(), "topic string, key string, event_id string, seq long", "Append", "None")


def windowed(stream: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by topic and event-time window, late rows past the delay dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "topic").agg(F.count("*").alias("events"))


def run_to_end(make: Callable[[], StreamingQuery]) -> None:
    make().awaitTermination()
