"""Structured Streaming over events and notes; each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """A file stream with timestamps that watermarks accept (session time zone UTC)."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_messages(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row an event id within the watermark: state does not grow without bound."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, used): the sum of each UTC day."""
    by = events.withWatermark("ts", late) if events.isStreaming else events
    return by.groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("used")).select(F.col("w.start").cast("date").alias("day"), "used")


def sliding_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    by = events.withWatermark("ts", late) if events.isStreaming else events
    return by.groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) of events less than ``gap`` apart."""
    by = events.withWatermark("ts", late) if events.isStreaming else events
    return by.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cursors(events: DataFrame) -> DataFrame:
    """(user_id, cursor, last_id): the high-water mark of each binding, in update mode."""
    return events.groupBy("user_id").agg(F.max("ts").alias("cursor"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_id"))


class Quota(StatefulProcessor):
    """Running use of each user against a quota: (user_id, event_id, used, remaining), remaining never below 0."""

    def __init__(self, quota: float):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0.0
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            used += float(r.value)
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [r.event_id], "used": [used], "remaining": [max(0.0, self.quota - used)]})
        self.used.update((used,))

    def close(self) -> None:
        pass


class Thread(StatefulProcessor):
    """Memory of each (user, thread): how many events, the last id; with ``ttl`` it expires after so many ms without one."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "n long, last_id long", *([self.ttl] if self.ttl else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.memory.get() if self.memory.exists() else (0, -1)
        for part in rows:
            n, last = n + len(part), max(last, int(part["event_id"].max()))
        self.memory.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "n": [n], "last_id": [last]})

    def close(self) -> None:
        pass


def quota_charges(events: DataFrame, quota: float) -> DataFrame:
    """Batch: a running sum a user. Stream: the same with state."""
    if events.isStreaming:
        return events.groupBy("user_id").transformWithStateInPandas(Quota(quota), "user_id long, event_id long, used double, remaining double", "Append", "None")
    from pyspark.sql import Window

    used = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select("user_id", "event_id", used.alias("used"), F.greatest(F.lit(0.0), F.lit(quota) - used).alias("remaining"))


def thread_memory(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """(user_id, event_type, n, last_id). A ttl needs a processing-time trigger: a run that ends by itself would wait for it."""
    if events.isStreaming:
        return events.groupBy("user_id", "event_type").transformWithStateInPandas(Thread(ttl), "user_id long, event_type string, n long, last_id long", "Update", "ProcessingTime" if ttl else "None")
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def upsert_documents(spark: SparkSession, folder: str, index, checkpoint: str, docs_of):
    """Watch a note folder: each micro-batch's files, and no others, are put into ``index`` (a ChunkTable).

    docs_of(files) makes documents of the batch's files(rel_path, modified, raw). A file that is in the stream twice, or
    a batch that is replayed, changes nothing: its hash is known.
    """
    stream = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    path = F.regexp_replace("_metadata.file_path", "^.*?" + folder.removeprefix("file:").rstrip("/") + "/", "")
    files = stream.select(path.alias("rel_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))

    def put(batch: DataFrame, batch_id: int) -> None:
        newest = batch.where(F.element_at(F.split("rel_path", "/"), -1) != "README.md").groupBy("rel_path").agg(F.max_by("raw", "modified").alias("raw"), F.max("modified").alias("modified"))
        index.upsert(docs_of(newest))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
