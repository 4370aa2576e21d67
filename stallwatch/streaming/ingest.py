"""Streaming ingest: parse, validate, drop duplicates, store valid events and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwatch.sources.ingest import parse_events, rejected, store_status, stored_events, valid
from stallwatch.streaming.sinks import has_data, write_batch


EVENT_KEY = ["insertion_id", "event_type", "event_timestamp"]


def json_files(spark: SparkSession, folder: str, *, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines arriving as files, as raw text; a Kafka source gives the same ``value`` column."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A Parquet table replayed as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def deduplicated(events: DataFrame, *, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of an event arriving within the watermark; state is keyed by event, so it spreads evenly."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def start_ingest(raw: DataFrame, folder: str) -> StreamingQuery:
    """Store valid events with their status (``stored`` for a new id, ``updated`` for a known one) and keep rejects aside.

    A repeat of an event is dropped by comparing with the stored events' keys rather than by a watermark, so an event is kept
    however late it arrives. Each micro-batch writes its own partition, so a retry replaces rather than repeats.
    """
    spark = raw.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good = valid(batch).dropDuplicates(EVENT_KEY)
        target = f"{folder}/events"
        known = good.limit(0)
        if has_data(spark, target):
            known = stored_events(spark, target).filter(F.col("batch_id") < batch_id).select(EVENT_KEY)
            good = good.join(known, EVENT_KEY, "left_anti")
        write_batch(store_status(good, known), target, batch_id)
        write_batch(rejected(batch), f"{folder}/rejected", batch_id)
        batch.unpersist()

    return (
        parse_events(raw).writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
