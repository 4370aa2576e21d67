"""Streaming form of the signal correlation: a time-bounded stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched(
    events: DataFrame, signals: DataFrame, *, key: str, event_time: str, signal_time: str, delay: str, before: str, after: str
) -> DataFrame:
    """Events left-joined to the signals of the same key between ``before`` and ``after`` the event.

    Unmatched events are emitted with nulls once the watermark shows that no signal can come any more.
    """
    left = events.withWatermark(event_time, delay).alias("e")
    right = signals.withWatermark(signal_time, delay).withColumnRenamed(key, "__key").alias("s")
    near = F.expr(
        f"e.{key} = s.__key AND s.{signal_time} >= e.{event_time} - interval {before} AND s.{signal_time} <= e.{event_time} + interval {after}"
    )
    return left.join(right, near, "leftOuter").drop("__key")
