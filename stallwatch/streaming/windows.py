"""Event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(
    events: DataFrame, *, time: str, keys: Sequence[str], value: str, delay: str, length: str, slide: str | None = None, session: bool = False
) -> DataFrame:
    """Count and sum per key in tumbling, sliding (``slide``) or session (``session``) windows.

    Works on streams and batches alike; on a stream, rows later than ``delay`` are dropped and a window is
    emitted once the watermark passes it.
    """
    if session:
        place = F.session_window(time, length)
    else:
        place = F.window(time, length, slide) if slide else F.window(time, length)
    kept = events.withWatermark(time, delay) if events.isStreaming else events
    counted = kept.groupBy(place.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")
