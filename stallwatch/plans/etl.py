"""The batch flow: flags, scoring rows, correlation, label, pseudonymisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwatch.functions.hashing import Salts, hash_merged
from stallwatch.functions.scalar import FLAG_TIME_FORMAT, flagged_label, parse_time
from stallwatch.operators.aggregates import drop_all_null
from stallwatch.operators.joins import asof_join, left_join_suffixed, propagate_flag
from stallwatch.sources.feeds import Feeds, read_feeds, write_summary, write_table


def merge_feeds(lifecycle: DataFrame, signals: DataFrame, feeds: Feeds, *, tolerance_seconds: float | None = None) -> DataFrame:
    """Flag every row of an id, keep scoring statuses, match each to one signal row, attach its columns, label.

    The flag is propagated before the status filter because it sits on rows that filter removes. The raw
    right-hand key is not carried over.
    """
    feed, unique = feeds.lifecycle, feeds.signals.unique
    flagged = lifecycle.withColumn(feed.flag, parse_time(feed.flag, FLAG_TIME_FORMAT))
    scoring = propagate_flag(flagged, "INSERTION_ID", feed.flag).filter(F.col(feed.status).isin(list(feed.scoring_statuses)))
    matched = asof_join(
        scoring, signals, key="INSERTION_ID", left_time="event_dt", right_time="signal_dt", right_id=unique, tolerance_seconds=tolerance_seconds
    ).drop("asof_seconds", "signal_dt")
    merged = left_join_suffixed(matched, signals, [unique], "_signal", drop=["INSERTION_ID", "signal_dt"])
    return merged.withColumn("is_fraud", flagged_label(feed.flag)).drop("event_dt")


def run(spark: SparkSession, feeds: Feeds, salts: Salts, output: str, *, only_if_missing: bool = True) -> DataFrame:
    """Feeds to a pseudonymised merged table in Parquet, with its summary next to it.

    The merged table is written once and pruned of empty columns when read back, so the heavy plan runs a
    single time.
    """
    lifecycle, signals = read_feeds(spark, feeds)
    write_table(hash_merged(merge_feeds(lifecycle, signals, feeds), salts), output, only_if_missing=only_if_missing)
    merged, _ = drop_all_null(spark.read.parquet(output))
    write_summary(merged, f"{output.rstrip('/')}_summary", "INSERTION_ID_hash", "is_fraud", feeds.lifecycle.status)
    return merged
