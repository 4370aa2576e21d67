"""Decision and retrain sinks, storage statistics, review queue as derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stallwatch.plans.skew import lookup

BUCKETS = ("approved", "declined")


def decision_rows(scored: DataFrame, *, admin: str = "auto", summary: str | None = "event", names: Sequence[str] = ()) -> DataFrame:
    """Add bucket and date, and flatten the event fields (a map or struct named ``summary``) to ``evt_*`` text columns when present."""
    if summary is not None and summary in scored.columns:
        kind = scored.schema[summary].dataType
        scored = flatten_summary(scored, summary, kind.fieldNames() if isinstance(kind, StructType) else list(names))
    out = scored.withColumns(
        {
            "admin_id": F.col("admin_id") if "admin_id" in scored.columns else F.lit(admin),
            "notes": F.col("notes") if "notes" in scored.columns else F.lit(""),
            "bucket": F.when(F.col("admin_decision") == "APPROVE", "approved").otherwise("declined"),
            "decision_date": F.to_date("decided_at"),
        }
    )
    return out


def flatten_summary(df: DataFrame, summary: str, names: list[str]) -> DataFrame:
    """Turn a map of event fields into ``evt_<name>`` text columns."""
    return df.select(
        *[F.col(c) for c in df.columns if c != summary],
        *[F.col(summary).getItem(n).cast("string").alias(f"evt_{n}") for n in names],
    )


def append_decisions(decisions: DataFrame, folder: str, *, batch_id: int | None = None, source: str = "auto") -> None:
    """Append to ``bucket=/decision_date=`` Parquet. With a batch id the append is repeatable: a retried
    batch of one ``source`` replaces its own partition instead of adding rows twice, and no other source's."""
    target = f"{folder}/decisions"
    decisions = decisions.hint("rebalance", "bucket", "decision_date")  # few files per day, hot days split
    if batch_id is None:
        decisions.write.mode("append").option("compression", "zstd").partitionBy("bucket", "decision_date").parquet(target)
        return
    (
        decisions.withColumns({"source": F.lit(source), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("source", "batch_id", "bucket", "decision_date")
        .parquet(target)
    )


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All decisions; columns added over time are merged."""
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/decisions")


def retrain_rows(decisions: DataFrame) -> DataFrame:
    """Training pool: APPROVE counts as 0, DECLINE as 1."""
    kept = [c for c in ("insertion_id", "fraud_probability", "admin_decision", "decided_at") if c in decisions.columns]
    extra = [c for c in decisions.columns if c.startswith("evt_")]
    label = F.when(F.col("admin_decision") == "APPROVE", 0).otherwise(1).cast("tinyint").alias("is_fraud")
    return decisions.select(*kept, *extra, label)


def append_retrain(decisions: DataFrame, folder: str, *, batch_id: int | None = None, source: str = "auto") -> None:
    rows, target = retrain_rows(decisions), f"{folder}/retrain"
    if batch_id is None:
        rows.write.mode("append").option("compression", "zstd").parquet(target)
        return
    (
        rows.withColumns({"source": F.lit(source), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("source", "batch_id")
        .parquet(target)
    )


def storage_stats(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Rows per bucket, pending training rows, queue size and the last decision time, as one row."""
    queued = queue.agg(F.count(F.lit(1)).alias("n")).scalar()
    return decisions.agg(
        *[F.count(F.when(F.col("bucket") == b, 1)).alias(f"{b}_count") for b in BUCKETS],
        F.count(F.lit(1)).alias("pending_retrain_rows"),
        F.max("decided_at").alias("last_decision"),
    ).withColumn("queue_size", queued)


def review_queue(queued: DataFrame, decided: DataFrame, key: str = "insertion_id", queued_at: str = "queued_at") -> DataFrame:
    """Pending reviews: one item per id (the earliest since its last decision), gone once decided.

    A decision clears what was queued up to its time; a later enqueue makes the id pending again.
    """
    last = decided.groupBy(key).agg(F.max("decided_at").alias("__done"))
    open_items = lookup(queued, last, [key], "left").filter(F.col("__done").isNull() | (F.col(queued_at) > F.col("__done")))
    columns = [F.col(c) for c in queued.columns]
    first = open_items.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(queued_at)).alias("__row"))
    return first.select("__row.*")


def unknown_decisions(decisions: DataFrame, queued: DataFrame, key: str = "insertion_id") -> DataFrame:
    """Human decisions about ids that were never queued."""
    return lookup(decisions, queued.select(key).distinct(), [key], "left_anti")


def retrain_ready(pool: DataFrame, at_least: int = 50) -> DataFrame:
    return pool.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) >= at_least).alias("ready"))
