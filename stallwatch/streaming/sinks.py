"""Repeatable micro-batch writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(df: DataFrame, folder: str, batch_id: int, *, partition_by: list[str] | None = None) -> None:
    """Write one micro-batch into its own ``batch_id`` partition, replacing what an earlier attempt left there."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("batch_id", *(partition_by or []))
        .parquet(folder)
    )


def has_data(spark: SparkSession, folder: str) -> bool:
    """Whether a Parquet table with at least one file exists at the folder."""
    try:
        return len(spark.read.parquet(folder).columns) > 0
    except AnalysisException:
        return False
