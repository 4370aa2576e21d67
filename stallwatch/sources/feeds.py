"""The two CSV feeds, tables in Parquet, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwatch.functions.scalar import LIFECYCLE_TIME_FORMAT, REFERENCE_ID_PATTERN, SIGNAL_TIME_FORMAT, extract_id, lower_in, parse_time
from stallwatch.operators.aggregates import summary
from stallwatch.operators.windows import first_per
from stallwatch.session import path_exists


@dataclass(frozen=True)
class LifecycleFeed:
    """Column names and statuses of the lifecycle feed."""

    path: str
    id_source: str = "OBJECTREFERENCE"
    id_pattern: str = REFERENCE_ID_PATTERN
    time: str = "DATAPIPELINE_EVENT_SENT_AT"
    status: str = "STATUS"
    flag: str = "FLAGGEDFORFRAUD"
    exclude_statuses: Sequence[str] = ("DRAFT", "REPUBLISHING")
    scoring_statuses: Sequence[str] = ("PENDING_APPROVAL", "PENDING_REPUBLISH_APPROVAL")
    platform: str | None = None
    allowed_platforms: Sequence[str] = ()
    schema: T.StructType | None = None


@dataclass(frozen=True)
class SignalFeed:
    """Column names of the risk-signal feed."""

    path: str
    id: str = "transaction_id"
    unique: str = "id"
    time: str = "date"
    schema: T.StructType | None = None


@dataclass(frozen=True)
class Feeds:
    lifecycle: LifecycleFeed
    signals: SignalFeed
    options: dict[str, str] = field(default_factory=dict)


def header_schema(spark: SparkSession, path: str, separator: str) -> T.StructType:
    """All columns of a CSV as text, named by its header; types are cast leniently where they are used."""
    header = spark.read.option("sep", separator).option("header", True).option("inferSchema", False).csv(path)
    return T.StructType([T.StructField(c, T.StringType()) for c in header.columns])


def read_csv(spark: SparkSession, path: str, separator: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan: malformed values become null, ragged lines are cut or padded, and no pass is spent on inference."""
    schema = schema or header_schema(spark, path, separator)
    return spark.read.schema(schema).option("sep", separator).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_checked(
    spark: SparkSession, path: str, separator: str, schema: T.StructType, folder: str, *, checks: dict[str, Column] | None = None, options: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV scan, both stored below ``folder`` by one pass: every line ends up in exactly one of them.

    A reject is (line, errors). Reasons: ``ragged line`` (too few or too many fields, or broken quotes), ``bad <column>`` for text that
    is not of the column's type, and the names of ``checks`` whose condition on the typed columns is false (null passes).
    """
    corrupt = "__line"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(corrupt, T.StringType())])
    read = spark.read.schema(text).options(**{"sep": separator, "header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, **(options or {})}).csv(path)
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    own = F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema]), {"sep": separator})
    bad = [F.when(F.col(f"`{n}`").isNotNull() & v.isNull(), F.lit(f"bad {n}")) for n, v in typed.items()]
    read = read.select(*[v.alias(n) for n, v in typed.items()], F.coalesce(corrupt, own).alias(corrupt), F.when(F.col(corrupt).isNotNull(), F.array(F.lit("ragged line"))).otherwise(F.filter(F.array(*bad), lambda e: e.isNotNull())).alias("__errors"))
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in (checks or {}).items()]), lambda e: e.isNotNull()) if checks else F.array().cast("array<string>")
    judged = read.withColumn("__errors", F.when(F.size("__errors") > 0, F.col("__errors")).otherwise(failed))
    judged = judged.withColumn("__rejected", F.size("__errors") > 0)
    judged.write.mode("overwrite").option("compression", "zstd").partitionBy("__rejected").parquet(folder)
    stored = spark.read.schema(judged.schema).parquet(folder)
    rows = stored.filter(~F.col("__rejected")).select(*[F.col(f"`{f.name}`") for f in schema])
    return rows, stored.filter("__rejected").select(F.col(corrupt).alias("line"), F.col("__errors").alias("errors"))


def lifecycle_rows(df: DataFrame, feed: LifecycleFeed) -> DataFrame:
    """Parse id and time, drop unusable or excluded rows, keep the first event per (id, status)."""
    parsed = df.withColumns({"INSERTION_ID": extract_id(feed.id_source, feed.id_pattern), "event_dt": parse_time(feed.time, LIFECYCLE_TIME_FORMAT)})
    usable = (
        F.col("INSERTION_ID").isNotNull()
        & F.col("event_dt").isNotNull()
        & F.col(feed.status).isNotNull()
        & ~F.col(feed.status).isin(list(feed.exclude_statuses))
    )
    if feed.platform and feed.allowed_platforms:
        usable = usable & lower_in(feed.platform, feed.allowed_platforms)
    return first_per(parsed.filter(usable), ["INSERTION_ID", feed.status], "event_dt", feed.id_source)


def signal_rows(df: DataFrame, feed: SignalFeed) -> DataFrame:
    """Rename the key, parse the time, drop rows without either."""
    parsed = df.withColumnRenamed(feed.id, "INSERTION_ID").withColumns(
        {"INSERTION_ID": F.col("INSERTION_ID").cast("string"), "signal_dt": parse_time(feed.time, SIGNAL_TIME_FORMAT)}
    )
    return parsed.filter(F.col("INSERTION_ID").isNotNull() & F.col("signal_dt").isNotNull())


def read_feeds(spark: SparkSession, feeds: Feeds) -> tuple[DataFrame, DataFrame]:
    """Both feeds, ready to correlate."""
    lifecycle = read_csv(spark, feeds.lifecycle.path, ",", feeds.lifecycle.schema)
    signals = read_csv(spark, feeds.signals.path, ";", feeds.signals.schema)
    return lifecycle_rows(lifecycle, feeds.lifecycle), signal_rows(signals, feeds.signals)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan by table name."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite", only_if_missing: bool = False) -> None:
    """Zstandard Parquet sink; ``only_if_missing`` leaves a finished table alone, and overwrites what a broken write left."""
    if only_if_missing and finished(df.sparkSession, path):
        return
    writer = df.write.option("compression", "zstd").mode("overwrite" if only_if_missing else mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table's last write was committed: its success mark is there."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def write_summary(df: DataFrame, path: str, key: str, label: str, status: str) -> None:
    """Table summary and status distribution as JSON."""
    totals, statuses = summary(df, key, label, status)
    totals.write.mode("overwrite").json(f"{path}/totals")
    statuses.write.mode("overwrite").json(f"{path}/statuses")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
