"""First sightings kept between micro-batches: hash buckets, compacted, expired ones removed.

The table lies in a folder as versions of a bucketed ``base`` and one ``delta`` per micro-batch since. A batch reads the buckets its
keys fall into and the few deltas; every ``compact_every`` batches both become the next base without what has expired. So
what a batch reads follows its own keys and the time to live, not the stream's age. Everything a batch writes
carries its number, and a batch reads only what earlier ones wrote: a retry repeats itself and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwatch.session import path_exists, remove_folder

VERSIONS_DDL = "version bigint, removed bigint, kept bigint"
# Pieces a bucket is written in, so that a bucket with a hot key is not one task.
PIECES = 8


@dataclass(frozen=True)
class Sightings:
    """Rows with ``keys``, a ``member`` and ``seen`` (microseconds), one per key and member, in ``folder``."""

    folder: str
    keys: Sequence[str]
    member: str = "entity"
    buckets: int = 64
    compact_every: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession, before: int) -> list:
        """The versions complete before a batch, newest first; there are at most two, and a row each for those replaced."""
        if not path_exists(spark, f"{self.folder}/versions"):
            return []
        return spark.read.schema(VERSIONS_DDL).parquet(f"{self.folder}/versions").filter(F.col("version") < before).orderBy(F.desc("version")).limit(2).collect()

    def _delta(self, spark: SparkSession, after: int, before: int, schema) -> DataFrame | None:
        if not path_exists(spark, f"{self.folder}/delta"):
            return None
        read = spark.read.schema(schema).parquet(f"{self.folder}/delta")
        return read.filter((F.col("batch_id") > after) & (F.col("batch_id") < before)).drop("batch_id")

    def _rows(self, spark: SparkSession, before: int, schema, touched: list[int] | None) -> DataFrame | None:
        """All rows known before a batch, of the touched buckets if these are given."""
        versions = self._versions(spark, before)
        version, parts = (versions[0]["version"] if versions else -1), []
        if versions:
            parts.append(spark.read.schema(schema).parquet(f"{self.folder}/base-{version}"))
        delta = self._delta(spark, version, before, schema)
        parts += [] if delta is None else [delta]
        if touched is not None:
            parts = [p.filter(F.col("bucket").isin(touched)) for p in parts]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, fresh: DataFrame, batch_id: int, horizon: Column | None = None) -> DataFrame:
        """Rows of earlier batches in the buckets of ``fresh`` (which has ``bucket``), none seen before ``horizon`` (microseconds)."""
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        found = self._rows(fresh.sparkSession, batch_id, fresh.schema, touched)
        if found is None:
            return fresh.limit(0)
        return found if horizon is None else found.filter(F.col("seen") >= horizon)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's new rows, replacing what an earlier attempt left."""
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy("batch_id").parquet(f"{self.folder}/delta")

    def compact(self, spark: SparkSession, batch_id: int, schema, horizon: int | None) -> None:
        """Every ``compact_every`` batches: base and deltas up to this one become a new base without rows seen before ``horizon``."""
        if (batch_id + 1) % self.compact_every or any(v["version"] == batch_id for v in self._versions(spark, batch_id + 1)):
            return
        rows = self._rows(spark, batch_id + 1, schema, None)
        if rows is None:
            return
        stays = F.lit(True) if horizon is None else F.col("seen") >= horizon
        folder = f"{self.folder}/base-{batch_id}"
        dealt = rows.filter(stays).repartition("bucket", F.pmod(F.xxhash64(self.member), F.lit(PIECES)))
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
        total = rows.count()
        kept = spark.read.schema(schema).parquet(folder).count()
        marker = spark.range(1).select(F.lit(batch_id).cast("long").alias("version"), F.lit(total - kept).cast("long").alias("removed"), F.lit(kept).cast("long").alias("kept"))
        older = self._versions(spark, batch_id)
        marker.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        # The version before stays for a reader that has it open; what lies behind that one goes.
        for gone in older[1:]:
            remove_folder(spark, f"{self.folder}/base-{gone['version']}")
        if older:
            for batch in range(older[0]["version"] - self.compact_every + 1, older[0]["version"] + 1):
                remove_folder(spark, f"{self.folder}/delta/batch_id={batch}")
