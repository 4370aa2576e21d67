"""Scoring-event ingest: schema, validation, storing, reading back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage

# The scoring-event fields by type; the first eight text fields are required.
REQUIRED_TEXT = ("insertion_id", "user_id", "event_type", "event_timestamp", "email_hash", "phone_hash", "ip_hash", "device_hash")
OPTIONAL_TEXT = (
    "listing_category", "listing_platform", "listing_offer_type", "listing_country", "ip_type", "ip_country", "ip_isp",
    "phone_type", "phone_carrier", "phone_country", "device_type", "browser", "os", "screen_resolution",
)
OPTIONAL_NUMBERS = ("listing_price", "listing_rooms", "listing_living_space")
SCORES = ("fraud_score", "email_score", "phone_score", "blackbox_score", "proxy_score")
OPTIONAL_BOOLEANS = (
    "tor", "vpn", "proxy", "datacenter", "email_deliverable", "email_disposable", "email_free", "phone_valid", "adblock", "private_mode",
)
OPTIONAL_INTEGERS = ("email_breaches",)
EVENT_TYPES = (
    "DRAFT", "PENDING_APPROVAL", "APPROVED", "PUBLISHED", "REPUBLISHING", "PENDING_REPUBLISH_APPROVAL", "ARCHIVED", "DELETED",
)
MAX_REPORTED_ERRORS = 10

EVENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*REQUIRED_TEXT, *OPTIONAL_TEXT)]
    + [T.StructField(c, T.DoubleType()) for c in (*OPTIONAL_NUMBERS, *SCORES)]
    + [T.StructField(c, T.BooleanType()) for c in OPTIONAL_BOOLEANS]
    + [T.StructField(c, T.IntegerType()) for c in OPTIONAL_INTEGERS]
)


def problems(prefix: str = "") -> Column:
    """Reasons why an event is invalid, as an array (empty when valid)."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    checks = [F.when(c(n).isNull(), F.lit(f"missing {n}")) for n in REQUIRED_TEXT]
    checks.append(F.when(c("event_type").isNotNull() & ~c("event_type").isin(list(EVENT_TYPES)), F.lit("unknown event_type")))
    checks.append(
        F.when(c("event_timestamp").isNotNull() & c("event_timestamp").try_cast("timestamp").isNull(), F.lit("bad event_timestamp"))
    )
    checks += [F.when((c(n) < 0) | (c(n) > 100), F.lit(f"{n} outside 0-100")) for n in SCORES]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON text (files, Kafka values) into events with their problems; works on batches and streams alike.

    The event comes out of an ``explode``: a filter on its problems stays above it, where on a plain projection it would be
    pushed below with the text parsed anew for every field it names.
    """
    text = raw.select(F.col(column).cast("string").alias("raw"))
    parsed = text.select(F.explode(F.array(F.from_json("raw", EVENT_SCHEMA))).alias("e"), "raw")
    flat = parsed.select("e.*", "raw")
    unreadable = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in REQUIRED_TEXT])
    errors = F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(problems())
    return flat.withColumn("errors", errors).withColumn("event_timestamp", F.col("event_timestamp").try_cast("timestamp"))


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("errors") == 0).drop("errors", "raw")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("errors") > 0).select("raw", "errors")


def bulk_report(parsed: DataFrame) -> DataFrame:
    """Events processed and stored, with the first ten error texts (a report, not the rejects themselves).

    Events are counted per error text, of which there are few, in one pass over them.
    """
    valid_event = F.size("errors") == 0
    tally = parsed.groupBy(F.concat_ws("; ", "errors").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(valid_event, 1)).alias("ok"))
    repeated = F.explode(F.array_repeat("e", F.least(F.col("n") - F.col("ok"), F.lit(MAX_REPORTED_ERRORS)).cast("int"))).alias("e")
    first = tally.select(repeated).orderBy("e").limit(MAX_REPORTED_ERRORS).agg(F.array_sort(F.collect_list("e")).alias("errors")).scalar()
    return tally.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events_processed"), F.coalesce(F.sum("ok"), F.lit(0)).alias("events_stored")
    ).withColumn("errors", first)


def store_status(batch: DataFrame, stored: DataFrame, key: str = "insertion_id", time: str = "event_timestamp") -> DataFrame:
    """Tell for each incoming event whether its id is new (``stored``) or already known (``updated``).

    Inside a batch the earliest event of a new id is ``stored`` and the later ones are ``updated``; where several share the
    earliest time, the one with the smallest hash of all its values comes first. Only minima are shuffled by id.
    """
    known = stored.select(key).distinct().withColumn("__known", F.lit(True))
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns])
    place = F.struct(F.col(time) if time in batch.columns else F.lit(0), whole, F.monotonically_increasing_id())
    placed = cut_lineage(batch.withColumn("__place", place))
    first = placed.groupBy(key).agg(F.min("__place").alias("__first"))
    told = lookup(lookup(placed, first, [key], "left"), known, [key], "left")
    new = F.col("__known").isNull() & F.col("__place").eqNullSafe(F.col("__first"))
    return told.withColumn("status", F.when(new, "stored").otherwise("updated")).drop("__known", "__place", "__first")


def append_events(events: DataFrame, folder: str) -> None:
    """Store events by day; the stored table doubles as snapshot and export."""
    events.withColumn("event_date", F.to_date("event_timestamp")).write.mode("append").option("compression", "zstd").partitionBy(
        "event_date"
    ).parquet(folder)


def ingest_batch(raw: DataFrame, folder: str, *, column: str = "value") -> DataFrame:
    """Store a batch of JSON texts: valid events by day, rejects with text and reasons aside. Returns the report of :func:`bulk_report`.

    Parsed once and stored, so events, rejects and report come from the same reading.
    """
    parsed = cut_lineage(parse_events(raw, column))
    append_events(valid(parsed), f"{folder}/events")
    rejected(parsed).write.mode("append").option("compression", "zstd").parquet(f"{folder}/rejected")
    return bulk_report(parsed)


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def store_stats(events: DataFrame) -> DataFrame:
    """Totals and distinct identities of the stored events."""
    distinct = {"insertions": "insertion_id", "emails": "email_hash", "phones": "phone_hash", "ips": "ip_hash", "devices": "device_hash", "users": "user_id"}
    return events.agg(F.count(F.lit(1)).alias("total_events")).withColumns({f"unique_{n}": events.agg(F.count_distinct(c)).scalar() for n, c in distinct.items()})
