"""Ordered views of rows and identities: first events, normalised time, ranks, point-in-time history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.functions.scalar import cyclical, log_count
from stallwatch.plans.ordered import ORDER, SLICE, earlier_slices, micros, running_totals, with_carry, with_slice
from stallwatch.plans.skew import first_n_per_key, lookup
from stallwatch.session import stored


def first_per(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The first row of each key combination in (time, tie) order, by parsed time."""
    return first_n_per_key(df, keys, [F.col(time).asc_nulls_last(), F.col(tie)], 1)


def first_time(df: DataFrame, key: str, time: str, name: str = "first_time") -> DataFrame:
    """Earliest time per id."""
    return df.groupBy(key).agg(F.min(time).alias(name))


def time_encodings(per_id: DataFrame, time: str, count: str) -> dict[str, Column]:
    """The eight time inputs of a listing node: position twice, cyclical hour and weekday, recency, log count."""
    t = micros(time).cast("double")
    span = per_id.agg(
        F.struct(F.min(micros(time)).cast("double").alias("lo"), F.max(micros(time)).cast("double").alias("hi")).alias("s")
    ).scalar()
    width = F.when(span["hi"] > span["lo"], span["hi"] - span["lo"]).otherwise(1e6)
    position = F.coalesce((t - span["lo"]) / width, F.lit(0.5))
    hour_sin, hour_cos = cyclical(F.coalesce(F.hour(time), F.lit(0)), 24)
    day_sin, day_cos = cyclical(F.coalesce(F.weekday(time), F.lit(0)), 7)
    return {
        "days_since_start": position,
        "relative_position": position,
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "weekday_sin": day_sin,
        "weekday_cos": day_cos,
        "recency": 1.0 - position,
        "log_event_count": log_count(count),
    }


def running_best(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Best value so far, in order (for example over search trials); null for rows without an order value."""
    sliced = with_slice(df, F.col(order).cast("double"))
    group = [*keys, SLICE]
    best = sliced.filter(F.col(ORDER).isNotNull()).groupBy(*group).agg(F.max(value).alias("__b"))
    carry = best.select(*group, F.max("__b").over(earlier_slices(keys)).alias("__c"))
    inside = Window.partitionBy(*group).orderBy(ORDER)
    local = sliced.withColumn("__l", F.max(value).over(inside))
    so_far = F.when(F.col(ORDER).isNotNull(), F.greatest("__l", "__c"))
    return with_carry(local, carry, group).withColumn("best_so_far", so_far).drop("__l", "__c", SLICE, ORDER)


def importance_ranks(importance: DataFrame) -> DataFrame:
    """1-based rank by falling importance (one row per feature, so a single small window)."""
    return importance.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))


def identity_history(
    events: DataFrame,
    *,
    identity: str,
    entity: str,
    time: str,
    flag: str,
    slices: int | None = None,
) -> DataFrame:
    """What was known about each event's identity strictly before the event.

    Adds ``prior_entities`` (distinct other ids seen with the identity), ``prior_flagged`` (those of them
    already flagged), ``prior_flagged_rate`` and ``days_since_first_seen``. A flag counts from the moment it
    was raised, not from the flagged id's event. Rows without identity or without a time get zeros and nulls.
    """
    known = events.filter(F.col(identity).isNotNull())
    pairs = known.groupBy(identity, entity).agg(F.min(micros(time)).alias("__seen"), F.min(micros(flag)).alias("__flag"))
    pairs = stored(pairs, "pairs")  # one narrow row per (identity, id), used three times below
    pairs = pairs.withColumn("__known", F.when(F.col("__flag").isNotNull(), F.greatest("__seen", "__flag")))
    marks = pairs.select(
        F.col(identity).alias("__identity"),
        F.explode(
            F.array(
                F.struct(F.col("__seen").alias("t"), F.lit(1).alias("seen"), F.lit(0).alias("flagged")),
                F.struct(F.col("__known").alias("t"), F.lit(0).alias("seen"), F.lit(1).alias("flagged")),
            )
        ).alias("m"),
    ).select("__identity", F.col("m.t").alias("__t"), F.col("m.seen").alias("__seen1"), F.col("m.flagged").alias("__flag1"))
    marks = marks.filter(F.col("__t").isNotNull()).groupBy("__identity", "__t").agg(F.sum("__seen1").alias("__seen1"), F.sum("__flag1").alias("__flag1"))
    own = lookup(known, pairs.select(identity, entity, "__seen", "__known"), [identity, entity], "left")
    rows = own.select(
        F.col(identity).alias("__identity"),
        micros(time).alias("__t"),
        F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__row"),
        (F.col("__seen") < micros(time)).cast("int").alias("__own_seen"),
        F.coalesce((F.col("__known") < micros(time)).cast("int"), F.lit(0)).alias("__own_flag"),
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    times = known.select(F.col(identity).alias("__identity"), micros(time).alias("__t"))
    shape = times.unionByName(marks, allowMissingColumns=True)
    counted = running_totals(
        both,
        ["__identity"],
        F.col("__t"),
        {"__n_seen": F.coalesce("__seen1", F.lit(0)), "__n_flag": F.coalesce("__flag1", F.lit(0))},
        before=True,
        slices=slices,
        shape=shape,
        null_keys=False,
    ).filter(F.col("__row").isNotNull())
    starts = pairs.groupBy(F.col(identity).alias("__identity")).agg(F.min("__seen").alias("__start"))
    with_start = lookup(counted, starts, ["__identity"], "left")
    entities = F.col("__n_seen") - F.col("__own_seen")
    flagged = F.col("__n_flag") - F.col("__own_flag")
    found = with_start.select(
        "__row.*",
        F.coalesce(entities, F.lit(0)).cast("long").alias("prior_entities"),
        F.coalesce(flagged, F.lit(0)).cast("long").alias("prior_flagged"),
        (flagged / F.nullif(entities, F.lit(0))).alias("prior_flagged_rate"),
        ((F.col("__t") - F.col("__start")) / 8.64e10).alias("days_since_first_seen"),
    )
    nameless = events.filter(F.col(identity).isNull()).select(
        "*", F.lit(0).cast("long").alias("prior_entities"), F.lit(0).cast("long").alias("prior_flagged")
    )
    return found.unionByName(nameless, allowMissingColumns=True)
