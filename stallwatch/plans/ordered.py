"""Ordered work (running totals, numbering, exact quantiles) that survives one key holding a third of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a hot key into one task. Here the
order column is first cut at approximate quantiles into as many slices as the cluster has shuffle
partitions. Whatever the key distribution, a (key, slice) group then holds at most about
``rows / slices`` rows (ties on one order value stay together). The window runs inside a slice, a small
pre-aggregated table of per-slice totals gives each slice what came before it, and both parts share one
exchange on (key, slice).

A null key is a key of its own; where null means "no identity", callers filter it first. Rows without an order value have no
place in the order: they get slices of their own, dealt out by partition, add to nothing, and their results are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage, shuffle_width

SLICE = "__slice"
ORDER = "__order"


def micros(column: str | Column) -> Column:
    """Whole microseconds since the epoch, for zoned and zone-free timestamps alike (UTC session)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def slice_bounds(df: DataFrame, order: Column, slices: int | None = None) -> list[float]:
    """Approximate quantiles of the order value: at most ``slices - 1`` numbers, whatever the table size."""
    slices = slices or shuffle_width(df.sparkSession)
    points = [i / slices for i in range(1, slices)]
    probe = df.select(order.cast("double").alias("o"))
    return sorted(set(probe.approxQuantile("o", points, 1.0 / (4 * slices)))) if points else []


def cut_at(df: DataFrame, order: Column, bounds: Sequence[float]) -> DataFrame:
    """Add ``__order`` (the order value) and ``__slice`` (the interval of ``bounds`` it falls into; negative without a value)."""
    ordered = df.withColumn(ORDER, order)
    unplaced = (-1 - F.pmod(F.spark_partition_id(), F.lit(shuffle_width(df.sparkSession)))).cast("int")
    if not bounds:
        return ordered.withColumn(SLICE, F.when(F.col(ORDER).isNull(), unplaced).otherwise(0))
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")],
        inputCol="__order_value",
        outputCol="__slice_value",
        handleInvalid="keep",
    )
    return (
        cut.transform(ordered.withColumn("__order_value", F.col(ORDER).cast("double")))
        .withColumn(SLICE, F.when(F.col(ORDER).isNull(), unplaced).otherwise(F.col("__slice_value").cast("int")))
        .drop("__order_value", "__slice_value")
    )


def with_slice(df: DataFrame, order: Column, slices: int | None = None) -> DataFrame:
    """Slice ``df`` at the quantiles of its own order value."""
    return cut_at(df, order, slice_bounds(df, order, slices))


def earlier_slices(keys: Sequence[str]) -> WindowSpec:
    """All slices of a key before the current one; at most one row per slice, so the group is bounded."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def later_slices(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    measures: dict[str, Column],
    *,
    before: bool = False,
    slices: int | None = None,
    shape: DataFrame | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """Cumulative sums per key over ``order`` (ascending), added as the names in ``measures``; null without an order value.

    ``before=False`` includes rows with the same order value; ``before=True`` excludes them and needs an
    integral order (for example :func:`micros`). The frame is read three times (bounds, totals, rows); when it
    is costly, ``shape`` names a cheaper one with the same keys, order and measures for the first two.
    Without ``null_keys`` (no key is null) the carry joins in the window's own partitioning, which spares a shuffle of the rows.
    """
    shape = df if shape is None else shape
    bounds = slice_bounds(shape, order, slices)
    counted = [F.when(order.isNotNull(), m).alias(f"__m_{n}") for n, m in measures.items()]
    sliced = cut_at(df.select("*", *counted), order, bounds)
    group = [*keys, SLICE]
    outline = cut_at(shape.select("*", *counted), order, bounds).filter(F.col(ORDER).isNotNull())
    totals = outline.groupBy(*group).agg(*[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures])
    carry = totals.select(
        *group, *[F.coalesce(F.sum(f"__t_{n}").over(earlier_slices(keys)), F.lit(0)).alias(f"__c_{n}") for n in measures]
    )
    inside = Window.partitionBy(*group).orderBy(ORDER)
    inside = inside.rangeBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    local = sliced.select("*", *[F.coalesce(F.sum(f"__m_{n}").over(inside), F.lit(0)).alias(f"__l_{n}") for n in measures])
    return with_carry(local, carry, group, null_keys=null_keys).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in measures],
        *[F.when(F.col(ORDER).isNotNull(), F.col(f"__l_{n}") + F.col(f"__c_{n}")).alias(n) for n in measures],
    )


def with_carry(local: DataFrame, carry: DataFrame, group: Sequence[str], *, null_keys: bool = True) -> DataFrame:
    """Rows with what their slice carries in, a null key like any other; rows whose slice carries nothing stay."""
    held = {c: f"__carried_{i}" for i, c in enumerate(group)}
    named = carry.select(*[F.col(f"`{c}`").alias(held.get(c, c)) for c in carry.columns])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(h)) if null_keys and c != SLICE else F.col(f"`{c}`") == F.col(h) for c, h in held.items()]
    return local.join(named, same, "left").drop(*held.values())


def numbered(
    df: DataFrame, keys: Sequence[str], order: Column, ties: Sequence[str | Column], name: str, *, slices: int | None = None
) -> DataFrame:
    """Exact 1-based ``row_number`` per key in (order, ties), whose columns may have any sortable type.

    Spark's range partitioning cuts by keys, order and ties together, so neither a hot key, nor many rows of one order value, nor
    long common prefixes gather in one slice. The ranged frame is stored before it is read twice, as its bounds are
    sampled.
    """
    width = slices or shuffle_width(df.sparkSession)
    ranged = df.withColumn(ORDER, order).repartitionByRange(width, *[F.col(f"`{k}`") for k in keys], F.col(ORDER), *ties)
    sliced, group = cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id())), [*keys, SLICE]
    totals = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    carry = totals.select(*group, F.coalesce(F.sum("__n").over(earlier_slices(keys)), F.lit(0)).alias("__c"))
    local = sliced.withColumn("__l", F.row_number().over(Window.partitionBy(*group).orderBy(ORDER, *ties)))
    placed = with_carry(local, carry, group).withColumn(name, F.col("__l") + F.col("__c"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], *, slices: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles per key without holding a key's values in one task.

    Equal values are counted before the shuffle; the running count of values then tells which value sits at
    each position. ``probabilities`` maps output names to quantile levels.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    counts = cut_lineage(counts)  # distinct values with counts: small next to the table, and read several times
    ranked = running_totals(counts, keys, F.col("__v"), {"__cum": F.col("__n")}, slices=slices)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = lookup(ranked, totals, keys, "inner", null_safe=True) if keys else ranked.withColumn("__total", totals.scalar())

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("__cum") > position, F.col("__v")))

    ends = []
    for name, level in probabilities.items():
        position = (F.col("__total") - 1) * F.lit(float(level))
        ends += [
            at(F.floor(position)).alias(f"__lo_{name}"),
            at(F.ceil(position)).alias(f"__hi_{name}"),
            F.max(position - F.floor(position)).alias(f"__w_{name}"),
        ]
    return joined.groupBy(*keys).agg(*ends).select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
            for n in probabilities
        ],
    )
