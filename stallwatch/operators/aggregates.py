"""Grouped reports: counts, rates, coverage, histograms, lifecycle and delay statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.plans.ordered import exact_quantiles, micros
from stallwatch.plans.skew import lookup


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_counts(df: DataFrame, columns: Sequence[str], *, approximate: float | None = None) -> DataFrame:
    """One row of distinct non-null counts; ``approximate`` gives the allowed relative error instead.

    Each exact count reads its own column only: counted together they would copy every row once per column.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), approximate).alias(f"distinct_{c}") for c in columns])
    one = df.sparkSession.range(1)
    return one.select(*[df.agg(F.count_distinct(F.col(f"`{c}`"))).scalar().alias(f"distinct_{c}") for c in columns])


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), *, log_size: int = 14) -> DataFrame:
    """(by..., name, sketch): mergeable counts of distinct values, to be stored per period (relative error about 0.8 % at 14)."""
    made = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(log_size)).alias(f"__s{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"__s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return made.select(*by, F.inline(cells))


def add_sketches(df: DataFrame, columns: Sequence[str], day: Column, folder: str, *, log_size: int = 14) -> None:
    """Store the sketches of the days in ``df`` as ``day=`` partitions, replacing those days and reading no other."""
    sketches = distinct_sketches(df.withColumn("day", day), columns, ["day"], log_size=log_size)
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def merged_distincts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, distinct): estimates over all sketches of a name, whatever periods they are from."""
    return sketches.groupBy(*by, "name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def entity_profile(
    df: DataFrame, key: str, *, maxima: Sequence[str] = (), means: Sequence[str] = (), firsts: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """One row per id: flags by maximum, signal numbers by mean, listing attributes from the first row, and a row count."""
    at = F.struct(*[F.col(f"`{c}`") for c in order])
    return df.groupBy(key).agg(
        *[F.max(F.col(f"`{c}`")).alias(c) for c in maxima],
        *[F.avg(F.col(f"`{c}`")).alias(c) for c in means],
        *[F.min_by(F.col(f"`{c}`"), at).alias(c) for c in firsts],
        F.count(F.lit(1)).alias("event_count"),
    )


def cluster_sizes(df: DataFrame, identity: str, name: str = "cluster_size") -> DataFrame:
    """Rows per identity, null identities left out."""
    return df.filter(F.col(f"`{identity}`").isNotNull()).groupBy(F.col(f"`{identity}`")).agg(F.count(F.lit(1)).alias(name))


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, coverage) for all columns in one pass over the table; the coverage of an empty table is null."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("present")) for i, c in enumerate(columns)]))
    return one.select("__n", rows.alias("r")).select(
        "r.column", (F.col("__n") - F.col("r.present")).alias("nulls"), (F.col("r.present") / F.nullif(F.col("__n"), F.lit(0))).alias("coverage")
    )


def drop_all_null(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns without any value; an empty table is left as it is. Reads the table once."""
    columns = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(columns)]).first()
    if not counts["__n"]:
        return df, []
    empty = [c for i, c in enumerate(columns) if counts[f"__{i}"] == 0]
    return df.drop(*empty), empty


def impute_median(df: DataFrame, columns: Sequence[str], *, approximate_accuracy: int | None = None) -> DataFrame:
    """Fill nulls with the column median (exact unless an accuracy is given); a column without values becomes 0."""
    if approximate_accuracy:
        medians = df.agg(
            F.struct(*[F.percentile_approx(c, 0.5, approximate_accuracy).cast("double").alias(c) for c in columns]).alias("m")
        ).scalar()
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), medians[c], F.lit(0.0)) for c in columns})
    long = unpivot_numbers(df, columns)
    found = exact_quantiles(long, ["feature"], "value", {"median": 0.5})
    entry = F.struct(F.col("feature"), F.col("median"))
    medians = found.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at(medians, F.lit(c)), F.lit(0.0)) for c in columns})


def unpivot_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long (keep..., feature, value) form of numeric columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("__cell")).select(*keep, "__cell.*")


def positive_rate(df: DataFrame, by: Sequence[str | Column], label: str, *, at_least: int = 1) -> DataFrame:
    """Rows, positives and positive rate per category, for categories with enough rows."""
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.col(label).cast("double")).alias("rate")
    )
    return grouped.filter(F.col("n") >= at_least)


def positive_rate_report(df: DataFrame, dimensions: Sequence[str], label: str, *, at_least: int = 1) -> DataFrame:
    """Positive rate for every value of every dimension, in one shuffle: (dimension, category, n, positives, rate)."""
    found = positive_rate_sets(df, [[d] for d in dimensions], label, at_least=at_least)
    name = category = F
    for d in dimensions:
        mine = F.col(f"in_{d}")
        name, category = name.when(mine, F.lit(d)), category.when(mine, F.col(f"`{d}`").cast("string"))
    return found.select(name.alias("dimension"), category.alias("category"), "n", "positives", "rate")


def positive_rate_sets(df: DataFrame, sets: Sequence[Sequence[str]], label: str, *, at_least: int = 1) -> DataFrame:
    """Positive rate over each of several sets of dimensions, in one aggregation; the empty set is the grand total.

    Adds ``in_<dimension>``: whether the row is grouped by it, which tells a null category from a subtotal.
    """
    dimensions = list(dict.fromkeys(d for s in sets for d in s))
    y = F.col(f"`{label}`")
    grouped = df.groupingSets([[F.col(f"`{d}`") for d in s] for s in sets], *[F.col(f"`{d}`") for d in dimensions]).agg(
        *[(F.grouping(F.col(f"`{d}`")) == 0).alias(f"in_{d}") for d in dimensions],
        F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("positives"), F.avg(y.cast("double")).alias("rate"),
    )
    return grouped.filter(F.col("n") >= at_least)


def event_and_entity_rate(df: DataFrame, key: str, label: str) -> DataFrame:
    """Positive rate over events next to the rate over ids (an id is positive when any of its rows is)."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"), F.max(label).alias("any"))
    return per_id.agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("entities"),
        (F.sum("p") / F.sum("n")).alias("event_rate"),
        F.avg(F.col("any").cast("double")).alias("entity_rate"),
    )


def signal_report(df: DataFrame, signals: Sequence[str], label: str) -> DataFrame:
    """Per boolean signal: prevalence, positive rate when true, lift over the base rate; shares of nothing are null."""
    hot = [F.coalesce(F.col(f"`{s}`").cast("int"), F.lit(0)) for s in signals]
    y = F.col(label).cast("long")
    one = df.agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(y).alias("__p"),
        *[F.coalesce(F.sum(h), F.lit(0)).alias(f"__s{i}") for i, h in enumerate(hot)],
        *[F.coalesce(F.sum(h * y), F.lit(0)).alias(f"__h{i}") for i, h in enumerate(hot)],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"__s{i}").alias("n_true"), F.col(f"__h{i}").alias("hits")) for i, s in enumerate(signals)])
    )
    flat = one.select("__n", "__p", rows.alias("r")).select("__n", "__p", "r.*")
    rate = F.col("hits") / F.nullif(F.col("n_true"), F.lit(0))
    return flat.select(
        "signal",
        F.col("n_true"),
        (F.col("n_true") / F.nullif(F.col("__n"), F.lit(0))).alias("prevalence"),
        rate.alias("rate_when_true"),
        (rate / F.nullif(F.col("__p") / F.nullif(F.col("__n"), F.lit(0)), F.lit(0.0))).alias("lift"),
    )


def connectivity_report(df: DataFrame, identity: str, label: str) -> DataFrame:
    """Positive rate by cluster size of an identity, in the disjoint buckets 1, 2-4, 5+."""
    per = (
        df.filter(F.col(identity).isNotNull())
        .groupBy(identity)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    )
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 4, "2-4").otherwise("5+")
    return per.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("identities"), F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("rate")
    )


def shared_identity_report(df: DataFrame, identity: str, entity: str, label: str, *, connector_at: int = 10) -> DataFrame:
    """How many identities are shared, how many of those touch a positive, how many are super-connectors."""
    per = _entities_per_identity(df, identity, entity, label)
    shared = F.col("entities") >= 2
    return per.agg(
        F.count(F.lit(1)).alias("identities"),
        F.count(F.when(shared, 1)).alias("shared"),
        F.count(F.when(shared & (F.col("any_positive") == 1), 1)).alias("shared_with_positive"),
        (F.count(F.when(shared & (F.col("any_positive") == 1), 1)) / F.nullif(F.count(F.when(shared, 1)), F.lit(0))).alias("positive_share"),
        F.count(F.when(F.col("entities") >= connector_at, 1)).alias("super_connectors"),
        F.max("entities").alias("largest"),
    )


def largest_identities(df: DataFrame, identity: str, entity: str, label: str, n: int = 10) -> DataFrame:
    """The ``n`` identities shared by the most ids."""
    return _entities_per_identity(df, identity, entity, label).orderBy(F.desc("entities"), identity).limit(n)


def _entities_per_identity(df: DataFrame, identity: str, entity: str, label: str) -> DataFrame:
    pairs = df.filter(F.col(identity).isNotNull()).groupBy(identity, entity).agg(F.max(label).alias("p"))
    return pairs.groupBy(identity).agg(F.count(F.lit(1)).alias("entities"), F.max("p").alias("any_positive"))


def lifecycle_length(df: DataFrame, key: str, label: str) -> DataFrame:
    """Mean and median number of events per id, by class of the id (ids without a class among themselves)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(label).alias(label))
    means = per.groupBy(label).agg(F.count(F.lit(1)).alias("ids"), F.avg("n").alias("mean_events"))
    medians = exact_quantiles(per, [label], "n", {"median_events": 0.5})
    return lookup(means, medians, [label], "inner", null_safe=True)


# Upper edges (hours) and names of the delay buckets.
DELAY_BUCKETS = ((24, "<=24h"), (24 * 7, "1-7d"), (24 * 28, "1-4w"), (24 * 90, "1-3m"))
LAST_DELAY_BUCKET = "3m+"


def delay_bucket(hours: Column) -> Column:
    chain = F
    for edge, name in DELAY_BUCKETS:
        chain = chain.when(hours <= edge, name)
    return chain.otherwise(LAST_DELAY_BUCKET)


def detection_delay(df: DataFrame, key: str, time: str, flag: str) -> DataFrame:
    """Per delay bucket: ids and mean hours between an id's first event and its first flag at or after it."""
    per = df.groupBy(key).agg(F.min(time).alias("__t"), F.min(flag).alias("__f")).filter(F.col("__f").isNotNull())
    hours = (micros("__f") - micros("__t")) / 3.6e9
    timed = per.withColumn("hours", hours).filter(F.col("hours") >= 0)
    return timed.groupBy(delay_bucket(F.col("hours")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("ids"), F.avg("hours").alias("mean_hours"), F.max("hours").alias("max_hours")
    )


def across_runs(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population and sample deviation, extremes and range of a value over runs."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.stddev_samp(value).alias("std_samp"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
    )


def runs_wide(df: DataFrame, run: str, name: str, value: str, names: Sequence[str], best_by: str) -> DataFrame:
    """One row per run with the named values as columns, best run first."""
    return df.groupBy(run).pivot(name, list(names)).agg(F.max(value)).orderBy(F.desc_nulls_last(best_by), run)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram with a closed last bin; every bin appears."""
    span = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("s")).scalar()
    bin_of = bin_index(F.col(value).cast("double"), span["lo"], span["hi"], bins)
    counts = df.filter(F.col(value).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (span["hi"] - span["lo"]) / bins
    return grid.join(counts, "bin", "left").select(
        "bin",
        (span["lo"] + F.col("bin") * width).alias("lower"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of a value, with values outside the range in the outer bins; a point range is widened by half."""
    flat = (hi <= lo).cast("double") * 0.5
    raw = F.floor((value - (lo - flat)) / (hi - lo + 2 * flat) * bins).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw))


def importance_by_group(importance: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of importance per feature group with its percentage (null where all sum to 0); ``groups`` maps feature to feature_group."""
    total = importance.agg(F.sum("importance").alias("t")).scalar()
    return (
        importance.join(groups, "feature")
        .groupBy("feature_group")
        .agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))
        .withColumn("percent", F.col("importance") / F.nullif(total, F.lit(0.0)) * 100)
    )


def rate_by_membership(df: DataFrame, key: str, member: str, values: Sequence[str], label: str) -> DataFrame:
    """Positive rate of ids by the set of values they appear with (for example the platforms an id is on).

    Membership is one flag per listed value, so no per-id collection is built.
    """
    values = sorted(values)
    per = df.groupBy(key).agg(
        *[F.max((F.col(member) == v).cast("int")).alias(f"__m{i}") for i, v in enumerate(values)], F.max(label).alias("__y")
    )
    name = F.concat_ws("+", *[F.when(F.col(f"__m{i}") == 1, v) for i, v in enumerate(values)])
    return per.groupBy(name.alias("membership")).agg(F.count(F.lit(1)).alias("ids"), F.avg(F.col("__y").cast("double")).alias("rate"))


def summary(df: DataFrame, key: str, label: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Table summary (rows, columns, ids, positives, negatives) and the status distribution, most frequent first."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.count_distinct(key).alias("unique_ids"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positive_events"),
        F.count(F.when(F.col(label) == 0, 1)).alias("negative_events"),
    )
    return totals, count_by(df, status)


def with_cluster_size(df: DataFrame, sizes: DataFrame, identity: str, size: str = "cluster_size") -> DataFrame:
    """Attach fitted cluster sizes to rows; unseen identities get null."""
    return lookup(df, sizes.select(identity, size), [identity], "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
