"""Keyed joins: as-of correlation, flag propagation, membership labels, dictionaries, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.plans.ordered import ORDER, SLICE, earlier_slices, later_slices, micros, numbered, with_slice
from stallwatch.plans.skew import first_n_per_key, lookup
from stallwatch.session import cut_lineage


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_time: str,
    right_time: str,
    right_id: str,
    strategy: str = "forward_else_backward",
    tolerance_seconds: float | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Match every left row to one right row of the same key by time; unmatched left rows are kept.

    Strategies: ``forward`` (nearest at or after), ``backward`` (nearest at or before), ``nearest`` (forward
    on equal distance), ``forward_else_backward``. Equal right times break by ``right_id``: smallest going
    forward, largest going backward. Adds ``right_id``, ``right_time`` and ``asof_seconds`` (right minus left).

    Both sides are unioned and scanned once each way inside (key, time slice) groups, so one key may hold a
    third of all rows; what lies in other slices arrives through a pre-aggregated per-slice carry.
    Left rows with a null key or time match nothing and take no part in the slicing.
    """
    if strategy not in ("forward", "backward", "nearest", "forward_else_backward"):
        raise ValueError(f"unknown strategy {strategy!r}")
    unique_right = (
        right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
        .groupBy(F.col(key).alias("__key"), F.col(right_time).alias("__rt"))
        .agg(F.min(right_id).alias("__first"), F.max(right_id).alias("__last"))
    )
    payload = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    usable = F.col(f"`{key}`").isNotNull() & F.col(f"`{left_time}`").isNotNull()
    lefts = left.filter(usable).select(F.col(key).alias("__key"), micros(left_time).alias("__t"), payload.alias("__row"))
    rights = unique_right.select(
        "__key",
        micros("__rt").alias("__t"),
        F.struct(micros("__rt").alias("t"), F.col("__first").alias("id"), F.col("__rt").alias("ts")).alias("__fwd"),
        F.struct(micros("__rt").alias("t"), F.col("__last").alias("id"), F.col("__rt").alias("ts")).alias("__bwd"),
    )
    both = with_slice(lefts.unionByName(rights, allowMissingColumns=True), F.col("__t"), slices)
    keys, group = ["__key"], ["__key", SLICE]
    ends = both.groupBy(*group).agg(F.min("__fwd").alias("__f"), F.max("__bwd").alias("__b"))
    carry = ends.select(
        *group,
        F.min("__f").over(later_slices(keys)).alias("__carry_f"),
        F.max("__b").over(earlier_slices(keys)).alias("__carry_b"),
    )
    up, down = Window.partitionBy(*group).orderBy(ORDER), Window.partitionBy(*group).orderBy(F.desc(ORDER))
    scanned = both.select(
        *group, "__t", "__row", F.max("__bwd").over(up).alias("__in_b"), F.min("__fwd").over(down).alias("__in_f")
    ).filter(F.col("__row").isNotNull())
    found = scanned.join(carry, group, "left").select(
        "__t",
        "__row",
        F.coalesce("__in_f", "__carry_f").alias("__f"),
        F.coalesce("__in_b", "__carry_b").alias("__b"),
    )
    f, b, t = F.col("__f"), F.col("__b"), F.col("__t")
    if tolerance_seconds is not None:
        reach = F.lit(int(tolerance_seconds * 1_000_000))
        f, b = F.when(f["t"] - t <= reach, f), F.when(t - b["t"] <= reach, b)
    chosen = {
        "forward": f,
        "backward": b,
        "nearest": F.when(f.isNotNull() & (b.isNull() | (f["t"] - t <= t - b["t"])), f).otherwise(b),
        "forward_else_backward": F.coalesce(f, b),
    }[strategy]
    matched = found.select("__row", t.alias("__t"), chosen.alias("__m")).select(
        "__row.*",
        F.col("__m.id").alias(right_id),
        F.col("__m.ts").alias(right_time),
        ((F.col("__m.t") - F.col("__t")) / 1_000_000.0).alias("asof_seconds"),
    )
    never = left.filter(~usable).select("*", *[F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in (right_id, right_time, "asof_seconds")])
    return matched.unionByName(never)


def match_stats(joined: DataFrame, right_id: str) -> DataFrame:
    """Total, matched and unmatched left rows of an as-of join."""
    return joined.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count(right_id).alias("matched_events"),
        (F.count(F.lit(1)) - F.count(right_id)).alias("unmatched_events"),
    )


def left_join_suffixed(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right", drop: Sequence[str] = ()
) -> DataFrame:
    """Left equi-join that renames clashing right columns and can drop right columns (raw identifiers)."""
    clashing = {c for c in right.columns if c in left.columns and c not in keys}
    kept = right.select(
        *[F.col(f"`{c}`").alias(c + suffix if c in clashing else c) for c in right.columns if c not in drop]
    )
    return lookup(left, kept, keys, "left")


def propagate_flag(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Give every row of an id the id's earliest flag time.

    Flags are reduced to one row per flagged id before any row moves; the way back is a salted lookup.
    """
    flagged = df.filter(F.col(flag).isNotNull()).groupBy(key).agg(F.min(flag).alias(flag))
    return lookup(df.drop(flag), flagged, [key], "left")


def propagate_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Label 1 for every row of an id that has any row labelled 1; otherwise the row keeps its label."""
    positive = df.filter(F.col(label) == 1).select(key).distinct().withColumn("__hit", F.lit(1))
    joined = lookup(df, positive, [key], "left")
    return joined.withColumn(label, F.coalesce(F.col("__hit"), F.col(label)).cast("tinyint")).drop("__hit")


OVERLAP_POLICIES = ("allow", "train_priority", "test_priority", "remove_both")


def resolve_overlap(train: DataFrame, test: DataFrame, key: str, policy: str) -> tuple[DataFrame, DataFrame]:
    """Remove ids present on both sides from the test side, the train side, both, or neither."""
    if policy not in OVERLAP_POLICIES:
        raise ValueError(f"unknown overlap policy {policy!r}")
    train_ids, test_ids = train.select(key).distinct(), test.select(key).distinct()
    kept_train = lookup(train, test_ids, [key], "left_anti") if policy in ("test_priority", "remove_both") else train
    kept_test = lookup(test, train_ids, [key], "left_anti") if policy in ("train_priority", "remove_both") else test
    return kept_train, kept_test


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, code): alphabetical zero-based codes per column, nulls left out."""
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("category")) for c in columns])
        ).alias("p")
    ).select("p.*")
    distinct = cut_lineage(pairs.filter(F.col("category").isNotNull()).distinct())
    coded = numbered(distinct, ["feature"], F.col("category"), [], "code")
    return coded.withColumn("code", (F.col("code") - 1).cast("double"))


def encode_categories(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace categories by their codes; null and unseen categories become null.

    Each feature joins its part of the dictionary, made unique per category; Spark broadcasts the part if it is small.
    """
    for c in columns:
        part = dictionary.filter(F.col("feature") == c).groupBy("category").agg(F.min("code").alias("__code"))
        codes = part.select(F.col("category").alias("__cat"), "__code")
        joined = df.withColumn("__cat", F.col(f"`{c}`").cast("string"))
        coded = lookup(joined, codes, ["__cat"], "left")
        df = (coded if suffix else coded.drop(c)).withColumnRenamed("__code", c + suffix).drop("__cat")
    return df


def attach_vectors(rows: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Attach a node vector to every event row; rows without a node get zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    joined = lookup(rows, vectors.select(key, F.col(vector).cast("array<double>").alias(vector)), [key], "left")
    return joined.withColumn(vector, F.coalesce(F.col(vector), zeros))


def compare_importance(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer alignment of two (feature, importance, rank) tables."""
    a = first.select("feature", F.col("importance").alias("importance_1"), F.col("rank").alias("rank_1"))
    b = second.select("feature", F.col("importance").alias("importance_2"), F.col("rank").alias("rank_2"))
    return a.join(b, "feature", "full_outer")


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The newest row of each id."""
    return first_n_per_key(df, [key], order, 1)


def detection_difference(a: DataFrame, b: DataFrame, key: str, label: str, score: str, threshold: float) -> DataFrame:
    """Positives caught by the first model only, the second only, both, neither.

    A row that only one model scored counts as not caught by the other; its label comes from the side that has it. The
    scores of a repeated id are averaged on either side, so no pairs arise.
    """
    def one(df: DataFrame, name: str) -> DataFrame:
        known = F.max(label).alias(f"__y{name}") if label in df.columns else F.lit(None).cast("int").alias(f"__y{name}")
        return df.groupBy(key).agg(F.avg(score).alias(f"__{name}"), known)

    scored = one(a, "a").join(one(b, "b"), key, "full_outer")
    hit_a, hit_b = (F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in ("__a", "__b"))
    positive = F.coalesce("__ya", "__yb") == 1

    def count(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return scored.agg(
        count(positive & hit_a & ~hit_b, "only_a"),
        count(positive & ~hit_a & hit_b, "only_b"),
        count(positive & hit_a & hit_b, "both"),
        count(positive & ~hit_a & ~hit_b, "neither"),
    )


def node_labels(nodes: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Node label (largest of its rows) and a mask telling whether the node is labelled."""
    labels = rows.filter(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    return nodes.join(labels, key, "left").withColumn("is_labelled", F.col(label).isNotNull())
