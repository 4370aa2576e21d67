"""Top-k selections and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.plans.skew import first_n_per_key, lookup


def precision_at_k(df: DataFrame, label: str, score: str, row_id: str, ks: Sequence[int] = (50, 100, 200)) -> DataFrame:
    """Precision, recall and lift among the k highest scores; a k beyond the table gives zeros.

    Only ``max(ks)`` rows survive the distributed top-k, so the ranking window that follows is bounded.
    """
    totals = df.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).alias("t")
    ).scalar()
    top = df.select(label, score, row_id).orderBy(F.desc(score), row_id).limit(max(ks))
    ranked = first_n_per_key(top.withColumn("__all", F.lit(0)), ["__all"], [F.desc(score), F.col(row_id)], max(ks), rank="__rank")
    y = F.col(label).cast("long")
    one = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("__rank") <= k, y)), F.lit(0)).alias(f"__h{k}") for k in ks])
    hits = one.select(F.inline(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"__h{k}").alias("hits")) for k in ks])))
    enough = F.col("k") <= totals["n"]
    precision = F.when(enough, F.col("hits") / F.col("k")).otherwise(0.0)
    return hits.select(
        "k",
        precision.alias("precision"),
        F.when(enough & (totals["p"] > 0), F.col("hits") / totals["p"]).otherwise(0.0).alias("recall"),
        F.when(enough & (totals["p"] > 0), precision / (totals["p"] / totals["n"])).otherwise(0.0).alias("lift"),
    )


def top_above(df: DataFrame, score: str, row_id: str, n: int, threshold: float) -> DataFrame:
    """The ``n`` highest scores at or above a threshold."""
    return df.filter(F.col(score) >= threshold).orderBy(F.desc(score), row_id).limit(n)


def recent_then_filter(df: DataFrame, time: str, tie: str, n: int, bucket: str, wanted: str) -> DataFrame:
    """The last ``n`` decisions, of which those in one bucket are shown; the limit comes first on purpose."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n).filter(F.col(bucket) == wanted)


def queue_view(df: DataFrame, queued_at: str, tie: str, n: int) -> DataFrame:
    """The first ``n`` queued items in arrival order with the age anchor of the whole queue."""
    oldest = df.agg(F.min(queued_at).alias("o")).scalar()
    return df.orderBy(queued_at, tie).limit(n).withColumn("oldest_queued_at", oldest)


def top_contributions(long: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The strongest ``n`` raising and ``n`` lowering contributions of every row."""
    signed = long.filter(F.col("contribution") != 0).withColumn("raises", F.col("contribution") > 0)
    return first_n_per_key(
        signed, [row_id, "raises"], [F.desc(F.abs("contribution")), F.col("feature")], n, rank="position"
    )


def related_ids(df: DataFrame, identity: str, entity: str, time: str, limit: int) -> DataFrame:
    """Up to ``limit`` ids per identity (earliest first), paired with each of its ids, self left out.

    The limit applies before an id is removed from its own list, so a listed id has one neighbour fewer.
    """
    members = df.filter(F.col(identity).isNotNull()).groupBy(identity, entity).agg(F.min(time).alias("__t"))
    listed = first_n_per_key(members, [identity], [F.col("__t"), F.col(entity)], limit)
    listed = listed.select(F.col(identity).alias("__identity"), F.col(entity).alias("related"))
    arrays = listed.groupBy("__identity").agg(F.array_sort(F.collect_list("related")).alias("__r"))
    joined = lookup(members.select(F.col(identity).alias("__identity"), entity), arrays, ["__identity"], "inner")
    return (
        joined.select(F.col("__identity").alias(identity), entity, F.explode("__r").alias("related"))
        .filter(F.col("related") != F.col(entity))
    )


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on both sides."""
    return a.select(key).intersect(b.select(key))


def entity_ids(df: DataFrame, columns: Sequence[str], name: str = "entity_id") -> DataFrame:
    """Distinct non-blank ids over several id columns."""
    cells = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias(name)
    return df.select(cells).filter(F.trim(F.col(name)) != "").distinct()


def only_one_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids seen by exactly one of two result sets, with the side that saw them."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("a")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("b"))
    )
