"""Joins and per-key selections that stay balanced when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.session import shuffle_width


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *, null_safe: bool = False) -> DataFrame:
    """Join ``left`` to ``right`` (inner, left, left_semi or left_anti) so that hot left keys spread out.

    Adaptive execution cuts a large left partition into pieces and sends the matching right partition to each, but
    only where both sides are shuffled for the join. A right side that was just aggregated on the join key is not.
    Its keys are rewritten here as expressions whose partitioning Spark does not recognise, which costs one
    shuffle of the aggregated rows and needs no sketch, no salt and no second run of the left plan. ``null_safe`` lets a null
    key meet a null key.
    """
    keys = list(keys)
    if null_safe:
        named = {c: f"__right_{i}" for i, c in enumerate(keys)}
        shown = [F.element_at(F.array(F.col(f"`{c}`")), 1).alias(named[c]) if c in named else F.col(f"`{c}`") for c in right.columns]
        same = [F.col(f"`{c}`").eqNullSafe(F.col(named[c])) for c in keys]
        return left.join(right.select(*shown), same, how).drop(*named.values())
    shown = [F.element_at(F.array(F.col(f"`{c}`")), 1).alias(c) if c in keys else F.col(f"`{c}`") for c in right.columns]
    return left.join(right.select(*shown), keys, how)


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.

    ``row_number() <= n`` is planned with a partial group limit before the exchange, so each input
    partition sends at most ``n`` rows per key and a hot key cannot pile up.
    """
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly to as many tasks as the cluster shuffles into.

    For costly work on few narrow rows: a small file is read by one task for each of its row groups, and of those there may be one.
    """
    return df.repartition(shuffle_width(df.sparkSession))
