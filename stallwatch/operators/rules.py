"""Class-association rules over binary columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage

# Up to so many flags the patterns themselves are few and are exploded directly.
PROJECTED_ABOVE = 20


def _patterns(df: DataFrame, flags: Sequence[str], label: str) -> DataFrame:
    """Distinct flag patterns with their row and positive counts.

    Rows collapse to patterns before the shuffle; everything after works on patterns, whose number depends
    on the flags and not on the table.
    """
    bits = [F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)).alias(f"b{i}") for i, c in enumerate(flags)]
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    names = [f"b{i}" for i in range(len(flags))]
    return df.select(*bits, y.alias("__y")).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("hits"))


def itemset_counts(df: DataFrame, flags: Sequence[str], label: str, *, min_support: float = 0.001, max_size: int = 4) -> DataFrame:
    """(antecedent, size, n, hits, total, total_hits) of every frequent set of up to ``max_size`` flags.

    Grows sets level by level: a set is extended only by later items, and only frequent sets are extended,
    which loses nothing because support cannot grow. Null flags count as absent. With more than ``PROJECTED_ABOVE`` flags rows are
    projected on frequent prefixes instead, see :func:`projected_itemset_counts`; both ways give the same sets.
    """
    flags = sorted(flags)
    if len(flags) > PROJECTED_ABOVE:
        return projected_itemset_counts(df, flags, label, min_support=min_support, max_size=max_size)
    patterns = cut_lineage(_patterns(df, flags, label))  # the table is read once; every level works on patterns
    items = F.filter(F.array(*[F.when(F.col(f"b{i}") == 1, F.lit(c)) for i, c in enumerate(flags)]), lambda x: x.isNotNull())
    totals = patterns.agg(F.struct(F.sum("n").alias("n"), F.sum("hits").alias("hits")).alias("t")).scalar()
    base = patterns.select("n", "hits", items.alias("__items"))

    def count(grown: DataFrame, size: int) -> DataFrame:
        counted = grown.groupBy("__set").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        return counted.filter(F.col("n") / totals["n"] >= min_support).withColumn("size", F.lit(size))

    grown = base.select("n", "hits", "__items", F.explode("__items").alias("__last")).withColumn("__set", F.array("__last"))
    levels = [count(grown, 1)]
    for size in range(2, max_size + 1):
        alive = grown.join(levels[-1].select("__set"), "__set", "left_semi")
        later = F.filter(F.col("__items"), lambda x: x > F.col("__last"))
        grown = alive.select("n", "hits", "__items", "__set", F.explode(later).alias("__last"))
        grown = grown.withColumn("__set", F.concat("__set", F.array("__last")))
        levels.append(count(grown, size))
    out = reduce(lambda a, b: a.unionByName(b), levels)
    return out.select(F.col("__set").alias("antecedent"), "size", "n", "hits", totals["n"].alias("total"), totals["hits"].alias("total_hits"))


def projected_itemset_counts(df: DataFrame, flags: Sequence[str], label: str, *, min_support: float = 0.001, max_size: int = 4) -> DataFrame:
    """The counts of :func:`itemset_counts` for hundreds of flags, by prefix-projected rows (after parallel FP-growth, Li et al. 2008).

    Items are ordered from rare to common, so the rows of a common prefix have little left. A level holds, for every frequent
    prefix, what rows with it still have to offer: only items that are frequent together with the prefix, and equal remainders as
    one counted row. Counts are summed before the shuffle and remainders are dealt out by their content, so a common
    prefix is no single group; nothing larger than the list of flags is held by a task or sent to the driver.
    """
    flags = sorted(flags)
    present = F.filter(F.array(*[F.when(F.col(f"`{c}`").cast("boolean"), F.lit(i)) for i, c in enumerate(flags)]), lambda x: x.isNotNull())
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    sums = [F.sum("n").alias("n"), F.sum("hits").alias("hits")]
    rows = df.select(present.alias("rest"), y.alias("hits"), F.lit(1).cast("long").alias("n"))
    patterns = cut_lineage(rows.groupBy("rest").agg(*sums))
    total = patterns.agg(*sums).first()
    n_all, hits_all = total["n"] or 0, total["hits"] or 0
    singles = patterns.select(F.explode("rest").alias("item"), "n", "hits").groupBy("item").agg(*sums).collect()  # one row a flag
    rank = {r["item"]: i for i, r in enumerate(sorted((r for r in singles if r["n"] / n_all >= min_support), key=lambda r: (r["n"], r["item"])))}
    item_of = {i: flags[item] for item, i in rank.items()}
    empty = df.sparkSession.createDataFrame([], "antecedent array<string>, size int, n bigint, hits bigint, total bigint, total_hits bigint")
    if not rank:
        return empty
    ranks = F.create_map(*[F.lit(v) for pair in rank.items() for v in pair])
    ranked = F.array_sort(F.filter(F.transform("rest", lambda i: F.try_element_at(ranks, i)), lambda r: r.isNotNull()))
    level = patterns.select(F.array().cast("array<int>").alias("prefix"), ranked.alias("rest"), "n", "hits").filter(F.size("rest") > 0)
    level = cut_lineage(level.groupBy("prefix", "rest").agg(*sums))
    found = []
    for size in range(1, max_size + 1):
        counted = level.select("prefix", F.explode("rest").alias("item"), "n", "hits").groupBy("prefix", "item").agg(*sums)
        counted = cut_lineage(counted.filter(F.col("n") / n_all >= min_support))
        found.append(counted.select(F.concat("prefix", F.array("item")).alias("set"), F.lit(size).alias("size"), "n", "hits"))
        if size == max_size:
            break
        allowed = counted.groupBy("prefix").agg(F.collect_list("item").alias("allowed"))  # at most all flags
        kept = lookup(level, allowed, ["prefix"], "inner").select("prefix", F.array_sort(F.array_intersect("rest", "allowed")).alias("rest"), "n", "hits")
        split = F.transform("rest", lambda item, i: F.struct(item.alias("item"), F.slice("rest", i + 2, F.size("rest")).alias("rest")))
        split = F.explode(F.filter(split, lambda s: F.size(s["rest"]) > 0)).alias("s")
        deeper = kept.groupBy("prefix", "rest").agg(*sums).select("prefix", split, "n", "hits")
        level = cut_lineage(deeper.select(F.concat("prefix", F.array("s.item")).alias("prefix"), F.col("s.rest").alias("rest"), "n", "hits").groupBy("prefix", "rest").agg(*sums))
    names = F.create_map(*[F.lit(v) for pair in item_of.items() for v in pair])
    out = reduce(lambda a, b: a.unionByName(b), found)
    antecedent = F.array_sort(F.transform("set", lambda r: F.try_element_at(names, r)))
    return out.select(antecedent.alias("antecedent"), "size", "n", "hits", F.lit(n_all).cast("long").alias("total"), F.lit(hits_all).cast("long").alias("total_hits"))


def frequent_itemsets(df: DataFrame, flags: Sequence[str], label: str, *, min_support: float = 0.001, max_size: int = 4) -> DataFrame:
    """(antecedent, size, n, support)."""
    counts = itemset_counts(df, flags, label, min_support=min_support, max_size=max_size)
    return counts.select("antecedent", "size", "n", (F.col("n") / F.col("total")).alias("support"))


def class_rules(
    df: DataFrame,
    flags: Sequence[str],
    label: str,
    *,
    min_support: float = 0.001,
    max_size: int = 4,
    min_confidence: float = 0.5,
    min_lift: float = 2.0,
    min_count: int = 10,
) -> DataFrame:
    """Rules "itemset implies positive" (antecedent, support, confidence, lift, n), strongest lift first."""
    counts = itemset_counts(df, flags, label, min_support=min_support, max_size=max_size)
    confidence = F.col("hits") / F.col("n")
    rules = counts.select(
        "antecedent",
        (F.col("n") / F.col("total")).alias("support"),
        confidence.alias("confidence"),
        (confidence / F.nullif(F.col("total_hits") / F.col("total"), F.lit(0.0))).alias("lift"),
        "n",
    )
    kept = rules.filter((F.col("n") >= min_count) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    return kept.orderBy(F.desc("lift"), F.desc("n"), F.array_join("antecedent", ","))


def top_rules(rules: DataFrame, n: int = 20) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("n"), F.array_join("antecedent", ",")).limit(n)


def rule_features(df: DataFrame, rules: DataFrame, n: int = 10) -> DataFrame:
    """``rule_i_match`` columns for the ``n`` strongest rules (those few rules are read on the driver)."""
    strongest = [row["antecedent"] for row in top_rules(rules, n).collect()]

    def match(items: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)) for c in items if c in df.columns])

    return df.withColumns({f"rule_{i}_match": match(items) for i, items in enumerate(strongest, start=1)})
