"""Row-level contributions and the reports built on them."""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.operators.aggregates import importance_by_group
from stallwatch.operators.models import FittedModel
from stallwatch.operators.ranking import top_above, top_contributions
from stallwatch.operators.windows import importance_ranks
from stallwatch.plans.skew import lookup
from stallwatch.session import cut_lineage


def linear_contributions(df: DataFrame, row_id: str, coefficients: dict[str, float], means: DataFrame | None = None) -> DataFrame:
    """Exact contributions of a linear model: coefficient x (value - mean), in long form."""
    columns = list(coefficients)
    background = df if means is None else means
    mean = background.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(float(b)) * (F.col(c) - mean[c])).alias("contribution"))
            for c, b in coefficients.items()
        ]
    )
    return df.select(row_id, F.explode(cells).alias("__c")).select(row_id, "__c.*")


@dataclass(frozen=True)
class Leaf:
    """A leaf seen from the root: its value and, per feature on the way, bounds (low, high] and the share of
    training rows that take the way when the feature is unknown."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    shares: tuple[float, ...]
    cover: float


def _leaves(node, value, path: dict) -> Iterator[Leaf]:
    stats = node.impurityStats()
    if node.getClass().getSimpleName() == "LeafNode":
        names = tuple(path)
        share = math.prod(path[f][2] for f in names)
        yield Leaf(value(node), names, tuple(path[f][0] for f in names), tuple(path[f][1] for f in names), tuple(path[f][2] for f in names), share)
        return
    split = node.split()
    feature, threshold, total = split.featureIndex(), split.threshold(), stats.count()
    for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
        yield from _leaves(child, value, {**path, feature: (*bounds, share * child.impurityStats().count() / total)})


def tree_leaves(model: FittedModel) -> tuple[list[list[Leaf]], list[float]]:
    """All trees of a boosted or forest model as leaf lists with their weights (read from the fitted model)."""
    ensemble = model.classifier
    boosted = type(ensemble).__name__.startswith("GBT")

    def value(node) -> float:
        if boosted:
            return node.prediction()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    trees = [list(_leaves(t._call_java("rootNode"), value, {})) for t in ensemble.trees]
    weights = [float(w) for w in ensemble.treeWeights]
    return trees, weights if boosted else [1.0 / len(trees)] * len(trees)


def _shap(x: np.ndarray, trees: Sequence[Sequence[Leaf]], weights: Sequence[float]) -> np.ndarray:
    """Path-dependent Shapley values of tree ensembles, vectorised over rows.

    For one leaf the game is a product over the path's features of "taken" (0/1 per row) or the training
    share, so its Shapley value follows from the coefficients of a small polynomial.
    """
    phi = np.zeros(x.shape)
    for leaves, weight in zip(trees, weights):
        for leaf in leaves:
            d = len(leaf.features)
            taken = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
            size_weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
            for j, feature in enumerate(leaf.features):
                poly = np.zeros((d, len(x)))
                poly[0] = 1.0
                for k in range(d):
                    if k != j:
                        shifted = np.vstack([np.zeros(len(x)), poly[:-1]])
                        poly = poly * leaf.shares[k] + shifted * taken[k]
                phi[:, feature] += weight * leaf.value * (taken[j] - leaf.shares[j]) * (np.array(size_weight) @ poly)
    return phi


def _cells(df: DataFrame, inputs: Sequence[str], trees: Sequence[Sequence[Leaf]]) -> DataFrame:
    """Add ``__cell``: between which of the trees' thresholds each input lies. Rows of one cell take the same ways in all trees."""
    ends: dict[int, set[float]] = {}
    for leaf in itertools.chain.from_iterable(trees):
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            ends.setdefault(f, set()).update(b for b in (low, high) if math.isfinite(b))
    used = sorted(ends)
    if not used:
        return df.withColumn("__cell", F.array().cast("array<int>"))
    cuts = [[-math.inf, *[math.nextafter(b, math.inf) for b in sorted(ends[f])], math.inf] for f in used]
    names = [f"__cell_{f}" for f in used]
    cut = Bucketizer(splitsArray=cuts, inputCols=[inputs[f] for f in used], outputCols=names, handleInvalid="keep").transform(df)
    return cut.withColumn("__cell", F.array(*[F.col(n).cast("int") for n in names])).drop(*names)


def tree_contributions(model: FittedModel, df: DataFrame, row_id: str) -> tuple[DataFrame, float]:
    """Contributions of every feature for every row (long form) and the base value they add to.

    The fitted trees travel to the tasks once as a broadcast of the model's own size. Rows that lie between the same
    thresholds have the same contributions, so these are computed once per such cell, in Arrow batches, and fetched
    by a join. Missing-value indicators are added to their column.
    """
    trees, weights = tree_leaves(model)
    base = sum(w * sum(leaf.value * leaf.cover for leaf in leaves) for leaves, w in zip(trees, weights))
    inputs = model.inputs
    features = list(dict.fromkeys(c.removesuffix("_missing") for c in inputs))
    merged = np.array([[c.removesuffix("_missing") == f for f in features] for c in inputs], dtype=float)
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((trees, weights)))  # by value: workers have no copy of this package

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ensemble, tree_weights = pickle.loads(shared.value)
        for batch in batches:
            phi = _shap(batch[inputs].to_numpy(dtype=float), ensemble, tree_weights) @ merged
            yield pd.DataFrame({"__cell": batch["__cell"], "__phi": list(phi)})

    rows = _cells(model.prepare(df).select(row_id, *[F.col(f"`{c}`").cast("double").alias(c) for c in inputs]), inputs, trees)
    ones = rows.groupBy("__cell").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in inputs])).alias("__one"))
    spread = ones.select("__cell", "__one.*").repartition(df.sparkSession.sparkContext.defaultParallelism, "__cell")
    known = cut_lineage(spread.mapInPandas(run, "__cell array<int>, __phi array<double>"))
    told = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"), F.col("__phi")[i].alias("contribution")) for i, f in enumerate(features)])
    return lookup(rows, known, ["__cell"], "inner").select(row_id, F.explode(told).alias("__c")).select(row_id, "__c.*"), base


def global_importance(long: DataFrame) -> DataFrame:
    """Mean absolute, mean and spread of contributions per feature, ranked."""
    stats = long.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("importance"),
        F.avg("contribution").alias("mean_contribution"),
        F.stddev_pop("contribution").alias("std_contribution"),
    )
    return importance_ranks(stats)


def explanation_cases(
    scored: DataFrame, *, row_id: str, label: str, score: str, threshold: float = 0.5, top_threshold: float = 0.7, n_top: int = 5, n_cases: int = 3
) -> DataFrame:
    """(case, row_id, score): the top predictions, and a few true positives and false negatives, out of all scored rows."""
    top = top_above(scored, score, row_id, n_top, top_threshold).select(F.lit("top").alias("case"), row_id, score)
    positives = scored.filter(F.col(label) == 1)
    hits = positives.filter(F.col(score) >= threshold).orderBy(row_id).limit(n_cases).select(F.lit("true_positive").alias("case"), row_id, score)
    misses = positives.filter(F.col(score) < threshold).orderBy(row_id).limit(n_cases).select(F.lit("false_negative").alias("case"), row_id, score)
    return cut_lineage(top.unionByName(hits).unionByName(misses))


def rows_of(cases: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """The rows that the cases name: at most n_top + 2 n_cases ids, sent to every task."""
    return rows.join(F.broadcast(cases.select(row_id).distinct()), row_id, "left_semi")


def explanation_report(cases: DataFrame, long: DataFrame, *, row_id: str) -> DataFrame:
    """(case, row_id, score, raises, position, feature, value, contribution) for :func:`explanation_cases` and their contributions; bounded."""
    return cases.join(top_contributions(rows_of(cases, long, row_id), row_id), row_id)


def group_shares(importance: DataFrame, groups: DataFrame) -> DataFrame:
    return importance_by_group(importance, groups)
