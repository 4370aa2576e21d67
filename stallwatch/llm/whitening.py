"""Embedding whitening: an exact integer covariance by polarisation, and projections on its leading components.

Entries are quantised to whole numbers, so sums have no rounding and do not depend on how rows are dealt out. With x the
quantised vectors of the fit list and m their means, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2: only squares of one centred
value are summed, one for every dimension and one for every sum of two dimensions. Each task adds them up in blocks; what meets
afterwards is one row per dimension pair and task, and the driver gets one row per dimension pair, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import stored

WHOLE = pa.decimal128(38, 0)
BLOCK = 1024


@dataclass(frozen=True)
class Whitening:
    """A fitted transform in plain numbers. ``mean`` of dimension d is ``(n * anchors[d] + rests[d]) / n``."""

    n: int
    anchors: tuple[int, ...]
    rests: tuple[int, ...]
    components: tuple[tuple[float, ...], ...]
    variances: tuple[float, ...]
    explained: tuple[float | None, ...]
    covariance: tuple[tuple[float, ...], ...]


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * entry) as an array of longs; null for a null vector and for one with a null, NaN or infinite entry."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(whole, F.transform(entries, lambda c: F.floor(c * scale).cast("long")))


def _rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's vectors, all of one length, as a matrix of longs."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _top(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


def _less(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """x - anchors, in Python's integers where a long, or the squares of a block's sums of two, could overflow."""
    if _top(x) < 1 << 60 and _top(anchors) < 1 << 60:
        z = x - anchors
        if (2 * _top(z)) ** 2 * max(len(z), 1) < 1 << 62:
            return z
    return x.astype(object) - anchors.astype(object)


def _partial_sums(dims: int):
    """Per task: the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            x = _rows_of(batch, dims)
            n += len(x)
            total += (x if _top(x) * max(len(x), 1) < 1 << 62 else x.astype(object)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(int(t)) for t in total], WHOLE), pa.array([n] * dims, pa.int64())], ["d", "total", "n"])

    return run


def _partial_squares(anchors: np.ndarray):
    """Per task: for every dimension (d, d) and every pair (d, e) the sum of squares of the centred value or of the centred sum."""
    dims = len(anchors)

    def squares(z: np.ndarray, d: int) -> np.ndarray:
        pair = z[:, d:] + z[:, d : d + 1]
        pair[:, 0] = z[:, d]
        return (pair * pair).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = [np.zeros(dims - d, object) for d in range(dims)], False
        for batch in batches:
            x = _rows_of(batch, dims)
            for at in range(0, len(x), BLOCK):
                seen = True
                z = _less(x[at : at + BLOCK], anchors)
                for d in range(dims):
                    total[d] = total[d] + squares(z, d)
        if seen:
            for d in range(dims):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * (dims - d), pa.int32()), pa.array(range(d, dims), pa.int32()), pa.array([Decimal(int(v)) for v in total[d]], WHOLE)], ["d", "e", "squares"]
                )

    return run


def fit(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """Fit on ``vectors``, one column ``x`` (array of longs of one length); None without rows or dimensions.

    Reads them twice: sums first, then squares of what is left of each entry after taking off the whole part of its mean; the
    fraction left over is put right in exact integers. Components are unit eigenvectors by falling eigenvalue.
    """
    first = vectors.select(F.size("x").alias("dims")).first()
    dims = first["dims"] if first else 0
    if dims < 1:
        return None
    sums = vectors.mapInArrow(_partial_sums(dims), "d int, total decimal(38,0), n bigint").groupBy("d").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).orderBy("d").collect()
    n, totals = int(sums[0]["n"]), [int(r["total"]) for r in sums]
    anchors, rests = [t // n for t in totals], [t % n for t in totals]
    made = vectors.mapInArrow(_partial_squares(np.array(anchors, np.int64)), "d int, e int, squares decimal(38,0)").groupBy("d", "e").agg(F.sum("squares").cast("decimal(38,0)").alias("squares")).collect()
    squares = {(r["d"], r["e"]): int(r["squares"]) for r in made}
    # n * n * n times each variance: of a dimension, or of the sum of two.
    variance = {(d, e): n * n * s - n * (rests[d] if d == e else rests[d] + rests[e]) ** 2 for (d, e), s in squares.items()}
    covariance = np.empty((dims, dims))
    for (d, e), v in variance.items():
        twice = 2 * v if d == e else v - variance[d, d] - variance[e, e]
        covariance[d, e] = covariance[e, d] = twice / (2 * n**3)  # one rounding
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: components or dims]
    trace = sum(variance[d, d] for d in range(dims)) / n**3
    floor = trace * dims * np.finfo(float).eps
    kept = [max(float(values[i]), 0.0) if values[i] > floor else 0.0 for i in order]
    return Whitening(
        n, tuple(anchors), tuple(rests), tuple(tuple(map(float, axes[:, i])) for i in order), tuple(kept),
        tuple(v / trace if trace > 0 else None for v in kept), tuple(tuple(map(float, r)) for r in covariance),
    )


def _projected(z: np.ndarray, n: int, rests: np.ndarray, axes: np.ndarray, variances: np.ndarray) -> np.ndarray:
    centred = z.astype(float) - rests.astype(float) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(variances > 0, centred @ axes / np.sqrt(variances), np.nan)


def _deviations(z: np.ndarray, n: int, rests: np.ndarray) -> list[int]:
    """sum((n * z - rest)^2) per row, exact."""
    if z.dtype != object and (n * (_top(z) + 1)) ** 2 * z.shape[1] < 1 << 62:
        y = z * n - rests
        return (y * y).sum(axis=1).tolist()
    y = z.astype(object) * n - rests.astype(object)
    return (y * y).sum(axis=1).tolist()


def _transform(model: Whitening):
    anchors, rests = np.array(model.anchors, np.int64), np.array(model.rests, np.int64)
    axes, variances, n, dims = np.array(model.components).T, np.array(model.variances), model.n, len(model.anchors)
    most = 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("x")]) if batch.num_rows else np.array([], int)
            ok = lengths == dims
            whitened, deviations = np.full((batch.num_rows, len(variances)), np.nan), np.full(batch.num_rows, None, object)
            if ok.any():
                x = _rows_of(batch.filter(pa.array(ok)), dims)
                z = _less(x, anchors)
                whitened[ok] = _projected(z, n, rests, axes, variances)
                deviations[ok] = [Decimal(d) if d <= most else None for d in _deviations(z, n, rests)]
            flat = whitened.reshape(-1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(variances), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "x"], pa.array(deviations, WHOLE), values], [*[c for c in batch.schema.names if c != "x"], "deviation", "whitened"])

    return run


def vectors_of(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The fit list, stored: each distinct quantised vector (column ``x``) of the commonest length (ties: the longest) once."""
    distinct = stored(df.select(quantised(vector, scale).alias("x")).filter(F.col("x").isNotNull()).distinct(), "whitening")
    common = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return distinct.filter(F.size("x") == (common["dims"] if common else 0))


def whiten(df: DataFrame, model: Whitening | None, *, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per vector: ``id``, deviation (decimal(38,0), the sum of squared ``n * x - S``) and whitened (array of doubles).

    Null vectors and vectors with a null, NaN or infinite entry are dropped, from the fit as well; copies weigh nothing there. Vectors
    of another length than the fitted one are kept with null results. A component without variance has null whitened values.
    Deviations beyond 38 digits are null. Rows that share an id, or have none, each get a row; an empty table gives no rows; other
    columns are not read.
    """
    rows = df.select(F.col(f"`{id}`").alias("row_id"), quantised(vector, scale).alias("x")).filter(F.col("x").isNotNull())
    if model is None:
        made = rows.select("row_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    else:
        made = rows.mapInArrow(_transform(model), f"row_id {rows.schema['row_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    return made.withColumnRenamed("row_id", id)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity), over the components that have variance.

    It is measured on the whitened values themselves, centred on their own means before they are multiplied.
    """
    kept = [i for i, v in enumerate(model.variances) if v > 0]
    if not kept:
        return None
    values = vectors.mapInArrow(_transform(model), "deviation decimal(38,0), whitened array<double>")
    pairs = [(a, b) for a in kept for b in kept if a <= b]
    found = values.agg(*[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c_{a}_{b}"] - (a == b)) for a, b in pairs)
